"""Chunks with halos as the unit of work: a voxel goes to its own chunk and to those whose widened box holds it, once each.

A group is one chunk with its halo, so its size is bounded by the chunk's, and a voxel away from the borders is shuffled once whatever
the reach of the operation is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["z", "y", "x"]
TARGET = ["tz", "ty", "tx"]
Three = tuple[int, int, int]


def with_halo(voxels: DataFrame, size: Three, halo: Three) -> DataFrame:
    """Rows of voxels with tz, ty, tx: once for each chunk of the size that has the voxel in its box widened by the halo."""
    out = voxels
    for c, t, s, h in zip(CELL, TARGET, size, halo, strict=True):
        reach = F.sequence(F.floor((F.col(c) - h) / s).cast("int"), F.floor((F.col(c) + h) / s).cast("int"))
        out = out.select("*", F.explode(reach).alias(t))
    return out


def context_gaps(targets: DataFrame, present: DataFrame, size: Three, halo: Three, shape: Three) -> DataFrame:
    """targets (tz, ty, tx) with needed, missing and reason.

    needed counts the chunks inside the volume's shape that the widened box of a target meets; missing those that present (tz, ty, tx)
    lacks. reason is null for a target with a complete context, "outside" for one beyond the volume and "incomplete" else: nothing
    is padded for such a target.
    """
    need = targets.select(*TARGET).distinct()
    last = [-(-n // s) - 1 for n, s in zip(shape, size, strict=True)]
    inside = F.lit(True)
    for t, top in zip(TARGET, last, strict=True):
        inside = inside & F.col(t).between(0, top)
    near = need.where(inside)
    for t, s, h, top in zip(TARGET, size, halo, last, strict=True):
        low, high = F.floor((F.col(t) * s - h) / s), F.floor((F.col(t) * s + s - 1 + h) / s)
        near = near.select("*", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(top)).cast("int"))).alias(f"n{t}"))
    there = present.select(*[F.col(t).alias(f"n{t}") for t in TARGET], F.lit(1).alias("there")).distinct()
    counts = near.join(there, [f"n{t}" for t in TARGET], "left").groupBy(*TARGET).agg(F.count("*").alias("needed"), F.count_if(F.col("there").isNull()).alias("missing"))
    out = need.join(counts, TARGET, "left")
    reason = F.when(F.col("needed").isNull(), "outside").when(F.col("missing") > 0, "incomplete")
    return out.select(*TARGET, F.coalesce("needed", F.lit(0)).alias("needed"), F.coalesce("missing", F.lit(0)).alias("missing"), reason.alias("reason"))


class Block:
    """One chunk with its halo: arrays of the columns (not-a-number where no voxel is known) and the place of its first cell."""

    def __init__(self, keys: dict, arrays: dict[str, np.ndarray], origin: tuple[int, ...], halo: Three):
        self.keys, self.arrays, self.origin, self.halo = keys, arrays, origin, halo
        self.core = tuple(slice(h, n - h) for h, n in zip(halo, next(iter(arrays.values())).shape, strict=True))

    def rows(self, mask: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
        """Columns z, y, x and values of the cells of the core that the mask (of the core) names."""
        at = np.nonzero(mask)
        place = {c: (p + o + h).astype(np.int32) for c, p, o, h in zip(CELL, at, self.origin, self.halo, strict=True)}
        return {**place, **{name: v[at] for name, v in values.items()}}


def over_chunks(voxels: DataFrame, columns: list[str], size: Three, halo: Three, work: Callable[[Block], dict[str, np.ndarray] | None], schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that work returns for each chunk (of each group of by) from the arrays of its widened box.

    voxels has by, z, y, x and the numeric columns; of repeated voxels one known value counts for each column, null is unknown. work returns columns of equal
    length, without by, which is added; or nothing.
    """
    kind = voxels.select(*by).schema
    names = [f.split()[0] for f in schema.split(",")]
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), schema])
    shape = tuple(s + 2 * h for s, h in zip(size, halo, strict=True))

    def run(table: pa.Table) -> pa.Table:
        key = [table.column(c)[0].as_py() for c in TARGET]
        origin = tuple(k * s - h for k, s, h in zip(key, size, halo, strict=True))
        at = tuple(table.column(c).to_numpy() - o for c, o in zip(CELL, origin, strict=True))
        arrays = {}
        for c in columns:
            arrays[c] = np.full(shape, np.nan)
            values = table.column(c).cast(pa.float64()).to_numpy()
            known = np.isfinite(values)
            arrays[c][tuple(a[known] for a in at)] = values[known]
        got = work(Block({b: table.column(b)[0].as_py() for b in by}, arrays, origin, halo)) or {n: np.zeros(0) for n in names}
        own = {b: pa.array([table.column(b)[0].as_py()] * len(got[names[0]]), table.schema.field(b).type) for b in by}
        return pa.table({**own, **{n: pa.array(got[n]) for n in names}}).cast(wanted)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(full))
    placed = with_halo(voxels.select(*by, *CELL, *columns), size, halo)
    return placed.groupBy(*by, *TARGET).applyInArrow(run, full)


def box_sums(values: np.ndarray) -> np.ndarray:
    """Sums over all boxes that begin at the first cell: one longer along each axis."""
    out = np.zeros([n + 1 for n in values.shape], np.int64)
    out[1:, 1:, 1:] = values.cumsum(0).cumsum(1).cumsum(2)
    return out


def eligible_cubes(occupied: DataFrame, shape: Three, cube: Three, halo: Three, scale: Three, cubes_a_block: int = 8) -> DataFrame:
    """z, y, x: first voxels of the cubes whose widened box lies in the volume and has only occupied cells of a coarse level.

    occupied has the occupied coarse cells z, y, x; a cell is scale voxels wide. Cubes stand at multiples of their size. A block of
    cubes_a_block cubes along each axis gets the coarse cells that its contexts meet and answers all its cubes from one table of box sums.
    """
    reach = occupied.select(*CELL).distinct()
    for c, t, s, h, n in zip(CELL, TARGET, scale, halo, cube, strict=True):
        low = F.floor((F.col(c) * s - h - n) / n) + 1
        high = F.ceil(((F.col(c) + 1) * s + h) / n) - 1
        reach = reach.select("*", F.explode(F.sequence(F.floor(low / cubes_a_block).cast("int"), F.floor(high / cubes_a_block).cast("int"))).alias(t))

    def run(table: pa.Table) -> pa.Table:
        key = [table.column(t)[0].as_py() for t in TARGET]
        first = [k * cubes_a_block for k in key]
        low = [math.floor((i * n - h) / s) for i, n, h, s in zip(first, cube, halo, scale, strict=True)]
        high = [math.ceil(((i + cubes_a_block) * n + h) / s) for i, n, h, s in zip(first, cube, halo, scale, strict=True)]
        there = np.zeros([b - a for a, b in zip(low, high, strict=True)], np.int64)
        there[tuple(table.column(c).to_numpy() - a for c, a in zip(CELL, low, strict=True))] = 1
        sums = box_sums(there)
        origins, begins, ends, fits = [], [], [], []
        for axis in range(3):
            o = (first[axis] + np.arange(cubes_a_block)) * cube[axis]
            a, b = o - halo[axis], o + cube[axis] + halo[axis]
            origins.append(o)
            begins.append(a // scale[axis] - low[axis])
            ends.append(-(-b // scale[axis]) - low[axis])
            fits.append((a >= 0) & (b <= shape[axis]))
        total = sum((-1) ** (3 - sum(corner)) * sums[np.ix_(*[(ends if end else begins)[axis] for axis, end in enumerate(corner)])] for corner in np.ndindex(2, 2, 2))
        wide = (ends[0] - begins[0])[:, None, None] * (ends[1] - begins[1])[None, :, None] * (ends[2] - begins[2])[None, None, :]
        at = np.nonzero((total == wide) & np.logical_and.outer(np.logical_and.outer(fits[0], fits[1]), fits[2]))
        return pa.table({c: pa.array(o[p].astype(np.int32)) for c, o, p in zip(CELL, origins, at, strict=True)})

    return reach.groupBy(*TARGET).applyInArrow(run, "z int, y int, x int")


def occupancy(mask: DataFrame, scale: Three) -> DataFrame:
    """Coarse cells z, y, x that hold a voxel of the mask."""
    return mask.select(*[F.floor(F.col(c) / s).cast("int").alias(c) for c, s in zip(CELL, scale, strict=True)]).distinct()


def chunk_of(size: Three) -> list[Column]:
    return [F.floor(F.col(c) / s).cast("int").alias(t) for c, t, s in zip(CELL, TARGET, size, strict=True)]

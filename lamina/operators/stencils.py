"""Morphology and resampling of voxel tables, in chunks with halos where a neighbourhood is wide; outside the table is background."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.chunks import Block, over_chunks
from lamina.operators.graph import CHUNK, offsets
from lamina.sources.shared import materialise, partitions

CELL = ["z", "y", "x"]


def _moves(steps: list[tuple[int, int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(o, "zyx", strict=True)]) for o in steps])).alias("o")


def shifted(df: DataFrame, steps: list[tuple[int, int, int]], *columns: str) -> DataFrame:
    """Each row once for each offset, moved by it."""
    return df.select(*CELL, *columns, _moves(steps)).select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in CELL], *columns)


def moved(block: np.ndarray, step: tuple[int, int, int], fill: float | bool) -> np.ndarray:
    """A block of voxels moved by a step; what comes in from outside is fill."""
    out = np.full_like(block, fill)
    to = tuple(slice(max(0, d), n + min(0, d)) for d, n in zip(step, block.shape, strict=True))
    out[to] = block[tuple(slice(max(0, -d), n + min(0, -d)) for d, n in zip(step, block.shape, strict=True))]
    return out


def dilate(mask: DataFrame, connectivity: int, n: int = 1, within: DataFrame | None = None) -> DataFrame:
    """The mask grown n times; within, if given, is what it may grow through. All steps are taken in chunks with a halo of n."""
    steps, bounded = offsets(connectivity), within is not None
    flags = mask.select(*CELL, F.lit(1.0).alias("mask"), F.lit(None).cast("double").alias("open"))
    if bounded:
        flags = flags.unionByName(within.select(*CELL, F.lit(None).cast("double").alias("mask"), F.lit(1.0).alias("open")))

    def work(block: Block) -> dict[str, np.ndarray]:
        own, may = np.isfinite(block.arrays["mask"]), np.isfinite(block.arrays["open"])
        out = own
        for _ in range(n):
            grown = np.logical_or.reduce([out, *(moved(out, s, False) for s in steps)])
            out = grown & may | own if bounded else grown
        return block.rows(out[block.core])

    return over_chunks(flags, ["mask", "open"], CHUNK, (0 if connectivity in (4, 8) else n, n, n), work, "z int, y int, x int")


def beside(mask: DataFrame, connectivity: int) -> DataFrame:
    """The voxels that have a neighbour in the mask, each once."""
    steps = offsets(connectivity)

    def work(block: Block) -> dict[str, np.ndarray]:
        own = np.isfinite(block.arrays["mask"])
        return block.rows(np.logical_or.reduce([moved(own, s, False) for s in steps])[block.core])

    return over_chunks(mask.select(*CELL, F.lit(1.0).alias("mask")), ["mask"], CHUNK, (0 if connectivity in (4, 8) else 1, 1, 1), work, "z int, y int, x int")


def erode(mask: DataFrame, connectivity: int, n: int = 1) -> DataFrame:
    """The voxels of the mask whose neighbours are all in it, n times."""
    steps = offsets(connectivity)

    def work(block: Block) -> dict[str, np.ndarray]:
        out = np.isfinite(block.arrays["mask"])
        for _ in range(n):
            out = np.logical_and.reduce([out, *(moved(out, s, False) for s in steps)])
        return block.rows(out[block.core])

    return over_chunks(mask.select(*CELL, F.lit(1.0).alias("mask")), ["mask"], CHUNK, (0 if connectivity in (4, 8) else n, n, n), work, "z int, y int, x int")


def cross(steps: int) -> list[tuple[int, int, int]]:
    """Offsets of at most so many steps along the axes."""
    r = range(-steps, steps + 1)
    return [(z, y, x) for z in r for y in r for x in r if abs(z) + abs(y) + abs(x) <= steps]


def max_filter(field: DataFrame, value: str, connectivity: int) -> DataFrame:
    """Largest value of the neighbourhood at each known voxel."""
    spread = shifted(field, [(0, 0, 0), *offsets(connectivity)], value).groupBy(*CELL).agg(F.max(value).alias("filtered"))
    return field.select(*CELL).join(spread, CELL)


def l1_depth(mask: DataFrame, cap: int = 17, connectivity: int = 6) -> DataFrame:
    """Number of erosions that a voxel survives plus one, at most cap; 4 neighbours stay in a plane."""
    out = left = materialise(mask.select(*CELL).distinct().withColumn("depth", F.lit(1)), "depth1")
    for depth in range(2, cap + 1):
        left = materialise(erode(left, connectivity).withColumn("depth", F.lit(depth)), f"depth{depth}")
        if not left.take(1):
            break
        out = out.unionByName(left)
    return out.groupBy(*CELL).agg(F.max("depth").alias("depth"))


def ball(radius: float) -> list[tuple[int, int, int]]:
    r = math.floor(radius)
    return [(z, y, x) for z in range(-r, r + 1) for y in range(-r, r + 1) for x in range(-r, r + 1) if z * z + y * y + x * x <= radius * radius]


def capped_distance(source: DataFrame, target: DataFrame, tolerance: float) -> DataFrame:
    """Distance of each source voxel to the nearest target voxel; null beyond the tolerance."""
    r = math.floor(tolerance)
    steps = sorted((sum(v * v for v in o), o) for o in ball(tolerance))
    flags = source.select(*CELL, F.lit(1.0).alias("source"), F.lit(None).cast("double").alias("target")).unionByName(target.select(*CELL, F.lit(None).cast("double").alias("source"), F.lit(1.0).alias("target")))

    def work(block: Block) -> dict[str, np.ndarray]:
        asked, there = np.isfinite(block.arrays["source"])[block.core], np.isfinite(block.arrays["target"])
        square = np.full(asked.shape, np.nan)
        left = asked.copy()
        for d2, step in steps:
            near = left & there[tuple(slice(r + o, r + o + n) for o, n in zip(step, asked.shape, strict=True))]
            square[near] = d2
            left &= ~near
        return block.rows(asked, d2=square)

    near = over_chunks(flags, ["source", "target"], CHUNK, (r, r, r), work, "z int, y int, x int, d2 double")
    return near.select(*CELL, F.round(F.sqrt(F.nanvl("d2", F.lit(None))), 6).alias("distance"))


def gaussian(field: DataFrame, value: str, sigma: float) -> DataFrame:
    """Separable smoothing, normalised over the known voxels in reach; one weighted pass per axis."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]

    def work(block: Block) -> dict[str, np.ndarray]:
        out = block.arrays[value]
        for axis in range(3):
            n = out.shape[axis] - 2 * radius
            known = np.isfinite(out)
            filled = np.where(known, out, 0.0)
            parts = [tuple(slice(k, k + n) if a == axis else slice(None) for a in range(3)) for k in range(2 * radius + 1)]
            total = sum(w * filled[p] for w, p in zip(weights, parts, strict=True))
            mass = sum(w * known[p] for w, p in zip(weights, parts, strict=True))
            out = np.where(known[parts[radius]], total / np.where(mass > 0, mass, 1.0), np.nan)
        return block.rows(np.isfinite(out), v=out)

    out = over_chunks(field.select(*CELL, F.col(value).cast("double").alias(value)), [value], CHUNK, (radius,) * 3, work, "z int, y int, x int, v double")
    return out.select(*CELL, F.round("v", 6).alias("smoothed"))


def pyramid(voxels: DataFrame, value: str, levels: int) -> DataFrame:
    """Nearest downsampling by 2**level: level, z, y, x, value."""
    out = None
    for k in range(levels):
        keep = F.lit(True)
        for c in CELL:
            keep = keep & (F.col(c) % (1 << k) == 0)
        level = voxels.where(keep).select(F.lit(k).alias("level"), *[F.shiftright(c, k).alias(c) for c in CELL], value)
        out = level if out is None else out.unionByName(level)
    return out


def mirror_average(predictions: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Mean over mirrored predictions: bit i of flip says that axis i was reversed. Views of a voxel are dealt out before they are summed: hardly two of them come from one task."""
    back = [F.when(F.col("flip").bitwiseAND(1 << i) > 0, size[i] - 1 - F.col(c)).otherwise(F.col(c)).alias(c) for i, c in enumerate(CELL)]
    return predictions.select(*back, "p").repartition(partitions(predictions.sparkSession, math.prod(size)), *CELL).groupBy(*CELL).agg(F.round(F.avg("p"), 6).alias("p"), F.count("*").alias("views"))


def blend(predictions: DataFrame, window: int) -> DataFrame:
    """Overlapping window predictions (oz, oy, ox, z, y, x, p) weighted by a Gaussian around each window's centre."""
    centre, sigma = (window - 1) / 2, window / 8
    d2 = sum(((F.col(c) - F.col(f"o{c}") - centre) / sigma) ** 2 for c in CELL)
    w = F.greatest(F.exp(-d2 / 2), F.lit(1e-4))
    return predictions.withColumn("w", w).groupBy(*CELL).agg(F.round(F.sum(F.col("p") * F.col("w")) / F.sum("w"), 6).alias("p"), F.count("*").alias("windows"))


def explode_chunks(chunks: DataFrame, size: int) -> DataFrame:
    """Voxel rows of chunk payloads (cz, cy, cx, values in row-major order); fill values are null."""
    cells = chunks.select("cz", "cy", "cx", F.posexplode("values").alias("i", "value")).where("value is not null")
    return cells.select((F.col("cz") * size + F.floor(F.col("i") / (size * size))).cast("int").alias("z"), (F.col("cy") * size + F.floor(F.col("i") / size) % size).cast("int").alias("y"), (F.col("cx") * size + F.col("i") % size).cast("int").alias("x"), "value")


def implode_chunks(voxels: DataFrame, value: str, size: int) -> DataFrame:
    """One row per chunk that has voxels: cz, cy, cx, values (null where unknown); of repeated voxels one counts."""
    place = ((F.col("z") % size) * size + F.col("y") % size) * size + F.col("x") % size
    cells = voxels.select(*[F.floor(F.col(c) / size).cast("int").alias(f"c{c}") for c in CELL], place.cast("int").alias("i"), F.col(value).alias("value"))
    kind = cells.schema["value"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        values = table.column("value").combine_chunks()
        at = np.full(size**3, -1, np.int64)
        at[table.column("i").to_numpy()] = np.arange(len(values))
        row = values.take(pa.array(at, mask=at < 0))
        keys = {c: table.column(c).slice(0, 1) for c in ("cz", "cy", "cx")}
        return pa.table({**keys, "values": pa.ListArray.from_arrays(pa.array([0, size**3], pa.int32()), row)})

    return cells.groupBy("cz", "cy", "cx").applyInArrow(pack, f"cz int, cy int, cx int, values array<{kind}>")

"""Surfaces given by parameter grids: made dense, drawn into labels; disks drawn from centres and radii."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.chunks import Block, Three, over_chunks

CELL = ["z", "y", "x"]


def _quads(nodes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, row, col and the corners c00, c01, c10, c11 (structs z, y, x) of each parameter cell whose four nodes are valid.

    At the last row or column of a surface the cell has no extent: its far nodes are the near ones again.
    """
    ends = nodes.groupBy(*by).agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    place = F.struct(*[F.col(c).cast("double").alias(c) for c in CELL])
    good = F.col("valid") & F.col("z").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    known = nodes.where(good).groupBy(*by, "row", "col").agg(F.min(place).alias("at")).join(ends, list(by))
    roles = []
    for i in (0, 1):
        for j in (0, 1):
            r, c = F.col("row") - i, F.col("col") - j
            # The far corner of the cell before, or of the own cell where nothing follows.
            roles.append(F.struct(r.alias("row"), c.alias("col"), F.lit(f"c{i}{j}").alias("role")))
            if i:
                roles.append(F.when(F.col("row") == F.col("last_row"), F.struct(F.col("row").alias("row"), c.alias("col"), F.lit(f"c{i}{j}").alias("role"))))
            if j:
                roles.append(F.when(F.col("col") == F.col("last_col"), F.struct(r.alias("row"), F.col("col").alias("col"), F.lit(f"c{i}{j}").alias("role"))))
            if i and j:
                roles.append(F.when((F.col("row") == F.col("last_row")) & (F.col("col") == F.col("last_col")), F.struct("row", "col", F.lit(f"c{i}{j}").alias("role"))))
    parts = known.select(*by, "at", "last_row", "last_col", F.explode(F.array(*roles)).alias("o")).where("o is not null and o.row >= 0 and o.col >= 0")
    corners = [F.max(F.when(F.col("role") == f"c{i}{j}", F.col("at"))).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)]
    cells = parts.select(*by, "at", "last_row", "last_col", "o.*").groupBy(*by, "row", "col", "last_row", "last_col").agg(*corners)
    return cells.where("c00 is not null and c01 is not null and c10 is not null and c11 is not null")


def _apart(a: str, b: str) -> Column:
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in CELL]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def grid_spacing(nodes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by and spacing: the median distance of neighbouring valid nodes of each surface along rows and columns."""
    place = F.struct(*[F.col(c).cast("double").alias(c) for c in CELL])
    known = nodes.where("valid and z is not null and y is not null and x is not null").groupBy(*by, "row", "col").agg(F.min(place).alias("at"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("along"), F.lit(e).alias("end"), (F.col("row") - (e if k == 0 else 0)).alias("row"), (F.col("col") - (e if k == 1 else 0)).alias("col")) for k in (0, 1) for e in (0, 1)]))
    both = known.select(*by, "at", steps.alias("o")).select(*by, "at", "o.*").groupBy(*by, "along", "row", "col").agg(F.max(F.when(F.col("end") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("at"))).alias("b"))
    return both.where("a is not null and b is not null").groupBy(*by).agg(F.percentile(_apart("a", "b"), 0.5).alias("spacing"))


def densify(nodes: DataFrame, by: tuple[str, ...], spacing: float = 0.6) -> DataFrame:
    """by, z, y, x: points of each surface between its nodes, so dense that neighbours are at most spacing apart in the median cell.

    nodes has by, row, col (from 0), z, y, x and valid. Points are bilinear in their parameter cell; a cell without four valid nodes
    gives none, and a surface without two neighbouring valid nodes neither.
    """
    fine = grid_spacing(nodes, by).select(*by, F.greatest(F.ceil(F.col("spacing") / spacing), F.lit(1)).cast("int").alias("n"))
    cells = _quads(nodes, by).join(fine, list(by))
    steps = lambda at, last: F.explode(F.sequence(F.lit(0), F.when(F.col(at) == F.col(last), 0).otherwise(F.col("n") - 1)))
    spread = cells.select("*", steps("row", "last_row").alias("i")).select("*", steps("col", "last_col").alias("j"))
    u, v = F.col("i") / F.col("n"), F.col("j") / F.col("n")
    point = {}
    for c in CELL:
        near = F.col(f"c00.{c}") * (1 - v) + F.col(f"c01.{c}") * v
        far = F.col(f"c10.{c}") * (1 - v) + F.col(f"c11.{c}") * v
        point[c] = near * (1 - u) + far * u
    return spread.select(*by, *[p.alias(c) for c, p in point.items()])


def rasterize(points: DataFrame, surface: float, background: float, veto: DataFrame | None = None, size: Three = (32, 32, 32)) -> DataFrame:
    """z, y, x, label: 1 within the surface radius of a point's voxel, 0 up to the background radius. All other voxels are unknown.

    Points go to their nearest voxels, halves to the even one. Background voxels of veto (z, y, x) are unknown too.
    """
    r = math.floor(background)
    ball = sorted((a * a + b * b + c * c, (a, b, c)) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= background * background)
    seeds = points.dropna(subset=CELL).select(*[F.rint(c).cast("int").alias(c) for c in CELL]).distinct().withColumn("one", F.lit(1.0))

    def work(block: Block) -> dict[str, np.ndarray]:
        there = np.isfinite(block.arrays["one"])
        label = np.full(there[block.core].shape, 2, np.int32)
        for d2, step in ball:
            near = there[tuple(slice(r + o, r + o + n) for o, n in zip(step, label.shape, strict=True))] & (label == 2)
            label[near] = 1 if d2 <= surface * surface else 0
        return block.rows(label < 2, label=label)

    out = over_chunks(seeds, ["one"], size, (r, r, r), work, "z int, y int, x int, label int")
    if veto is None:
        return out
    return out.where("label = 1").unionByName(out.where("label = 0").join(veto.select(*CELL).distinct(), CELL, "left_anti"))


def _inward(radius: Column) -> Column:
    """The next smaller single-precision number: an open disk then never holds the voxel that its radius was measured to."""
    r = radius.cast("float").cast("double")
    power = F.pow(F.lit(2.0), F.floor(F.log2(r)))
    return r - power * F.when(r == power, 2.0**-24).otherwise(2.0**-23)


def _disk(centres: DataFrame, extent: Column, sampling: tuple[float, float]) -> DataFrame:
    """Each centre once for each pixel (py, px) of its plane within the extent, with the distance to it."""
    sy, sx = sampling
    out = centres.withColumn("extent", extent)
    for axis, s in (("y", sy), ("x", sx)):
        n = F.ceil(F.col("extent") / s).cast("int")
        out = out.select("*", F.explode(F.sequence(-n, n)).alias(f"d{axis}"))
    square = (F.col("dy") * sy) * (F.col("dy") * sy) + (F.col("dx") * sx) * (F.col("dx") * sx)
    return out.select("*", (F.col("y") + F.col("dy")).alias("py"), (F.col("x") + F.col("dx")).alias("px"), square.alias("d2"))


def reconstruct_disks(centres: DataFrame, shape: tuple[int, int], sampling: tuple[float, float] = (1.0, 1.0), margin: float = 0.0) -> DataFrame:
    """z, y, x of the union of the open disks of all centres (z, y, x, radius) within planes of the shape (height, width).

    With a margin the radius is that much larger; without one it is held just below its stored value. Radii of 0 draw nothing.
    """
    r = F.col("radius") + margin if margin else F.when(F.col("radius") > 0, _inward(F.col("radius"))).otherwise(0.0)
    drawn = _disk(centres.select("z", "y", "x", r.alias("r")).where("r > 0"), F.col("r"), sampling).where("d2 < r * r")
    inside = (F.col("py").between(0, shape[0] - 1)) & (F.col("px").between(0, shape[1] - 1))
    return drawn.where(inside).select("z", F.col("py").alias("y"), F.col("px").alias("x")).distinct()


def radius_envelope(centres: DataFrame, shape: tuple[int, int], least: float, sampling: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """z, y, x, envelope, radius for each pixel whose envelope is at least least: the greatest radius - distance over the plane's centres.

    radius is that of the winning centre, the first by (y, x) of equals. A centre is looked at only up to radius - least away.
    """
    seen = _disk(centres.select("z", "y", "x", F.col("radius").cast("double").alias("r")), F.greatest(F.col("r") - least, F.lit(0.0)), sampling)
    seen = seen.withColumn("value", F.col("r") - F.sqrt("d2")).where((F.col("value") >= least) & F.col("py").between(0, shape[0] - 1) & F.col("px").between(0, shape[1] - 1))
    best = F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"), "r"))
    return seen.groupBy("z", "py", "px").agg(best.alias("b")).select("z", F.col("py").alias("y"), F.col("px").alias("x"), F.col("b.value").alias("envelope"), F.col("b.r").alias("radius"))

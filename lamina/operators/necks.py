"""Thin necks that join two bodies of a mask within a plane, and how many near planes show them too."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.chunks import Block, over_chunks
from lamina.operators.graph import CHUNK, offsets, voxel_components
from lamina.operators.stencils import CELL, moved, shifted
from lamina.sources.shared import large, materialise

# Half-width of a neck at most, of the bodies at its ends at least, and its length at most, in pixels.
NARROW, OPEN, LONGEST = 1.9, 2.4, 12
# A neck is certified if its ends differ so much in distance from the centre and it runs so much along the radius.
RADIAL_STEP, RADIAL_DOT = 2.0, 0.6
# Planes and pixels within which a neck counts as the same one, and planes that have to show it.
NEAR_PLANES, NEAR_PIXELS, SUPPORT = 6, 5, 3


def local_width(mask: DataFrame, reach: int = 4) -> DataFrame:
    """z, y, x, width: half the width of the mask around each of its voxels in its plane, at most reach.

    The half-width of a voxel is its distance to the nearest one that isn't in the mask; the width around a voxel is the largest half-width
    of those whose open disk holds it. Outside the mask's table is background.
    """
    r = range(-reach, reach + 1)
    disk = sorted((math.hypot(a, b), (0, a, b)) for a in r for b in r if 0 < a * a + b * b <= reach * reach)

    def work(block: Block) -> dict[str, np.ndarray]:
        there = np.isfinite(block.arrays["one"])
        half = np.where(there, float(reach), 0.0)
        for d, step in reversed(disk):
            half[there & moved(~there, step, False)] = d
        out = half.copy()
        for d, step in disk:
            other = moved(half, step, 0.0)
            out = np.where(there & (d < other), np.maximum(out, other), out)
        return block.rows(there[block.core], width=out[block.core])

    return over_chunks(mask.select(*CELL, F.lit(1.0).alias("one")), ["one"], CHUNK, (0, 2 * reach, 2 * reach), work, "z int, y int, x int, width double")


def find_necks(mask: DataFrame, centre: tuple[float, float] | None = None, narrow: float = NARROW, opening: float = OPEN, longest: int = LONGEST) -> DataFrame:
    """z, ay, ax, by, bx, my, mx, length, width, bodies, dr, radial_dot, certified for each neck of a mask.

    A neck is an 8-connected set of voxels of a plane around which the mask is at most narrow, beside two or more bodies (sets of the wider
    voxels) that are at least opening wide somewhere. Its ends are the first voxels beside it of the bodies of the smallest and the largest
    number, its length counts the steps between them (diagonal ones too) less one; longer necks are left out. Without a centre (y, x) none is certified and
    dr and radial_dot are null.
    """
    wide = materialise(local_width(mask), "width")
    thin = materialise(voxel_components(wide.where(F.col("width") <= narrow), 8).withColumnRenamed("component", "neck").join(large(wide), CELL), "thin")
    thick = voxel_components(wide.where(F.col("width") > narrow), 8).withColumnRenamed("component", "body").join(large(wide), CELL)
    bodies = materialise(thick, "bodies")
    opened = bodies.groupBy("body").agg(F.max("width").alias("w")).where(F.col("w") >= opening).select("body")
    opens = bodies.join(large(opened), "body", "left_semi").withColumn("at", F.struct("y", "x"))
    contact = shifted(opens, offsets(8), "body", "at").join(large(thin), CELL).groupBy("neck", "z", "body").agg(F.min("at").alias("at"))
    facts = contact.groupBy("neck", "z").agg(F.count("*").alias("bodies"), F.min_by("at", "body").alias("a"), F.max_by("at", "body").alias("b")).where("bodies > 1")
    sizes = thin.groupBy("neck").agg(F.max("width").alias("width"))
    rows = facts.join(large(sizes), "neck").select("z", *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "yx"], "width", "bodies")
    dy, dx = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    rows = rows.withColumns({"length": F.greatest(F.abs(dy), F.abs(dx)) - 1, "my": F.floor((F.col("ay") + F.col("by")) / 2).cast("int"), "mx": F.floor((F.col("ax") + F.col("bx")) / 2).cast("int")}).where(F.col("length") <= longest)
    if centre is None:
        return rows.withColumns({"dr": F.lit(None).cast("double"), "radial_dot": F.lit(None).cast("double"), "certified": F.lit(False)})

    def radius(y: Column, x: Column) -> Column:
        return F.sqrt((y - centre[0]) * (y - centre[0]) + (x - centre[1]) * (x - centre[1]))

    size, middle = F.sqrt(dy * dy + dx * dx), radius(F.col("my"), F.col("mx"))
    dot = F.when((size > 0) & (middle > 0), F.abs(dy * (F.col("my") - centre[0]) + dx * (F.col("mx") - centre[1])) / (size * middle)).otherwise(0.0)
    step = F.abs(radius(F.col("ay"), F.col("ax")) - radius(F.col("by"), F.col("bx")))
    return rows.withColumns({"dr": step, "radial_dot": dot}).withColumn("certified", (F.col("dr") >= RADIAL_STEP) & (F.col("radial_dot") >= RADIAL_DOT))


def neck_support(necks: DataFrame, planes: int = NEAR_PLANES, pixels: int = NEAR_PIXELS, least: int = SUPPORT) -> DataFrame:
    """necks with support, the number of planes at most so far away that have a neck with its middle within so many pixels, and persistent.

    The own plane counts. persistent is set for certified necks with enough support. Necks meet through cells of the pixels' size.
    """
    rows = necks.withColumn("neck", F.struct("z", "my", "mx", "ay", "ax", "by", "bx"))
    cell = [F.floor(F.col(c) / pixels) for c in ("my", "mx")]
    around = rows.select("neck", "my", "mx", "z", F.explode(F.sequence(F.col("z") - planes, F.col("z") + planes)).alias("oz"))
    for c, name in zip(cell, ("cy", "cx"), strict=True):
        around = around.select("*", F.explode(F.sequence(c - 1, c + 1)).alias(name))
    others = rows.select(F.col("z").alias("oz"), F.col("my").alias("py"), F.col("mx").alias("px"), cell[0].alias("cy"), cell[1].alias("cx")).distinct()
    near = around.join(large(others), ["oz", "cy", "cx"]).where((F.col("my") - F.col("py")) * (F.col("my") - F.col("py")) + (F.col("mx") - F.col("px")) * (F.col("mx") - F.col("px")) <= pixels * pixels)
    counts = near.select("neck", "oz").distinct().groupBy("neck").agg(F.count("*").alias("support"))
    return rows.join(large(counts), "neck").drop("neck").withColumn("persistent", F.col("certified") & (F.col("support") >= least))

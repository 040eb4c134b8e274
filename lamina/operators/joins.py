"""Overlays, membership, box and distance joins; near pairs meet through grid cells, never through a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["z", "y", "x"]


def overlay(a: DataFrame, b: DataFrame, how: str = "full") -> DataFrame:
    """Voxels of two masks with flags in_a and in_b."""
    left, right = a.select(*CELL).distinct().withColumn("in_a", F.lit(True)), b.select(*CELL).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, CELL, how).select(*CELL, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def in_support(voxels: DataFrame, support: DataFrame, size: int) -> DataFrame:
    """Voxels whose chunk is in the support: a chunk that is absent is unknown, not empty."""
    chunk = [F.floor(F.col(c) / size).cast("int").alias(f"c{c}") for c in CELL]
    return voxels.withColumns({f"c{c}": chunk[i] for i, c in enumerate(CELL)}).join(support.select("cz", "cy", "cx"), ["cz", "cy", "cx"], "left_semi").drop("cz", "cy", "cx")


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def at_threshold(df: DataFrame, by: list[str], wanted: float, tolerance: float) -> DataFrame:
    """The row of each group whose threshold is nearest to the wanted one, if it is near enough."""
    gap = F.abs(F.col("threshold") - wanted)
    best = df.withColumn("_gap", gap).where(F.col("_gap") <= tolerance).groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct("_gap", "threshold")).alias("_row"))
    return best.select("_row.*")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: int) -> DataFrame:
    """Points (y, x) in half-open boxes (box_id, y0, y1, x0, x1), counted per box; a box is dealt to the cells that it meets."""
    spread = boxes.withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor((F.col("y1") - 1) / cell)))).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell))))
    placed = points.groupBy("y", "x").agg(F.count("*").alias("n")).withColumns({"cy": F.floor(F.col("y") / cell), "cx": F.floor(F.col("x") / cell)})
    inside = placed.join(spread, ["cy", "cx"]).where("y0 <= y and y < y1 and x0 <= x and x < x1")
    return inside.groupBy("box_id").agg(F.sum("n").alias("points"))


def pairs_within(points: DataFrame, reach: int, keep: Column | None = None) -> DataFrame:
    """Pairs a < b of points (id, plane, y, x) in a plane at a distance of at most reach, each found once."""
    cell = {"cy": F.floor(F.col("y") / reach), "cx": F.floor(F.col("x") / reach)}
    left = points.withColumns(cell).select(F.col("id").alias("a"), "plane", F.col("y").alias("ay"), F.col("x").alias("ax"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: d + F.col("cy"))).alias("cy"), "cx")
    left = left.withColumn("cx", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: d + F.col("cx"))))
    right = points.withColumns(cell).select(F.col("id").alias("b"), "plane", F.col("y").alias("by"), F.col("x").alias("bx"), "cy", "cx")
    d2 = (F.col("ay") - F.col("by")) ** 2 + (F.col("ax") - F.col("bx")) ** 2
    near = left.join(right, ["plane", "cy", "cx"]).where("a < b").where(d2 <= reach * reach)
    return near.select("plane", "a", "b", F.round(F.sqrt(d2), 6).alias("distance"))


def nearest(a: DataFrame, b: DataFrame, reach: int, by: list[str] | None = None) -> DataFrame:
    """For each point of a (id, y, x) its nearest point of b within reach and, if given, of the same by; the smaller id on ties."""
    by = by or []
    cell = {"cy": F.floor(F.col("y") / reach), "cx": F.floor(F.col("x") / reach)}
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    left = a.withColumns(cell).select(F.col("id").alias("a"), *by, F.col("y").alias("ay"), F.col("x").alias("ax"), "cy", "cx", around).select("a", *by, "ay", "ax", (F.col("cy") + F.col("o.i")).alias("cy"), (F.col("cx") + F.col("o.j")).alias("cx"))
    right = b.withColumns(cell).select(F.col("id").alias("b"), *by, F.col("y").alias("by"), F.col("x").alias("bx"), "cy", "cx")
    d2 = (F.col("ay") - F.col("by")) ** 2 + (F.col("ax") - F.col("bx")) ** 2
    near = left.join(right, [*by, "cy", "cx"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    return near.groupBy("a").agg(F.min(F.struct("d2", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.round(F.sqrt("m.d2"), 6).alias("distance"))


def component_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of components (of labelled voxels a and b) that share voxels, and how many."""
    shared = a.withColumnRenamed("component", "candidate").join(b.withColumnRenamed("component", "reference"), CELL)
    return shared.groupBy("candidate", "reference").agg(F.count("*").alias("voxels"))


def bridges(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Candidate components that touch two or more reference components of at least so many voxels."""
    large = b.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    touched = component_overlap(a, b.join(large, "component", "left_semi"))
    return touched.groupBy("candidate").agg(F.count("*").alias("references"), F.sum("voxels").alias("voxels")).where("references > 1").withColumn("excess", F.col("references") - 1)

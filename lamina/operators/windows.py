"""Ranking, ordering and island operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number
from lamina.sources.shared import materialise


def pick_best(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """The first row of each group in the order of the keys."""
    w = Window.partitionBy(*by).orderBy(*keys)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def top_k(df: DataFrame, by: list[str], keys: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their place; Spark cuts to k before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("place") <= k)


def ranked(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None, parts: int = 64) -> DataFrame:
    """Adds each row's place, from 0, in its group's order, without one task for a whole group.

    Rows are dealt by ranges of the order; a row's place is its place within its range plus the sizes of the ranges before it. The
    ranges come from a written table, so that both uses see the same.
    """
    keys = [F.col(c) for c in by or []]
    dealt = materialise(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(base, [*(by or []), "_range"]).withColumn(name, F.col("_own") + F.col("_base")).drop("_own", "_base", "_range")


def longest_run(df: DataFrame, by: list[str], index: str, flag: str) -> DataFrame:
    """The longest run of consecutive flagged indices of each group, and where it starts."""
    islands = ranked(df.where(F.col(flag)).select(*by, index), [F.col(index)], "_place", by).withColumn("_island", F.col(index) - F.col("_place"))
    runs = islands.groupBy(*by, "_island").agg(F.count("*").alias("length"), F.min(index).alias("start"))
    return pick_best(runs, by, [F.col("length").desc(), F.col("start")]).drop("_island")


def stratified_order(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """Interleaves strata: position is (rank + 0.25 + 0.5 * jitter) / size of the stratum, ranks by hash."""
    h = hash_number(F.concat_ws(":", F.lit(seed), F.col(key)))
    jitter = hash_number(F.concat_ws(":", F.lit(seed + 1), F.col(key))) / float(1 << 32)
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    placed = ranked(df.withColumn("_hash", h), [F.col("_hash"), F.col(key)], "_rank", [stratum]).join(sizes, stratum)
    return placed.withColumn("position", F.round((F.col("_rank") + 0.25 + 0.5 * jitter) / F.col("_size"), 9)).drop("_rank", "_size", "_hash")


def tercile_strata(df: DataFrame, by: str, value: str) -> DataFrame:
    """low, middle or high by the interpolated terciles of each group."""
    cuts = df.groupBy(by).agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_cut"))
    level = F.when(F.col(value) <= F.col("_cut")[0], "low").when(F.col(value) <= F.col("_cut")[1], "middle").otherwise("high")
    return df.join(cuts, by).withColumn("level", level).drop("_cut")


def holm(df: DataFrame, alpha: float) -> DataFrame:
    """Step-down decisions over p (and id on ties): a test is rejected if it and all smaller ones pass alpha / (n - rank)."""
    facts = df.agg(F.count("*").alias("_n"))
    placed = materialise(ranked(df, [F.col("p"), F.col("id")], "_rank").join(F.broadcast(facts)), "tests")
    failed = placed.where(F.col("p") > alpha / (F.col("_n") - F.col("_rank"))).agg(F.min("_rank").alias("_failed"))
    return placed.join(F.broadcast(failed)).withColumn("rejected", F.coalesce(F.col("_rank") < F.col("_failed"), F.lit(True))).drop("_rank", "_n", "_failed")


def trajectory(df: DataFrame, by: str, step: str, value: str) -> DataFrame:
    """Value, change against the step before, and the best value so far."""
    w = Window.partitionBy(by).orderBy(step)
    return df.withColumns({"delta": F.round(F.col(value) - F.lag(value).over(w), 6), "best": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def interpolate(frontier: DataFrame, at: list[float]) -> DataFrame:
    """y at given x on the polyline of points (x, y); equal x collapse to their largest y, nothing is extrapolated."""
    points = frontier.groupBy("x").agg(F.max("y").alias("y"))
    w = Window.orderBy("x")
    segments = points.select("x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    wanted = segments.withColumn("at", F.explode(F.array(*map(F.lit, at)))).where("x <= at and (at < x1 or (at = x1))")
    value = F.col("y") + (F.col("y1") - F.col("y")) * (F.col("at") - F.col("x")) / (F.col("x1") - F.col("x"))
    return wanted.groupBy("at").agg(F.round(F.max_by(value, "x"), 6).alias("y"))

"""Seeded draws by hash, splits, bootstraps and selection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number
from lamina.sources.shared import large, materialise, partitions


def sample_n(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement, the first in the order of a hash."""
    h = hash_number(F.concat_ws(":", F.lit(seed), F.col(key)))
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(h, key))).where(F.col("_place") <= n).drop("_place")


def audit_sample(df: DataFrame, record: str, key: str, n: int, seed: int) -> DataFrame:
    """One row of each record first, then the others by hash, n in all."""
    h = hash_number(F.concat_ws(":", F.lit(seed), F.col(key)))
    tiers = df.withColumn("_tier", F.when(F.row_number().over(Window.partitionBy(record).orderBy(h, key)) == 1, 0).otherwise(1))
    return tiers.orderBy("_tier", h, key).limit(n).drop("_tier")


def holdout(df: DataFrame, key: str, modulus: int, seed: int) -> DataFrame:
    return df.withColumn("held_out", hash_number(F.concat_ws(":", F.lit(seed), F.col(key))) % modulus == 0)


def bootstrap(counts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Macro Dice of each replicate: the clusters of a scroll are drawn with replacement, as often as there are clusters.

    counts has scroll, cluster, tp, fp, fn: one row per cluster, far fewer than the rows they sum. Draw k of a scroll takes the
    cluster with the number hash(seed, replicate, scroll, k) modulo their count.
    """
    ranked = counts.withColumns({"_i": F.row_number().over(Window.partitionBy("scroll").orderBy("cluster")) - 1, "_n": F.count("*").over(Window.partitionBy("scroll"))})
    ranked = materialise(ranked.drop("cluster"), "clusters")
    # The clusters are dealt out before they are drawn for: a scroll's draws aren't one task's, and no task holds draws to count them.
    parts = partitions(counts.sparkSession, ranked.count() * replicates)
    draws = ranked.select("scroll", F.col("_i").alias("k"), "_n").repartition(parts, "scroll", "k").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.select("scroll", "replicate", (hash_number(F.concat_ws(":", F.lit(seed), "replicate", "scroll", "k")) % F.col("_n")).cast("int").alias("_i"))
    # Both sides meet in that number of partitions too: those of the session would be put together by their bytes.
    draws, ranked = (df.repartition(parts, "scroll", "_i") for df in (draws, ranked))
    sums = draws.join(large(ranked), ["scroll", "_i"]).groupBy("replicate", "scroll").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    dice = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
    return sums.groupBy("replicate").agg(F.avg(dice).alias("macro"))


def interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    q = F.percentile("macro", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return replicates.agg(F.count("*").alias("replicates"), F.round(F.avg("macro"), 6).alias("mean"), q.alias("q")).select("replicates", "mean", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def paired_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Replicate by replicate difference of two bootstraps with the same draws."""
    both = a.select("replicate", F.col("macro").alias("a")).join(b.select("replicate", F.col("macro").alias("b")), "replicate").withColumn("d", F.col("a") - F.col("b"))
    return both.agg(F.round(F.avg("d"), 6).alias("delta"), F.round(F.percentile("d", 0.025), 6).alias("low"), F.round(F.percentile("d", 0.975), 6).alias("high"), F.round(F.avg((F.col("d") <= 0).cast("double")), 6).alias("p_not_better"))


def tie_margin(a: DataFrame, b: DataFrame, key: str, value: str, least: float = 0.005) -> DataFrame:
    """Differences below this margin are ties: twice the root mean square of matched deltas, at least least."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.round(F.greatest(F.lit(least), 2 * F.sqrt(F.avg((F.col("_a") - F.col("_b")) ** 2))), 6).alias("margin"))


def gate_verdict(df: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """passed and the worst normalised excess over the limits: column -> (max or min, limit)."""
    excess = [((F.col(c) - v) if kind == "max" else (v - F.col(c))) / abs(v) for c, (kind, v) in gates.items()]
    worst = F.greatest(*excess) if len(excess) > 1 else excess[0]
    return df.withColumns({"worst": F.round(worst, 6), "passed": worst <= 0})

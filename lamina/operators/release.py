"""Release statistics: optimism of a chosen threshold, paired bootstraps of cases, verdicts on arms, operating points, candidate gates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number
from lamina.operators.windows import ranked


def _dice() -> Column:
    return 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))


def _draws(numbered: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """by, replicate, _i, w: how often each of _n numbered units is drawn with replacement in _n draws a replicate."""
    rows = numbered.select(*by, F.col("_i").alias("_k"), "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    pick = hash_number(F.concat_ws(":", F.lit(seed), "replicate", *by, "_k")) % F.col("_n")
    return rows.select(*by, "replicate", pick.cast("long").alias("_i")).groupBy(*by, "replicate", "_i").agg(F.count("*").alias("w"))


def optimism(counts: DataFrame, fixed: float, replicates: int, seed: int) -> DataFrame:
    """What choosing the best threshold in each replicate gains over the fixed one, on average: replicates, reselected, fixed, optimism.

    counts has scroll, cluster, threshold, tp, fp, fn; all thresholds of a replicate share its draws of clusters within each scroll.
    """
    units = counts.select("scroll", "cluster").distinct()
    numbered = units.withColumns({"_i": F.row_number().over(Window.partitionBy("scroll").orderBy("cluster")) - 1, "_n": F.count("*").over(Window.partitionBy("scroll"))})
    weights = _draws(numbered, ["scroll"], replicates, seed).join(numbered.select("scroll", "_i", "cluster"), ["scroll", "_i"])
    sums = weights.join(counts, ["scroll", "cluster"]).groupBy("replicate", "threshold", "scroll").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    macro = sums.groupBy("replicate", "threshold").agg(F.avg(_dice()).alias("macro"))
    chosen = macro.groupBy("replicate").agg(F.max("macro").alias("best"), F.max(F.when(F.abs(F.col("threshold") - fixed) < 1e-9, F.col("macro"))).alias("at"))
    return chosen.agg(F.count("*").alias("replicates"), F.avg("best").alias("reselected"), F.avg("at").alias("fixed"), F.avg(F.col("best") - F.col("at")).alias("optimism"))


def bootstrap_cases(a: DataFrame, b: DataFrame, clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Paired differences a - b of the mean of each metric over cases, with an interval from draws of clusters.

    a and b have case, metric, value; clusters has case, cluster. A pair in which a value is null or NaN is dropped; so are replicates
    that draw no pair, and metrics with fewer than two replicates. metric, cases, candidate, reference, delta, low, high, replicates,
    p_not_better. Pairs are summed by cluster first, so draws meet one row a cluster and metric.
    """
    known = [d.where(F.col("value").isNotNull() & ~F.isnan("value")) for d in (a, b)]
    pairs = known[0].select("case", "metric", F.col("value").alias("_a")).join(known[1].select("case", "metric", F.col("value").alias("_b")), ["case", "metric"]).join(clusters, "case")
    sums = pairs.groupBy("metric", "cluster").agg(F.count("*").alias("n"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum(F.col("_a") - F.col("_b")).alias("_d"))
    units = ranked(clusters.select("cluster").distinct(), [F.col("cluster")], "_i")
    numbered = units.withColumn("_n", F.lit(units.count()))
    weights = _draws(numbered, [], replicates, seed).join(numbered.select("_i", "cluster"), "_i")
    drawn = weights.join(sums, "cluster").groupBy("metric", "replicate").agg((F.sum(F.col("w") * F.col("_d")) / F.sum(F.col("w") * F.col("n"))).alias("_mean"))
    spread = drawn.groupBy("metric").agg(F.percentile("_mean", 0.025).alias("low"), F.percentile("_mean", 0.975).alias("high"), F.count("*").alias("replicates"), F.avg((F.col("_mean") <= 0).cast("double")).alias("p_not_better"))
    n = F.sum("n")
    point = sums.groupBy("metric").agg(n.alias("cases"), (F.sum("_a") / n).alias("candidate"), (F.sum("_b") / n).alias("reference"), (F.sum("_d") / n).alias("delta"))
    return point.join(spread.where("replicates > 1"), "metric")


def loo_verdicts(arms: DataFrame, by: list[str], margin: float, full: str = "R_full", prefix: str = "R_minus_") -> DataFrame:
    """Verdict on the term that each arm (arm, macro, passed) leaves out, against the full arm of its group.

    A term earns its place if the full arm is better by more than margin, unless only the arm without it passes its gates; it hurts if
    the full arm is worse by more than margin. Without a full arm or a macro the milestone is missing.
    """
    whole = arms.where(F.col("arm") == full).select(*by, F.col("macro").alias("macro_full"), F.col("passed").alias("_full"))
    rows = arms.where(F.col("arm").startswith(prefix)).join(whole, by, "left").withColumn("delta", F.col("macro_full") - F.col("macro"))
    rescued = F.coalesce("passed", F.lit(False)) & ~F.coalesce("_full", F.lit(False))
    verdict = F.when(F.col("delta").isNull(), "milestone-missing").when((F.col("delta") > margin) & ~rescued, "earns-its-place").when(F.col("delta") < -margin, "hurts").otherwise("no-measurable-effect")
    return rows.select(*by, "arm", F.substring("arm", len(prefix) + 1, 1 << 20).alias("term"), "macro_full", "macro", "delta", "passed", verdict.alias("verdict"))


def surviving_terms(arms: DataFrame, scrolls: DataFrame, by: list[str], margin: float, base: str = "B0", skip: tuple[str, ...] = ("B0", "B0r", "A0")) -> DataFrame:
    """Arms (arm, macro, passed) that pass their gates, lose on no scroll (scrolls: arm, gain) and don't trail the base by more than margin."""
    floor = arms.where(F.col("arm") == base).select(*by, (F.col("macro") - margin).alias("_floor"))
    losing = scrolls.where("gain < 0 or gain is null").select(*by, "arm").distinct()
    return arms.where(F.col("passed") & ~F.col("arm").isin(*skip)).join(losing, [*by, "arm"], "left_anti").join(floor, by).where(F.col("macro") >= F.col("_floor")).select(*by, "arm", "macro")


def pick_winner(arms: DataFrame, by: list[str], skip: tuple[str, ...] = ("A0",)) -> DataFrame:
    """The passing arm with the highest macro of each group, the first by name on ties; null if none passes."""
    top = arms.where(~F.col("arm").isin(*skip)).groupBy(*by).agg(F.max(F.when(F.col("passed"), F.col("macro"))).alias("macro"))
    tied = arms.where(F.col("passed") & ~F.col("arm").isin(*skip)).select(*by, "arm", "macro").join(top.where("macro is not null"), [*by, "macro"]).groupBy(*by).agg(F.min("arm").alias("arm"))
    return top.join(tied, by, "left").select(*by, "arm", "macro")


class PointGates(NamedTuple):
    scroll_gain: float = 0.0
    precision_gain: float = 0.0
    least_ratio: float = 0.9
    most_ratio: float = 1.1


def operating_points(initial: DataFrame, trained: DataFrame, scrolls: DataFrame, by: list[str], gates: PointGates = PointGates()) -> DataFrame:
    """Candidates of each group's threshold sweep with their gates; selected marks one of each group.

    initial and trained have threshold, score, precision, ratio, macro; scrolls has threshold, scroll, before, after. A candidate is
    qualified if no scroll loses more than allowed, precision gains enough and the foreground ratio stays in bounds. The best score wins
    among the qualified ones, or among all if none is; then precision, macro, nearness to 0.5, the lower threshold. A point with no
    partner in the other sweep, or a scroll without one, isn't comparable and is never selected.
    """
    key = [*by, "threshold"]
    gain = scrolls.groupBy(*key).agg(F.min(F.coalesce(F.col("after") - F.col("before"), F.lit(float("-inf")))).alias("worst_gain"), F.every(F.col("after").isNotNull() & F.col("before").isNotNull()).alias("_scrolls"))
    before = initial.select(*key, F.col("score").alias("_score"), F.col("precision").alias("_precision"), F.lit(True).alias("_initial"))
    rows = trained.withColumn("_trained", F.lit(True)).join(before, key, "full").join(gain, key, "left")
    comparable = F.coalesce(F.col("_trained") & F.col("_initial") & F.col("_scrolls"), F.lit(False))
    rows = rows.select(*key, "score", "precision", "macro", "ratio", "worst_gain", (F.col("score") - F.col("_score")).alias("score_gain"), (F.col("precision") - F.col("_precision")).alias("precision_gain"), comparable.alias("comparable"))
    holds = (F.col("worst_gain") >= gates.scroll_gain) & (F.col("precision_gain") >= gates.precision_gain) & F.col("ratio").between(gates.least_ratio, gates.most_ratio)
    rows = rows.withColumn("qualified", F.col("comparable") & F.coalesce(holds, F.lit(False)))
    order = [F.desc("comparable"), F.desc("qualified"), F.desc_nulls_last("score"), F.desc_nulls_last("precision"), F.desc_nulls_last("macro"), F.abs(F.col("threshold") - 0.5), F.col("threshold")]
    return rows.withColumn("selected", F.col("comparable") & (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1))


def sweep_difference(sweep: DataFrame, sealed: DataFrame, by: list[str]) -> DataFrame:
    """Largest difference of macro between two sweeps over the sealed one's thresholds, and how many of those the other lacks."""
    both = sealed.select(*by, "threshold", F.col("macro").alias("_s")).join(sweep.select(*by, "threshold", F.col("macro").alias("_m")), [*by, "threshold"], "left")
    return both.groupBy(*by).agg(F.max(F.abs(F.col("_m") - F.col("_s"))).alias("largest"), F.count_if(F.col("_m").isNull()).alias("missing"))


class Contract(NamedTuple):
    """Limits of a candidate against a stored baseline."""

    bridge_reduction: float
    deep_reduction: float
    named_recall_drop: float
    guard_bridge_increase: float
    guard_deep_increase: float
    guard_recall_drop: float
    dice_drop: float


def candidate_gate(candidate: DataFrame, baseline: DataFrame, failures: DataFrame, known: DataFrame, by: list[str], contract: Contract) -> DataFrame:
    """One row a criterion: value, minimum or maximum, passed.

    candidate and baseline have named_bridge, named_deep, named_recall, guard_bridge, guard_deep, guard_recall, fixed_dice and
    calibrated_dice; failures and known (failure) are those of the candidate and of the baseline, of which no new one may appear.
    A reduction from nothing is 1 if nothing is left, else 0. A null value doesn't pass.
    """
    names = ["named_bridge", "named_deep", "named_recall", "guard_bridge", "guard_deep", "guard_recall", "fixed_dice", "calibrated_dice"]
    fresh = failures.select(*by, "failure").distinct().join(known.select(*by, "failure"), [*by, "failure"], "left_anti").groupBy(*by).agg(F.count("*").alias("_new"))
    rows = candidate.select(*by, *names).join(baseline.select(*by, *[F.col(c).alias(f"_{c}") for c in names]), by, "left").join(fresh, by, "left")

    def reduction(c: str) -> Column:
        return F.when(F.col(f"_{c}") <= 0, F.when(F.col(c) > 0, 0.0).otherwise(1.0)).otherwise(1 - F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0)))

    def lost(c: str) -> Column:
        return F.col(f"_{c}") - F.col(c)

    none = F.lit(None).cast("double")
    rules = [
        ("named_bridge_reduction", reduction("named_bridge"), F.lit(contract.bridge_reduction), none),
        ("named_deep_reduction", reduction("named_deep"), F.lit(contract.deep_reduction), none),
        ("named_recall_drop", lost("named_recall"), none, F.lit(contract.named_recall_drop)),
        ("guard_bridge", F.col("guard_bridge"), none, F.col("_guard_bridge") * (1 + contract.guard_bridge_increase)),
        ("guard_deep", F.col("guard_deep"), none, F.col("_guard_deep") * (1 + contract.guard_deep_increase)),
        ("guard_recall_drop", lost("guard_recall"), none, F.lit(contract.guard_recall_drop)),
        ("fixed_dice_delta", -lost("fixed_dice"), F.lit(-contract.dice_drop), none),
        ("calibrated_dice_delta", -lost("calibrated_dice"), F.lit(-contract.dice_drop), none),
        ("new_failures", F.coalesce("_new", F.lit(0)), none, F.lit(0.0)),
    ]
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("criterion"), v.cast("double").alias("value"), lo.cast("double").alias("minimum"), hi.cast("double").alias("maximum")) for n, v, lo, hi in rules])))
    return long.withColumn("passed", F.coalesce(F.when(F.col("minimum").isNotNull(), F.col("value") >= F.col("minimum")).otherwise(F.col("value") <= F.col("maximum")), F.lit(False)))

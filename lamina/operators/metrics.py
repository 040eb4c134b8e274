"""Overlap metrics of scores against labels; label 2 is unknown and never counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = 2


def ratio(a: Column, b: Column) -> Column:
    """a over b with a denominator of at least 1: empty sets give 0."""
    return a / F.greatest(b, F.lit(1))


def hit_at(threshold: float) -> Column:
    """score >= threshold in float32; a null score and not-a-number are misses."""
    score = F.col("score").cast("float")
    return F.coalesce((score >= F.lit(threshold).cast("float")) & ~F.isnan(score), F.lit(False))


def confusion(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """tp, fp, fn, tn, known for each group: scores compare as float32 with >=."""
    hit, real = hit_at(threshold), F.col("target") == 1
    return df.where(F.col("target") != UNKNOWN).groupBy(*by).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"), F.count("*").alias("known"))


def threshold_counts(df: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """tp, fp, fn, known, positive for each group and threshold, from one histogram rather than a fan-out.

    A score falls into the bin of the number of thresholds that it reaches; counts at a threshold are cumulative from the top.
    """
    table, score = F.array(*[F.lit(t).cast("float") for t in thresholds]), F.col("score").cast("float")
    reached = F.when(score.isNull() | F.isnan(score), 0).otherwise(F.size(F.filter(table, lambda t: score >= t)))
    bins = df.where(F.col("target") != UNKNOWN).withColumn("bin", reached)
    counts = bins.groupBy(*by, "bin").agg(F.count_if(F.col("target") == 1).alias("real"), F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("real").alias("positive"), F.sum("n").alias("known"))
    every = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds)))))
    full = every.join(counts, [*by, "bin"], "left").fillna(0, ["real", "n"])
    above = Window.partitionBy(*by).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = full.select(*by, "bin", "positive", "known", F.sum("real").over(above).alias("tp"), F.sum("n").over(above).alias("hits")).where("bin > 0")
    return swept.select(*by, F.element_at(F.array(*map(F.lit, thresholds)), F.col("bin")).alias("threshold"), "tp", (F.col("hits") - F.col("tp")).alias("fp"), (F.col("positive") - F.col("tp")).alias("fn"), "known", "positive")


def derive(df: DataFrame) -> DataFrame:
    """dice, precision, recall, prevalence, predicted from tp, fp, fn, known, rounded to 6 digits."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = {"dice": ratio(2 * tp, 2 * tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "prevalence": ratio(tp + fn, F.col("known")), "predicted": ratio(tp + fp, F.col("known"))}
    return df.withColumns({k: F.round(v, 6) for k, v in out.items()})


def pooled_macro(counts: DataFrame) -> DataFrame:
    """threshold, pooled, macro: Dice of all counts, and the plain mean over scrolls of the pooled Dice of each."""
    sets = counts.groupBy("threshold", "scroll").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    dice = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return sets.withColumn("dice", dice).groupBy("threshold").agg(F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("pooled"), F.round(F.avg("dice"), 6).alias("macro"), F.count("*").alias("scrolls"))


def stratified(df: DataFrame, strata: list[str], threshold: float) -> DataFrame:
    """Confusion counts and Dice of the scores and of the baseline for each value of each stratum, and the gain."""
    known = df.where(F.col("target") != UNKNOWN).withColumns({"hit": hit_at(threshold), "real": F.col("target") == 1})
    long = known.select("hit", "real", "baseline", F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("level")) for s in strata])).alias("s"))
    parts = [F.count_if(F.col(p) & F.col("real")).alias(f"tp_{p}") for p in ("hit", "baseline")] + [F.count_if(F.col(p)).alias(f"n_{p}") for p in ("hit", "baseline")]
    sums = long.groupBy(F.col("s.stratum").alias("stratum"), F.col("s.level").alias("level")).agg(F.count("*").alias("known"), F.count_if("real").alias("positive"), *parts)
    dice = [ratio(2 * F.col(f"tp_{p}"), F.col(f"n_{p}") + F.col("positive")) for p in ("hit", "baseline")]
    return sums.select("stratum", "level", "known", "positive", F.round(dice[0], 6).alias("dice"), F.round(dice[1], 6).alias("baseline_dice"), F.round(dice[0] - dice[1], 6).alias("gain"))


def ranking(df: DataFrame, by: list[str], bins: int = 2048) -> DataFrame:
    """Average precision, AUROC, Dice at one half, the best Dice with its threshold, and prevalence, from a histogram of tied scores.

    Scores are clipped to [0, 1] and rounded to bins, halves to even; null and not-a-number are 0. The best Dice is that of the
    highest threshold on ties.
    """
    score = F.col("score").cast("double")
    clipped = F.least(F.greatest(F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score), F.lit(0.0)), F.lit(1.0))
    b = F.bround(clipped * (bins - 1)).cast("int")
    counts = df.where(F.col("target") != UNKNOWN).groupBy(*by, b.alias("bin")).agg(F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") == 0).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    c = counts.select("*", F.sum("p").over(down).alias("cp"), F.sum("n").over(down).alias("cn"), F.sum("p").over(whole).alias("tp"), F.sum("n").over(whole).alias("tn"))
    ap = F.sum(F.col("p") / F.greatest("tp", F.lit(1)) * F.col("cp") / (F.col("cp") + F.col("cn")))
    roc = F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2.0)) / F.greatest(F.max("tp") * F.max("tn"), F.lit(1))
    dice = 2 * F.col("cp") / (F.col("tp") + F.col("cp") + F.col("cn"))
    best = F.max_by("bin", F.struct(F.round(dice, 12), "bin")) / (bins - 1)
    half = F.min_by(dice, F.when(F.col("bin") >= round(0.5 * (bins - 1)), F.col("bin")))
    return c.groupBy(*by).agg(F.round(ap, 6).alias("ap"), F.round(roc, 6).alias("auroc"), F.round(F.max(dice), 6).alias("best_dice"), F.round(best, 6).alias("best_threshold"), F.round(half, 6).alias("dice_at_half"), F.round(F.max("tp") / (F.max("tp") + F.max("tn")), 6).alias("prevalence"))


def mask_agreement(df: DataFrame, by: list[str]) -> DataFrame:
    """iou and agreement of two masks (boolean columns a and b) over the rows of each group."""
    a, b = F.col("a"), F.col("b")
    c = df.groupBy(*by).agg(F.count_if(a & b).alias("i"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count("*").alias("n"))
    return c.select(*by, F.round(ratio(F.col("i"), F.col("a") + F.col("b") - F.col("i")), 6).alias("iou"), F.round((F.col("n") - F.col("a") - F.col("b") + 2 * F.col("i")) / F.col("n"), 6).alias("agreement"))


def nan_means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of columns without null and not-a-number, and the number of cases."""
    return df.groupBy(*by).agg(*[F.round(F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))), 4).alias(c) for c in columns], F.count("*").alias("cases"))


def otsu(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """The cut of each group's histogram with the largest variance between the two sides; the first one on ties."""
    counts = df.groupBy(*by, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    c = counts.select(*by, "bin", F.sum("n").over(up).alias("w"), F.sum(F.col("n") * F.col("bin")).over(up).alias("m"), F.sum("n").over(whole).alias("tw"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("tm"))
    gap = F.col("tm").cast("double") / F.col("tw") * F.col("w") - F.col("m")
    between = F.when(F.col("w") < F.col("tw"), gap * gap / (F.col("w") * (F.col("tw") - F.col("w")).cast("double"))).otherwise(0.0)
    c = c.withColumn("between", F.round(between, 4))
    return c.groupBy(*by).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("cut"), F.max("between").alias("between"))


def distribution(df: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """n, least, greatest, mean and exact interpolated quantiles of a column."""
    q = F.percentile(value, F.array(*map(F.lit, quantiles)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("greatest"), F.round(F.avg(value), 4).alias("mean"), q.alias("q"))
    return out.select(*by, "n", "least", "greatest", "mean", *[F.round(F.col("q")[i], 4).alias(f"q{round(100 * x)}") for i, x in enumerate(quantiles)])


def loss_components(df: DataFrame, by: list[str], floor: float = 1e-6) -> DataFrame:
    """Cross entropy and soft Dice loss over known rows of a probability score."""
    p = F.least(F.greatest(F.col("score").cast("double"), F.lit(floor)), F.lit(1 - floor))
    y = (F.col("target") == 1).cast("double")
    known = df.where(F.col("target") != UNKNOWN).select(*by, p.alias("p"), y.alias("y"))
    bce = -F.avg(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    soft = 1 - (2 * F.sum(F.col("p") * F.col("y")) + 1) / (F.sum("p") + F.sum("y") + 1)
    return known.groupBy(*by).agg(F.round(bce, 5).alias("bce"), F.round(soft, 5).alias("soft_dice"), F.count("*").alias("known"))

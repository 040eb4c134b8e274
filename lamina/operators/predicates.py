"""Decoding, scaling, acceptance and refusal rules as columns and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.windows import ranked


def decode_labels(df: DataFrame, value: str, positive: list[int], ignore: list[int]) -> DataFrame:
    """Adds known, positive and probability (1.0 or 0.0) of a label field. A null label is unknown."""
    known = F.col(value).isNotNull() & ~F.col(value).isin(ignore)
    real = F.coalesce(F.col(value).isin(positive), F.lit(False))
    return df.withColumns({"known": F.coalesce(known, F.lit(False)), "positive": known & real, "probability": real.cast("double")})


def decode_probability(df: DataFrame, value: str, scale: float, threshold: float) -> DataFrame:
    """Adds known, positive and probability (clipped to [0, 1]) of a scaled field. Null and non-finite values are unknown and 0."""
    p = F.col(value).cast("double") / scale
    known = F.coalesce(~F.isnan(p) & (F.abs(p) < float("inf")), F.lit(False))
    clipped = F.least(F.greatest(F.when(F.isnan(p) | p.isNull(), 0.0).otherwise(p), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({"known": known, "positive": known & (p >= threshold), "probability": clipped})


def zscore(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds z: the value less its group's mean, over the group's standard deviation (1e-8 at least)."""
    facts = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    return df.join(facts, by).withColumn("z", (F.col(value) - F.col("_mean")) / F.greatest("_std", F.lit(1e-8))).drop("_mean", "_std")


def robust_unit(df: DataFrame, by: list[str], value: str, mask: Column, least: int = 128) -> DataFrame:
    """Adds unit: the value scaled to the 1st and 99th percentile of the group's masked values, clipped to [0, 1].

    0 where the group has fewer masked values than least or its percentiles are equal.
    """
    inside = F.when(mask, F.col(value))
    cuts = df.groupBy(*by).agg(F.count(inside).alias("_n"), F.percentile(inside, F.array(F.lit(0.01), F.lit(0.99))).alias("_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    unit = F.when((F.col("_n") >= least) & (hi > lo), F.least(F.greatest((F.col(value) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return df.join(cuts, by).withColumn("unit", unit).drop("_n", "_q")


def to_mask(score: Column, threshold: float) -> Column:
    """score >= threshold in float32; null and not-a-number are no hit."""
    s = score.cast("float")
    return F.coalesce((s >= F.lit(threshold).cast("float")) & ~F.isnan(s), F.lit(False))


def to_mask_u8(score: Column, threshold: float) -> Column:
    """The rule for scores kept as 0 to 255: at least the smallest number that stands for the threshold."""
    return score >= F.lit(_least_u8(threshold))


def _least_u8(threshold: float) -> int:
    import math

    return math.ceil(255.0 * threshold + 0.5 - 1e-9)


def acceptable(df: DataFrame, known: float, positive: int, nonzero: float, source: dict[str, float] | None = None) -> DataFrame:
    """Rows (known_fraction, positive_voxels, ct_nonzero_fraction, supervision_source) that clear all minima.

    source gives other minima of known_fraction for sources whose name contains a text.
    """
    least = reduce(lambda c, x: F.when(F.col("supervision_source").contains(x[0]), x[1]).otherwise(c), (source or {}).items(), F.lit(known))
    return df.where((F.col("known_fraction") >= least) & (F.col("positive_voxels") >= positive) & (F.col("ct_nonzero_fraction") >= nonzero))


def quality_gate(support: DataFrame, records: DataFrame, key: str, fraction: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The keys of the support whose record has at least that fraction, and one row with before, after and excluded."""
    joined = support.select(key).distinct().join(records.select(key, fraction), key, "left")
    clear = F.coalesce(F.col(fraction) >= least, F.lit(False))
    facts = joined.agg(F.count("*").alias("before"), F.count_if(clear).alias("after"), F.count_if(~clear).alias("excluded"))
    return joined.where(clear).select(key), facts


def eligible_anchors(df: DataFrame, support: float, ncc: float, margin: float) -> DataFrame:
    """Measured anchors (status, registration_3d, sampling) with enough support, correlation and margin, not on the search boundary."""
    r = F.col("registration_3d")
    checks = [F.col("status") == "measured", r["available"], r["best_shift_zyx"].isNotNull(), ~F.coalesce(r["best_on_search_boundary"], F.lit(False)), F.coalesce(F.col("sampling.fine_ct_support_fraction"), F.lit(0.0)) >= support, r["best_structure_ncc"] >= ncc, r["peak_margin"] >= margin]
    return df.where(F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False)))


def align_region(df: DataFrame, chunk: int) -> DataFrame:
    """Widens z0, z1, y0, y1, x0, x1 to whole chunks and adds changed."""
    new = {c: (F.floor(F.col(c) / chunk) if c.endswith("0") else F.ceil(F.col(c) / chunk)) * chunk for c in ("z0", "z1", "y0", "y1", "x0", "x1")}
    changed = reduce(lambda a, b: a | b, [v != F.col(c) for c, v in new.items()])
    return df.withColumn("changed", changed).withColumns(new)


def region_origins(df: DataFrame, chunk: int) -> DataFrame:
    """One row per chunk of each region: z, y, x of its first voxel."""
    for c in "zyx":
        df = df.withColumn(c, F.explode(F.sequence(F.col(f"{c}0"), F.col(f"{c}1") - 1, F.lit(chunk))))
    return df


def interior(df: DataFrame, margin: int, size: dict[str, Column]) -> DataFrame:
    """Rows at least margin away from both ends of each axis; an axis that the margin would empty keeps all."""
    keep = [(2 * margin >= n) | ((F.col(c) >= margin) & (F.col(c) < n - margin)) for c, n in size.items()]
    return df.where(reduce(lambda a, b: a & b, keep))


def partition_masks(df: DataFrame) -> DataFrame:
    """Adds part: p1 where the label is known, else p2 where distill_valid, else p3 where rehearsal_valid, else none."""
    part = F.when(F.col("label") < 1.5, "p1").when(F.col("distill_valid") > 0.5, "p2").when(F.col("rehearsal_valid") > 0.5, "p3").otherwise("none")
    return df.withColumn("part", part)


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """The alias of a trimmed name without hyphens and underscores in upper case; else the trimmed name."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(F.translate(F.trim(name), "-_", ""))), F.trim(name))


def renamed(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), value)


def pathology_band(score: Column) -> Column:
    return F.when(score >= 0.10, "high").when(score > 0, "low").otherwise("zero")


def supervision_category(source: Column, categories: dict[str, str]) -> Column:
    """The category of the first text that the source contains; null if there is none."""
    return F.coalesce(*[F.when(source.contains(text), name) for text, name in categories.items()])


def registration_action(shift: list[Column], accept: float = 0.75, correct: float = 2.0) -> Column:
    size = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in shift]))
    return F.when(size <= accept, "accept").when(size <= correct, "correct").otherwise("reject")


def first_refusal(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule (accepted, reason) that isn't true; null if all are."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), reason) for ok, reason in rules])


def corridor_rules(gap: int, alignment: float, anisotropy: float, arc: float, mean: float, ridge: float, coverage: float, planes: int) -> list[tuple[Column, str]]:
    """Acceptance rules of a corridor between two curve ends, in the order in which a refusal names them."""
    return [
        (F.col("gap_pixels") >= gap, "tiny_gap"),
        (F.array_min("endpoint_alignment") >= alignment, "endpoint_direction"),
        (F.array_min("endpoint_anisotropy") >= anisotropy, "ambiguous_endpoint_shape"),
        (F.col("arc_ratio") <= arc, "excessive_detour"),
        (F.col("probability_mean") >= mean, "weak_mean_probability"),
        (F.col("probability_ridge_positive_fraction") >= ridge, "off_probability_ridge"),
        (F.size(F.filter("neighbor_probability_coverage", lambda v: v >= coverage)) >= planes, "insufficient_neighbor_probability_support"),
    ]


def refined_path_rules(outward: float, turn: float) -> list[tuple[Column, str]]:
    """Two more rules for corridors whose path was refined; they come after those of the corridor."""
    return [
        (F.array_min("endpoint_outward") >= outward, "backwards_anchor_approach"),
        (F.col("maximum_local_turn_degrees") <= turn, "abrupt_local_turn"),
    ]


def dequantise(q: Column) -> Column:
    return q / 255.0


def pathology_bands(df: DataFrame, by: list[str], score: str) -> DataFrame:
    return df.groupBy(*by, pathology_band(F.col(score)).alias("band")).agg(F.count("*").alias("n"))


def strategies(df: DataFrame, pathology: str, density: str, tie: Column, key: str) -> DataFrame:
    """Adds strategy: high-pathology for the first third by pathology, dense-positive for the densest sixth of all among the rest.

    Rank is counted over sorted partitions (ranked), so no task holds the whole table.
    """
    n = df.count()
    first = ranked(df, [F.col(pathology).desc(), tie, F.col(key)], "_place")
    third, sixth = -(-n // 3), -(-n // 6)
    rest = ranked(first.where(F.col("_place") >= third), [F.col(density).desc(), F.col(key)], "_second")
    later = rest.withColumn("strategy", F.when(F.col("_second") < sixth, "dense-positive").otherwise("random")).drop("_second")
    return first.where(F.col("_place") < third).withColumn("strategy", F.lit("high-pathology")).unionByName(later).drop("_place")

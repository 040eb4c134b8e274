"""Audit figures: tolerant counts, chunk and patch statistics, slices, cubes, verdicts and comparisons of runs."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.chunks import Block, over_chunks
from lamina.operators.graph import CHUNK, component_facts, offsets
from lamina.operators.joins import bridges
from lamina.operators.metrics import ratio, threshold_counts
from lamina.operators.stencils import CELL, cross, dilate, l1_depth, moved, shifted
from lamina.sources.shared import dealt, large, materialise


def _fixed(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def recovered(field: DataFrame, score: str, steps: int, matched: bool = False) -> DataFrame:
    """z, y, x, recovered: the largest score within so many steps of each voxel of field (z, y, x, target, score) of a known target.

    Only scores of known voxels count; null and not-a-number don't. Chunks with a halo are looked at, so no voxel is written once a step.
    With matched, near tells whether so many steps through known voxels lead to a true one (target 1).
    """
    real = [F.max(F.when(F.col("target") == 1, 1.0)).alias("real")] if matched else []
    known = field.where("target <> 2").groupBy(*CELL).agg(F.max(F.nanvl(F.col(score).cast("double"), F.lit(None))).alias("score"), *real)
    most = F.lit(sys.float_info.max)
    finite = known.select(*CELL, F.when(F.col("score").isNotNull(), F.greatest(F.least("score", most), -most)).alias("score"), F.lit(1.0).alias("known"), *(["real"] if matched else []))
    columns, schema = ["score", "known"], "z int, y int, x int, recovered double"

    def work(block: Block) -> dict[str, np.ndarray]:
        values, may = block.arrays["score"], np.isfinite(block.arrays["known"])
        there = may[block.core]
        best = np.full(there.shape, np.nan)
        if there.any():
            for step in cross(steps):
                best = np.fmax(best, values[tuple(slice(steps + o, steps + o + n) for o, n in zip(step, there.shape, strict=True))])
        if not matched:
            return block.rows(there, recovered=best)
        near = np.isfinite(block.arrays["real"])
        for _ in range(steps):
            near = np.logical_or.reduce([near, *(moved(near, s, False) for s in offsets(6))]) & may
        return block.rows(there, recovered=best, near=near[block.core])

    if matched:
        columns, schema = [*columns, "real"], f"{schema}, near boolean"
    found = over_chunks(finite, columns, CHUNK, (steps,) * 3, work, schema)
    return found.select(*CELL, F.nanvl("recovered", F.lit(None)).cast(field.schema[score].dataType).alias("recovered"), *(["near"] if matched else []))


def tolerant_counts(field: DataFrame, thresholds: list[float], tolerance: int) -> DataFrame:
    """threshold, matched_prediction, predicted, matched_truth, truth, precision, recall, f0_5 of voxels (z, y, x, score, target).

    A predicted voxel is matched within so many steps of a true one, through known voxels only; a true voxel is matched if a
    known voxel within so many steps has the score.
    """
    known = materialise(field.where("target <> 2").select(*CELL, "score", "target"), "known")
    known = dealt(known, known.count(), *CELL)
    placed = materialise(known.join(large(recovered(known, "score", tolerance, True)), CELL, "left"), "tolerant")
    as_score = lambda score, hit: placed.where(hit).select(F.lit(1).alias("one"), F.col(score).alias("score"), F.lit(1).alias("target"))
    counts = None
    for name, df in (("predicted", as_score("score", F.lit(True))), ("matched_prediction", as_score("score", F.coalesce("near", F.lit(False)))), ("matched_truth", as_score("recovered", F.col("target") == 1))):
        part = threshold_counts(df, thresholds, ["one"]).select("threshold", F.col("tp").alias(name), *([F.col("positive").alias("truth")] if name == "matched_truth" else []))
        counts = part if counts is None else counts.join(part, "threshold", "left")
    counts = counts.fillna(0)
    p, r = ratio(F.col("matched_prediction"), F.col("predicted")), ratio(F.col("matched_truth"), F.col("truth"))
    return counts.select("threshold", "matched_prediction", "predicted", "matched_truth", "truth", *_fixed(precision=p, recall=r, f0_5=1.25 * p * r / F.greatest(0.25 * p + r, F.lit(1e-12))))


def dilated_counts(field: DataFrame, thresholds: list[float], steps: int) -> DataFrame:
    """Threshold counts of the prediction grown by so many steps: a largest-value filter is a dilation at every threshold."""
    grown = field.where("target <> 2").select(*CELL, "target").join(recovered(field, "score", steps), CELL)
    return threshold_counts(grown.select("target", F.col("recovered").alias("score"), F.lit("all").alias("part")), thresholds, ["part"]).drop("part")


def label_stats(voxels: DataFrame, by: list[str], label: str, positive: list[int], ignore: list[int], allowed: list[int]) -> DataFrame:
    """decoded, known, positive, ignored, background, observed ("label:count", in order) and unexpected for each chunk."""
    counts = voxels.groupBy(*by, F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    total = lambda labels: F.coalesce(F.sum(F.when(F.col("_label").isin(labels), F.col("_n"))), F.lit(0))
    seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_label", "_n"))), lambda x: F.concat_ws(":", x["_label"], x["_n"])), ",")
    facts = counts.groupBy(*by).agg(F.sum("_n").alias("decoded"), total(positive).alias("positive"), total(ignore).alias("ignored"), seen.alias("observed"), F.coalesce(F.sum(F.when(~F.col("_label").isin(allowed), F.col("_n"))), F.lit(0)).alias("unexpected"))
    known = F.col("decoded") - F.col("ignored")
    return facts.select(*by, "decoded", known.alias("known"), "positive", "ignored", (known - F.col("positive")).alias("background"), "observed", "unexpected")


def patch_stats(voxels: DataFrame, by: list[str]) -> DataFrame:
    """known_fraction, positive_fraction, ct_nonzero_fraction, pathology_score (share of known voxels where baseline and target differ), soft_mass."""
    known, n = F.col("target") != 2, F.count("*")
    c = voxels.groupBy(*by).agg(n.alias("n"), F.count_if(known).alias("known"), F.count_if(F.col("target") == 1).alias("positive"), F.count_if(F.col("image") > 0).alias("nonzero"), F.count_if(known & (F.col("baseline") != F.col("target"))).alias("wrong"), F.sum("soft").alias("soft_mass"))
    return c.select(*by, "known", "positive", *_fixed(known_fraction=F.col("known") / F.col("n"), positive_fraction=ratio(F.col("positive"), F.col("known")), ct_nonzero_fraction=F.col("nonzero") / F.col("n"), pathology_score=ratio(F.col("wrong"), F.col("known")), soft_mass=F.col("soft_mass")))


def pathology_scores(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Counts and scores of a 0/1 prediction for each patch: wrong voxels over known ones (0 without any); empty denominators give 1."""
    known, truth, hit = F.col("target") != 2, F.col("target") == 1, F.col("prediction") == 1
    c = voxels.groupBy(*by).agg(F.count_if(known).alias("known"), F.count_if(hit & truth).alias("tp"), F.count_if(hit & known & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(1.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "known", "tp", "fp", "fn", *_fixed(pathology_score=F.when(F.col("known") > 0, (fp + fn) / F.greatest("known", F.lit(1))).otherwise(0.0), dice=share(2 * tp, 2 * tp + fp + fn), precision=share(tp, tp + fp), recall=share(tp, tp + fn)))


def compare_counts(counts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose count n differs from the expected one or is on one side only."""
    both = counts.select(*keys, F.col("n").alias("found")).join(expected.select(*keys, F.col("n").alias("expected")), keys, "full")
    return both.where(~F.col("found").eqNullSafe(F.col("expected")))


def tolerance_agreement(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Voxels of two masks, their intersection over union, and the share of each within so many steps of the other."""
    one, two = (m.select(*CELL).distinct() for m in (a, b))
    both = one.join(two, CELL, "left_semi")
    near = lambda x, y: x.join(dilate(y, 6, tolerance), CELL, "left_semi").agg(F.count("*").alias("n"))
    parts = [df.agg(F.count("*").alias("n")) if i < 3 else df for i, df in enumerate((one, two, both, near(one, two), near(two, one)))]
    named = [p.select(F.col("n").alias(name)) for p, name in zip(parts, ("a", "b", "both", "near_a", "near_b"), strict=True)]
    row = reduce(lambda x, y: x.join(F.broadcast(y)), named)
    return row.select("a", "b", "both", *_fixed(iou=ratio(F.col("both"), F.col("a") + F.col("b") - F.col("both")), precision=ratio(F.col("near_a"), F.col("a")), recall=ratio(F.col("near_b"), F.col("b"))))


def thickness(candidate: DataFrame, reference: DataFrame, by: list[str], radius: int, cap: int = 17, connectivity: int = 6) -> DataFrame:
    """Foreground, interior (depth over the radius) and greatest depth of two masks, their differences, and the candidate's new interior."""
    a = l1_depth(candidate, cap, connectivity).select(*CELL, F.col("depth").alias("da"))
    b = l1_depth(reference, cap, connectivity).select(*CELL, F.col("depth").alias("db"))
    both = a.join(b, CELL, "full")
    inside = lambda c: F.count_if(F.coalesce(F.col(c) > radius, F.lit(False)))
    c = both.groupBy(*by).agg(F.count("da").alias("foreground"), F.count("db").alias("reference_foreground"), inside("da").alias("interior"), inside("db").alias("reference_interior"), F.coalesce(F.max("da"), F.lit(0)).alias("deepest"), F.coalesce(F.max("db"), F.lit(0)).alias("reference_deepest"), F.count_if((F.col("da") > radius) & F.col("db").isNull()).alias("new_interior"))
    share, other = ratio(F.col("interior"), F.col("foreground")), ratio(F.col("reference_interior"), F.col("reference_foreground"))
    return c.select("*", *_fixed(interior_fraction=share, interior_delta=share - other), (F.col("deepest") - F.col("reference_deepest")).alias("deepest_delta"))


def slice_blob_metrics(candidate: DataFrame, reference: DataFrame, labels: DataFrame, reference_labels: DataFrame, least: int, radius: int = 2, cap: int = 17) -> DataFrame:
    """Overlap, components, interior and merges of each plane of a candidate mask against a reference mask.

    labels and reference_labels have the components within planes (z, y, x, component). Components of fewer voxels than least aren't
    meaningful; a candidate component merges if it touches two or more meaningful ones of the reference.
    """
    a, b = (m.select(*CELL).distinct() for m in (candidate, reference))
    flags = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), CELL, "full").fillna(0, ["a", "b"])
    counts = flags.groupBy("z").agg(F.sum("a").alias("candidate"), F.sum("b").alias("reference"), F.sum(F.col("a") * F.col("b")).alias("shared"))
    facts = component_facts(labels, ["z"], least).select("z", F.col("components").alias("candidate_components"), F.col("meaningful").alias("candidate_meaningful"), F.col("largest").alias("candidate_largest"))
    other = component_facts(reference_labels, ["z"], least).select("z", F.col("components").alias("reference_components"), F.col("meaningful").alias("reference_meaningful"))
    depth = thickness(a, b, ["z"], radius, cap, 4).select("z", "interior", "reference_interior", "new_interior", "deepest", "reference_deepest")
    merging = bridges(labels, reference_labels, least)
    planes = labels.groupBy("component").agg(F.min("z").alias("z")).join(merging.select(F.col("candidate").alias("component"), "excess"), "component")
    merged = planes.groupBy("z").agg(F.count("*").alias("merging"), F.sum("excess").alias("excess"))
    out = reduce(lambda x, y: x.join(y, "z", "left"), [facts, other, depth, merged], counts).fillna(0)
    return out.select("*", (F.col("candidate") - F.col("shared")).alias("candidate_only"), (F.col("reference") - F.col("shared")).alias("reference_only"), *_rates())


def _rates() -> list[Column]:
    c, r, s = F.col("candidate"), F.col("reference"), F.col("shared")
    return _fixed(dice=ratio(2 * s, c + r), precision=ratio(s, c), recall=ratio(s, r), foreground_ratio=ratio(c, r), interior_fraction=ratio(F.col("interior"), c), reference_interior_fraction=ratio(F.col("reference_interior"), r))


def aggregate_slices(slices: DataFrame, by: list[str]) -> DataFrame:
    """Counts summed over planes and rates recomputed from them, never averaged; the greatest depths."""
    sums = [c for c in slices.columns if c not in ("z", "dice", "precision", "recall", "foreground_ratio", "interior_fraction", "reference_interior_fraction", "deepest", "reference_deepest", *by)]
    return slices.groupBy(*by).agg(F.count("*").alias("slices"), *[F.sum(c).alias(c) for c in sums], F.max("deepest").alias("deepest"), F.max("reference_deepest").alias("reference_deepest"), F.max(F.col("deepest") - F.col("reference_deepest")).alias("deepest_delta")).select("*", *_rates())


def survival(field: DataFrame, depths: list[int]) -> DataFrame:
    """z, y, x and, for each depth k, level_k: the largest single-precision threshold at which the voxel is still deeper than k.

    A voxel at the threshold or above has depth 1; it is deeper than k if it survives k erosions with 6 neighbours. level_k is the smallest
    score within k steps, null where an unknown voxel is as near. All steps are taken in chunks with a halo of the greatest depth.
    """
    known = field.select(*CELL, F.col("score").cast("float").alias("v")).where("v is not null and not isnan(v)").groupBy(*CELL).agg(F.max(F.col("v").cast("double")).alias("v"))
    most, far = F.lit(sys.float_info.max), max([0, *depths])
    names = [f"level_{k}" for k in range(far + 1) if k == 0 or k in depths]

    def work(block: Block) -> dict[str, np.ndarray]:
        now = block.arrays["v"]
        levels = {"level_0": now[block.core]}
        for k in range(1, far + 1):
            now = np.minimum.reduce([now[tuple(slice(1 + o, n - 1 + o) for o, n in zip(step, now.shape, strict=True))] for step in cross(1)])
            if k in depths:
                levels[f"level_{k}"] = now[tuple(slice(far - k, n - far + k) for n in now.shape)]
        return block.rows(np.isfinite(levels["level_0"]), **levels)

    out = over_chunks(known.select(*CELL, F.greatest(F.least("v", most), -most).alias("v")), ["v"], CHUNK, (far,) * 3, work, ", ".join(["z int, y int, x int", *(f"{n} double" for n in names)]))
    return out.select(*CELL, *[F.nanvl(n, F.lit(None)).cast("float").alias(n) for n in names])


def frontier(field: DataFrame, by: str, thresholds: list[float], interior: int = 2, deep: int = 5) -> DataFrame:
    """For each threshold the pooled shares of voxels deeper than interior and at least deep, and the mean share over groups.

    Scores meet thresholds in single precision. All thresholds are counted from one table of survival levels.
    """
    levels = survival(field, [interior, deep - 1]).join(field.select(*CELL, by).distinct(), CELL)
    columns = {"n": "level_0", "i": f"level_{interior}", "d": f"level_{deep - 1}"}
    counts = [F.count_if(F.col(c) >= F.lit(t).cast("float")).alias(f"{name}{k}") for k, t in enumerate(thresholds) for name, c in columns.items()]
    groups = field.select(by).distinct().join(levels.groupBy(by).agg(*counts), by, "left").fillna(0)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{name}{k}").alias(name) for name in columns]) for k, t in enumerate(thresholds)])).alias("r")
    share = F.avg(F.when(F.col("n") > 0, F.col("i") / F.greatest("n", F.lit(1))).otherwise(0.0))
    return groups.select(rows).select("r.*").groupBy("threshold").agg(F.sum("n").alias("foreground"), *_fixed(interior_share=ratio(F.sum("i"), F.sum("n")), deep_share=ratio(F.sum("d"), F.sum("n")), mean_share=share))


def cube_summary(cubes: DataFrame, dims: list[str]) -> DataFrame:
    """Rates, means and the median thickness of cubes by each dimension alone and overall ("*")."""
    grouped = cubes.groupingSets([[d] for d in dims] + [[]], *dims)
    rate = lambda c: F.avg(c.cast("double"))
    facts = grouped.agg(F.count("*").alias("cubes"), *_fixed(deep_rate=rate(F.col("max_thickness") >= 6), thick_rate=rate(F.col("thick")), slab_rate=rate(F.col("reject_kind") == "solid-slab"), empty_rate=rate(F.col("reject_kind") == "empty"), mean_interior=F.avg("interior_fraction"), mean_fill=F.avg("fill_fraction"), median_thickness=F.percentile("max_thickness", 0.5)))
    return facts.select(*[F.coalesce(F.col(d).cast("string"), F.lit("*")).alias(d) for d in dims], *[c for c in facts.columns if c not in dims])


def fragments(labels: DataFrame, by: list[str], small: int, piece: int) -> DataFrame:
    """Share of the voxels in components smaller than small, and the number of components of at least piece voxels."""
    sizes = labels.groupBy(*by, "component").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.sum("n").alias("foreground"), F.round(F.sum(F.when(F.col("n") < small, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("small_share"), F.count_if(F.col("n") >= piece).alias("pieces"))


def band_thickness(distances: DataFrame, by: list[str], band: float) -> DataFrame:
    """Median and 90th percentile of distance, and the share within the band; missing distances aren't in it."""
    return distances.groupBy(*by).agg(F.count("*").alias("n"), *_fixed(p50=F.percentile("distance", 0.5), p90=F.percentile("distance", 0.9), inside=F.avg(F.coalesce(F.col("distance") <= band, F.lit(False)).cast("double"))))


def joint_sweep(field: DataFrame, by: str, thresholds: list[float], floor: float) -> DataFrame:
    """Overlap of a score with two masks (published, reference) at each threshold, for each cube and pooled ("*"), in one pass.

    low_cubes of the pooled rows counts the cubes whose foreground ratio is below the floor.
    """
    parts = []
    for name in ("published", "reference"):
        swept = threshold_counts(field.select(by, "score", F.col(name).cast("int").alias("target")), thresholds, [by])
        parts.append(swept.select(by, "threshold", F.col("tp").alias(f"{name}_shared"), F.col("positive").alias(f"{name}_positive"), (F.col("tp") + F.col("fp")).alias("student")))
    cubes = parts[0].join(parts[1].drop("student"), [by, "threshold"]).withColumn("low", (ratio(F.col("student"), F.col("reference_positive")) < floor).cast("int"))
    names = ("student", "published_shared", "published_positive", "reference_shared", "reference_positive", "low")
    pooled = cubes.groupingSets([[by, "threshold"], ["threshold"]], by, "threshold").agg(*[F.sum(c).alias(c) for c in names])
    s = F.col("student")
    rates = {f"dice_{n}": ratio(2 * F.col(f"{n}_shared"), s + F.col(f"{n}_positive")) for n in ("published", "reference")}
    return pooled.select(F.coalesce(F.col(by).cast("string"), F.lit("*")).alias(by), "threshold", "student", "published_shared", "reference_shared", *_fixed(**rates, foreground_ratio=ratio(s, F.col("reference_positive"))), F.col("low").alias("low_cubes"))


def slice_registration(df: DataFrame, by: str, least: int = 100) -> DataFrame:
    """Mask Dice of two images (fixed > 0, moving > 1) in each plane and their correlation on the overlap, null up to least voxels."""
    a, b = F.col("fixed") > 0, F.col("moving") > 1
    on = lambda c: F.when(a & b, F.col(c).cast("double"))
    c = df.groupBy(by).agg(F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.count_if(a & b).alias("n"), F.avg(on("fixed")).alias("ma"), F.avg(on("moving")).alias("mb"), F.avg(on("fixed") * on("moving")).alias("mab"), F.stddev_pop(on("fixed")).alias("sa"), F.stddev_pop(on("moving")).alias("sb"))
    corr = (F.col("mab") - F.col("ma") * F.col("mb")) / ((F.col("sa") + 1e-6) * (F.col("sb") + 1e-6))
    return c.select(by, F.col("na").alias("fixed"), F.col("nb").alias("moving"), F.round(2 * F.col("n") / F.greatest(F.col("na") + F.col("nb"), F.lit(1)), 6).alias("dice"), F.round(F.when(F.col("n") > least, corr), 5).alias("correlation"))


def verdict_summary(verdicts: DataFrame, near: float = 6.0) -> DataFrame:
    """Counts of each verdict by kind, decided and connected ones in all and near and far, and the share connected."""
    connected, decided = F.col("verdict") == "CONNECTED", F.col("verdict").isin("CONNECTED", "SEPARATE")
    close = F.coalesce(F.col("dist"), F.lit(0.0)) <= near
    c = verdicts.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(connected).alias("connected"), F.count_if(F.col("verdict") == "SEPARATE").alias("separate"), F.count_if(~decided).alias("undecided"), F.count_if(decided & close).alias("near_decided"), F.count_if(connected & close).alias("near_connected"), F.count_if(decided & ~close).alias("far_decided"), F.count_if(connected & ~close).alias("far_connected"))
    n = F.col("connected") + F.col("separate")
    return c.withColumn("precision", F.round(F.when(n > 0, F.col("connected") / F.greatest(n, F.lit(1))), 4))


def composite(cases: DataFrame, weights: dict[str, float], recorded: str, tolerance: float) -> DataFrame:
    """Mean of the weighted score recomputed from its columns, the mean recorded one, and how many cases differ by more than the tolerance."""
    score = reduce(lambda a, b: a + b, [w * F.col(c) for c, w in weights.items()])
    return cases.agg(F.count("*").alias("cases"), *_fixed(score=F.avg(score), recorded=F.avg(recorded)), F.count_if(F.abs(score - F.col(recorded)) > tolerance).alias("different"))


def repair_summary(before: DataFrame, after: DataFrame, base: DataFrame, probability: DataFrame, by: str, floor: float) -> DataFrame:
    """Voxels added and erased in each cube, those new over a baseline, baseline repairs lost, and the added voxels' probabilities.

    before, after and base have by and z, y, x; probability also p.
    """
    keys = [by, *CELL]
    flags = [m.select(*keys).distinct().withColumn(n, F.lit(True)) for n, m in (("was", before), ("now", after), ("other", base))]
    every = reduce(lambda a, b: a.join(b, keys, "full"), flags).fillna(False).join(probability.select(*keys, "p"), keys, "left")
    added, other = F.col("now") & ~F.col("was"), F.col("other") & ~F.col("was")
    p = F.when(added, F.col("p"))
    return every.groupBy(by).agg(F.count_if(added).alias("added"), F.count_if(F.col("was") & ~F.col("now")).alias("erased"), F.count_if(added & ~F.col("other")).alias("new"), F.count_if(other & ~F.col("now")).alias("lost"), *_fixed(mean_p=F.avg(p), p10=F.percentile(p, 0.1), least_p=F.min(p), below=F.avg((p < floor).cast("double"))))


def difference_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Erosion, addition and symmetric difference summed over slices, pooled Dice, and mean and median of the slices' Dice (1 if both are empty).

    scores has teacher, candidate and shared counts of each slice.
    """
    t, c, s = F.col("teacher"), F.col("candidate"), F.col("shared")
    dice = F.when(t + c == 0, 1.0).otherwise(2 * s / F.greatest(t + c, F.lit(1)))
    out = scores.groupBy(*by).agg(F.count("*").alias("slices"), F.sum(t - s).alias("erosion"), F.sum(c - s).alias("addition"), *_fixed(dice=ratio(2 * F.sum(s), F.sum(t + c)), macro_mean=F.avg(dice), macro_median=F.percentile(dice, 0.5)))
    return out.withColumn("difference", F.col("erosion") + F.col("addition"))


def compare_runs(scores: DataFrame, run: str, key: list[str], value: str, left: str, right: str) -> DataFrame:
    """Rows of two runs side by side with the difference, for keys that both have."""
    side = lambda name, alias: scores.where(F.col(run) == name).select(*key, F.col(value).alias(alias))
    return side(left, "left").join(side(right, "right"), key).withColumn("delta", F.col("right") - F.col("left"))


def common_agreement(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of two fields (z, y, x, known, positive) on the voxels that both know, by group of the voxels."""
    both = a.where("known").select(*CELL, F.col("positive").alias("pa")).join(b.where("known").select(*CELL, F.col("positive").alias("pb")), CELL)
    pa, pb = F.col("pa"), F.col("pb")
    c = both.groupBy(*by).agg(F.count("*").alias("common"), F.count_if(pa).alias("a"), F.count_if(pb).alias("b"), F.count_if(pa & pb).alias("both"), F.count_if(pa == pb).alias("same"))
    return c.select(*by, "common", "a", "b", "both", *_fixed(agreement=F.col("same") / F.col("common"), precision=ratio(F.col("both"), F.col("a")), recall=ratio(F.col("both"), F.col("b")), dice=ratio(2 * F.col("both"), F.col("a") + F.col("b"))))


def mesh_metrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, faces, area, longest edge of triangle meshes: vertices (mesh_id, vertex_id, z, y, x), faces (mesh_id, a, b, c)."""
    placed = faces
    for corner in "abc":
        placed = placed.join(vertices.select("mesh_id", F.col("vertex_id").alias(corner), F.struct("z", "y", "x").alias(f"p{corner}")), ["mesh_id", corner])
    edge = {n: [F.col(f"p{q}")[c] - F.col(f"p{p}")[c] for c in CELL] for n, p, q in (("u", "a", "b"), ("v", "a", "c"), ("w", "b", "c"))}
    u, v = edge["u"], edge["v"]
    cross_ = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = lambda x: F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    return placed.groupBy("mesh_id").agg(F.count("*").alias("faces"), F.round(F.sum(size(cross_)) / 2, 4).alias("area"), F.round(F.max(F.greatest(*map(size, edge.values()))), 4).alias("longest_edge"))


def merging_components(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Candidate components over two or more large reference components, the most voxels first, then the most references."""
    return bridges(a, b, least).orderBy(F.col("voxels").desc(), F.col("references").desc(), "candidate")



"""The registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number, hash_number_sql
from lamina.functions import geometry
from lamina.operators import graph, joins, metrics, quality, sampling, stencils, windows
from lamina.plans import audits, checks, growth, matching, reads, records, registration, release, rules, surfaces, tracks  # noqa: F401 (registers its queries)
from lamina.plans.bindings import GRID, LABELS, MASK, N4, N6, PATCHES, SCORES, THRESHOLDS, grid, load, mask, patches, scores
from lamina.plans.registry import QUERIES, SQL, query
from lamina.sources import manifests
from lamina.sources.shared import materialise, shared_dir
from lamina.streaming import counts as streams

FLAGSHIP = "best_threshold"
T = "(select unnest([" + ", ".join(map(str, THRESHOLDS)) + "]) as threshold)"
COUNTS = f"{SCORES}, counts as (select scroll, cast(threshold as double) as threshold, count(*) filter (where score >= cast(threshold as float) and target = 1) as tp, count(*) filter (where score >= cast(threshold as float) and target = 0) as fp, count(*) filter (where score < cast(threshold as float) and target = 1) as fn, count(*) as known, count(*) filter (where target = 1) as positive from scores, {T} where target <> 2 group by all)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def swept(s: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_counts(scores(s, d), THRESHOLDS, ["scroll"])


# Metrics


@query(f"with {COUNTS} select scroll, tp, fp, fn, known - tp - fp - fn as tn, known from counts where threshold = 0.3")
def confusion(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scores(s, d), ["scroll"], 0.3)


@query(f"with {COUNTS} select * from counts")
def threshold_counts(s: SparkSession, d: str) -> DataFrame:
    return swept(s, d)


@query(f"with {COUNTS} select *, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) as dice, round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall, round((tp + fn) / greatest(known, 1), 6) as prevalence, round((tp + fp) / greatest(known, 1), 6) as predicted from counts")
def derived_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.derive(swept(s, d))


MACRO = f"{COUNTS}, macro as (select threshold, round(2 * sum(tp) / greatest(sum(2 * tp + fp + fn), 1), 6) as pooled, round(avg(2 * tp / greatest(2 * tp + fp + fn, 1)), 6) as macro, count(*) as scrolls from counts group by threshold)"


@query(f"with {MACRO} select * from macro")
def pooled_macro(s: SparkSession, d: str) -> DataFrame:
    return metrics.pooled_macro(swept(s, d))


@query(f"with {MACRO} select * from macro order by macro desc, threshold limit 1")
def best_threshold(s: SparkSession, d: str) -> DataFrame:
    return metrics.pooled_macro(swept(s, d)).orderBy(F.col("macro").desc(), "threshold").limit(1)


@query(f"with {COUNTS} select * from (select *, row_number() over (partition by scroll order by 2 * tp / greatest(2 * tp + fp + fn, 1) desc, threshold) as place from counts) where place <= 3")
def top_thresholds(s: SparkSession, d: str) -> DataFrame:
    dice = metrics.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return windows.top_k(swept(s, d), ["scroll"], [dice.desc(), F.col("threshold")], 3)


@query(f"with {SCORES}, long as (select stratum, level, score >= cast(0.3 as float) as hit, baseline, target = 1 as real from (select score, baseline, target, unnest(['scroll', 'patch_band']) as stratum, unnest([scroll, cast(patch % 5 as varchar)]) as level from scores where target <> 2)), sums as (select stratum, level, count(*) as known, count(*) filter (where real) as positive, 2 * count(*) filter (where hit and real) / greatest(count(*) filter (where hit) + count(*) filter (where real), 1) as a, 2 * count(*) filter (where baseline and real) / greatest(count(*) filter (where baseline) + count(*) filter (where real), 1) as b from long group by all) select stratum, level, known, positive, round(a, 6) as dice, round(b, 6) as baseline_dice, round(a - b, 6) as gain from sums")
def stratified_counts(s: SparkSession, d: str) -> DataFrame:
    return metrics.stratified(scores(s, d).withColumn("patch_band", F.col("patch") % 5), ["scroll", "patch_band"], 0.3)


@query(f"with {SCORES}, b as (select scroll, cast(round_even(least(greatest(cast(score as double), 0), 1) * 2047, 0) as int) as bin, count(*) filter (where target = 1) as p, count(*) filter (where target = 0) as n from scores where target <> 2 group by all), c as (select *, sum(p) over w as cp, sum(n) over w as cn, sum(p) over (partition by scroll) as tp, sum(n) over (partition by scroll) as tn from b window w as (partition by scroll order by bin desc rows unbounded preceding)) select scroll, round(sum(p / greatest(tp, 1) * cp / (cp + cn)), 6) as ap, round(sum(n * (cp - p / 2)) / greatest(max(tp) * max(tn), 1), 6) as auroc, round(max(2 * cp / (tp + cp + cn)), 6) as best_dice, round(arg_max(bin, (round(2 * cp / (tp + cp + cn), 12), bin)) / 2047, 6) as best_threshold, round(arg_min(2 * cp / (tp + cp + cn), bin) filter (where bin >= 1024), 6) as dice_at_half, round(max(tp) / (max(tp) + max(tn)), 6) as prevalence from c group by scroll")
def ranking_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.ranking(scores(s, d), ["scroll"])


@query("with b as (select l_returnflag as scroll, cast(least(floor(l_discount * 256), 255) as bigint) as bin, count(*) as n from lineitem group by all), c as (select scroll, bin, sum(n) over w as w, sum(n * bin) over w as m, sum(n) over (partition by scroll) as tw, sum(n * bin) over (partition by scroll) as tm from b window w as (partition by scroll order by bin rows unbounded preceding)), e as (select scroll, bin, round(case when w < tw then (tm::double / tw * w - m) * (tm::double / tw * w - m) / (w * (tw - w)::double) else 0.0 end, 4) as \"between\" from c) select scroll, arg_max(bin, (\"between\", -bin)) as cut, max(\"between\") as \"between\" from e group by scroll")
def otsu(s: SparkSession, d: str) -> DataFrame:
    return metrics.otsu(load(s, d, "lineitem").select(F.col("l_returnflag").alias("scroll"), "l_discount"), ["scroll"], "l_discount")


@query("select l_returnflag as scroll, count(l_extendedprice) as n, round(min(l_extendedprice), 6) as least, round(max(l_extendedprice), 6) as greatest, round(avg(l_extendedprice), 4) as mean, round(quantile_cont(l_extendedprice, 0.1), 4) as q10, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.9), 4) as q90 from lineitem group by all")
def distribution(s: SparkSession, d: str) -> DataFrame:
    return metrics.distribution(load(s, d, "lineitem").withColumnRenamed("l_returnflag", "scroll"), ["scroll"], "l_extendedprice", [0.1, 0.5, 0.9])


@query(f"with {SCORES}, k as (select scroll, least(greatest(cast(score as double), 1e-6), 1 - 1e-6) as p, case when target = 1 then 1.0 else 0.0 end as y from scores where target <> 2) select scroll, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 5) as bce, round(1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1), 5) as soft_dice, count(*) as known from k group by scroll")
def loss_components(s: SparkSession, d: str) -> DataFrame:
    return metrics.loss_components(scores(s, d), ["scroll"])


@query(f"with {SCORES}, s as (select l_suppkey % 8 as z, count(*) filter (where l_discount >= 0.05 and l_tax >= 0.04) as i, count(*) filter (where l_discount >= 0.05) as a, count(*) filter (where l_tax >= 0.04) as b, count(*) as n from lineitem group by 1) select z, round(i / greatest(a + b - i, 1), 6) as iou, round((n - a - b + 2 * i) / n, 6) as agreement from s")
def mask_agreement(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "lineitem").select((F.col("l_suppkey") % 8).alias("z"), (F.col("l_discount") >= 0.05).alias("a"), (F.col("l_tax") >= 0.04).alias("b"))
    return metrics.mask_agreement(rows, ["z"])


@query("select s_nationkey as grp, round(avg(case when s_acctbal < 0 then null else s_acctbal end), 4) as mean, count(*) as cases from supplier group by all")
def nan_means(s: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("s_acctbal") < 0, float("nan")).otherwise(F.col("s_acctbal"))
    return metrics.nan_means(load(s, d, "supplier").select(F.col("s_nationkey").alias("grp"), value.alias("mean")), ["grp"], ["mean"])


# Windows


@query("with f as (select distinct l_returnflag as scroll, l_partkey as i from lineitem where l_discount >= 0.05), r as (select scroll, i - row_number() over (partition by scroll order by i) as g, i from f), c as (select scroll, count(*) as length, min(i) as start from r group by scroll, g) select scroll, length, start from (select *, row_number() over (partition by scroll order by length desc, start) as k from c) where k = 1")
def longest_run(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "lineitem").where("l_discount >= 0.05").select(F.col("l_returnflag").alias("scroll"), F.col("l_partkey").alias("i")).distinct().withColumn("flag", F.lit(True))
    return windows.longest_run(rows, ["scroll"], "i", "flag")


@query(f"with {PATCHES}, h as (select *, {hash_number_sql("'7:' || patch_id")} as h, {hash_number_sql("'8:' || patch_id")} / 4294967296.0 as j from patches) select patch_id, source, round((row_number() over (partition by source order by h, patch_id) - 1 + 0.25 + 0.5 * j) / count(*) over (partition by source), 9) as position from h")
def stratified_order(s: SparkSession, d: str) -> DataFrame:
    return windows.stratified_order(patches(s, d).select("patch_id", "source"), "source", "patch_id", 7)


@query(f"with {PATCHES}, c as (select split, quantile_cont(score, 1/3::double) as a, quantile_cont(score, 2/3::double) as b from patches group by split) select split, case when score <= a then 'low' when score <= b then 'middle' else 'high' end as level, count(*) as n from patches join c using (split) group by all")
def tercile_strata(s: SparkSession, d: str) -> DataFrame:
    return windows.tercile_strata(patches(s, d).select("patch_id", "split", "score"), "split", "score").groupBy("split", "level").agg(F.count("*").alias("n"))


@query("with t as (select s_suppkey as id, abs(s_acctbal) / 1e6 as p from supplier), r as (select id, p, row_number() over (order by p, id) - 1 as k, count(*) over () as n from t) select id, p, min(case when p <= 0.05 / (n - k) then 1 else 0 end) over (order by p, id rows unbounded preceding) = 1 as rejected from r")
def holm(s: SparkSession, d: str) -> DataFrame:
    return windows.holm(load(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 1e6).alias("p")), 0.05)


@query("with m as (select event_type as run, cast(hour(ts) as int) as step, round(avg(value), 6) as v from events group by all) select run, step, v, round(v - lag(v) over (partition by run order by step), 6) as delta, max(v) over (partition by run order by step rows unbounded preceding) as best from m")
def trajectory(s: SparkSession, d: str) -> DataFrame:
    m = load(s, d, "events").groupBy(F.col("event_type").alias("run"), F.hour("ts").alias("step")).agg(F.round(F.avg("value"), 6).alias("v"))
    return windows.trajectory(m, "run", "step", "v")


@query("with p as (select cast(p_size as double) as x, max(p_retailprice) as y from part group by 1), g as (select x, y, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from p), w as (select *, unnest([2.5, 10.25, 33.0]) as x0 from g where x1 is not null) select cast(x0 as double) as \"at\", round(arg_max(y + (y1 - y) * (x0 - x) / (x1 - x), x), 6) as y from w where x <= x0 and x0 <= x1 group by x0")
def interpolate_limit(s: SparkSession, d: str) -> DataFrame:
    return windows.interpolate(load(s, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), [2.5, 10.25, 33.0])


# Joins


@query(f"with {MASK} select in_a, in_b, count(*) as n from (select m.z is not null as in_a, r.z is not null as in_b from mask m full join ref r using (z, y, x)) group by all")
def overlay(s: SparkSession, d: str) -> DataFrame:
    both = joins.overlay(mask(s, d), mask(s, d, 0.06, "other"))
    return both.groupBy("in_a", "in_b").agg(F.count("*").alias("n"))


@query(f"with {MASK}, support as (select distinct z // 4 as cz, y // 4 as cy, x // 4 as cx from grid where value >= 0.1) select z, y, x from mask where (z // 4, y // 4, x // 4) in (select (cz, cy, cx) from support)")
def in_support(s: SparkSession, d: str) -> DataFrame:
    support = mask(s, d, 0.1).select(*[F.floor(F.col(c) / 4).cast("int").alias(f"c{c}") for c in "zyx"]).distinct()
    return joins.in_support(mask(s, d), support, 4)


@query("select c_custkey as key from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def pending_work(s: SparkSession, d: str) -> DataFrame:
    done = load(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return joins.pending(load(s, d, "customer").select(F.col("c_custkey").alias("key")), done, "key")


@query(f"with {COUNTS} select scroll, tp, fp, fn, known, positive, threshold from (select *, row_number() over (partition by scroll order by abs(threshold - 0.42), threshold) as k from counts where abs(threshold - 0.42) <= 0.03) where k = 1")
def nearest_threshold(s: SparkSession, d: str) -> DataFrame:
    return joins.at_threshold(swept(s, d), ["scroll"], 0.42, 0.03)


POINTS = "points as (select cast(l_partkey % 997 as int) as y, cast(l_orderkey % 997 as int) as x from lineitem), boxes as (select s_suppkey as box_id, cast(s_suppkey * 37 % 900 as int) as y0, cast(s_suppkey * 37 % 900 + 20 + s_suppkey % 70 as int) as y1, cast(s_suppkey * 91 % 900 as int) as x0, cast(s_suppkey * 91 % 900 + 15 + s_suppkey % 50 as int) as x1 from supplier)"


@query(f"with {POINTS} select box_id, count(*) as points from points, boxes where y0 <= y and y < y1 and x0 <= x and x < x1 group by box_id")
def points_in_boxes(s: SparkSession, d: str) -> DataFrame:
    points = load(s, d, "lineitem").select((F.col("l_partkey") % 997).cast("int").alias("y"), (F.col("l_orderkey") % 997).cast("int").alias("x"))
    k = F.col("s_suppkey")
    boxes = load(s, d, "supplier").select(k.alias("box_id"), (k * 37 % 900).cast("int").alias("y0"), (k * 37 % 900 + 20 + k % 70).cast("int").alias("y1"), (k * 91 % 900).cast("int").alias("x0"), (k * 91 % 900 + 15 + k % 50).cast("int").alias("x1"))
    return joins.points_in_boxes(points, boxes, 32)


ENDPOINTS = "endpoints as (select o_orderkey as id, cast(o_orderkey // 500 as int) as plane, cast((o_orderkey * 7919 + o_custkey * 31) % 1000 as int) as y, cast((o_custkey * 104729 + o_orderkey) % 1000 as int) as x from orders)"


def endpoints(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return load(s, d, "orders").select(k.alias("id"), F.floor(k / 500).cast("int").alias("plane"), ((k * 7919 + c * 31) % 1000).cast("int").alias("y"), ((c * 104729 + k) % 1000).cast("int").alias("x"))


NEAR = f"{ENDPOINTS}, near as (select a.plane, a.id as a, b.id as b, round(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2), 6) as distance from endpoints a, endpoints b where a.plane = b.plane and a.id < b.id and abs(a.y - b.y) <= 12 and abs(a.x - b.x) <= 12 and (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 144)"


@query(f"with {NEAR} select * from near")
def pairs_within_reach(s: SparkSession, d: str) -> DataFrame:
    return joins.pairs_within(endpoints(s, d), 12)


@query(f"with {ENDPOINTS}, p as (select a.id as a, b.id as b, (a.y - b.y) ** 2 + (a.x - b.x) ** 2 as d2 from endpoints a, endpoints b where a.plane + 1 = b.plane and abs(a.y - b.y) <= 25 and abs(a.x - b.x) <= 25) select a, b, round(sqrt(d2), 6) as distance from (select *, row_number() over (partition by a order by d2, b) as k from p where d2 <= 625) where k = 1")
def nearest_neighbour(s: SparkSession, d: str) -> DataFrame:
    e = endpoints(s, d)
    return joins.nearest(e, e.withColumn("plane", F.col("plane") - 1), 25, ["plane"])


@query(f"with {MASK}, n as (select z + dz as z, y + dy as y, x + dx as x, m.z as oz from mask m, {N6} o(dz, dy, dx)) select cz, cy, cx, count(*) as voxels from (select distinct z, y, x, cast(floor(z / 4) as bigint) as cz, cast(floor(y / 4) as bigint) as cy, cast(floor(x / 4) as bigint) as cx from n) group by all")
def halo_chunks(s: SparkSession, d: str) -> DataFrame:
    grown = stencils.beside(mask(s, d), 6)
    return grown.groupBy(*[F.floor(F.col(c) / 4).cast("bigint").alias(f"c{c}") for c in "zyx"]).agg(F.count("*").alias("voxels"))


# Stencils


@query(f"with {MASK} select distinct z + dz as z, y + dy as y, x + dx as x from mask, (select * from {N6} union all values (0, 0, 0)) o(dz, dy, dx)")
def dilate(s: SparkSession, d: str) -> DataFrame:
    return stencils.dilate(mask(s, d), 6)


@query(f"with {MASK} select z, y, x from (select z + dz as z, y + dy as y, x + dx as x, count(*) as n from mask, {N4} o(dz, dy, dx) group by all) join mask using (z, y, x) where n = 4")
def erode(s: SparkSession, d: str) -> DataFrame:
    return stencils.erode(mask(s, d), 4)


@query(f"with {GRID} select g.z, g.y, g.x, max(h.value) as filtered from grid g, (select * from {N6} union all values (0, 0, 0)) o(dz, dy, dx), grid h where h.z = g.z + dz and h.y = g.y + dy and h.x = g.x + dx group by all")
def max_filter(s: SparkSession, d: str) -> DataFrame:
    return stencils.max_filter(grid(s, d), "value", 6)


@query(f"with {MASK}, e1 as (select m.z, m.y, m.x from mask m, {N6} o(dz, dy, dx), mask n where n.z = m.z + dz and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = 6), e2 as (select m.z, m.y, m.x from e1 m, {N6} o(dz, dy, dx), e1 n where n.z = m.z + dz and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = 6) select z, y, x, 1 + (e1.z is not null)::int + (e2.z is not null)::int as depth from mask left join e1 using (z, y, x) left join e2 using (z, y, x)")
def l1_depth(s: SparkSession, d: str) -> DataFrame:
    return stencils.l1_depth(mask(s, d), 3)


@query(f"with {MASK} select m.z, m.y, m.x, round(sqrt(min((m.z - r.z) ** 2 + (m.y - r.y) ** 2 + (m.x - r.x) ** 2)), 6) as distance from strong m left join ref r on abs(m.z - r.z) <= 2 and abs(m.y - r.y) <= 2 and abs(m.x - r.x) <= 2 and (m.z - r.z) ** 2 + (m.y - r.y) ** 2 + (m.x - r.x) ** 2 <= 4 group by all")
def capped_distance(s: SparkSession, d: str) -> DataFrame:
    return stencils.capped_distance(mask(s, d, 0.09), mask(s, d, 0.06, "other"), 2)


_AXIS = "select g.z, g.y, g.x, sum(h.v * w) / sum(w) as v from {src} h, k, grid g where {on} group by all"
_ON = {"z": "g.z = h.z + k and g.y = h.y and g.x = h.x", "y": "g.z = h.z and g.y = h.y + k and g.x = h.x", "x": "g.z = h.z and g.y = h.y and g.x = h.x + k"}


@query(f"with {GRID}, k as (select k, exp(-k * k / (2 * 0.5 * 0.5)) as w from unnest([-2, -1, 0, 1, 2]) t(k)), g0 as (select z, y, x, value as v from grid), g1 as ({_AXIS.format(src='g0', on=_ON['z'])}), g2 as ({_AXIS.format(src='g1', on=_ON['y'])}), g3 as ({_AXIS.format(src='g2', on=_ON['x'])}) select z, y, x, round(v, 6) as smoothed from g3")
def gaussian(s: SparkSession, d: str) -> DataFrame:
    return stencils.gaussian(grid(s, d), "value", 0.5)


@query(f"with {GRID} select l as level, z >> l as z, y >> l as y, x >> l as x, value from grid, unnest([0, 1, 2]) t(l) where z % (1 << l) = 0 and y % (1 << l) = 0 and x % (1 << l) = 0")
def pyramid(s: SparkSession, d: str) -> DataFrame:
    return stencils.pyramid(grid(s, d).select("z", "y", "x", "value"), "value", 3)


@query(f"with {GRID}, p as (select case when f & 1 > 0 then (select max(z) from grid) - z else z end as z, case when f & 2 > 0 then 63 - y else y end as y, case when f & 4 > 0 then 63 - x else x end as x, value + f / 100 as p from grid, unnest(range(8)) t(f)) select z, y, x, round(avg(p), 6) as p, count(*) as views from p group by all")
def mirror_average(s: SparkSession, d: str) -> DataFrame:
    seen = grid(s, d).select("z", "y", "x", F.col("value"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("flip"))
    planes = 1 + (grid(s, d).agg(F.max("z")).first()[0] or 0)
    return stencils.mirror_average(seen.withColumn("p", F.col("value") + F.col("flip") / 100), (planes, 64, 64))


@query(f"with {GRID}, p as (select z, y, x, oz * 4 as oz, oy * 8 as oy, ox * 8 as ox, value as p from (select *, unnest([z // 4, z // 4 - 1]) as oz, y // 8 as oy, x // 8 as ox from grid) where oz >= 0), w as (select z, y, x, p, greatest(exp(-(((z - oz - 3.5) / 1.0) ** 2 + ((y - oy - 3.5) / 1.0) ** 2 + ((x - ox - 3.5) / 1.0) ** 2) / 2), 1e-4) as w from p) select z, y, x, round(sum(p * w) / sum(w), 6) as p, count(*) as windows from w group by all")
def blend_windows(s: SparkSession, d: str) -> DataFrame:
    base = F.floor(F.col("z") / 4)
    seen = grid(s, d).withColumn("oz", F.explode(F.array(base, base - 1))).where("oz >= 0")
    seen = seen.select("z", "y", "x", (F.col("oz") * 4).alias("oz"), (F.floor(F.col("y") / 8) * 8).alias("oy"), (F.floor(F.col("x") / 8) * 8).alias("ox"), F.col("value").alias("p"))
    return stencils.blend(seen, 8)


@query(f"with {GRID} select z, y, x, value from grid where value >= 0.05")
def chunk_round_trip(s: SparkSession, d: str) -> DataFrame:
    held = grid(s, d).where("value >= 0.05").select("z", "y", "x", "value")
    return stencils.explode_chunks(stencils.implode_chunks(held, "value", 8), 8)


# Components


@query(f"with {MASK}, {LABELS.format(name='lab', src='strong')} select z, label % 4096 // 64 as cy, label % 64 as cx, count(*) as voxels from lab group by z, label")
def voxel_components(s: SparkSession, d: str) -> DataFrame:
    found = graph.voxel_components(mask(s, d, 0.09), 4)
    sizes = found.groupBy("z", "component").agg(F.count("*").alias("voxels"))
    return sizes.select("z", F.shiftright("component", 21).bitwiseAND(F.lit(0x1FFFFF)).alias("cy"), F.col("component").bitwiseAND(F.lit(0x1FFFFF)).alias("cx"), "voxels")


@query(f"with {MASK}, {LABELS.format(name='lab', src='strong')}, sizes as (select z, label, count(*) as n from lab group by all) select z, count(*) as components, count(*) filter (where n >= 3) as meaningful, max(n) as largest, round(max(n) / sum(n), 6) as fraction from sizes group by z")
def component_facts(s: SparkSession, d: str) -> DataFrame:
    return graph.component_facts(graph.voxel_components(mask(s, d, 0.09), 4), ["z"], 3)


@query(f"with {MASK}, sparse as (select z, y, x from grid where other >= 0.08), {LABELS.format(name='cand', src='strong')}, {LABELS.format(name='refs', src='sparse')}, big as (select label from refs group by label having count(*) >= 2), pairs as (select c.label as c, r.label as r, count(*) as n from cand c join refs r using (z, y, x) where r.label in (select label from big) group by all), b as (select c, count(*) as \"references\", cast(sum(n) as bigint) as voxels from pairs group by c having count(*) > 1) select count(*) as bridging, cast(coalesce(sum(\"references\" - 1), 0) as bigint) as excess, cast(coalesce(sum(voxels), 0) as bigint) as voxels from b")
def bridge_metrics(s: SparkSession, d: str) -> DataFrame:
    cand, ref = graph.voxel_components(mask(s, d, 0.09), 4), graph.voxel_components(mask(s, d, 0.08, "other"), 4)
    found = joins.bridges(cand, ref, 2)
    return found.agg(F.count("*").alias("bridging"), F.coalesce(F.sum("excess"), F.lit(0)).alias("excess"), F.coalesce(F.sum("voxels"), F.lit(0)).alias("voxels"))


@query(f"""with recursive {NEAR}, ranked as (select *, row_number() over (partition by plane order by distance, a, b) as k from near),
walk(plane, k, used, a, b, distance, taken) as (select distinct plane, 0::bigint, []::bigint[], null::bigint, null::bigint, null::double, false from near union all select r.plane, r.k, case when list_has_any(w.used, [r.a, r.b]) then w.used else list_concat(w.used, [r.a, r.b]) end, r.a, r.b, r.distance, not list_has_any(w.used, [r.a, r.b]) from walk w join ranked r on r.plane = w.plane and r.k = w.k + 1)
select plane, a, b, distance from walk where taken""")
def greedy_matching(s: SparkSession, d: str) -> DataFrame:
    """Endpoint pairs that a greedy walk accepts, the nearest first; a pair excludes pairs that share an endpoint."""
    near = joins.pairs_within(endpoints(s, d), 12).withColumn("id", F.concat_ws("-", "a", "b"))
    near = materialise(near.withColumns({"priority": F.struct(-F.col("distance"), -F.col("a"), -F.col("b")), "ends": F.array("a", "b")}), "near")
    return near.join(graph.greedy_disjoint(near), "id").select("plane", "a", "b", "distance")


# Sets and checks


@query("select l_orderkey as a, l_linenumber as b, count(*) as rows from lineitem group by all having count(*) > 1")
def check_unique(s: SparkSession, d: str) -> DataFrame:
    return quality.check_unique(load(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")), ["a", "b"])


@query(f"with {PATCHES} select scroll, count(distinct split) as splits, string_agg(distinct split, ',' order by split) as names from patches group by scroll having count(distinct split) > 1")
def check_leakage(s: SparkSession, d: str) -> DataFrame:
    return quality.check_leakage(patches(s, d), "scroll", "split")


@query(f"with {PATCHES}, rule as (select cast(i as bigint) as scroll, case when i < 6 then 'train' else 'val' end as assigned from unnest(range(10)) t(i)) select reason, count(*) as n from (select case when assigned is null then 'unknown' when assigned <> split then 'wrong split' end as reason from patches left join rule using (scroll)) where reason is not null group by all")
def check_policy(s: SparkSession, d: str) -> DataFrame:
    rule = s.range(10).select(F.col("id").alias("scroll"), F.when(F.col("id") < 6, "train").otherwise("val").alias("assigned"))
    return quality.check_policy(patches(s, d), rule, "scroll", "split").groupBy("reason").agg(F.count("*").alias("n"))


@query("with n as (select o_custkey as k, round(sum(o_totalprice), 2) as v from orders group by 1), r as (select c_custkey as k, round(c_acctbal * 100, 2) as v from customer) select k, n.v as now, r.v as recorded from n full join r using (k) where n.v is null or r.v is null or abs(n.v - r.v) > 50000.0")
def check_stats(s: SparkSession, d: str) -> DataFrame:
    now = load(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    recorded = load(s, d, "customer").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 100, 2).alias("v"))
    return quality.check_stats(now, recorded, "k", "v", 50000.0)


@query(f"with {PATCHES} select origin, split, count(*) as n from (select *, 'first' as origin from patches where known union all select *, 'second' as origin from patches where not known) group by all")
def merge_manifests(s: SparkSession, d: str) -> DataFrame:
    p = patches(s, d)
    return quality.merge_manifests({"first": p.where("known"), "second": p.where("not known")}).groupBy("origin", "split").agg(F.count("*").alias("n"))


@query("select side, key, count(*) as n from (select 'left' as side, key from (select o_custkey as key from orders except all select c_custkey + 5 from customer) union all select 'right', key from (select c_custkey + 5 as key from customer except all select o_custkey from orders)) group by all")
def set_differences(s: SparkSession, d: str) -> DataFrame:
    a, b = load(s, d, "orders").select(F.col("o_custkey").alias("key")), load(s, d, "customer").select((F.col("c_custkey") + 5).alias("key"))
    return quality.set_differences(a, b).groupBy("side", "key").agg(F.count("*").alias("n"))


@query(f"with {MASK} select side, count(*) as n from (select 'left' as side from (select * from mask except all select * from ref) union all select 'right' from (select * from ref except all select * from mask)) group by all")
def verify_additive(s: SparkSession, d: str) -> DataFrame:
    return quality.set_differences(mask(s, d), mask(s, d, 0.06, "other")).groupBy("side").agg(F.count("*").alias("n"))


@query("select state, count(*) as keys from (select case when a.k is null then 'listing only' when b.k is null then 'inventory only' else 'both' end as state from (select distinct l_partkey as k from lineitem) a full join (select p_partkey as k from part where p_size > 10) b using (k)) group by all")
def reconcile(s: SparkSession, d: str) -> DataFrame:
    return quality.reconcile(load(s, d, "lineitem").select(F.col("l_partkey").alias("k")), load(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")), "k")


@query(f"with {PATCHES} select coalesce(split, '*') as split, coalesce(source, '*') as source, coalesce(cast(scroll as varchar), '*') as scroll, count(*) as n from patches group by grouping sets ((split), (source), (scroll), (split, source), ())")
def corpus_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.corpus_counts(patches(s, d), ["split", "source", "scroll"])


# Sampling and statistics


@query(f"with {PATCHES} select patch_id, split, source from (select *, row_number() over (partition by source order by {hash_number_sql("'3:' || patch_id")}, patch_id) as k from patches) where k <= 20")
def sample_per_group(s: SparkSession, d: str) -> DataFrame:
    return sampling.sample_n(patches(s, d).select("patch_id", "split", "source"), "source", "patch_id", 20, 3)


@query(f"with {PATCHES}, t as (select patch_id, record, {hash_number_sql("'5:' || patch_id")} as h, row_number() over (partition by record order by {hash_number_sql("'5:' || patch_id")}, patch_id) as k from patches) select patch_id, record from t order by case when k = 1 then 0 else 1 end, h, patch_id limit 500")
def audit_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.audit_sample(patches(s, d).select("patch_id", "record"), "record", "patch_id", 500, 5)


@query(f"with {PATCHES} select split, {hash_number_sql("'9:' || record")} % 5 = 0 as held_out, count(*) as n from patches group by all")
def holdout(s: SparkSession, d: str) -> DataFrame:
    return sampling.holdout(patches(s, d), "record", 5, 9).groupBy("split", "held_out").agg(F.count("*").alias("n"))


def cluster_counts(s: SparkSession, d: str, threshold: float) -> DataFrame:
    return metrics.confusion(scores(s, d), ["scroll", "cluster"], threshold).select("scroll", "cluster", "tp", "fp", "fn")


def _boot(name: str, threshold: float) -> str:
    at = f"cast({threshold} as float)"
    return f"""c_{name} as (select *, row_number() over (partition by scroll order by cluster) - 1 as i, count(*) over (partition by scroll) as n from (select scroll, cluster, count(*) filter (where score >= {at} and target = 1) as tp, count(*) filter (where score >= {at} and target = 0) as fp, count(*) filter (where score < {at} and target = 1) as fn from scores where target <> 2 group by all)),
w_{name} as (select scroll, rep, h % n as i, count(*) as w from (select scroll, rep, n, {hash_number_sql("'11:' || rep || ':' || scroll || ':' || i")} as h from c_{name}, unnest(range(50)) t(rep)) group by all),
{name} as (select rep, avg(2 * tp / greatest(2 * tp + fp + fn, 1)) as macro from (select rep, w_{name}.scroll, sum(w * tp) as tp, sum(w * fp) as fp, sum(w * fn) as fn from w_{name} join c_{name} using (scroll, i) group by all) group by rep)"""


@query(f"with {SCORES}, {_boot('boot', 0.3)} select count(*) as replicates, round(avg(macro), 6) as mean, round(quantile_cont(macro, 0.025), 6) as low, round(quantile_cont(macro, 0.975), 6) as high from boot")
def bootstrap_level(s: SparkSession, d: str) -> DataFrame:
    return sampling.interval(sampling.bootstrap(cluster_counts(s, d, 0.3), 50, 11))


@query(f"with {SCORES}, {_boot('ba', 0.3)}, {_boot('bb', 0.5)} select round(avg(ba.macro - bb.macro), 6) as delta, round(quantile_cont(ba.macro - bb.macro, 0.025), 6) as low, round(quantile_cont(ba.macro - bb.macro, 0.975), 6) as high, round(avg(case when ba.macro <= bb.macro then 1.0 else 0.0 end), 6) as p_not_better from ba join bb using (rep)")
def bootstrap_delta(s: SparkSession, d: str) -> DataFrame:
    return sampling.paired_delta(sampling.bootstrap(cluster_counts(s, d, 0.3), 50, 11), sampling.bootstrap(cluster_counts(s, d, 0.5), 50, 11))


@query("with m as (select l_suppkey as k, avg(l_discount) as a, avg(l_tax) as b from lineitem group by 1) select round(greatest(0.005, 2 * sqrt(avg((a - b) * (a - b)))), 6) as margin from m")
def tie_margin(s: SparkSession, d: str) -> DataFrame:
    m = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return sampling.tie_margin(m.select("k", F.col("a").alias("v")), m.select("k", F.col("b").alias("v")), "k", "v")


@query(f"with {COUNTS}, r as (select scroll, threshold, tp / greatest(tp + fp, 1) as p, tp / greatest(tp + fn, 1) as q from counts) select scroll, threshold, round(greatest((0.4 - p) / 0.4, (0.5 - q) / 0.5), 6) as worst, greatest((0.4 - p) / 0.4, (0.5 - q) / 0.5) <= 0 as passed from r")
def gate_verdict(s: SparkSession, d: str) -> DataFrame:
    r = swept(s, d).select("scroll", "threshold", metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"), metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("q"))
    return sampling.gate_verdict(r, {"p": ("min", 0.4), "q": ("min", 0.5)}).select("scroll", "threshold", "worst", "passed")


# Scalars


@query(f"with {GRID} select format('z{{:05d}}_y{{:05d}}_x{{:05d}}', z, y, x) as cube, z, y, x, cast((z * 64 + y) * 64 + x as bigint) as chunk from grid")
def cube_ids(s: SparkSession, d: str) -> DataFrame:
    g = grid(s, d).select(geometry.cube_id(F.col("z"), F.col("y"), F.col("x")).alias("cube"))
    g = g.select("cube", *geometry.parse_cube_id(F.col("cube")))
    return g.select("cube", "z", "y", "x", geometry.chunk_id(F.col("z"), F.col("y"), F.col("x"), 64, 64).alias("chunk"))


@query(f"with {GRID} select z, y, x, cast(list_sum(list_transform(range(21), lambda i: ((z >> i::int) & 1) * (1::hugeint << (3 * i + 2)::int) + ((y >> i::int) & 1) * (1::hugeint << (3 * i + 1)::int) + ((x >> i::int) & 1) * (1::hugeint << (3 * i)::int))) as bigint) as morton from grid")
def morton_keys(s: SparkSession, d: str) -> DataFrame:
    return grid(s, d).select("z", "y", "x", geometry.morton(F.col("z"), F.col("y"), F.col("x")).alias("morton"))


AFFINE = [0.5, 0.1, 0.0, 3.0, 0.0, 0.4, 0.05, -2.0, 0.02, 0.0, 0.25, 1.0]


@query(f"with {GRID}, f as (select z, y, x, 0.5 * x + 0.1 * y + 3 as fx, 0.4 * y + 0.05 * z - 2 as fy, 0.02 * x + 0.25 * z + 1 as fz from grid) select z, y, x, round(fx::double, 6) as fx, round(fy::double, 6) as fy, round(fz::double, 6) as fz, round(x::double, 6) as bx, round(y::double, 6) as \"by\", round(z::double, 6) as bz from f")
def affine_round_trip(s: SparkSession, d: str) -> DataFrame:
    there = geometry.apply_affine([F.col("x"), F.col("y"), F.col("z")], AFFINE)
    back = geometry.apply_affine(there, geometry.invert_affine(AFFINE))
    return grid(s, d).select("z", "y", "x", *[F.round(c, 6).alias(f"f{n}") for c, n in zip(there, "xyz", strict=True)], *[(F.round(c, 6) + 0.0).alias(f"b{n}") for c, n in zip(back, "xyz", strict=True)])


@query("select l_returnflag as scroll, round(avg((least(greatest(l_quantity * 10, 0.0), 212.0) - 106.0) / 53.0), 6) as mean, cast(sum(cast(round_even(l_discount * 255, 0) as bigint)) as bigint) as quantised from lineitem group by all")
def normalised(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("scroll")).agg(F.round(F.avg(geometry.normalise_ct(F.col("l_quantity") * 10)), 6).alias("mean"), F.sum(geometry.quantise(F.col("l_discount"))).alias("quantised"))


@query(f"with {PATCHES} select patch_id, {hash_number_sql("patch_id")} as h, sha256(cast(patch_id as varchar)) as sha from patches")
def hash_order(s: SparkSession, d: str) -> DataFrame:
    return patches(s, d).select("patch_id", hash_number(F.col("patch_id")).alias("h"), F.sha2(F.col("patch_id").cast("string").cast("binary"), 256).alias("sha"))


# Manifests, journals, streams


@query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n, round(sum(value), 4) as total from events where props is not null group by 1")
def parse_manifest(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import StructType

    lines = load(s, d, "events").where("props is not null").select(F.concat(F.lit('{"value": '), F.col("value").cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}")).alias("value"))
    rows = manifests.parse_manifest(lines, StructType.fromDDL("value double, props struct<k:long>"))
    return rows.groupBy(F.col("props.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {PATCHES} select split, count(*) as n, round(sum(score), 2) as total from patches group by all")
def manifest_round_trip(s: SparkSession, d: str) -> DataFrame:
    import uuid

    p = patches(s, d).select("patch_id", "split", "score")
    path = f"{shared_dir(s)}/manifest-{uuid.uuid4().hex}"
    manifests.write_manifest(p, path, ["split", "patch_id"])
    return manifests.read_manifest(s, path, p.schema).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("select user_id, count(*) as n from (select distinct event_id, user_id from events) group by all")
def journal_append(s: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(s)}/journal-{uuid.uuid4().hex}"
    events = load(s, d, "events").select("event_id", "user_id")
    manifests.append_journal(events.where("event_id % 3 <> 0"), path, "event_id")
    manifests.append_journal(events, path, "event_id")
    return s.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


def event_stream(s: SparkSession, d: str) -> DataFrame:
    schema = load(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(d + "/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_type, cast(least(floor(value / 5.0), 15) as int) as bin, count(*) as n from events group by all")
def stream_histogram(s: SparkSession, d: str) -> DataFrame:
    return streams.run_available(streams.histogram(event_stream(s, d), 16, 5.0), "histogram", "complete")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    return streams.run_available(streams.label_counts(event_stream(s, d), "1 hour", "10 minutes"), "windows", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))

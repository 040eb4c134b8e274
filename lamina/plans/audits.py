"""Queries of the audit figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import audits, graph, stencils
from lamina.plans.bindings import GRID, LABELS, MASK, N4, N6, SCORES, THRESHOLDS, grid, load, mask, scores
from lamina.plans.registry import query

FIELD = f"{GRID}, field as (select z, y, x, cast(value * 10 as float) as score, case when other >= 0.07 then 1 when other < 0.02 then 2 else 0 end as target from grid), known as (select * from field where target <> 2), n7 as (select * from {N6} o(dz, dy, dx) union all values (0, 0, 0)), l2 as (select dz, dy, dx from unnest([-2, -1, 0, 1, 2]) a(dz), unnest([-2, -1, 0, 1, 2]) b(dy), unnest([-2, -1, 0, 1, 2]) c(dx) where abs(dz) + abs(dy) + abs(dx) <= 2)"
FEW = [0.3, 0.5, 0.7, 0.9]
T = "(select unnest([0.3, 0.5, 0.7, 0.9]) as threshold)"


def field(s: SparkSession, d: str) -> DataFrame:
    """z, y, x, score, target: 1 is true, 2 is unknown."""
    target = F.when(F.col("other") >= 0.07, 1).when(F.col("other") < 0.02, 2).otherwise(0)
    return grid(s, d).select("z", "y", "x", (F.col("value") * 10).cast("float").alias("score"), target.alias("target"))


@query(f"""with {FIELD}, d1 as (select distinct k.z, k.y, k.x from known t, n7, known k where t.target = 1 and k.z = t.z + dz and k.y = t.y + dy and k.x = t.x + dx), d2 as (select distinct k.z, k.y, k.x from d1 t, n7, known k where k.z = t.z + dz and k.y = t.y + dy and k.x = t.x + dx),
r as (select k.z, k.y, k.x, max(t.score) as score from known t, l2, known k where k.target = 1 and k.z = t.z + dz and k.y = t.y + dy and k.x = t.x + dx group by all),
c as (select threshold::double as threshold, (select count(*) from known join d2 using (z, y, x) where score >= cast(threshold as float)) as matched_prediction, (select count(*) from known where score >= cast(threshold as float)) as predicted, (select count(*) from r where score >= cast(threshold as float)) as matched_truth, (select count(*) from r) as truth from {T}),
e as (select *, matched_prediction / greatest(predicted, 1) as p, matched_truth / greatest(truth, 1) as q from c)
select threshold, matched_prediction, predicted, matched_truth, truth, round(p, 6) as precision, round(q, 6) as recall, round(1.25 * p * q / greatest(0.25 * p + q, 1e-12), 6) as f0_5 from e""")
def tolerant_counts(s: SparkSession, d: str) -> DataFrame:
    return audits.tolerant_counts(field(s, d), FEW, 2)


@query(f"with {FIELD}, r as (select k.z, k.y, k.x, k.target, max(t.score) as score from known t, l2, known k where k.z = t.z + dz and k.y = t.y + dy and k.x = t.x + dx group by all) select threshold::double as threshold, count(*) filter (where score >= cast(threshold as float) and target = 1) as tp, count(*) filter (where score >= cast(threshold as float) and target = 0) as fp, count(*) filter (where score < cast(threshold as float) and target = 1) as fn, count(*) as known, count(*) filter (where target = 1) as positive from r, {T} group by threshold")
def dilated_counts(s: SparkSession, d: str) -> DataFrame:
    return audits.dilated_counts(field(s, d), FEW, 2)


@query("with c as (select l_partkey as chunk, l_linenumber as label, count(*) as n from lineitem group by all) select chunk, sum(n)::bigint as decoded, (sum(n) - coalesce(sum(n) filter (where label = 7), 0))::bigint as known, coalesce(sum(n) filter (where label in (1, 2)), 0)::bigint as positive, coalesce(sum(n) filter (where label = 7), 0)::bigint as ignored, (sum(n) - coalesce(sum(n) filter (where label in (1, 2, 7)), 0))::bigint as background, string_agg(label || ':' || n, ',' order by label) as observed, coalesce(sum(n) filter (where label = 6), 0)::bigint as unexpected from c group by chunk")
def label_stats(s: SparkSession, d: str) -> DataFrame:
    return audits.label_stats(load(s, d, "lineitem").select(F.col("l_partkey").alias("chunk"), "l_linenumber"), ["chunk"], "l_linenumber", [1, 2], [7], [1, 2, 3, 4, 5, 7])


VOXELS = "voxels as (select l_orderkey as patch, case when l_linenumber = 7 then 2 when l_linestatus = 'F' then 1 else 0 end as target, cast(l_quantity as int) - 5 as image, case when l_tax >= 0.04 then 1 else 0 end as baseline, case when l_discount >= 0.05 then 1 else 0 end as prediction, l_discount as soft from lineitem)"


def voxels(s: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("l_linenumber") == 7, 2).when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return load(s, d, "lineitem").select(F.col("l_orderkey").alias("patch"), target.alias("target"), (F.col("l_quantity").cast("int") - 5).alias("image"), (F.col("l_tax") >= 0.04).cast("int").alias("baseline"), (F.col("l_discount") >= 0.05).cast("int").alias("prediction"), F.col("l_discount").alias("soft"))


@query(f"with {VOXELS}, c as (select patch, count(*) as n, count(*) filter (where target <> 2) as known, count(*) filter (where target = 1) as positive, count(*) filter (where image > 0) as nz, count(*) filter (where target <> 2 and baseline <> target) as wrong, sum(soft) as soft from voxels group by patch) select patch, known, positive, round(known / n, 6) as known_fraction, round(positive / greatest(known, 1), 6) as positive_fraction, round(nz / n, 6) as ct_nonzero_fraction, round(wrong / greatest(known, 1), 6) as pathology_score, round(soft, 6) as soft_mass from c")
def patch_stats(s: SparkSession, d: str) -> DataFrame:
    return audits.patch_stats(voxels(s, d), ["patch"])


@query(f"with {VOXELS}, c as (select patch, count(*) filter (where target <> 2) as known, count(*) filter (where prediction = 1 and target = 1) as tp, count(*) filter (where prediction = 1 and target = 0) as fp, count(*) filter (where prediction = 0 and target = 1) as fn from voxels group by patch) select patch, known, tp, fp, fn, round(case when known > 0 then (fp + fn) / known else 0.0 end, 6) as pathology_score, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 1.0 end, 6) as dice, round(case when tp + fp > 0 then tp / (tp + fp) else 1.0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 1.0 end, 6) as recall from c")
def pathology_scores(s: SparkSession, d: str) -> DataFrame:
    return audits.pathology_scores(voxels(s, d), ["patch"])


@query("with a as (select o_orderpriority as source, o_orderstatus as split, count(*) as n from orders group by all), b as (select o_orderpriority as source, o_orderstatus as split, count(*) as n from orders where o_custkey % 50 <> 0 or o_orderstatus = 'F' group by all) select source, split, a.n as found, b.n as expected from a full join b using (source, split) where a.n is distinct from b.n")
def compare_counts(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("split"), "o_custkey")
    n = F.count("*").alias("n")
    return audits.compare_counts(o.groupBy("source", "split").agg(n), o.where("o_custkey % 50 <> 0 or split = 'F'").groupBy("source", "split").agg(n), ["source", "split"])




@query(f"with {FIELD}, ref as (select z, y, x from grid where other >= 0.06), strong as (select z, y, x from grid where value >= 0.09), da as (select distinct r.z + dz as z, r.y + dy as y, r.x + dx as x from ref r, n7), db as (select distinct r.z + dz as z, r.y + dy as y, r.x + dx as x from strong r, n7), c as (select (select count(*) from strong) as a, (select count(*) from ref) as b, (select count(*) from strong join ref using (z, y, x)) as \"both\", (select count(*) from strong join da using (z, y, x)) as na, (select count(*) from ref join db using (z, y, x)) as nb) select a, b, \"both\", round(\"both\" / greatest(a + b - \"both\", 1), 6) as iou, round(na / greatest(a, 1), 6) as precision, round(nb / greatest(b, 1), 6) as recall from c")
def tolerance_agreement(s: SparkSession, d: str) -> DataFrame:
    return audits.tolerance_agreement(mask(s, d, 0.09), mask(s, d, 0.06, "other"), 1)


def erosions(src: str, name: str, n: int, offsets: str, k: int) -> str:
    """name1 is src; each next one has the voxels of the last whose k neighbours are all in it; name has their depths."""
    parts = [f"{name}1 as (select distinct z, y, x from {src})"]
    for i in range(2, n + 1):
        parts.append(f"{name}{i} as (select m.z, m.y, m.x from {name}{i - 1} m, {offsets} o(dz, dy, dx), {name}{i - 1} n where n.z = m.z + dz and n.y = m.y + dy and n.x = m.x + dx group by all having count(*) = {k})")
    depth = " + ".join(["1", *(f"({name}{i}.z is not null)::int" for i in range(2, n + 1))])
    joins = " ".join(f"left join {name}{i} using (z, y, x)" for i in range(2, n + 1))
    return ", ".join([*parts, f"{name} as (select z, y, x, {depth} as depth from {name}1 {joins})"])


@query(f"with {MASK}, {erosions('mask', 'da', 3, N6, 6)}, {erosions('ref', 'db', 3, N6, 6)}, j as (select z, da.depth as a, db.depth as b from da full join db using (z, y, x)), c as (select z, count(a) as foreground, count(b) as reference_foreground, count(*) filter (where a > 1) as interior, count(*) filter (where b > 1) as reference_interior, coalesce(max(a), 0) as deepest, coalesce(max(b), 0) as reference_deepest, count(*) filter (where a > 1 and b is null) as new_interior from j group by z) select *, round(interior / greatest(foreground, 1), 6) as interior_fraction, round(interior / greatest(foreground, 1) - reference_interior / greatest(reference_foreground, 1), 6) as interior_delta, deepest - reference_deepest as deepest_delta from c")
def thickness(s: SparkSession, d: str) -> DataFrame:
    return audits.thickness(mask(s, d), mask(s, d, 0.06, "other"), ["z"], 1, 3)


_RATES = "round(2 * shared / greatest(candidate + reference, 1), 6) as dice, round(shared / greatest(candidate, 1), 6) as precision, round(shared / greatest(reference, 1), 6) as recall, round(candidate / greatest(reference, 1), 6) as foreground_ratio, round(interior / greatest(candidate, 1), 6) as interior_fraction, round(reference_interior / greatest(reference, 1), 6) as reference_interior_fraction"
SLICES = f"""{MASK}, sparse as (select z, y, x from grid where other >= 0.08), {LABELS.format(name='cand', src='strong')}, {LABELS.format(name='refs', src='sparse')}, {erosions('strong', 'da', 3, N4, 4)}, {erosions('sparse', 'db', 3, N4, 4)},
counts as (select z, count(a.h) as candidate, count(b.h) as reference, count(a.h + b.h) as shared from (select *, 1 as h from strong) a full join (select *, 1 as h from sparse) b using (z, y, x) group by z),
sa as (select z, label, count(*) as n from cand group by all), sb as (select z, label, count(*) as n from refs group by all),
fa as (select z, count(*) as candidate_components, count(*) filter (where n >= 2) as candidate_meaningful, max(n) as candidate_largest from sa group by z), fb as (select z, count(*) as reference_components, count(*) filter (where n >= 2) as reference_meaningful from sb group by z),
dd as (select z, count(*) filter (where da.depth > 1) as interior, count(*) filter (where db.depth > 1) as reference_interior, count(*) filter (where da.depth > 1 and db.depth is null) as new_interior, coalesce(max(da.depth), 0) as deepest, coalesce(max(db.depth), 0) as reference_deepest from da full join db using (z, y, x) group by z),
touch as (select c.z, c.label, count(distinct r.label) as k from cand c join refs r using (z, y, x) where r.label in (select label from sb where n >= 2) group by all), mm as (select z, count(*) as merging, sum(k - 1)::bigint as excess from touch where k > 1 group by z),
slices as (select z, candidate, reference, shared, coalesce(candidate_components, 0) as candidate_components, coalesce(candidate_meaningful, 0) as candidate_meaningful, coalesce(candidate_largest, 0) as candidate_largest, coalesce(reference_components, 0) as reference_components, coalesce(reference_meaningful, 0) as reference_meaningful, interior, reference_interior, new_interior, deepest, reference_deepest, coalesce(merging, 0) as merging, coalesce(excess, 0) as excess, candidate - shared as candidate_only, reference - shared as reference_only from counts left join fa using (z) left join fb using (z) left join dd using (z) left join mm using (z))"""


def slices(s: SparkSession, d: str) -> DataFrame:
    a, b = mask(s, d, 0.09), mask(s, d, 0.08, "other")
    return audits.slice_blob_metrics(a, b, graph.voxel_components(a, 4), graph.voxel_components(b, 4), 2, 1, 3)


@query(f"with {SLICES} select *, {_RATES} from slices")
def slice_blob_metrics(s: SparkSession, d: str) -> DataFrame:
    return slices(s, d)


@query(f"with {SLICES}, t as (select z % 3 as part, count(*) as slices, {', '.join(f'sum({c})::bigint as {c}' for c in ('candidate', 'reference', 'shared', 'candidate_components', 'candidate_meaningful', 'candidate_largest', 'reference_components', 'reference_meaningful', 'interior', 'reference_interior', 'new_interior', 'merging', 'excess', 'candidate_only', 'reference_only'))}, max(deepest) as deepest, max(reference_deepest) as reference_deepest, max(deepest - reference_deepest) as deepest_delta from slices group by 1) select *, {_RATES} from t")
def aggregate_slices(s: SparkSession, d: str) -> DataFrame:
    return audits.aggregate_slices(slices(s, d).withColumn("part", F.col("z") % 3), ["part"])


def _front(t: float, k: int) -> str:
    return f"{erosions(f'(select z, y, x from known where score >= cast({t} as float)) q', f'f{k}_', 5, N6, 6)}, g{k} as (select z // 8 as part, count(*) as n, count(*) filter (where depth > 2) as i, count(*) filter (where depth >= 5) as d from f{k}_ group by 1), h{k} as (select part, coalesce(n, 0) as n, coalesce(i, 0) as i, coalesce(d, 0) as d from (select distinct z // 8 as part from known) left join g{k} using (part)), o{k} as (select {t}::double as threshold, sum(n)::bigint as foreground, round(sum(i) / greatest(sum(n), 1), 6) as interior_share, round(sum(d) / greatest(sum(n), 1), 6) as deep_share, round(avg(case when n > 0 then i / n else 0.0 end), 6) as mean_share from h{k})"


@query(f"with {FIELD}, {', '.join(_front(t, k) for k, t in enumerate(THRESHOLDS))} {' union all '.join(f'select * from o{k}' for k in range(len(THRESHOLDS)))}")
def frontier(s: SparkSession, d: str) -> DataFrame:
    """Shares of voxels deeper than 2 and at least 5 deep at all 17 thresholds of an audit."""
    known = field(s, d).where("target <> 2").withColumn("part", F.floor(F.col("z") / 8))
    return audits.frontier(known, "part", THRESHOLDS)


@query("with c as (select o_orderpriority as stratum, o_orderstatus as scroll, o_orderkey % 13 as max_thickness, o_custkey % 4 = 0 as thick, case o_custkey % 9 when 0 then 'solid-slab' when 1 then 'empty' else 'keep' end as reject_kind, o_orderkey % 100 / 100.0 as interior_fraction, o_custkey % 100 / 100.0 as fill_fraction from orders) select coalesce(stratum, '*') as stratum, coalesce(scroll, '*') as scroll, count(*) as cubes, round(avg((max_thickness >= 6)::int), 6) as deep_rate, round(avg(thick::int), 6) as thick_rate, round(avg((reject_kind = 'solid-slab')::int), 6) as slab_rate, round(avg((reject_kind = 'empty')::int), 6) as empty_rate, round(avg(interior_fraction::double), 6) as mean_interior, round(avg(fill_fraction::double), 6) as mean_fill, round(quantile_cont(max_thickness, 0.5), 6) as median_thickness from c group by grouping sets ((stratum), (scroll), ())")
def cube_summary(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(c % 9 == 0, "solid-slab").when(c % 9 == 1, "empty").otherwise("keep")
    cubes = load(s, d, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("scroll"), (k % 13).alias("max_thickness"), (c % 4 == 0).alias("thick"), kind.alias("reject_kind"), (k % 100 / 100.0).alias("interior_fraction"), (c % 100 / 100.0).alias("fill_fraction"))
    return audits.cube_summary(cubes, ["stratum", "scroll"])


@query(f"with {MASK}, {LABELS.format(name='lab', src='strong')}, s as (select z, label, count(*) as n from lab group by all) select z, sum(n)::bigint as foreground, round(sum(case when n < 4 then n else 0 end) / sum(n), 6) as small_share, count(*) filter (where n >= 4) as pieces from s group by z")
def fragments(s: SparkSession, d: str) -> DataFrame:
    return audits.fragments(graph.voxel_components(mask(s, d, 0.09), 4), ["z"], 4, 4)


@query(f"with {MASK}, dist as (select m.z, m.y, m.x, sqrt(min((m.z - r.z) ** 2 + (m.y - r.y) ** 2 + (m.x - r.x) ** 2)) as distance from strong m left join ref r on abs(m.z - r.z) <= 2 and abs(m.y - r.y) <= 2 and abs(m.x - r.x) <= 2 and (m.z - r.z) ** 2 + (m.y - r.y) ** 2 + (m.x - r.x) ** 2 <= 4 group by all) select z, count(*) as n, round(quantile_cont(distance, 0.5), 6) as p50, round(quantile_cont(distance, 0.9), 6) as p90, round(avg(case when distance <= 1 then 1.0 else 0.0 end), 6) as inside from dist group by z")
def band_thickness(s: SparkSession, d: str) -> DataFrame:
    return audits.band_thickness(stencils.capped_distance(mask(s, d, 0.09), mask(s, d, 0.06, "other"), 2), ["z"], 1.0)


@query(f"with {SCORES}, c as (select cluster, threshold::double as threshold, count(*) filter (where score >= cast(threshold as float)) as student, count(*) filter (where score >= cast(threshold as float) and baseline) as ps, count(*) filter (where baseline) as pp, count(*) filter (where score >= cast(threshold as float) and target = 1) as rs, count(*) filter (where target = 1) as rp from scores, {T} group by all), g as (select coalesce(cluster::varchar, '*') as cluster, threshold, sum(student) as student, sum(ps) as ps, sum(pp) as pp, sum(rs) as rs, sum(rp) as rp, sum((student / greatest(rp, 1) < 0.9)::int) as low from c group by grouping sets ((cluster, threshold), (threshold))) select cluster, threshold, student::bigint as student, ps::bigint as published_shared, rs::bigint as reference_shared, round(2 * ps / greatest(student + pp, 1), 6) as dice_published, round(2 * rs / greatest(student + rp, 1), 6) as dice_reference, round(student / greatest(rp, 1), 6) as foreground_ratio, low::bigint as low_cubes from g")
def joint_sweep(s: SparkSession, d: str) -> DataFrame:
    rows = scores(s, d).select("cluster", "score", F.col("baseline").alias("published"), (F.col("target") == 1).alias("reference"))
    return audits.joint_sweep(rows, "cluster", FEW, 0.9)


@query("with v as (select l_orderkey // 512 as plane, case when l_linenumber = 1 then 0 else cast(l_quantity as int) end as f, cast(l_quantity as int) // 2 + l_linenumber as m from lineitem), c as (select plane, count(*) filter (where f > 0) as na, count(*) filter (where m > 1) as nb, count(*) filter (where f > 0 and m > 1) as n, avg(f) filter (where f > 0 and m > 1) as ma, avg(m) filter (where f > 0 and m > 1) as mb, avg(f * m) filter (where f > 0 and m > 1) as mab, stddev_pop(f) filter (where f > 0 and m > 1) as sa, stddev_pop(m) filter (where f > 0 and m > 1) as sb from v group by 1) select plane, na as fixed, nb as moving, round(2 * n / greatest(na + nb, 1), 6) as dice, round(case when n > 100 then (mab - ma * mb) / ((sa + 1e-6) * (sb + 1e-6)) end, 5) as correlation from c")
def slice_registration(s: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    rows = load(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 512).alias("plane"), F.when(n == 1, 0).otherwise(q).alias("fixed"), (F.floor(q / 2) + n).alias("moving"))
    return audits.slice_registration(rows, "plane")


@query("with v as (select o_orderpriority as kind, case o_custkey % 5 when 0 then 'SEPARATE' when 1 then 'AMBIGUOUS' when 2 then 'NO_DATA' else 'CONNECTED' end as verdict, o_orderkey % 12 as dist from orders), c as (select kind, count(*) as n, count(*) filter (where verdict = 'CONNECTED') as connected, count(*) filter (where verdict = 'SEPARATE') as separate, count(*) filter (where verdict in ('AMBIGUOUS', 'NO_DATA')) as undecided, count(*) filter (where verdict in ('CONNECTED', 'SEPARATE') and dist <= 6) as near_decided, count(*) filter (where verdict = 'CONNECTED' and dist <= 6) as near_connected, count(*) filter (where verdict in ('CONNECTED', 'SEPARATE') and dist > 6) as far_decided, count(*) filter (where verdict = 'CONNECTED' and dist > 6) as far_connected from v group by kind) select *, round(case when connected + separate > 0 then connected / (connected + separate) end, 4) as precision from c")
def verdict_summary(s: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey") % 5
    verdict = F.when(c == 0, "SEPARATE").when(c == 1, "AMBIGUOUS").when(c == 2, "NO_DATA").otherwise("CONNECTED")
    return audits.verdict_summary(load(s, d, "orders").select(F.col("o_orderpriority").alias("kind"), verdict.alias("verdict"), (F.col("o_orderkey") % 12).cast("double").alias("dist")))


@query("select count(*) as cases, round(avg(0.35 * l_discount + 0.35 * l_tax + 0.3 * l_quantity / 50), 6) as score, round(avg(0.3 * l_quantity / 50 + 0.03), 6) as recorded, count(*) filter (where abs(0.35 * l_discount + 0.35 * l_tax + 0.3 * l_quantity / 50 - (0.3 * l_quantity / 50 + 0.03)) > 0.0101) as different from lineitem")
def composite(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity") / 50
    cases = load(s, d, "lineitem").select(F.col("l_discount").alias("surface"), F.col("l_tax").alias("voi"), q.alias("topo"), (0.3 * q + 0.03).alias("recorded"))
    return audits.composite(cases, {"surface": 0.35, "voi": 0.35, "topo": 0.3}, "recorded", 0.0101)


@query(f"with {MASK}, e as (select z, y, x, m.h is not null as was, s.h is not null as now, r.h is not null as other, g.value as p from (select *, 1 as h from ref) m full join (select *, 1 as h from mask) s using (z, y, x) full join (select *, 1 as h from strong) r using (z, y, x) left join grid g using (z, y, x)) select z as cube, count(*) filter (where now and not was) as added, count(*) filter (where was and not now) as erased, count(*) filter (where now and not was and not other) as new, count(*) filter (where other and not was and not now) as lost, round(avg(p) filter (where now and not was), 6) as mean_p, round(quantile_cont(p, 0.1) filter (where now and not was), 6) as p10, round(min(p) filter (where now and not was), 6) as least_p, round(avg((p < 0.08)::int) filter (where now and not was), 6) as below from e group by z")
def repair_summary(s: SparkSession, d: str) -> DataFrame:
    cube = lambda df: df.withColumn("cube", F.col("z"))
    return audits.repair_summary(cube(mask(s, d, 0.06, "other")), cube(mask(s, d)), cube(mask(s, d, 0.09)), cube(grid(s, d).withColumnRenamed("value", "p")), "cube", 0.08)


RUNS = f"{SCORES}, runs as (select threshold::double as threshold, scroll, cluster, count(*) filter (where target = 1) as teacher, count(*) filter (where score >= cast(threshold as float)) as candidate, count(*) filter (where target = 1 and score >= cast(threshold as float)) as shared from scores, {T} group by all)"


def runs(s: SparkSession, d: str) -> DataFrame:
    hit, t = F.col("score") >= F.col("threshold").cast("float"), F.col("target") == 1
    rows = scores(s, d).withColumn("threshold", F.explode(F.array(*map(F.lit, FEW))))
    return rows.groupBy("threshold", "scroll", "cluster").agg(F.count_if(t).alias("teacher"), F.count_if(hit).alias("candidate"), F.count_if(t & hit).alias("shared"))


@query(f"with {RUNS} select scroll, threshold, count(*) as slices, sum(teacher - shared)::bigint as erosion, sum(candidate - shared)::bigint as addition, round(2 * sum(shared) / greatest(sum(teacher + candidate), 1), 6) as dice, round(avg(case when teacher + candidate = 0 then 1.0 else 2 * shared / (teacher + candidate) end), 6) as macro_mean, round(quantile_cont(case when teacher + candidate = 0 then 1.0 else 2 * shared / (teacher + candidate) end, 0.5), 6) as macro_median, (sum(teacher - shared) + sum(candidate - shared))::bigint as difference from runs group by all")
def difference_summary(s: SparkSession, d: str) -> DataFrame:
    return audits.difference_summary(runs(s, d), ["scroll", "threshold"])


@query(f"with {RUNS} select a.cluster, a.threshold, a.shared as \"left\", b.shared as \"right\", b.shared - a.shared as delta from runs a join runs b using (cluster, threshold) where a.scroll = 'A' and b.scroll = 'R'")
def compare_runs(s: SparkSession, d: str) -> DataFrame:
    return audits.compare_runs(runs(s, d), "scroll", ["cluster", "threshold"], "shared", "A", "R")


@query(f"with {GRID}, c as (select z, count(*) as common, count(*) filter (where value >= 0.08) as a, count(*) filter (where other >= 0.06) as b, count(*) filter (where value >= 0.08 and other >= 0.06) as \"both\", count(*) filter (where (value >= 0.08) = (other >= 0.06)) as same from grid where value > 0.01 and other > 0.01 group by z) select z, common, a, b, \"both\", round(same / common, 6) as agreement, round(\"both\" / greatest(a, 1), 6) as precision, round(\"both\" / greatest(b, 1), 6) as recall, round(2 * \"both\" / greatest(a + b, 1), 6) as dice from c")
def common_agreement(s: SparkSession, d: str) -> DataFrame:
    g = grid(s, d)
    a = g.select("z", "y", "x", (F.col("value") > 0.01).alias("known"), (F.col("value") >= 0.08).alias("positive"))
    b = g.select("z", "y", "x", (F.col("other") > 0.01).alias("known"), (F.col("other") >= 0.06).alias("positive"))
    return audits.common_agreement(a, b, ["z"])


MESH = "vertices as (select o_orderkey // 100 as mesh_id, o_orderkey % 100 as vertex_id, min(o_custkey % 50)::double as z, min(o_orderkey % 10)::double as y, min(o_orderkey % 100 // 10)::double as x from orders group by all), faces as (select distinct l_orderkey // 100 as mesh_id, l_orderkey % 100 as a, (l_orderkey + 1) % 100 as b, (l_orderkey + 10) % 100 as c from lineitem)"


def mesh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, n = F.col("o_orderkey"), F.col("l_orderkey")
    vertices = load(s, d, "orders").groupBy(F.floor(k / 100).alias("mesh_id"), (k % 100).alias("vertex_id")).agg(F.min(F.col("o_custkey") % 50).cast("double").alias("z"), F.min(k % 10).cast("double").alias("y"), F.min(F.floor(k % 100 / 10)).cast("double").alias("x"))
    return vertices, load(s, d, "lineitem").select(F.floor(n / 100).alias("mesh_id"), (n % 100).alias("a"), ((n + 1) % 100).alias("b"), ((n + 10) % 100).alias("c")).distinct()


@query(f"with {MESH}, p as (select mesh_id, q.z - p.z as uz, q.y - p.y as uy, q.x - p.x as ux, r.z - p.z as vz, r.y - p.y as vy, r.x - p.x as vx from faces f join vertices p on p.mesh_id = f.mesh_id and p.vertex_id = f.a join vertices q on q.mesh_id = f.mesh_id and q.vertex_id = f.b join vertices r on r.mesh_id = f.mesh_id and r.vertex_id = f.c) select mesh_id, count(*) as faces, round(sum(sqrt((uy * vx - ux * vy) ** 2 + (ux * vz - uz * vx) ** 2 + (uz * vy - uy * vz) ** 2)) / 2, 4) as area, round(max(greatest(sqrt(uz * uz + uy * uy + ux * ux), sqrt(vz * vz + vy * vy + vx * vx), sqrt((vz - uz) ** 2 + (vy - uy) ** 2 + (vx - ux) ** 2))), 4) as longest_edge from p group by mesh_id".replace("select mesh_id, q.z", "select f.mesh_id as mesh_id, q.z"))
def mesh_metrics(s: SparkSession, d: str) -> DataFrame:
    return audits.mesh_metrics(*mesh(s, d))

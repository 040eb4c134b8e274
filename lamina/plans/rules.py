"""Queries of the predicates and the scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number_sql
from lamina.functions import geometry
from lamina.operators import predicates as rules
from lamina.plans.bindings import load
from lamina.plans.registry import query


@query("""with v as (select l_returnflag as scroll, 'labels' as encoding, l_linenumber <> 7 as known, l_linenumber in (1, 2) as positive, case when l_linenumber in (1, 2) then 1.0 else 0.0 end as p from lineitem
union all select l_returnflag, 'probability', l_linenumber <> 7, l_linenumber <> 7 and l_quantity / 50 >= 0.6, case when l_linenumber = 7 then 0.0 else least(greatest(l_quantity / 50, 0.0), 1.0) end from lineitem)
select scroll, encoding, count(*) filter (where known) as known, count(*) filter (where positive) as positive, round(avg(p), 6) as p from v group by all""")
def decode_field(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "lineitem").withColumn("q", F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_quantity")))
    both = [("labels", rules.decode_labels(rows, "l_linenumber", [1, 2], [7])), ("probability", rules.decode_probability(rows, "q", 50.0, 0.6))]
    parts = [df.select(F.col("l_returnflag").alias("scroll"), F.lit(name).alias("encoding"), "known", "positive", "probability") for name, df in both]
    return parts[0].unionByName(parts[1]).groupBy("scroll", "encoding").agg(F.count_if("known").alias("known"), F.count_if("positive").alias("positive"), F.round(F.avg("probability"), 6).alias("p"))


@query("with f as (select l_suppkey as patch, avg(l_quantity) as m, greatest(stddev_pop(l_quantity), 1e-8) as s from lineitem group by 1) select patch, round(min((l_quantity - m) / s), 5) as least, round(max((l_quantity - m) / s), 5) as greatest from lineitem join f on l_suppkey = patch group by patch")
def zscore(s: SparkSession, d: str) -> DataFrame:
    z = rules.zscore(load(s, d, "lineitem").withColumnRenamed("l_suppkey", "patch"), ["patch"], "l_quantity")
    return z.groupBy("patch").agg(F.round(F.min("z"), 5).alias("least"), F.round(F.max("z"), 5).alias("greatest"))


@query("with f as (select l_suppkey as patch, count(*) as n, quantile_cont(l_extendedprice, 0.01) as lo, quantile_cont(l_extendedprice, 0.99) as hi from lineitem where l_tax >= 0.02 group by 1), u as (select l_suppkey as patch, case when n >= 128 and hi > lo then least(greatest((l_extendedprice - lo) / (hi - lo), 0.0), 1.0) else 0.0 end as u from lineitem left join f on l_suppkey = patch) select patch, round(avg(u), 6) as mean, count(*) filter (where u = 1.0) as full from u group by patch")
def robust_unit(s: SparkSession, d: str) -> DataFrame:
    u = rules.robust_unit(load(s, d, "lineitem").withColumnRenamed("l_suppkey", "patch"), ["patch"], "l_extendedprice", F.col("l_tax") >= 0.02)
    return u.groupBy("patch").agg(F.round(F.avg("unit"), 6).alias("mean"), F.count_if(F.col("unit") == 1.0).alias("full"))


@query("select l_returnflag as scroll, count(*) filter (where l_linenumber <> 7 and cast(l_discount * 10 as float) >= cast(0.3 as float)) as hits, count(*) filter (where cast(round_even(l_discount * 2550, 0) as int) >= 77) as hits_u8 from lineitem group by all")
def to_mask(s: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_discount") * 10)
    return load(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("scroll")).agg(F.count_if(rules.to_mask(score, 0.3)).alias("hits"), F.count_if(rules.to_mask_u8(F.bround(F.col("l_discount") * 2550).cast("int"), 0.3)).alias("hits_u8"))


FACTS = "facts as (select l_orderkey as patch, count(*) filter (where l_linenumber <> 7) / count(*) as known_fraction, count(*) filter (where l_linestatus = 'F') as positive_voxels, count(*) filter (where l_discount > 0) / count(*) as ct_nonzero_fraction from lineitem group by 1)"


def patch_facts(s: SparkSession, d: str) -> DataFrame:
    """patch, known_fraction, positive_voxels, ct_nonzero_fraction: one row per order."""
    n = F.count("*")
    return load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("patch")).agg((F.count_if(F.col("l_linenumber") != 7) / n).alias("known_fraction"), F.count_if(F.col("l_linestatus") == "F").alias("positive_voxels"), (F.count_if(F.col("l_discount") > 0) / n).alias("ct_nonzero_fraction"))


@query(f"with {FACTS} select o_orderpriority as source, count(*) as n, sum(patch)::bigint as keys from facts join orders on o_orderkey = patch where known_fraction >= case when contains(o_orderpriority, 'URGENT') then 0.95 else 0.8 end and positive_voxels >= 1 and ct_nonzero_fraction >= 0.75 group by 1")
def acceptable(s: SparkSession, d: str) -> DataFrame:
    facts = patch_facts(s, d).join(load(s, d, "orders").select(F.col("o_orderkey").alias("patch"), F.col("o_orderpriority").alias("supervision_source")), "patch")
    kept = rules.acceptable(facts, 0.8, 1, 0.75, {"URGENT": 0.95})
    return kept.groupBy(F.col("supervision_source").alias("source")).agg(F.count("*").alias("n"), F.sum("patch").alias("keys"))


@query("with k as (select distinct l_partkey as chunk from lineitem), j as (select chunk, p_size / 50.0 as f from k left join part on p_partkey = chunk) select count(*) as before, count(*) filter (where f >= 0.4) as after, count(*) filter (where f is null or f < 0.4) as excluded, (sum(chunk) filter (where f >= 0.4))::bigint as keys from j")
def quality_gate(s: SparkSession, d: str) -> DataFrame:
    records = load(s, d, "part").select(F.col("p_partkey").alias("chunk"), (F.col("p_size") / 50.0).alias("fraction"))
    kept, facts = rules.quality_gate(load(s, d, "lineitem").select(F.col("l_partkey").alias("chunk")), records, "chunk", "fraction", 0.4)
    return facts.join(kept.agg(F.sum("chunk").alias("keys")))


@query("select o_orderkey as anchor from orders where o_orderstatus <> 'P' and o_custkey % 4 <> 0 and o_custkey % 5 <> 0 and o_custkey % 7 <> 0 and (o_orderkey % 10) / 10.0 >= 0.3 and (o_orderkey % 100) / 100.0 >= 0.25 and o_orderkey % 11 <> 0 and (o_orderkey % 11) / 11.0 >= 0.2")
def eligible_anchors(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    registration = F.struct((c % 4 != 0).alias("available"), F.when(c % 5 != 0, F.array(F.lit(0), F.lit(1), F.lit(0))).alias("best_shift_zyx"), ((k % 100) / 100.0).alias("best_structure_ncc"), F.when(k % 11 != 0, (k % 11) / 11.0).alias("peak_margin"), (c % 7 == 0).alias("best_on_search_boundary"))
    rows = load(s, d, "orders").select(k.alias("anchor"), F.when(F.col("o_orderstatus") != "P", "measured").otherwise("failed").alias("status"), registration.alias("registration_3d"), F.struct(((k % 10) / 10.0).alias("fine_ct_support_fraction")).alias("sampling"))
    return rules.eligible_anchors(rows, 0.3, 0.25, 0.2).select("anchor")


REGIONS = "regions as (select s_suppkey as region, cast(s_suppkey * 13 % 200 as bigint) as z0, cast(s_suppkey * 13 % 200 + 16 * (1 + s_suppkey % 3) as bigint) as z1, cast(s_suppkey * 37 % 900 as bigint) as y0, cast(s_suppkey * 37 % 900 + 20 + s_suppkey % 70 as bigint) as y1, cast(s_suppkey * 91 % 896 as bigint) as x0, cast(s_suppkey * 91 % 896 + 15 + s_suppkey % 50 as bigint) as x1 from supplier)"


def regions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    bounds = {"z0": k * 13 % 200, "z1": k * 13 % 200 + 16 * (1 + k % 3), "y0": k * 37 % 900, "y1": k * 37 % 900 + 20 + k % 70, "x0": k * 91 % 896, "x1": k * 91 % 896 + 15 + k % 50}
    return load(s, d, "supplier").select(k.alias("region"), *[c.cast("long").alias(n) for n, c in bounds.items()])


@query(f"with {REGIONS}, a as (select region, z0 // 16 * 16 as z0, (z1 + 15) // 16 * 16 as z1, y0 // 16 * 16 as y0, (y1 + 15) // 16 * 16 as y1, x0 // 16 * 16 as x0, (x1 + 15) // 16 * 16 as x1 from regions) select a.*, (a.z0, a.z1, a.y0, a.y1, a.x0, a.x1) <> (r.z0, r.z1, r.y0, r.y1, r.x0, r.x1) as changed from a join regions r using (region)")
def align_region(s: SparkSession, d: str) -> DataFrame:
    return rules.align_region(regions(s, d), 16)


@query(f"with {REGIONS}, a as (select region, z0 // 16 * 16 as z0, (z1 + 15) // 16 * 16 as z1, y0 // 16 * 16 as y0, (y1 + 15) // 16 * 16 as y1, x0 // 16 * 16 as x0, (x1 + 15) // 16 * 16 as x1 from regions), o as (select region, y0, y1, x0, x1, unnest(range(z0, z1, 16)) as z from a), o2 as (select region, x0, x1, z, unnest(range(y0, y1, 16)) as y from o) select region, z, y, unnest(range(x0, x1, 16)) as x from o2")
def region_origins(s: SparkSession, d: str) -> DataFrame:
    return rules.region_origins(rules.align_region(regions(s, d), 16), 16).select("region", "z", "y", "x")


@query("select count(*) filter (where y between 8 and 55 and x between 8 and 55) as n, count(*) as collapsed from (select l_partkey % 64 as y, l_orderkey % 64 as x from lineitem)")
def interior(s: SparkSession, d: str) -> DataFrame:
    cells = load(s, d, "lineitem").select((F.col("l_partkey") % 64).alias("y"), (F.col("l_orderkey") % 64).alias("x"))
    whole = {"y": F.lit(64), "x": F.lit(64)}
    return rules.interior(cells, 8, whole).agg(F.count("*").alias("n")).join(rules.interior(cells, 32, whole).agg(F.count("*").alias("collapsed")))


@query("select case when l_linenumber < 5 then 'p1' when l_tax > 0.04 then 'p2' when l_discount > 0.05 then 'p3' else 'none' end as part, count(*) as n from lineitem group by 1")
def partition_masks(s: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_linenumber") < 5, F.col("l_linenumber") % 2).otherwise(2)
    rows = load(s, d, "lineitem").select(label.alias("label"), (F.col("l_tax") > 0.04).cast("int").alias("distill_valid"), (F.col("l_discount") > 0.05).cast("int").alias("rehearsal_valid"))
    return rules.partition_masks(rows).groupBy("part").agg(F.count("*").alias("n"))


@query("select case when replace(trim(o_orderpriority), '-', '') in ('1URGENT', '2HIGH') then 'first' when replace(trim(o_orderpriority), '-', '') = '5LOW' then 'last' else trim(o_orderpriority) end as scroll, case o_orderstatus when 'P' then 'val' when 'O' then 'test' else o_orderstatus end as split, count(*) as n from orders group by all")
def canonical_ids(s: SparkSession, d: str) -> DataFrame:
    name = rules.canonical(F.col("o_orderpriority"), {"1URGENT": "first", "2HIGH": "first", "5LOW": "last"})
    return load(s, d, "orders").groupBy(name.alias("scroll"), rules.renamed(F.col("o_orderstatus"), {"P": "val", "O": "test"}).alias("split")).agg(F.count("*").alias("n"))


@query("select case when contains(o_orderpriority, 'URGENT') then 'human' when contains(o_orderpriority, 'LOW') then 'native' end as category, case when v >= 0.1 then 'high' when v > 0 then 'low' else 'zero' end as band, count(*) as n from (select o_orderpriority, o_orderkey % 20 / 100.0 as v from orders) group by all")
def pathology_bands(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "orders").select(rules.supervision_category(F.col("o_orderpriority"), {"URGENT": "human", "LOW": "native"}).alias("category"), (F.col("o_orderkey") % 20 / 100.0).alias("score"))
    return rules.pathology_bands(rows, ["category"], "score")


@query("select case when r <= 0.75 then 'accept' when r <= 2 then 'correct' else 'reject' end as action, count(*) as n from (select sqrt(pow(l_discount * 10, 2) + pow(l_tax * 10, 2) + pow(l_linenumber / 4.0, 2)) as r from lineitem) group by 1")
def registration_actions(s: SparkSession, d: str) -> DataFrame:
    action = rules.registration_action([F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber") / 4.0])
    return load(s, d, "lineitem").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""with c as (select cast(l_quantity as int) as gap, least(l_discount * 10, l_tax * 12.5) as alignment, least(l_linenumber, 3) as anisotropy, 1 + l_discount as arc, l_tax * 10 as mean, l_quantity / 50 as ridge, list_filter([l_discount * 10, l_tax * 10, l_quantity / 50], lambda v: v >= 0.3) as planes, least(l_discount * 20, 1.0) as outward, l_partkey % 90 as turn from lineitem)
select case when not gap >= 3 then 'tiny_gap' when not alignment >= 0.1 then 'endpoint_direction' when not anisotropy >= 2 then 'ambiguous_endpoint_shape' when not arc <= 1.08 then 'excessive_detour' when not mean >= 0.2 then 'weak_mean_probability' when not ridge >= 0.25 then 'off_probability_ridge' when not len(planes) >= 2 then 'insufficient_neighbor_probability_support' when not outward >= 0.5 then 'backwards_anchor_approach' when not turn <= 60 then 'abrupt_local_turn' end as reason, count(*) as n from c group by 1""")
def refusal_reasons(s: SparkSession, d: str) -> DataFrame:
    q, t, c, k = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_linenumber")
    rows = load(s, d, "lineitem").select(c.cast("int").alias("gap_pixels"), F.array(q * 10, t * 12.5).alias("endpoint_alignment"), F.array(k.cast("double"), F.lit(3.0)).alias("endpoint_anisotropy"), (1 + q).alias("arc_ratio"), (t * 10).alias("probability_mean"), (c / 50).alias("probability_ridge_positive_fraction"), F.array(q * 20, F.lit(1.0)).alias("endpoint_outward"), (F.col("l_partkey") % 90).alias("maximum_local_turn_degrees"), F.array(q * 10, t * 10, c / 50).alias("neighbor_probability_coverage"))
    reason = rules.first_refusal([*rules.corridor_rules(3, 0.1, 2.0, 1.08, 0.2, 0.25, 0.3, 2), *rules.refined_path_rules(0.5, 60.0)])
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("select q, round(q / 255.0, 6) as p, count(*) as n from (select cast(round_even(l_tax * 2550, 0) as smallint) as q from lineitem) group by q")
def quantised(s: SparkSession, d: str) -> DataFrame:
    q = load(s, d, "lineitem").groupBy(geometry.quantise(F.col("l_tax") * 10).alias("q")).agg(F.count("*").alias("n"))
    return q.select("q", F.round(rules.dequantise(F.col("q")), 6).alias("p"), "n")


# Scalars


@query(f"with {REGIONS}, t as (select region, case when region % 7 = 0 then 'nothing' else (case when region % 5 = 0 then '-1' else z0::varchar end) || ':' || z1 || ',' || y0 || ':' || (case when region % 6 = 0 then y0 else y1 end) || ',' || x0 || ':' || x1 end as text from regions) select region, case when region % 7 = 0 then null when region % 5 = 0 then -1 else z0 end as z0, case when region % 7 = 0 then null when region % 6 = 0 then y0 else y1 end as y1, case when region % 7 = 0 then 'form' when region % 5 = 0 then 'negative z' when region % 6 = 0 then 'empty y' end as reason from regions join t using (region)")
def parse_region(s: SparkSession, d: str) -> DataFrame:
    k = F.col("region")
    text = F.when(k % 7 == 0, "nothing").otherwise(F.concat(F.when(k % 5 == 0, "-1").otherwise(F.col("z0").cast("string")), F.lit(":"), "z1", F.lit(","), "y0", F.lit(":"), F.when(k % 6 == 0, F.col("y0")).otherwise(F.col("y1")), F.lit(","), "x0", F.lit(":"), "x1"))
    return regions(s, d).select("region", geometry.parse_region(text).alias("r")).select("region", "r.z0", "r.y1", "r.reason")


@query("select p_partkey as chunk, p_partkey // 6 as cz, p_partkey // 3 % 2 as cy, p_partkey % 3 as cx, list_transform([0, 1, 2, 3], lambda k: (p_size + (1 << k::int) - 1) // (1 << k::int))[3]::bigint as size from part")
def chunk_coordinates(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(s, d, "part").select(k.alias("chunk"), *geometry.chunk_coordinate(k, 2, 3), geometry.level_shape(F.col("p_size"), F.lit(2)).alias("size"))


@query(f"select o_orderkey as patch, {hash_number_sql("'7:' || o_custkey || ':' || o_orderkey % 4")} as seed, sha256('{{\"custkey\":' || o_custkey || ',\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}}') as sha from orders")
def record_identity(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"))
    return rows.select(F.col("key").alias("patch"), geometry.record_seed(7, F.col("custkey").cast("string"), (F.col("key") % 4).cast("string")).alias("seed"), geometry.canonical_sha(["key", "custkey", "status"]).alias("sha"))


A, B = [0.5, 0.1, 0.0, 3.0, 0.0, 0.4, 0.05, -2.0, 0.02, 0.0, 0.25, 1.0], [1.0, 0.0, 0.5, 4.0, -0.25, 2.0, 0.0, 0.0, 0.0, 0.5, 1.0, -3.0]


@query("""with p as (select l_orderkey as k, l_linenumber as n, l_quantity as x, l_discount * 100 as y, l_tax * 100 as z from lineitem), b as (select k, n, x + 0.5 * z + 4 as x, -0.25 * x + 2 * y as y, 0.5 * y + z - 3 as z from p)
select n, round(sum(0.5 * x + 0.1 * y + 3), 3) as x, round(sum(0.4 * y + 0.05 * z - 2), 3) as y, round(sum(0.02 * x + 0.25 * z + 1), 3) as z, round(pow(0.5 * (0.4 * 0.25) - 0.1 * (0.0 - 0.05 * 0.02), -1 / 3.0), 6) as scale from b group by n""")
def compose_affine(s: SparkSession, d: str) -> DataFrame:
    m = geometry.compose_affine(A, B)
    point = geometry.apply_affine([F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100], m)
    return load(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(*[F.round(F.sum(c), 3).alias(a) for a, c in zip("xyz", point, strict=True)], F.round(F.lit(geometry.affine_scale(A)), 6).alias("scale"))


@query(f"with {REGIONS}, c as (select region, 0.5 * x + 0.1 * y + 3 as fx, 0.4 * y + 0.05 * z - 2 as fy, 0.02 * x + 0.25 * z + 1 as fz from (select region, unnest([x0, x1]) as x, y0, y1, z0, z1 from regions) a, lateral (select unnest([y0, y1]) as y), lateral (select unnest([z0, z1]) as z)) select region, round(min(fx)::double - 1.5, 6) as x0, round(min(fy)::double - 1.5, 6) as y0, round(min(fz)::double - 1.5, 6) as z0, round(max(fx)::double + 1.5, 6) as x1, round(max(fy)::double + 1.5, 6) as y1, round(max(fz)::double + 1.5, 6) as z1 from c group by region")
def box_image(s: SparkSession, d: str) -> DataFrame:
    r = regions(s, d)
    image = geometry.box_image([F.col("x0"), F.col("y0"), F.col("z0")], [F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("z1") - F.col("z0")], A, 1.5)
    return r.select("region", *[F.round(c, 6).alias(n) for n, c in zip(("x0", "y0", "z0", "x1", "y1", "z1"), image, strict=True)])


@query("""with p as (select p_partkey as key, p_size * 5 as n from part), w as (select key, n, ceil((n - 32) / 16.0) as c, ceil((n - 32) / 22.0) as t from p)
select key, case when n <= 32 then [0] else list_transform(range(c::int + 1), lambda i: round_even(i * (n - 32) / c, 0)::int) end::varchar as steps, case when n <= 32 then [0] else list_transform(range(t::int + 1), lambda i: least(round_even((n - 32) / t * i, 0), n - 32)::int) end::varchar as teacher from w""")
def window_steps(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") * 5
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return load(s, d, "part").select(F.col("p_partkey").alias("key"), text(geometry.window_steps(n, 32, 0.5)).alias("steps"), text(geometry.teacher_steps(n, 32, 0.7)).alias("teacher"))


@query(f"""with p as (select o_orderkey as k, o_custkey % 500 + 0.5 as z, o_orderkey % 700 + 0.25 as y, o_orderkey * 3 % 900 as x from orders)
select k, least(greatest(round_even(z::double, 0)::bigint - 32 - {hash_number_sql("k || ':0'")} % 65, 0), 372) as oz, least(greatest(round_even(y::double, 0)::bigint - 32 - {hash_number_sql("k || ':1'")} % 65, 0), 572) as oy, least(greatest(x - 32 - {hash_number_sql("k || ':2'")} % 65, 0), 772) as ox from p""")
def local_origins(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    origin = geometry.local_origin([F.col("o_custkey") % 500 + 0.5, k % 700 + 0.25, (k * 3 % 900).cast("double")], k, [500, 700, 900], 128, 96, 16)
    return load(s, d, "orders").select(k.alias("k"), *[c.alias(f"o{n}") for c, n in zip(origin, "zyx", strict=True)])


@query("""with p as (select l_orderkey as k, l_linenumber as n, l_partkey % 500 as ay, l_orderkey % 500 as ax, l_partkey % 500 + l_quantity as "by", l_orderkey % 500 + l_linenumber as bx, l_discount * 10 as ty, sqrt(1 - l_discount * l_discount * 100) as tx from lineitem),
c as (select *, sqrt(("by" - ay) ** 2 + (bx - ax) ** 2) as chord from p),
q as (select k, n, ay, "by", chord, unnest(range(21)) as i, ay + chord / 3 * ty as y1, ax + chord / 3 * tx as x1, "by" - chord / 3 * tx as y2, bx - chord / 3 * ty as x2, ax, bx from c),
e as (select *, (1 - i / 20) ** 3 * ay + 3 * (1 - i / 20) ** 2 * (i / 20) * y1 + 3 * (1 - i / 20) * (i / 20) ** 2 * y2 + (i / 20) ** 3 * "by" as y, (1 - i / 20) ** 3 * ax + 3 * (1 - i / 20) ** 2 * (i / 20) * x1 + 3 * (1 - i / 20) * (i / 20) ** 2 * x2 + (i / 20) ** 3 * bx as x from q),
r as (select i, chord, sqrt((y - lag(y) over w) ** 2 + (x - lag(x) over w) ** 2) as step, k, n, ay, ax, "by", bx, y1 from e window w as (partition by k, n, ay, "by", bx, y1 order by i))
select k, count(*) as curves, round(sum(ratio), 4) as ratio from (select k, n, sum(step) / any_value(chord) as ratio from r group by k, n, ay, ax, "by", bx, y1) group by k""")
def arc_ratios(s: SparkSession, d: str) -> DataFrame:
    ay, ax, ty = F.col("l_partkey") % 500, F.col("l_orderkey") % 500, F.col("l_discount") * 10
    tx = F.sqrt(1 - F.col("l_discount") * F.col("l_discount") * 100)
    rows = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", ay.alias("ay"), ax.alias("ax"), (ay + F.col("l_quantity")).alias("by"), (ax + F.col("l_linenumber")).alias("bx"), ty.alias("ty"), tx.alias("tx")).distinct()
    ratio = geometry.arc_ratio([F.col("ay"), F.col("ax")], [F.col("ty"), F.col("tx")], [F.col("by"), F.col("bx")], [-F.col("tx"), -F.col("ty")])
    return rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("curves"), F.round(F.sum(ratio), 4).alias("ratio"))


@query("""with p as (select o_orderkey as k, o_orderkey * 7919 % 1000 as y, o_custkey * 31 % 1000 as x from orders), q as (select *, sqrt((y - 500.5) ** 2 + (x - 480.25) ** 2) as r from p)
select k, case when r >= 1 then round_even(y + 9.5 * (y - 500.5) / r, 0)::int end as "by", case when r >= 1 then round_even(x + 9.5 * (x - 480.25) / r, 0)::int end as bx from q""")
def crosswrap_controls(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pushed = geometry.crosswrap([k * 7919 % 1000, F.col("o_custkey") * 31 % 1000], (500.5, 480.25), 9.5)
    return load(s, d, "orders").select(k.alias("k"), pushed[0].alias("by"), pushed[1].alias("bx"))

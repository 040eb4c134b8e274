"""Queries of surfaces, disks, reports and catalogs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import reports
from lamina.operators import surfaces as surf
from lamina.plans.bindings import load
from lamina.plans.registry import query
from lamina.sources.shared import materialise

NODES = "nodes as materialized (select l_linenumber as map, l_orderkey % 12 as row, l_partkey % 12 as col, (l_orderkey % 12 * 3 + sum(l_partkey) % 3)::double as z, (l_partkey % 12 * 3 + sum(l_suppkey) % 2)::double as y, (l_linenumber * 10 + sum(l_orderkey) % 4)::double as x, sum(l_partkey) % 17 <> 0 as valid from lineitem group by l_linenumber, l_orderkey % 12, l_partkey % 12)"


def nodes(s: SparkSession, d: str) -> DataFrame:
    """map, row, col, z, y, x, valid: a folded sheet for each line number."""
    row, col = F.col("l_orderkey") % 12, F.col("l_partkey") % 12
    sums = load(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("map"), row.alias("row"), col.alias("col")).agg(*[F.sum(f"l_{c}key").alias(c) for c in ("part", "supp", "order")])
    return sums.select("map", "row", "col", (F.col("row") * 3 + F.col("part") % 3).cast("double").alias("z"), (F.col("col") * 3 + F.col("supp") % 2).cast("double").alias("y"), (F.col("map") * 10 + F.col("order") % 4).cast("double").alias("x"), (F.col("part") % 17 != 0).alias("valid"))


POINTS = f"""{NODES}, good as materialized (select * from nodes where valid), ends as (select map, max(row) as last_row, max(col) as last_col from nodes group by 1),
gaps as (select a.map, sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) as gap from good a join good b on a.map = b.map and ((a.row + 1 = b.row and a.col = b.col) or (a.row = b.row and a.col + 1 = b.col))),
n as (select map, greatest(ceil(quantile_cont(gap, 0.5) / 0.6), 1)::int as n from gaps group by 1),
quad as (select map, a.row, a.col, last_row, last_col, n, a.z as z00, a.y as y00, a.x as x00, b.z as z01, b.y as y01, b.x as x01, c.z as z10, c.y as y10, c.x as x10, e.z as z11, e.y as y11, e.x as x11 from good a join ends using (map) join n using (map) join good b on b.map = a.map and b.row = a.row and b.col = least(a.col + 1, last_col) join good c on c.map = a.map and c.row = least(a.row + 1, last_row) and c.col = a.col join good e on e.map = a.map and e.row = least(a.row + 1, last_row) and e.col = least(a.col + 1, last_col)),
i as (select *, unnest(range(case when row = last_row then 1 else n end)) as i from quad), ij as (select *, unnest(range(case when col = last_col then 1 else n end)) as j from i),
points as materialized (select map, {", ".join(f"({c}00 * (1 - j / n) + {c}01 * (j / n)) * (1 - i / n) + ({c}10 * (1 - j / n) + {c}11 * (j / n)) * (i / n) as {c}" for c in "zyx")} from ij)"""


@query(f"with {POINTS} select map, count(*) as n, round(sum(z), 3) as z, round(sum(y), 3) as y, round(sum(x), 3) as x, round(max(x), 6) as top from points group by map")
def densified(s: SparkSession, d: str) -> DataFrame:
    """Figures of the dense points of each surface."""
    return surf.densify(nodes(s, d), ("map",)).groupBy("map").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in "zyx"], F.round(F.max("x"), 6).alias("top"))


@query(f"""with {POINTS}, seeds as (select distinct round_even(z, 0)::int as z, round_even(y, 0)::int as y, round_even(x, 0)::int as x from points), o as (select unnest(range(-3, 4)) as o),
ball as (select a.o as dz, b.o as dy, c.o as dx, a.o * a.o + b.o * b.o + c.o * c.o as d2 from o a, o b, o c where a.o * a.o + b.o * b.o + c.o * c.o <= 9), near as (select z + dz as z, y + dy as y, x + dx as x, min(d2) as d2 from seeds, ball group by all)
select z, case when d2 <= 2.25 then 1 else 0 end as label, count(*) as n, sum(y * 1000 + x)::bigint as places from near where not (d2 > 2.25 and (z + y + x) % 7 = 0) group by 1, 2""")
def rasterized(s: SparkSession, d: str) -> DataFrame:
    """Labels drawn from the surfaces, counted by plane."""
    points = materialise(surf.densify(nodes(s, d), ("map",)), "points")
    labels = surf.rasterize(points, 1.5, 3.0)
    veto = labels.where("(z + y + x) % 7 = 0")
    kept = surf.rasterize(points, 1.5, 3.0, veto)
    return kept.groupBy("z", "label").agg(F.count("*").alias("n"), F.sum((F.col("y") * 1000 + F.col("x")).cast("long")).alias("places"))


CENTRES = "centres as (select (l_orderkey // 1024)::int as z, (l_partkey % 64)::int as y, (l_orderkey % 64)::int as x, max(l_quantity) / 16 as radius from lineitem where l_linenumber = 1 and l_partkey % 8 = 0 group by 1, 2, 3)"


def centres(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "lineitem").where("l_linenumber = 1 and l_partkey % 8 = 0")
    return rows.groupBy(F.floor(F.col("l_orderkey") / 1024).cast("int").alias("z"), (F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_orderkey") % 64).cast("int").alias("x")).agg((F.max("l_quantity") / 16).alias("radius"))


@query(f"with {CENTRES}, o as (select unnest(range(-4, 5)) as o) select distinct z, (y + a.o)::int as y, (x + b.o)::int as x from centres, o a, o b where a.o * a.o + b.o * b.o < radius * radius and y + a.o between 0 and 63 and x + b.o between 0 and 63")
def disks(s: SparkSession, d: str) -> DataFrame:
    """Pixels of the open disks around the centres."""
    return surf.reconstruct_disks(centres(s, d), (64, 64))


@query(f"with {CENTRES}, o as (select unnest(range(-6, 7)) as o) select z, (y + a.o)::int as y, (x + b.o)::int as x, round(max(radius - sqrt(a.o * a.o + b.o * b.o)), 6) as envelope from centres, o a, o b where radius - sqrt(a.o * a.o + b.o * b.o) >= -1.5 and y + a.o between 0 and 63 and x + b.o between 0 and 63 group by all")
def radius_envelope(s: SparkSession, d: str) -> DataFrame:
    """Weighted distance envelope around the centres."""
    return surf.radius_envelope(centres(s, d), (64, 64), -1.5).select("z", "y", "x", F.round("envelope", 6).alias("envelope"))


REPORT = """'{"epoch": ' || event_id || ', "loss": {"bce": ' || (event_id % 7) || '.5, "dice": {"hard": ' || (user_id % 5) || ', "soft": 0.25}}, "name": "' || event_type || '", "ok": ' || (case when user_id % 2 = 0 then 'true' else 'false' end) || ', "props": ' || props || ', "seen": [1, 2], "none": null}'"""


def report_rows(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select("event_id", F.expr(REPORT).alias("report"))


FLAT = "flat as (select event_id, ltrim(replace(fullkey, '.', '/'), '$/') as path, case type when 'BOOLEAN' then (case when atom = 'true' then 1.0 else 0.0 end) else atom::double end as value from (select event_id, {report} as report from events), json_tree(report) where type in ('BOOLEAN', 'UBIGINT', 'BIGINT', 'DOUBLE') and fullkey not like '%[%')".replace("{report}", REPORT)


@query(f"with {FLAT} select path, count(*) as n, round(sum(value), 4) as total, sum(event_id)::bigint as keys from flat group by path")
def flat_metrics(s: SparkSession, d: str) -> DataFrame:
    """Long table of nested reports, summed by path."""
    flat = reports.flatten_metrics(report_rows(s, d), "event_id", "report")
    return flat.groupBy("path").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum("event_id").alias("keys"))


@query("""select event_id, '{"epoch":' || event_id || '.0,"loss":{"bce":' || (event_id % 7) || '.5,"dice":{"hard":' || (user_id % 5) || '.0,"soft":0.25}},"ok":' || (case when user_id % 2 = 0 then '1.0' else '0.0' end) || ',"props":{"k":' || (props::json->>'k') || '.0}}' as report from events""")
def nested_metrics(s: SparkSession, d: str) -> DataFrame:
    """Reports put together again from their long table."""
    return reports.nest_metrics(reports.flatten_metrics(report_rows(s, d), "event_id", "report"), "event_id")


@query("""with s as (select s_nationkey as k, list(s_suppkey % 13 / 2.0 + 0.5) as scans, list((s_suppkey % 11 + 1) / 4.0) filter (where s_suppkey % 3 = 0) as predictions, count(*) as n from supplier group by 1)
select 'scroll-' || k as id, array_to_string(list_sort(list_distinct(scans)), ',') as scan, array_to_string(list_filter(list_sort(list_distinct(scans)), lambda v: v <= 3.0), ',') as fine, array_to_string(list_filter(list_sort(list_distinct(scans)), lambda v: v between 5.0 and 10.0), ',') as coarse, array_to_string(coalesce(list_sort(list_distinct(predictions)), []), ',') as surface, n as segments, len(list_filter(scans, lambda v: v <= 3.0)) > 0 as has_fine from s""")
def scan_catalog(s: SparkSession, d: str) -> DataFrame:
    """Resolution sets of a catalog of scans."""
    k = F.col("s_suppkey")
    rows = load(s, d, "supplier").groupBy(F.concat(F.lit("scroll-"), F.col("s_nationkey").cast("string")).alias("id")).agg(F.collect_list(F.struct((k % 13 / 2.0 + 0.5).alias("px"))).alias("scans"), F.collect_list(F.struct(((k % 11 + 1) / 4.0).alias("px"), F.when(k % 3 == 0, "surface-prediction").otherwise("other").alias("purpose"))).alias("predictions"), F.count("*").alias("n_segments"))
    found = reports.scan_catalog(rows.withColumn("label", F.lit(None).cast("string")), 3.0, 5.0, 10.0)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return found.where("reason is null").select("id", text("scan_px_um").alias("scan"), text("fine_px_um").alias("fine"), text("coarse_px_um").alias("coarse"), text("surface_prediction_px_um").alias("surface"), "segments", "has_fine")

"""Queries of reads from a chunked volume and of box distances, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import reads, stencils
from lamina.plans.bindings import GRID, grid, load
from lamina.plans.registry import query
from lamina.plans.rules import REGIONS, regions


def stored(s: SparkSession, d: str) -> DataFrame:
    """The grid as chunk payloads of 8 x 8 x 8."""
    return stencils.implode_chunks(grid(s, d), "value", 8)


@query(f"with {GRID}, p as (select l_orderkey as k, l_linenumber as n, (l_orderkey // 1024 * 2 + l_tax * 100 % 3 - 1)::int as z, l_suppkey % 70 - 2 as y, l_partkey % 70 - 2 as x from lineitem) select k, count(*) as n, round(sum(coalesce(value, -1)), 6) as total, count(*) filter (where value is null) as missing from p left join grid using (z, y, x) group by k")
def point_values(s: SparkSession, d: str) -> DataFrame:
    """Values of the volume at listed points, some of them outside, summed by order."""
    points = load(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.floor(F.col("l_orderkey") / 1024) * 2 + F.round(F.col("l_tax") * 100) % 3 - 1).cast("int").alias("z"), (F.col("l_suppkey") % 70 - 2).alias("y"), (F.col("l_partkey") % 70 - 2).alias("x"))
    values = reads.read_points(stored(s, d), points, 8, -1.0)
    return values.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("value") == -1.0).alias("missing"))


@query(f"with {GRID}, b as (select p_partkey as k, p_partkey % 12 - 2 as z0, p_partkey % 12 - 2 + p_size % 7 as z1, p_partkey * 7 % 66 - 3 as y0, p_partkey * 7 % 66 + 9 as y1, p_partkey * 5 % 66 - 3 as x0, p_partkey * 5 % 66 + 6 as x1 from part), v as (select k, count(*) as known, sum(value) as total from b join grid on z >= z0 and z < z1 and y >= y0 and y < y1 and x >= x0 and x < x1 group by k) select k, (p_size % 7 * 12 * 9)::bigint as cells, coalesce(known, 0) as known, round(coalesce(total, 0), 6) as total from part join b on k = p_partkey left join v using (k)")
def window_values(s: SparkSession, d: str) -> DataFrame:
    """Windows of the volume that reach over its borders: cells, known ones and their sum."""
    k, n = F.col("p_partkey"), F.col("p_size") % 7
    boxes = load(s, d, "part").select(k.alias("k"), (k % 12 - 2).alias("z0"), (k % 12 - 2 + n).alias("z1"), (k * 7 % 66 - 3).alias("y0"), (k * 7 % 66 + 9).alias("y1"), (k * 5 % 66 - 3).alias("x0"), (k * 5 % 66 + 6).alias("x1"))
    windows = reads.read_windows(stored(s, d), boxes, "k", 8, float("nan"))
    known = F.filter("values", lambda v: ~F.isnan(v))
    return windows.select("k", F.size("values").cast("long").alias("cells"), F.size(known).cast("long").alias("known"), F.round(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"with {REGIONS}, d as (select a.region, b.region as nearest, sqrt(pow(greatest(a.z0 - b.z1, b.z0 - a.z1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2) + pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2)) as distance from regions a, regions b where a.region <> b.region), m as (select * from d where distance <= 90 qualify row_number() over (partition by region order by distance, nearest) = 1) select region, nearest, round(distance, 6) as distance from regions left join m using (region)")
def nearest_boxes(s: SparkSession, d: str) -> DataFrame:
    """Distance of each region to the nearest other one within 90 voxels."""
    rows = regions(s, d)
    return reads.nearest_boxes(rows, rows, "region", 90.0, True).withColumn("distance", F.round("distance", 6))

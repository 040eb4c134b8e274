"""Views of the star tables in the shapes that the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.shared import dealt

THRESHOLDS = [round(0.1 + 0.05 * k, 2) for k in range(17)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scroll, cluster, patch, score (float), target (0, 1, 2 is unknown), baseline (boolean)."""
    target = F.when(F.col("l_linenumber") == 7, 2).when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("scroll"), F.col("l_suppkey").alias("cluster"), F.col("l_orderkey").alias("patch"), (F.col("l_discount") * 10).cast("float").alias("score"), target.alias("target"), (F.col("l_tax") >= 0.04).alias("baseline"))


SCORES = "scores as (select l_returnflag as scroll, l_suppkey as cluster, l_orderkey as patch, cast(l_discount * 10 as float) as score, case when l_linenumber = 7 then 2 when l_linestatus = 'F' then 1 else 0 end as target, l_tax >= 0.04 as baseline from lineitem)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, value, other: one row per known voxel. Planes are pairs for each 1024 order keys, so their number grows with the rows."""
    cell = [(F.floor(F.col("l_orderkey") / 1024) * 2 + F.col("l_linenumber") % 2).cast("int").alias("z"), (F.col("l_partkey") % 64).cast("int").alias("y"), (F.col("l_orderkey") % 64).cast("int").alias("x")]
    lines = load(spark, sf_dir, "lineitem")
    return dealt(lines.select(*cell, "l_discount", "l_tax"), lines.count(), "z", "y", "x").groupBy("z", "y", "x").agg(F.max("l_discount").alias("value"), F.max("l_tax").alias("other"))


GRID = "grid as (select cast(l_orderkey // 1024 * 2 + l_linenumber % 2 as int) as z, cast(l_partkey % 64 as int) as y, cast(l_orderkey % 64 as int) as x, max(l_discount) as value, max(l_tax) as other from lineitem group by all)"


MASK = f"{GRID}, mask as (select z, y, x from grid where value >= 0.07), ref as (select z, y, x from grid where other >= 0.06), strong as (select z, y, x from grid where value >= 0.09)"
N6 = "(values (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))"
N4 = "(values (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1))"
LABELS = "{name} as (with recursive node as (select z * 4096 + y * 64 + x as id, z, y, x from {src}), edge as (select a.id as a, b.id as b from node a, node b where a.z = b.z and (abs(a.y - b.y) + abs(a.x - b.x)) = 1), reach(id, label) as (select id, id from node union select edge.b, reach.label from reach join edge on edge.a = reach.id where reach.label < edge.b) select z, y, x, min(label) as label from reach join node using (id) group by all)"


def mask(s: SparkSession, d: str, least: float = 0.07, column: str = "value") -> DataFrame:
    return grid(s, d).where(F.col(column) >= least).select("z", "y", "x")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, record, scroll, split, source, score, known: one row per order."""
    split = F.when(F.col("o_custkey") % 10 < 7, "train").when(F.col("o_custkey") % 10 < 9, "val").otherwise("test")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patch_id"), F.col("o_custkey").alias("record"), (F.col("o_custkey") % 12).alias("scroll"), split.alias("split"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") != "P").alias("known"))


PATCHES = "patches as (select o_orderkey as patch_id, o_custkey as record, o_custkey % 12 as scroll, case when o_custkey % 10 < 7 then 'train' when o_custkey % 10 < 9 then 'val' else 'test' end as split, o_orderpriority as source, o_totalprice as score, o_orderstatus <> 'P' as known from orders)"

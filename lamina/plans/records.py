"""Queries of the typed scans: files written from the tables, with faulty lines among them, and what the scans make of each line."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.plans.bindings import load
from lamina.plans.registry import query
from lamina.sources import records
from lamina.sources.shared import shared_dir


def stored(s: SparkSession, lines: DataFrame) -> DataFrame:
    path = f"{shared_dir(s)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return records.numbered_lines(s, path)


def outcomes(result: records.Scan, by: list[Column], *sums: Column) -> DataFrame:
    """Accepted rows by the columns by with their sums, and violations by reason."""
    fine = result.rows.groupBy(F.lit("accepted").alias("reason"), *by).agg(F.count("*").alias("n"), *sums)
    bad = result.violations.groupBy("reason").agg(F.count("*").alias("n"))
    return fine.unionByName(bad, allowMissingColumns=True)


def faulty(template: str, faults: dict[int, tuple[str, str]]) -> Column:
    """template for most orders; for those whose fault number is listed, the line that a replacement in it gives."""
    line = F.expr(template)
    number = F.expr("(o_orderkey + o_custkey) % 40")
    chosen = F.coalesce(*[F.when(number == n, F.replace(line, F.lit(old), F.lit(new)) if old else F.lit(new)) for n, (old, new) in faults.items()], line)
    return chosen.alias("value")


COMMON = {1: ("", '{"record_id": '), 2: ("", "[1]"), 3: ("", "  "), 5: ("}", "} x")}
NUMBER = "o as (select *, (o_orderkey + o_custkey) % 40 as f from orders)"


def _case(faults: dict[int, str], column: str = "f") -> str:
    return f"case {column} " + " ".join(f"when {n} then '{r}'" for n, r in faults.items()) + " else 'accepted' end"


PAIR_LINE = """concat('{"record_id": "r', o_orderkey, '", "scroll_id": " PHerc-', o_custkey % 7, '", "split": "', element_at(array('Train', 'val', 'development_holdout'), cast(o_custkey % 3 + 1 as int)), '", "coarse": {"scan_id": "c", "voxel_um": "7.5", "volume": "v/', o_custkey % 5, '.zarr"}, "fine": {"scan_id": "f", "voxel_um": ', o_custkey % 4 + 1, ', "volume": "s3://b/v", "to_coarse_affine_xyz": [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, ', o_custkey % 9, ']]}, "surfaces": [{"surface_id": "a", "coarse_tifxyz": "/x", "fine_tifxyz": "y"}, {"surface_id": "b", "coarse_tifxyz": "/x", "fine_tifxyz": "y", "supervision_weight": ', o_custkey % 3 + 0.5, '}]}')"""
PAIR_FAULTS = COMMON | {4: ("", "# note"), 6: ('"record_id"', '"other"'), 7: ('"split": "', '"split": "no '), 8: ('"7.5"', "-1"), 9: ('"surface_id": "b"', '"surface_id": " a"'), 10: ("[0, 1, 0, 0]", "[0, 1, 0]"), 11: ('{"record_id"', '{"schema_version": 2, "record_id"'), 12: ('"coarse_tifxyz"', '"path"'), 13: ('"scan_id": "f"', '"scan_id": " "'), 14: ('"record_id": "r', '"record_id": "same", "was": "'), 15: ('"surfaces"', '"surface"')}
PAIR_REASONS = dict.fromkeys((1, 2, 5), "not a JSON object") | {6: "record_id is required", 7: "unknown split", 8: "coarse.voxel_um must be positive", 9: "surfaces: surface_id repeated", 10: "fine.to_coarse_affine_xyz must be 3 x 4 finite numbers", 11: "unsupported schema_version", 12: "surfaces: paths are required", 13: "fine.scan_id is required", 14: "record_id repeated", 15: "surfaces must be a non-empty array"}


@query(f"with {NUMBER}, t as (select {_case(PAIR_REASONS)} as reason, o_custkey as c from o where f not in (3, 4)) select reason, case when reason = 'accepted' then ['train', 'val', 'development_holdout'][c % 3 + 1] end as split, case when reason = 'accepted' then 'PHerc-' || (c % 7) end as scroll_id, count(*) as n, sum(c % 4 + 1) filter (where reason = 'accepted')::double as fine_um, sum(c % 9) filter (where reason = 'accepted')::double as shift, round(sum(1 + c % 3 + 0.5) filter (where reason = 'accepted'), 3)::double as weight, sum(1) filter (where reason = 'accepted')::bigint as placed from t group by all")
def pair_manifest(s: SparkSession, d: str) -> DataFrame:
    """Pairs by split and scroll with sums of their fields, and the lines that aren't pairs by reason."""
    result = records.scan_pairs(stored(s, load(s, d, "orders").select(faulty(PAIR_LINE, PAIR_FAULTS))))
    weight = F.aggregate("surfaces", F.lit(0.0), lambda a, x: a + x["supervision_weight"])
    placed = F.col("coarse.volume").startswith(F.concat(records.folder(F.col("file")), F.lit("/v/"))) | F.col("coarse.volume").contains("://")
    return outcomes(result, [F.col("split"), F.col("scroll_id")], F.sum("fine.voxel_um").alias("fine_um"), F.sum(F.col("fine.to_coarse_affine_xyz")[2][3]).alias("shift"), F.round(F.sum(weight), 3).alias("weight"), F.count_if(placed & (F.col("fine.volume") == "s3://b/v")).alias("placed"))


PATCH_LINE = """concat('{"schema_version": 2, "patch_id": "p', o_orderkey, '", "path": "p/', o_orderkey, '", "record_id": "r', o_custkey, '", "scroll_id": "s', o_custkey % 7, '", "split": "', element_at(array('train', 'VAL', 'development_holdout', 'sealed_prize_target'), cast(o_custkey % 4 + 1 as int)), '", "kind": "', if(o_custkey % 2 = 0, 'teacher', ' Student'), '", "origin_zyx": [', o_custkey % 64, ', "2", 3], "shape_zyx": [8, 8, ', o_custkey % 8 + 1, '], "policy_profile": "research"', if(o_custkey % 3 = 0, ', "pitch_um": 2.5', ''), '}')"""
PATCH_FAULTS = COMMON | {4: ("", "# note"), 6: ('"patch_id"', '"id"'), 7: ('"schema_version": 2', '"schema_version": 1'), 8: ('"kind": "', '"kind": "x'), 9: (', "2", 3]', ', "2"]'), 10: ("[8, 8, ", "[8, 0, "), 11: ('"split": "', '"split": "x'), 12: ('"research"', '"open"'), 13: ('"patch_id": "p', '"patch_id": "same", "was": "'), 14: ('"path"', '"where"'), 15: ('"schema_version": 2, ', "")}
PATCH_REASONS = dict.fromkeys((1, 2, 5), "not a JSON object") | {6: "patch_id is required", 7: "unsupported schema_version", 8: "unknown kind", 9: "origin_zyx must be three integers", 10: "shape_zyx must be three positive integers", 11: "unknown split", 12: "unknown policy_profile", 13: "patch_id repeated", 14: "path is required", 15: "unsupported schema_version"}


@query(f"with {NUMBER}, t as (select {_case(PATCH_REASONS)} as reason, o_custkey as c from o where f not in (3, 4)) select reason, case when reason = 'accepted' then ['train', 'val', 'val', 'test'][c % 4 + 1] end as split, case when reason = 'accepted' then case when c % 2 = 0 then 'teacher' else 'student' end end as kind, count(*) as n, sum(c % 64) filter (where reason = 'accepted')::bigint as z, sum(64 * (c % 8 + 1)) filter (where reason = 'accepted')::bigint as voxels, sum(case when c % 3 = 0 then 2.5 else 0 end) filter (where reason = 'accepted')::double as pitch from t group by all")
def patch_manifest(s: SparkSession, d: str) -> DataFrame:
    """Patches by split and kind with sums of their fields, and the lines that aren't patches by reason."""
    result = records.scan_patches(stored(s, load(s, d, "orders").select(faulty(PATCH_LINE, PATCH_FAULTS))))
    voxels = F.aggregate("shape_zyx", F.lit(1).cast("long"), lambda a, v: a * v)
    return outcomes(result, [F.col("split"), F.col("kind")], F.sum(F.col("origin_zyx")[0]).alias("z"), F.sum(voxels).alias("voxels"), F.sum("pitch_um").alias("pitch"))


SITE_LINE = """concat('{"site_id": "s', o_orderkey, '", "record_id": "r', o_custkey % 9, '", "scroll_id": "a", "split": "train", "coarse_origin_zyx": [', o_custkey % 64, ', 2, 3], "site_shape_zyx": [8, 8, 8], "fine_bbox_lo_zyx": [0, 0, 0], "fine_bbox_hi_zyx": [9, 9, ', o_custkey % 30, '], "fine_to_coarse_affine_xyz": [[1, 0, 0, 0.5], [0, 1, 0, 0], [0, 0, 1, 0]]}')"""
SITE_FAULTS = COMMON | {4: ("", "# note"), 6: ('"site_id"', '"id"'), 7: ('"split"', '"part"'), 8: ('"fine_to_coarse_affine_xyz"', '"affine"'), 9: ('"site_id": "s', '"site_id": "same", "was": "')}
SITE_REASONS = dict.fromkeys((1, 2, 4, 5), "not a JSON object") | {6: "site_id is required", 7: "split is required", 8: "fine_to_coarse_affine_xyz is required", 9: "site_id repeated"}


@query(f"with {NUMBER}, t as (select {_case(SITE_REASONS)} as reason, o_custkey as c from o where f <> 3) select reason, case when reason = 'accepted' then 'r' || (c % 9) end as record_id, count(*) as n, sum(c % 64) filter (where reason = 'accepted')::bigint as z, sum(c % 30) filter (where reason = 'accepted')::bigint as hi, sum(0.5) filter (where reason = 'accepted')::double as shift from t group by all")
def site_manifest(s: SparkSession, d: str) -> DataFrame:
    """Sites by record with sums of their fields, and the lines that aren't sites by reason."""
    result = records.scan_sites(stored(s, load(s, d, "orders").select(faulty(SITE_LINE, SITE_FAULTS))))
    return outcomes(result, [F.col("record_id")], F.sum(F.col("coarse_origin_zyx")[0]).alias("z"), F.sum(F.col("fine_bbox_hi_zyx")[2]).alias("hi"), F.sum(F.col("fine_to_coarse_affine_xyz")[0][3]).alias("shift"))


# Chunks lie at (key / 256, key / 16 % 16, key % 16); a third has a field, a third a path in parts and a third a dotted path.
CHUNK_LINE = """concat('{"kind": "', if(o_custkey % 19 = 0, 'meta', 'chunk'), '", ', case o_custkey % 3 when 0 then concat('"coordinate_zyx": [', o_orderkey div 256, ', ', o_orderkey div 16 % 16, ', ', o_orderkey % 16, ']') when 1 then concat('"relative_path": "a/0/', o_orderkey div 256, '/', o_orderkey div 16 % 16, '/', o_orderkey % 16, '"') else concat('"relative_path": "a/0/', o_orderkey div 256, '.', o_orderkey div 16 % 16, '.', o_orderkey % 16, '"') end, ', "size": ', o_custkey % 5, ', "known_voxels": ', o_custkey % 4, ', "positive_voxels": ', o_custkey % 2, '}')"""
CHUNK_FAULTS = COMMON | {6: ('"kind"', '"sort"'), 7: ("a/0/", "b/0/"), 8: ('"size": ', '"size": -1'), 9: ('"coordinate_zyx": [', '"coordinate_zyx": [-'), 10: ('"coordinate_zyx": [', '"coordinate_zyx": [1, ')}


@query(f"with {NUMBER}, t as (select case when f in (1, 2, 5) then 'not a JSON object' when f = 6 then 'kind is required' when f = 8 then 'size must be a number from 0' when f = 9 and c % 3 = 0 and z > 0 then 'coordinate outside the grid' when f = 10 and c % 3 = 0 then 'coordinate isn''t three-dimensional' else 'accepted' end as reason, * from (select f, o_custkey as c, o_orderkey as k, o_orderkey // 256 as z from o) where f <> 3 and (f in (1, 2, 5, 6) or c % 19 <> 0 and not (f = 7 and c % 3 <> 0))), u as (select reason, case when reason = 'accepted' then case when c % 5 = 0 then 'zero_byte' when c % 4 = 0 then 'unknown' else 'retained' end end as state, c, k from t) select reason, state, count(*) as n, sum(c % 5) filter (where reason = 'accepted')::bigint as bytes, sum(c % 4) filter (where reason = 'accepted')::bigint as known, sum(c % 2) filter (where reason = 'accepted')::bigint as positive, sum(k) filter (where reason = 'accepted')::bigint as ids from u group by all")
def chunk_inventory(s: SparkSession, d: str) -> DataFrame:
    """Chunks by state with sums of their fields, and the lines that aren't chunks by reason."""
    lines = stored(s, load(s, d, "orders").select(faulty(CHUNK_LINE, CHUNK_FAULTS)))
    result = records.scan_inventory(lines, (1 << 40, 16, 16), "a/0")
    return outcomes(result, [F.col("state")], F.sum("size").alias("bytes"), F.sum("known").alias("known"), F.sum("positive").alias("positive"), F.sum("chunk_id").alias("ids"))


@query("select metric, n, round(mean, 6) as mean from (select 'dice' as metric, count(*) filter (where l_linenumber <> 3) as n, avg(l_discount) filter (where l_linenumber <> 3) as mean from lineitem union all select 'voi', count(*) filter (where l_linenumber not in (2, 5)), avg(l_tax) filter (where l_linenumber not in (2, 5)) from lineitem)")
def case_tables(s: SparkSession, d: str) -> DataFrame:
    """Means over shards of a CSV whose cells may be nan, empty or words."""
    n = F.col("l_linenumber")
    table = load(s, d, "lineitem").select(F.concat_ws("_", "l_orderkey", n).alias("id"), F.when(n == 3, "nan").otherwise(F.col("l_discount").cast("string")).alias("dice"), F.when(n == 2, "none").when(n != 5, F.col("l_tax").cast("string")).alias("voi"))
    path = f"{shared_dir(s)}/cases-{uuid.uuid4().hex}"
    table.write.option("header", True).csv(path)
    return records.case_means(records.read_cases(s, path)).withColumn("mean", F.round("mean", 6))


def join_lines(s: SparkSession, d: str) -> DataFrame:
    line = """concat('{"z": ', l_orderkey % 50, ', "a": {"y": ', l_partkey % 64, ', "x": ', l_linenumber, '}, "b": {"y": ', l_suppkey % 64, ', "x": ', l_orderkey, '}', case l_linenumber % 4 when 0 then ', "kept": 1, "dist": 2.5' when 1 then ', "kept": true, "support": 3' when 2 then ', "kept": 0, "reason": "tangent"' else ', "reason": "evidence"' end, '}')"""
    return stored(s, load(s, d, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber").select(F.expr(line).alias("value")))


@query("select l_orderkey % 50 as z, count(*) as n, sum(case when l_linenumber % 4 = 0 then 2.5 else 0 end)::double as dist, sum(case when l_linenumber % 4 = 1 then 3 else 0 end)::bigint as support, min('join_z' || (l_orderkey % 50) || '_a' || (l_partkey % 64) || '_' || l_linenumber || '_b' || (l_suppkey % 64) || '_' || l_orderkey) as first_id from lineitem where l_linenumber % 4 < 2 group by all")
def join_rows(s: SparkSession, d: str) -> DataFrame:
    return records.read_joins(join_lines(s, d)).groupBy("z").agg(F.count("*").alias("n"), F.sum("dist").alias("dist"), F.sum("support").alias("support"), F.min("row_id").alias("first_id"))


@query("select 'reject:evidence' as kind, 40::bigint as n, count(*) >= 40 as enough from lineitem where l_linenumber % 4 = 3")
def reject_rows(s: SparkSession, d: str) -> DataFrame:
    """The first 40 rejects for want of evidence: how many, and whether all are of that kind."""
    first = records.read_rejects(join_lines(s, d), ["evidence"], 40)
    return first.groupBy("kind").agg(F.count("*").alias("n"), F.every(F.col("ax") % 4 == 3).alias("enough"))


@query("with h as (select o_custkey as run, row_number() over (partition by o_custkey order by o_orderkey) as place, o_orderkey % 9 = 0 as late from orders) select case when late then 'expected epoch ' || place else 'accepted' end as reason, count(*) as n, case when not late then sum(place)::bigint end as epochs from h group by late, case when late then 'expected epoch ' || place else 'accepted' end")
def training_history(s: SparkSession, d: str) -> DataFrame:
    """Histories of the customers (one each, as partitioned lines): consecutive epochs, and the lines that break the order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    epoch = place + F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)
    lines = load(s, d, "orders").select(F.concat(F.lit("run"), "o_custkey").alias("file"), place.cast("long").alias("line"), F.to_json(F.struct(epoch.alias("epoch"), F.col("o_totalprice").alias("loss"))).alias("value"))
    return outcomes(records.scan_history(lines), [], F.sum("epoch").alias("epochs"))


@query("select l_suppkey as surface, count(*) as n, sum(l_partkey)::bigint as total from lineitem where l_orderkey % 3 = 0 and l_linenumber % 3 = 0 and l_quantity <> 7 and l_linestatus = 'F' group by all")
def surface_samples(s: SparkSession, d: str) -> DataFrame:
    """Every third row and column of surfaces with sentinels, infinite points and a mask."""
    x = F.when(F.col("l_quantity") == 7, F.when(F.col("l_orderkey") % 2 == 0, -1.0).otherwise(float("inf"))).otherwise(F.col("l_partkey").cast("double"))
    cells = load(s, d, "lineitem").select(F.col("l_suppkey").alias("surface"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.col("l_linestatus") == "F").cast("int").alias("mask"))
    return records.surface_points(cells, 3).groupBy("surface").agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("total"))

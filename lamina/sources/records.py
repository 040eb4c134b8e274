"""Typed scans of manifests, inventories, case tables and histories: accepted rows, and what is wrong with which line.

A scan never fails on a line: each line that isn't accepted is a row of the violations (file, line, reason), with the first rule that
it breaks. Blank lines are skipped. A value that is null counts as missing. Numbers may be given as JSON strings.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.sources.shared import materialise

# Names of splits, what they mean for training, kinds of patches and profiles of policies.
SPLITS = {"train": "train", "val": "val", "test": "test", "development_holdout": "val", "sealed_prize_target": "test"}
KINDS = ["teacher", "student"]
PROFILES = ["prize-safe", "research"]
SITE_COLUMNS = ["site_id", "record_id", "scroll_id", "split", "coarse_origin_zyx", "site_shape_zyx", "fine_bbox_lo_zyx", "fine_bbox_hi_zyx", "fine_to_coarse_affine_xyz"]

SCAN = "struct<scan_id:string, voxel_um:string, volume:string, baseline:string, teacher:string, to_coarse_affine_xyz:array<array<string>>>"
SURFACE = "struct<surface_id:string, sheet_id:string, coarse_tifxyz:string, fine_tifxyz:string, supervision_source:string, supervision_weight:string>"
PAIR = f"schema_version string, record_id string, scroll_id string, split string, coarse {SCAN}, fine {SCAN}, surfaces array<{SURFACE}>"
PATCH = "schema_version string, patch_id string, path string, record_id string, scroll_id string, split string, kind string, origin_zyx array<string>, shape_zyx array<string>, policy_profile string, pitch_um string, sampling_stratum string"
CHUNK = "kind string, coordinate_zyx array<string>, relative_path string, size string, known_voxels string, positive_voxels string"
JOIN = "z string, a struct<y:string, x:string>, b struct<y:string, x:string>, kept string, reason string, dist string, support string, far_tier string"


class Scan(NamedTuple):
    rows: DataFrame
    violations: DataFrame


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 in each file) and value of text files. Blocks of a file are counted where they are read; only counts are ordered."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value").withColumn("_id", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = read.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    starts = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return read.join(starts, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def resolved(path: Column, base: Column) -> Column:
    """A path below base unless it is absolute or names a store (scheme://)."""
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(base, F.lit("/"), path))


def number(text: Column) -> Column:
    return text.try_cast("double")


def whole(text: Column) -> Column:
    return F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def _text(column: Column | str) -> Column:
    return F.trim(F.col(column) if isinstance(column, str) else column)


def _some(column: Column | str) -> Column:
    return F.length(_text(column)) > 0


def _positive(column: Column) -> Column:
    return (number(column) > 0) & ~F.isnan(number(column))


def _finite(value: Column) -> Column:
    return number(value).isNotNull() & ~F.isnan(number(value)) & (F.abs(number(value)) < float("inf"))


def screened(lines: DataFrame, schema: str, rules: list[tuple[Column, str]], comments: bool = True) -> DataFrame:
    """file, line, value, the fields of schema, and reason: the first rule (what must hold, its name) that isn't true; null if all are."""
    used = lines.where(F.trim("value") != "")
    if comments:
        used = used.where(~F.ltrim("value").startswith("#"))
    # The parser stops after the first value, so the line is also parsed inside an array and inside an object: both fail if more follows.
    alone = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"r":'), "value", F.lit(',"e":1}'))).isNotNull()
    # What parses alone and begins with a brace is an object: it isn't parsed once more to see that.
    is_object = F.col("value").rlike(r"^[ \t\r\n]*\{") & alone
    rows = used.select("file", "line", "value", is_object.alias("_object"), F.from_json("value", schema).alias("_row"))
    ladder = [(F.col("_object"), "not a JSON object"), *rules]
    rows = rows.select("file", "line", "value", "_object", "_row.*")
    return rows.withColumn("reason", F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), name) for c, name in ladder], F.lit(None).cast("string"))).drop("_object")


def scan(marked: DataFrame, key: list[str], columns: list[Column]) -> Scan:
    """Rows without a reason whose key no other such row has; the others are violations. No row at all is a violation without a line.

    The marked lines are written to the shared folder: lines are read and parsed once, whatever is asked of the rows and violations.
    """
    marked = materialise(marked, "scan")
    fine = marked.where("reason is null")
    name = ", ".join(key)
    repeated = fine.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    rows = fine.join(repeated, key, "left_anti").select("file", "line", *columns)
    copies = fine.join(repeated, key, "left_semi").select("file", "line", F.lit(f"{name} repeated").alias("reason"))
    none = rows.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.lit("no rows").alias("reason"))
    return Scan(rows, marked.where("reason is not null").select("file", "line", "reason").unionByName(copies).unionByName(none))


def _all(items: Column, holds: Callable[[Column], Column]) -> Column:
    return F.forall(items, lambda x: F.coalesce(holds(x), F.lit(False)))


def _scan_rules(name: str) -> list[tuple[Column, str]]:
    affine = F.col(f"{name}.to_coarse_affine_xyz")
    given = F.get_json_object("value", f"$.{name}.to_coarse_affine_xyz")
    fits = (F.size(affine) == 3) & F.forall(affine, lambda r: (F.size(r) == 4) & F.forall(r, lambda v: F.coalesce(_finite(v), F.lit(False))))
    return [(_some(f"{name}.scan_id"), f"{name}.scan_id is required"), (_positive(F.col(f"{name}.voxel_um")), f"{name}.voxel_um must be positive"), (F.coalesce(fits, F.lit(False)) | (F.coalesce(given, F.lit("null")) == "null"), f"{name}.to_coarse_affine_xyz must be 3 x 4 finite numbers")]


def _scan_fields(name: str, base: Column) -> Column:
    c = F.col(name)
    paths = [F.when(F.length(c[p]) > 0, resolved(c[p], base)).alias(p) for p in ("volume", "baseline", "teacher")]
    affine = F.transform(c["to_coarse_affine_xyz"], lambda r: F.transform(r, number))
    return F.struct(_text(c["scan_id"]).alias("scan_id"), number(c["voxel_um"]).alias("voxel_um"), *paths, affine.alias("to_coarse_affine_xyz")).alias(name)


def folder(file: Column) -> Column:
    return F.regexp_replace(file, "/[^/]*$", "")


def scan_pairs(lines: DataFrame, scroll: Column | None = None) -> Scan:
    """Pairs of a coarse and a fine scan with their surfaces; record_id is unique, surface_id within its record. scroll: the id's normal form."""
    base, s = folder(F.col("file")), F.col("surfaces")
    each = [
        (lambda x: _some(x["surface_id"]), "surface_id is required"),
        (lambda x: F.coalesce(_some(x["sheet_id"]), F.lit(True)), "sheet_id is empty"),
        (lambda x: F.coalesce(_some(x["supervision_source"]), F.lit(True)), "supervision_source is empty"),
        (lambda x: x["supervision_weight"].isNull() | F.coalesce(_positive(x["supervision_weight"]), F.lit(False)), "supervision_weight must be positive"),
        (lambda x: x["coarse_tifxyz"].isNotNull() & x["fine_tifxyz"].isNotNull(), "paths are required"),
    ]
    rules = [
        (F.coalesce(whole(F.col("schema_version")), F.lit(1)) == F.when(F.col("schema_version").isNull() | whole(F.col("schema_version")).isNotNull(), 1), "unsupported schema_version"),
        (_some("record_id"), "record_id is required"),
        (F.lower(_text("split")).isin(*SPLITS), "unknown split"),
        (F.size(s) > 0, "surfaces must be a non-empty array"),
        *[(_all(s, holds), f"surfaces: {name}") for holds, name in each],
        (F.size(F.array_distinct(F.transform(s, lambda x: F.trim(x["surface_id"])))) == F.size(s), "surfaces: surface_id repeated"),
        (_some("scroll_id"), "scroll_id is required"),
        *_scan_rules("coarse"),
        *_scan_rules("fine"),
    ]
    surface = F.transform(s, lambda x: F.struct(F.trim(x["surface_id"]).alias("surface_id"), F.trim(F.coalesce(x["sheet_id"], x["surface_id"])).alias("sheet_id"), resolved(x["coarse_tifxyz"], base).alias("coarse_tifxyz"), resolved(x["fine_tifxyz"], base).alias("fine_tifxyz"), F.trim(F.coalesce(x["supervision_source"], F.lit("manual-tifxyz"))).alias("supervision_source"), F.coalesce(number(x["supervision_weight"]), F.lit(1.0)).alias("supervision_weight")))
    columns = ["record_id", (F.trim("scroll_id") if scroll is None else scroll).alias("scroll_id"), F.lower(_text("split")).alias("split"), _scan_fields("coarse", base), _scan_fields("fine", base), surface.alias("surfaces")]
    return scan(screened(lines, PAIR, rules).withColumn("record_id", _text("record_id")), ["record_id"], columns)


def scan_patches(lines: DataFrame, scroll: Column | None = None) -> Scan:
    """Patch manifest of version 2: required columns, known kinds, splits and profiles, positive shapes; patch_id is unique."""
    origin, shape = F.transform("origin_zyx", whole), F.transform("shape_zyx", whole)
    split = F.lower("split")
    required = [(F.col(c).isNotNull(), f"{c} is required") for c in ("patch_id", "path", "record_id", "scroll_id", "split", "kind", "origin_zyx", "shape_zyx", "policy_profile")]
    rules = [
        *required,
        (whole(F.col("schema_version")) == 2, "unsupported schema_version"),
        (F.lower(_text("kind")).isin(KINDS), "unknown kind"),
        ((F.size(origin) == 3) & F.forall(origin, lambda v: v.isNotNull()), "origin_zyx must be three integers"),
        ((F.size(shape) == 3) & F.forall(shape, lambda v: F.coalesce(v > 0, F.lit(False))), "shape_zyx must be three positive integers"),
        (split.isin(*SPLITS), "unknown split"),
        (F.lower(_text("policy_profile")).isin(PROFILES), "unknown policy_profile"),
        (F.col("pitch_um").isNull() | number(F.col("pitch_um")).isNotNull(), "pitch_um must be a number"),
    ]
    normal = F.coalesce(*[F.when(split == a, b) for a, b in SPLITS.items()])
    columns = ["patch_id", resolved(F.col("path"), folder(F.col("file"))).alias("path"), "record_id", (F.trim("scroll_id") if scroll is None else scroll).alias("scroll_id"), normal.alias("split"), F.lower(_text("kind")).alias("kind"), origin.alias("origin_zyx"), shape.alias("shape_zyx"), F.lower(_text("policy_profile")).alias("policy_profile"), F.coalesce(number(F.col("pitch_um")), F.lit(0.0)).alias("pitch_um"), F.coalesce("sampling_stratum", F.lit("uniform")).alias("sampling_stratum")]
    return scan(screened(lines, PATCH, rules), ["patch_id"], columns)


def scan_sites(lines: DataFrame) -> Scan:
    """Site manifest: its nine columns are required, site_id is unique. Lines that begin with # aren't comments here."""
    arrays = [c for c in SITE_COLUMNS if c.endswith("_zyx")]
    kinds = {c: "array<long>" for c in arrays} | {"fine_to_coarse_affine_xyz": "array<array<double>>"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in SITE_COLUMNS)
    rules = [(F.col(c).isNotNull(), f"{c} is required") for c in SITE_COLUMNS]
    return scan(screened(lines, schema, rules, comments=False), ["site_id"], [F.col(c) for c in SITE_COLUMNS])


def scan_inventory(lines: DataFrame, grid: tuple[int, int, int], array: str = "") -> Scan:
    """Chunks of an array from its inventory: chunk_id, z, y, x, size, known, positive, state.

    The coordinate is coordinate_zyx or the path below array, as z/y/x or z.y.x; paths of other arrays or of another shape aren't
    chunks. state is zero_byte (size 0: a placeholder, nothing to read), unknown (no known voxel) or retained. A missing size or
    known_voxels counts as retained.
    """
    parts = F.split(F.regexp_replace("relative_path", r"\\", "/"), "/")
    key = [p for p in array.split("/") if p]
    below = F.slice(parts, F.lit(len(key) + 1), F.greatest(F.size(parts) - len(key), F.lit(0)))
    below = F.when(F.size(below) == 1, F.split(below[0], r"\.")).otherwise(below)
    below = F.when(F.slice(parts, 1, len(key)) == F.array(*[F.lit(k) for k in key]), below) if key else below
    place = F.transform(F.coalesce("coordinate_zyx", F.when(F.size(below) == 3, below)), whole)
    at = [F.get("_place", i) for i in range(3)]
    inside = [F.coalesce((c >= 0) & (c < n), F.lit(False)) for c, n in zip(at, grid, strict=True)]
    size = whole(F.col("size"))
    rows = screened(lines, CHUNK, [(F.col("kind").isNotNull(), "kind is required")], comments=False)
    rows = rows.where("reason is not null or kind = 'chunk'").withColumn("_place", place)
    rows = rows.where("reason is not null or coordinate_zyx is not null or (_place is not null and forall(_place, v -> v is not null))")
    ladder = [
        (F.size("_place") == 3, "coordinate isn't three-dimensional"),
        (inside[0] & inside[1] & inside[2], "coordinate outside the grid"),
        (F.col("size").isNull() | F.coalesce(size >= 0, F.lit(False)), "size must be a number from 0"),
    ]
    rows = rows.withColumn("reason", F.coalesce("reason", *[F.when(~F.coalesce(c, F.lit(False)), name) for c, name in ladder]))
    rows = rows.withColumn("chunk_id", F.when(F.col("reason").isNull(), (at[0] * grid[1] + at[1]) * grid[2] + at[2]))
    known, positive = whole(F.col("known_voxels")), F.coalesce(whole(F.col("positive_voxels")), F.lit(0))
    state = F.when(size == 0, "zero_byte").when(known == 0, "unknown").otherwise("retained")
    return scan(rows, ["chunk_id"], ["chunk_id", at[0].alias("z"), at[1].alias("y"), at[2].alias("x"), size.alias("size"), known.alias("known"), positive.alias("positive"), state.alias("state")])


def inventory_summary(rows: DataFrame) -> DataFrame:
    """Chunks, bytes, known and positive voxels of each state."""
    return rows.groupBy("state").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.sum("positive").alias("positive"), F.count_if(F.col("positive") > 0).alias("with_positive"))


def read_cases(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Shards of a CSV of metrics per case. All shards must have the first one's header, else the read fails with the file's name.

    Cells that aren't numbers are null, NaN too.
    """
    header = spark.read.option("header", True).csv(path).schema
    cases = spark.read.option("header", True).option("enforceSchema", False).schema(header).csv(path)
    cells = [F.col(f"`{c}`").try_cast("double") for c in cases.columns if c != key]
    return cases.select(key, *[F.when(~F.isnan(v), v).alias(c) for v, c in zip(cells, [c for c in cases.columns if c != key], strict=True)])


def case_means(cases: DataFrame, key: str = "id") -> DataFrame:
    """metric, n, mean over the cases that have it."""
    long = cases.unpivot([key], [c for c in cases.columns if c != key], "metric", "value")
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def _joins(lines: DataFrame) -> DataFrame:
    ends = [whole(F.col(f"{e}.{c}")).alias(f"{e}{c}") for e in "ab" for c in "yx"]
    return screened(lines, JOIN, [], comments=False).where("reason is null").select("file", "line", whole(F.col("z")).alias("z"), *ends, "kept", F.coalesce(F.get_json_object("value", "$.reason"), F.lit("")).alias("reason"), F.coalesce(number(F.col("dist")), F.lit(0.0)).alias("dist"), F.coalesce(whole(F.col("support")), F.lit(0)).alias("support"), F.coalesce(whole(F.col("far_tier")), F.lit(0)).alias("far_tier"))


def _row_id(kind: Column) -> Column:
    return F.concat(kind, F.lit("_z"), F.col("z"), F.lit("_a"), F.col("ay"), F.lit("_"), F.col("ax"), F.lit("_b"), F.col("by"), F.lit("_"), F.col("bx"))


def read_joins(lines: DataFrame, kept_only: bool = True) -> DataFrame:
    """Joins between two ends of a plane, with an id made of their places. kept may be a number or a boolean; missing is not kept."""
    rows = _joins(lines)
    if kept_only:
        rows = rows.where(F.coalesce(number(F.col("kept")) != 0, F.col("kept") == "true", F.lit(False)))
    return rows.select("file", "line", _row_id(F.lit("join")).alias("row_id"), "z", "ay", "ax", "by", "bx", "dist", "support", "far_tier")


def read_rejects(lines: DataFrame, reasons: list[str], limit: int) -> DataFrame:
    """The first limit rejected joins, in order of file and line, whose reason is listed."""
    rows = _joins(lines).where(F.col("reason").isin(reasons)).withColumn("kind", F.concat(F.lit("reject:"), "reason"))
    return rows.select("file", "line", _row_id(F.col("kind")).alias("row_id"), "kind", "z", "ay", "ax", "by", "bx").orderBy("file", "line").limit(limit)


def scan_history(lines: DataFrame, first: int = 1) -> Scan:
    """Epochs of training histories (a file each), which must be consecutive from first; rows have file, line, epoch and the JSON value."""
    rows = screened(lines, "epoch string", [(whole(F.col("epoch")).isNotNull(), "epoch must be an integer")], comments=False)
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1 + first
    rows = rows.withColumn("_expected", place).withColumn("epoch", whole(F.col("epoch")))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("epoch") != F.col("_expected"), F.concat(F.lit("expected epoch "), "_expected"))))
    return scan(rows, ["file", "epoch"], ["epoch", "value"])


def surface_points(cells: DataFrame, stride: int = 1) -> DataFrame:
    """Valid points of traced surfaces on every stride-th row and column of their parameter grids.

    cells has row, col, x, y, z and may have mask. A point is valid if it is finite and not negative, and its mask isn't 0; without a mask
    column points at (0, 0, 0) aren't valid.
    """
    valid = F.lit(True)
    for c in "xyz":
        valid = valid & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    valid = valid & ((F.col("mask") != 0) if "mask" in cells.columns else ((F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)))
    return cells.where(valid & (F.col("row") % stride == 0) & (F.col("col") % stride == 0))

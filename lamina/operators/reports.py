"""Nested reports as long tables of metrics and back; scan catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.sources.shared import materialise


def flatten_metrics(reports: DataFrame, key: str, report: str) -> DataFrame:
    """key, path and value of every number and truth value of a JSON report, at any depth; path joins the names by "/".

    Truth values count as 0 or 1; texts, nulls and lists are left out, and so are reports that are no object or no JSON. The reports are
    opened level by level as variants, all rows of a level at once. They are dealt out first: files of small rows have few splits.
    """
    dealt = reports.select(key, F.col(report).alias("report")).repartition(key, "report")
    level = dealt.select(key, F.lit("").alias("path"), F.try_parse_json("report").alias("v"))
    spark, out, depth = reports.sparkSession, None, 0
    while True:
        # A variant is opened by a lateral join, so every level is one pass over the values that are still objects; entries of lists have no name.
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "child")).where("name is not null")
        rows = opened.select(key, F.concat("path", F.when(F.col("path") != "", "/").otherwise(""), "name").alias("path"), F.schema_of_variant("child").alias("kind"), F.col("child").alias("v"))
        number = F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double")).when(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get("v", "$", "double"))
        found = materialise(rows.select(key, "path", number.alias("value"), F.when(F.col("kind").like("OBJECT%"), F.col("v")).alias("v")), f"level{depth}")
        numbers = found.where("value is not null").select(key, "path", "value")
        out = numbers if out is None else out.unionByName(numbers)
        level = found.where("v is not null").select(key, "path", "v")
        depth += 1
        if not level.take(1):
            return out


def nest_metrics(metrics: DataFrame, key: str) -> DataFrame:
    """key and report: the JSON object of the rows (key, path, value) of each key, names in order; the inverse of flatten_metrics.

    A name that is both a value and an object keeps the object; null values are left out. The rows of a report meet once, in order of their
    names: each then opens the objects that the row before isn't in and closes those that the next one isn't in.
    """
    # to_json of a list of one name gives the quoted name in brackets; U+0001, which it escapes, stands for a comma until it is known
    # whether something follows.
    quoted = lambda name: F.btrim(F.to_json(F.array(name)), F.lit("[]"))
    names = metrics.where("path is not null").select(key, F.split("path", "/").alias("names"), F.col("value").cast("string").alias("json"))
    leaf = F.concat(quoted(F.element_at("names", -1)), F.lit(":"), "json", F.lit("\x01"))
    rows = names.select(key, F.struct("names", leaf.alias("leaf")).alias("row"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    follows = lambda r, i: F.slice(F.get("rows", i + 1).names, 1, F.size(r.names)) == r.names
    rows = rows.select(key, F.filter("rows", lambda r, i: ~F.coalesce(follows(r, i), F.lit(False))).alias("rows"))
    # Objects of a row: how many of them the row at the other place is in too.
    depth = lambda r: F.size(r.names) - 1
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))

    def shared(r: Column, other: Column) -> Column:
        levels = steps(F.least(depth(r), depth(other)))
        return F.coalesce(F.size(F.filter(levels, lambda k: F.slice(r.names, 1, k) == F.slice(other.names, 1, k))), F.lit(0))

    def entry(r: Column, i: Column) -> Column:
        before = F.when(i > 0, shared(r, F.get("rows", i - 1))).otherwise(0)
        opened = F.array_join(F.transform(F.slice(r.names, before + 1, depth(r) - before), lambda n: F.concat(quoted(n), F.lit(":{"))), "")
        return F.concat(opened, F.coalesce(r.leaf, F.lit("")), F.repeat(F.lit("}\x01"), depth(r) - shared(r, F.get("rows", i + 1))))

    text = F.concat(F.lit("{"), F.array_join(F.transform("rows", entry), ""), F.lit("}"))
    return rows.select(key, F.replace(F.replace(text, F.lit("\x01}"), F.lit("}")), F.lit("\x01"), F.lit(",")).alias("report"))


def _sizes(column: str, keep=None) -> Column:
    """Different sizes px of an array of structs, rising."""
    rows = F.filter(column, lambda s: s.px.isNotNull() & (keep(s) if keep else F.lit(True)))
    return F.array_sort(F.array_distinct(F.transform(rows, lambda s: s.px.cast("double"))))


def scan_catalog(catalog: DataFrame, fine_most: float, coarse_least: float, coarse_most: float) -> DataFrame:
    """The resolutions of each sample of a catalog (id, label, scans (px), predictions (px, purpose), n_segments).

    scan, fine, coarse and surface-prediction sizes are rising sets; missing lists are empty. reason names a bad row: no id, an id
    that stands more than once, or a size outside (0, 1000); null for the others.
    """
    none = F.array().cast("array<double>")
    scans = F.coalesce(_sizes("scans"), none)
    rows = catalog.select("id", F.coalesce("label", "id").alias("label"), scans.alias("scan_px_um"), F.coalesce(_sizes("predictions", lambda p: F.coalesce(p.purpose == "surface-prediction", F.lit(False))), none).alias("surface_prediction_px_um"), F.coalesce("n_segments", F.lit(0)).alias("segments"))
    rows = rows.withColumns({"fine_px_um": F.filter("scan_px_um", lambda v: v <= fine_most), "coarse_px_um": F.filter("scan_px_um", lambda v: (v >= coarse_least) & (v <= coarse_most))})
    several = catalog.groupBy("id").agg(F.count("*").alias("times"))
    rows = rows.join(several, rows["id"].eqNullSafe(several["id"])).drop(several["id"])
    reason = F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id").when(F.col("times") > 1, "duplicate id").when(F.exists("scan_px_um", lambda v: (v <= 0) | (v >= 1000)), "invalid pixel size")
    return rows.select("id", "label", "scan_px_um", "fine_px_um", "coarse_px_um", "surface_prediction_px_um", "segments", (F.size("fine_px_um") > 0).alias("has_fine"), (F.size("coarse_px_um") > 0).alias("has_coarse"), reason.alias("reason"))

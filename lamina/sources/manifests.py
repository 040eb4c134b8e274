"""JSONL manifests: strict reading with line numbers of what is wrong, canonical writing, append-only journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_manifest(lines: DataFrame, schema: StructType) -> DataFrame:
    """Rows of text lines (value): blank lines and those that begin with # are skipped; lines that don't parse fail."""
    used = lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return used.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that aren't JSON objects."""
    used = lines.where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return used.where(F.get_json_object("value", "$").isNull() | ~F.ltrim("value").startswith("{"))


def read_manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return parse_manifest(spark.read.text(path), schema)


def to_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, keys in the order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_manifest(df: DataFrame, path: str, order: list[str]) -> None:
    to_lines(df.repartitionByRange(*order).sortWithinPartitions(*order)).write.text(path)


def append_journal(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the journal lacks; returns them. A first write makes the journal."""
    spark = df.sparkSession
    try:
        held = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df.dropDuplicates([key])
    else:
        fresh = df.dropDuplicates([key]).join(held, key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh

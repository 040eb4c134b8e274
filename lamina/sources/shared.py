"""Tables in the folder that the driver and all executors see; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def large(df: DataFrame) -> DataFrame:
    """df as a side of joins that is never sent whole to the driver: files and shuffles of voxels hold far more rows than their bytes suggest."""
    return df.hint("merge")


# Rows that a partition of dealt rows holds.
ROWS = 1 << 19


def partitions(spark: SparkSession, rows: int) -> int:
    """The session's number of partitions, or more where they would hold more than ROWS of so many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of so many rows by its keys in as many partitions as they need; as it is where one partition can hold them all.

    A number is always given beyond that: the session's partitions hold fewer rows each, but Spark puts them together by their bytes.
    """
    if rows <= ROWS:
        return df
    few = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * 8 // ROWS))
    return df.repartition(max(few, -(-rows // ROWS)), *keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What the operators share with the rest of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.operators.graph import components
from lamina.sources.shared import materialise, shared_dir

__all__ = ["components", "materialise", "shared_dir", "small_batches", "table"]
# Rows and bytes of an Arrow batch: whole texts can be long, and each worker holds a batch or two.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, for operators that hand whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

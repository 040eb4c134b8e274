"""Incremental twins of the count operators on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.sources.shared import shared_dir


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now into a table of the shared folder and reads the last result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def label_counts(stream: DataFrame, window: str, delay: str) -> DataFrame:
    """Rows and sums of value by type in tumbling windows; events later than the delay are dropped."""
    timed = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return timed.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def histogram(stream: DataFrame, bins: int, width: float) -> DataFrame:
    """Counts by type and bin; the sum doesn't depend on the order of arrival."""
    return stream.groupBy("event_type", F.least(F.floor(F.col("value") / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))

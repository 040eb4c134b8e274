"""Queries of tracks over planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import tracks
from lamina.plans.bindings import load
from lamina.plans.registry import query
from lamina.sources.shared import materialise, shared_dir
from lamina.streaming.counts import run_available


def ends(s: SparkSession, d: str) -> DataFrame:
    """region, z, id, y, x, ty, tx: line items as ends that drift slowly over the planes of a supplier."""
    k, lane = F.col("l_orderkey"), F.col("l_partkey") % 5
    y = lane * 40 + k % 7 + F.col("l_quantity") / 20
    x = lane * 25 + F.floor(k / 512) + F.col("l_discount") * 20
    ty = F.when((k + lane) % 13 == 0, -0.8).otherwise(0.6)
    tx = F.when((k + lane) % 13 == 0, -0.6).otherwise(0.8)
    return load(s, d, "lineitem").select((F.col("l_suppkey") % 40).alias("region"), F.floor(k / 128).cast("int").alias("z"), (k * 8 + F.col("l_linenumber")).alias("id"), y.alias("y"), x.alias("x"), ty.alias("ty"), tx.alias("tx"))


def matched(rows: DataFrame) -> DataFrame:
    """region, z, a, b: the two first ends of a plane, as round one would have matched them."""
    return rows.groupBy("region", "z").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")


@query()
def endpoint_tracks(s: SparkSession, d: str) -> DataFrame:
    """Track of each curve end."""
    return tracks.endpoint_tracks(ends(s, d))


@query()
def stream_tracks(s: SparkSession, d: str) -> DataFrame:
    """The same tracks found on a stream of planes with keyed state."""
    path = f"{shared_dir(s)}/planes"
    files = materialise(ends(s, d), "planes").inputFiles()
    path = files[0].rsplit("/", 1)[0] if files else path
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name, None)
    s.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_available(tracks.stream_tracks(s.readStream.schema(ends(s, d).schema).parquet(path)), "tracks", "append")
    finally:
        s.conf.unset(name) if before is None else s.conf.set(name, before)


@query()
def track_scores(s: SparkSession, d: str) -> DataFrame:
    """Support and score that tracks give to matched ends."""
    rows = ends(s, d)
    found = materialise(tracks.endpoint_tracks(rows), "tracks")
    pairs = materialise(matched(rows), "matched")
    return tracks.track_scores(pairs, found, materialise(tracks.connections(found, pairs), "connections"))

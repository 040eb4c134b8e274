"""Curve ends followed over planes, in a batch or on a stream, and how far tracks were paired with each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Reach in pixels, planes without an end after which a track is over, and what a pair's tracks add to its score.
REACH, GAP = 8.0, 10
STRONG, MODERATE, SUPPORT = 0.7, 0.4, 3
BOOST_STRONG, BOOST_MODERATE, AGAINST = 0.85, 0.5, -0.3
ENDS = ["id", "y", "x", "ty", "tx"]
# Distances between ends and live tracks that are held at once.
BLOCK = 1 << 18
TRACK_SCHEMA = "region {kind}, z int, id long, track long"


def _advance(live: dict[int, tuple], free: int, z: int, ends: np.ndarray, reach: float, gap: int) -> tuple[list[int], int]:
    """Gives each end (y, x, ty, tx) of a plane its track: the nearest live one in reach, of those that agree in direction.

    live maps a track to (y, x, ty, tx, last plane, members) and is changed: tracks not seen for more than gap planes go, the others'
    figures are means over their members. A track takes one end a plane; equally near ones go by number. New tracks are numbered from free.
    """
    for t in [t for t, v in live.items() if z - v[4] > gap]:
        del live[t]
    names = sorted(t for t, v in live.items() if v[4] != z)
    now = np.array([live[t][:4] for t in names]).reshape(-1, 4)
    out, taken, few = [], np.zeros(len(names), bool), max(1, BLOCK // max(1, len(names)))
    for first in range(0, len(ends), few):
        some = ends[first : first + few]
        far = (some[:, 0:1] - now[:, 0]) ** 2 + (some[:, 1:2] - now[:, 1]) ** 2
        far[some[:, 2:3] * now[:, 2] + some[:, 3:4] * now[:, 3] < 0] = np.inf
        nearest = far.argmin(1) if names else np.zeros(len(some), int)
        least = far[np.arange(len(some)), nearest] if names else np.full(len(some), np.inf)
        for i, (end, k, d) in enumerate(zip(some.tolist(), nearest.tolist(), least.tolist(), strict=True)):
            if names and taken[k]:  # by an end before it in this plane
                left = np.where(taken, np.inf, far[i])
                k = int(left.argmin())
                d = left[k]
            y, x, ty, tx = end
            if d < reach * reach:
                track, taken[k] = names[k], True
                my, mx, mty, mtx, _, n = live[track]
                n += 1
                live[track] = (my + (y - my) / n, mx + (x - mx) / n, mty + (ty - mty) / n, mtx + (tx - mtx) / n, z, n)
            else:
                track, free = free, free + 1
                live[track] = (y, x, ty, tx, z, 1)
            out.append(track)
    return out, free


def _follow(planes: np.ndarray, places: np.ndarray, good: np.ndarray, live: dict[int, tuple], free: int, newest: int | None, reach: float, gap: int) -> tuple[np.ndarray, int, int | None]:
    """Tracks of rows in order of planes and ids, plane by plane; -1 for rows that aren't good and those of planes before the newest one."""
    tracks = np.full(len(planes), -1, np.int64)
    # Rows are in order of planes, so each plane is a run of them.
    rows = np.flatnonzero(good if newest is None else good & (planes >= newest))
    first = np.flatnonzero(np.diff(planes[rows].astype(float), prepend=-np.inf))
    for begin, end in zip(first, [*first[1:], len(rows)], strict=True) if len(rows) else ():
        at, newest = rows[begin:end], int(planes[rows[begin]])
        tracks[at], free = _advance(live, free, newest, places[at], reach, gap)
    return tracks, free, newest


def _walk(df: pd.DataFrame, live: dict[int, tuple], free: int, newest: int | None, reach: float, gap: int) -> tuple[pd.DataFrame, int, int | None]:
    """df with track; rows without a place or direction and rows of planes before the newest one get none. Ends of one id go by their place."""
    df = df.sort_values(["z", *ENDS], kind="stable")
    good = df[["z", *ENDS]].notna().all(axis=1).to_numpy()
    tracks, free, newest = _follow(df["z"].to_numpy(), df[ENDS[1:]].to_numpy(float), good, live, free, newest, reach, gap)
    return df[["region", "z", "id"]].assign(track=pd.arrays.IntegerArray(tracks, tracks < 0)), free, newest


def _same(column: pa.Array, value: pa.Scalar) -> np.ndarray:
    same = pc.fill_null(pc.equal(column, value), False) if value.is_valid else pc.is_null(column)
    return same.to_numpy(zero_copy_only=False)


def _whole_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of region and plane in batches that end where a plane does."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = _same(batch["region"], batch["region"][-1]) & _same(batch["z"], batch["z"][-1])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        goes_on = not cut and kept and all(_same(kept[-1][c], batch[c][0])[-1] for c in ("region", "z"))
        if cut:
            kept.append(batch[:cut])
        if kept and not goes_on:
            yield pa.concat_batches(kept)
            kept = []
        kept.append(batch[cut:])
    if kept:
        yield pa.concat_batches(kept)


def endpoint_tracks(ends: DataFrame, reach: float = REACH, gap: int = GAP) -> DataFrame:
    """region, z, id and track for each row of ends (region, z, id, y, x and the direction ty, tx).

    Planes of a region are walked in order, ends of a plane by id and place; tracks are numbered within the region. A region's rows are
    sorted by Spark and pass through one task, which holds a plane of them and the live tracks. Rows with a null get no track.
    """
    kind = ends.schema["region"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, live, free, newest = None, {}, 0, None
        for batch in _whole_planes(batches):
            good = np.logical_and.reduce([pc.is_valid(batch[c]).to_numpy(zero_copy_only=False) for c in ("z", *ENDS)])
            z = pc.fill_null(batch["z"], 0).to_numpy()
            places = np.stack([batch[c].cast("double").to_numpy(zero_copy_only=False) for c in ENDS[1:]], axis=1)
            good &= ~np.isnan(places).any(axis=1)
            tracks, begin = np.empty(batch.num_rows, np.int64), 0
            while begin < batch.num_rows:
                name = batch["region"][begin]
                same = _same(batch["region"][begin:], name)
                end = batch.num_rows if same.all() else begin + int(same.argmin())
                if region is None or not _same(pa.array([region.as_py()], name.type), name)[0]:
                    region, live, free, newest = name, {}, 0, None
                end = max(end, begin + 1)
                tracks[begin:end], free, newest = _follow(z[begin:end], places[begin:end], good[begin:end], live, free, newest, reach, gap)
                begin = end
            yield pa.RecordBatch.from_arrays([batch["region"], batch["z"], batch["id"], pa.array(tracks, mask=tracks < 0)], ["region", "z", "id", "track"])

    few = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A given number of partitions, because Spark puts the session's own together by their bytes.
    rows = ends.select("region", "z", *ENDS).repartition(few, "region").sortWithinPartitions("region", "z", *ENDS)
    return rows.mapInArrow(run, TRACK_SCHEMA.format(kind=kind))


class TrackEnds(StatefulProcessor):
    """The live tracks of a region as state of a stream whose planes arrive in order, whole planes at a time."""

    def __init__(self, reach: float = REACH, gap: int = GAP):
        self.reach, self.gap = reach, gap

    def init(self, handle) -> None:
        self.live = handle.getMapState("live", "track long", "y double, x double, ty double, tx double, last int, members long")
        self.place = handle.getValueState("place", "free long, newest int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        known = {k[0]: tuple(v) for k, v in self.live.iterator()} if self.live.exists() else {}
        before = set(known)
        free, newest = self.place.get() if self.place.exists() else (0, None)
        out, free, newest = _walk(df, known, free, newest, self.reach, self.gap)
        for t in before - set(known):
            self.live.removeKey((t,))
        for t, v in known.items():
            self.live.updateValue((t,), v)
        if newest is not None:
            self.place.update((free, newest))
        yield out

    def close(self) -> None:
        pass


def stream_tracks(ends: DataFrame, reach: float = REACH, gap: int = GAP) -> DataFrame:
    """endpoint_tracks on a stream: the same tracks if planes arrive in order. Rows of a plane before the newest one get no track.

    State is the live tracks of each region, so it is bounded by the ends of gap planes. Needs the RocksDB state store.
    """
    kind = ends.schema["region"].dataType.simpleString()
    return ends.select("region", "z", *ENDS).groupBy("region").transformWithStateInPandas(TrackEnds(reach, gap), TRACK_SCHEMA.format(kind=kind), "Append", "None")


def connections(tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """region, ta, tb (ta < tb), confirmed, possible, confidence and first for each pair of tracks that was ever matched.

    matches has region, z, a and b (ids of two ends of a plane). confirmed counts matches, possible the planes in which both tracks have
    an end; first orders a region's connections by their first match (plane, smaller id). Matches of ends without a track, or of two
    ends of one track, are ignored.
    """
    known = tracks.where("track is not null")
    a = known.select("region", "z", F.col("id").alias("a"), F.col("track").alias("t1"))
    b = known.select("region", "z", F.col("id").alias("b"), F.col("track").alias("t2"))
    pair = matches.select("region", "z", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pair = pair.join(a, ["region", "z", "a"]).join(b, ["region", "z", "b"]).where("t1 <> t2")
    pair = pair.select("region", F.least("t1", "t2").alias("ta"), F.greatest("t1", "t2").alias("tb"), F.struct("z", "a").alias("at"))
    conns = pair.groupBy("region", "ta", "tb").agg(F.count("*").alias("confirmed"), F.min("at").alias("first"))
    # Planes of a track as bits of a few numbers: 64 planes each, so that a connection meets those and not every plane.
    planes = known.groupBy("region", "track", F.floor(F.col("z") / 64).alias("part")).agg(F.expr("bit_or(shiftleft(1L, pmod(z, 64)))").alias("bits"))
    both = conns.select("region", "ta", "tb").join(planes.select("region", F.col("track").alias("ta"), "part", F.col("bits").alias("bits_a")), ["region", "ta"])
    both = both.join(planes.select("region", F.col("track").alias("tb"), "part", F.col("bits").alias("bits_b")), ["region", "tb", "part"])
    possible = both.groupBy("region", "ta", "tb").agg(F.sum(F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).alias("possible"))
    return conns.join(possible, ["region", "ta", "tb"]).select("region", "ta", "tb", "confirmed", "possible", (F.col("confirmed") / F.col("possible")).alias("confidence"), "first")


def best_connections(conns: DataFrame) -> DataFrame:
    """region, track, partner and confidence: each track's connection with the highest confidence, the first of equals."""
    sides = conns.select("region", F.col("ta").alias("track"), F.col("tb").alias("partner"), "confidence", "first").unionByName(conns.select("region", F.col("tb").alias("track"), F.col("ta").alias("partner"), "confidence", "first"))
    return sides.groupBy("region", "track").agg(F.min_by(F.struct("partner", "confidence"), F.struct(-F.col("confidence"), F.col("first"))).alias("best")).select("region", "track", "best.*")


def track_scores(pairs: DataFrame, tracks: DataFrame, conns: DataFrame) -> DataFrame:
    """pairs (region, z, a, b) with support (planes in which their tracks were matched) and track_score.

    The score is a boost for a pair whose tracks are connected often enough, negative where one of them is strongly connected to another
    track, and else 0; ends without a track have 0.
    """
    known = tracks.where("track is not null")
    out = pairs.select("region", "z", "a", "b")
    for end, name in (("a", "t1"), ("b", "t2")):
        out = out.join(known.select("region", "z", F.col("id").alias(end), F.col("track").alias(name)), ["region", "z", end], "left")
        best = best_connections(conns).select("region", F.col("track").alias(name), F.col("partner").alias(f"{name}_partner"), F.col("confidence").alias(f"{name}_confidence"))
        out = out.join(best, ["region", name], "left")
    out = out.withColumns({"ta": F.least("t1", "t2"), "tb": F.greatest("t1", "t2"), "both": F.col("t1").isNotNull() & F.col("t2").isNotNull()})
    out = out.join(conns.select("region", "ta", "tb", "confirmed", "confidence"), ["region", "ta", "tb"], "left")

    def against(mine: str, other: str) -> Column:
        return F.coalesce((F.col(f"{mine}_confidence") >= STRONG) & (F.col(f"{mine}_partner") != F.col(other)), F.lit(False))

    score = F.when(~F.col("both"), 0.0).when((F.col("confidence") >= STRONG) & (F.col("confirmed") >= SUPPORT), BOOST_STRONG).when(F.col("confidence") >= MODERATE, BOOST_MODERATE)
    score = score.when(against("t1", "t2") | against("t2", "t1"), AGAINST).otherwise(0.0)
    return out.select("region", "z", "a", "b", F.when(F.col("both"), F.coalesce("confirmed", F.lit(0))).otherwise(0).alias("support"), score.alias("track_score"))

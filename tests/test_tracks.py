"""Tracks and their connections against walks plane by plane."""

import random
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa

from lamina.operators import tracks
from lamina.streaming.counts import run_available


def made(seed=3, planes=60):
    rng, rows = random.Random(seed), []
    for region in ("a", "b"):
        for lane in range(6):
            y, x = 30.0 * lane, 10.0
            for z in range(planes):
                y, x = y + rng.uniform(-1, 1), x + rng.uniform(-0.5, 1.5)
                if rng.random() < 0.75 and not (lane == 2 and 20 <= z < 35):
                    sign = -1 if rng.random() < 0.1 else 1
                    rows.append((region, z, rng.randrange(10**6), y, x, 0.6 * sign, 0.8 * sign))
                    if rng.random() < 0.1:
                        rows.append((region, z, rng.randrange(10**6), y + 2, x, 0.6, 0.8))
    return rows + [("a", 5, 1, None, 1.0, 1.0, 0.0), ("c", 0, 7, 1.0, 1.0, 1.0, 0.0)]


def walked(rows):
    out = {}
    for region in {r[0] for r in rows}:
        known = []
        for z in sorted({r[1] for r in rows if r[0] == region}):
            used = set()
            for r in sorted((r for r in rows if r[:2] == (region, z)), key=lambda r: r[2]):
                if None in r:
                    out[region, z, r[2]] = None
                    continue
                best = None
                for t, k in enumerate(known):
                    d2 = (r[3] - k["y"]) ** 2 + (r[4] - k["x"]) ** 2
                    if z - k["z"] <= 10 and k["z"] != z and t not in used and d2 < 64 and r[5] * k["ty"] + r[6] * k["tx"] >= 0 and (best is None or d2 < best[0]):
                        best = d2, t
                if best:
                    k = known[best[1]]
                    k["n"] += 1
                    for name, v in zip(("y", "x", "ty", "tx"), r[3:], strict=True):
                        k[name] += (v - k[name]) / k["n"]
                    k["z"] = z
                    used.add(best[1])
                    out[region, z, r[2]] = best[1]
                else:
                    known.append({"y": r[3], "x": r[4], "ty": r[5], "tx": r[6], "z": z, "n": 1})
                    out[region, z, r[2]] = len(known) - 1
    return out


SCHEMA = "region string, z int, id long, y double, x double, ty double, tx double"


def test_tracks_and_connections(spark):
    rows = made()
    want = walked(rows)
    found = tracks.endpoint_tracks(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {(r.region, r.z, r.id): r.track for r in found.collect()} == want and max(v for v in want.values() if v is not None) > 6
    rng, matches = random.Random(4), []
    for region in "ab":
        for z in range(60):
            ids = [r[2] for r in rows if r[:2] == (region, z) and None not in r]
            rng.shuffle(ids)
            ids = sorted(ids, key=lambda i: want[region, z, i] // 2) if rng.random() < 0.8 else ids
            matches += [(region, z, *p) for p in zip(ids[::2], ids[1::2], strict=False)]
    pairs = spark.createDataFrame(matches, "region string, z int, a long, b long")
    conns = tracks.connections(found, pairs)
    count, first = {}, {}
    for region, z, a, b in sorted(matches, key=lambda m: (m[0], m[1], min(m[2:]))):
        t = tuple(sorted((want[region, z, a], want[region, z, b])))
        count[region, t] = count.get((region, t), 0) + 1
        first.setdefault((region, t), len(first))
    there = {}
    for (region, z, _), t in want.items():
        there.setdefault((region, t), set()).add(z)
    plain = {k: n / len(there[k[0], k[1][0]] & there[k[0], k[1][1]]) for k, n in count.items()}
    got = {(r.region, (r.ta, r.tb)): (r.confirmed, r.confidence) for r in conns.collect()}
    assert got.keys() == plain.keys() and all(got[k] == (count[k], plain[k]) for k in plain)
    best = {}
    for k in sorted(plain, key=first.get):
        for t, other in (k[1], k[1][::-1]):
            if plain[k] > best.get((k[0], t), (0, None))[0]:
                best[k[0], t] = plain[k], other
    scores = set()
    for r in tracks.track_scores(pairs, found, conns).collect():
        t = tuple(sorted((want[r.region, r.z, r.a], want[r.region, r.z, r.b])))
        c, n = plain[r.region, t], count[r.region, t]
        s = 0.85 if c >= 0.7 and n >= 3 else 0.5 if c >= 0.4 else 0.0
        if not s and any(best[r.region, x][0] >= 0.7 and best[r.region, x][1] != y for x, y in (t, t[::-1])):
            s = -0.3
        assert (r.support, r.track_score) == (n, s)
        scores.add(s)
    assert scores >= {0.85, 0.5, -0.3}


def test_stream_and_batch_agree(spark):
    rows = made(8, 40)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == k], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
        got = {(r.region, r.z, r.id): r.track for r in run_available(tracks.stream_tracks(stream), "tracks", "append").collect()}
    finally:
        spark.conf.unset(name)
    assert got == walked(rows)


def test_planes_are_not_searched_for_once_a_plane(monkeypatch):
    n, looked = 3000, []
    df = pd.DataFrame({"region": 1, "z": np.arange(n) // 2, "id": np.arange(n), "y": 0.0, "x": 0.0, "ty": 1.0, "tx": 0.0})
    monkeypatch.setattr(tracks.np, "flatnonzero", lambda a, plain=np.flatnonzero: looked.append(np.size(a)) or plain(a))
    out = tracks._walk(df, {}, 0, None, 8.0, 10)[0]
    assert list(out["track"]) == [0, 1] * (n // 2) and sum(looked) <= 3 * n


def test_a_region_is_not_held_whole(spark, monkeypatch):
    rows = made(5, 50) + [(None, z, 10 * z + k, 3.0 * k, 1.0, 0.6, 0.8) for z in range(3) for k in range(15)] + [("a", None, 2, 1.0, 1.0, 1.0, 0.0), ("b", 1, None, 1.0, 1.0, 1.0, 0.0), ("d", 4, 9, float("nan"), 1.0, 1.0, 0.0)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        found = tracks.endpoint_tracks(spark.createDataFrame(rows, SCHEMA).repartition(5))
        got = {(r.region, r.z, r.id): r.track for r in found.collect()}
    finally:
        spark.conf.set(name, before)
    want = walked([(r[0] or "none", *r[1:]) for r in rows if r[1] is not None and r[2] is not None and r[3] == r[3]])
    assert got == {(None if k[0] == "none" else k[0], *k[1:]): v for k, v in want.items()} | {("a", None, 2): None, ("b", 1, None): None, ("d", 4, 9): None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan  # which give a task a region at once


def test_batches_end_with_planes():
    rows = [(r, z) for r in (None, "a", "b") for z, n in ((None, 2), (0, 9), (1, 1), (5, 4)) for _ in range(n)]
    table = pa.table({"region": pa.array([r[0] for r in rows], "string"), "z": pa.array([r[1] for r in rows], "int32")})
    for size in (1, 3, 5, 100):
        parts = [[tuple(r.values()) for r in b.to_pylist()] for b in tracks._whole_planes(iter(table.to_batches(max_chunksize=size)))]
        assert sum(parts, []) == rows and all(p[-1] != q[0] for p, q in zip(parts, parts[1:]))
        assert size > 5 or max(map(len, parts)) <= 9 + size


def test_distances_come_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    n = 400
    df = pd.DataFrame({"region": 1, "z": np.arange(n) // 40, "id": np.arange(n), "y": rng.uniform(0, 60, n), "x": rng.uniform(0, 60, n), "ty": 1.0, "tx": 0.0})
    plain = tracks._walk(df, {}, 0, None, 8.0, 10)[0]
    monkeypatch.setattr(tracks, "BLOCK", 300)
    assert list(tracks._walk(df, {}, 0, None, 8.0, 10)[0]["track"]) == list(plain["track"]) == list(walked_frame(df))


def walked_frame(df):
    out = walked([tuple(r) for r in df.itertuples(index=False)])
    return [out[r.region, r.z, r.id] for r in df.itertuples()]


def test_planes_of_connections_meet_as_bits(spark):
    rng = random.Random(11)
    there = {t: sorted(rng.sample(range(-150, 200), 90)) for t in range(4)}
    found = spark.createDataFrame([("r", z, 1000 * (z + 200) + t, t) for t, planes in there.items() for z in planes], "region string, z int, id long, track long")
    matches = [(z, t, u) for t in range(4) for u in range(t) for z in sorted(set(there[t]) & set(there[u]))[::3]]
    pairs = spark.createDataFrame([("r", z, 1000 * (z + 200) + t, 1000 * (z + 200) + u) for z, t, u in matches], "region string, z int, a long, b long")
    conns = tracks.connections(found, pairs)
    assert {(r.ta, r.tb): (r.confirmed, r.possible) for r in conns.collect()} == {(u, t): (len([m for m in matches if m[1:] == (t, u)]), len(set(there[t]) & set(there[u]))) for t in range(4) for u in range(t)}
    assert "bit_count" in conns._jdf.queryExecution().optimizedPlan().toString()  # no row for a connection's plane

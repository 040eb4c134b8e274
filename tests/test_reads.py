"""Reads from chunk payloads and box distances against numpy."""

import math

import numpy as np

from lamina.operators import reads, stencils


def volume(spark, seed=0):
    rng = np.random.default_rng(seed)
    field = np.where(rng.random((7, 9, 10)) < 0.6, rng.random((7, 9, 10)), np.nan)
    voxels = spark.createDataFrame([(*map(int, at), float(field[at])) for at in np.ndindex(field.shape) if np.isfinite(field[at])], "z int, y int, x int, value double")
    return field, stencils.implode_chunks(voxels, "value", 4)


def test_points(spark):
    field, chunks = volume(spark)
    rng = np.random.default_rng(1)
    places = [*map(tuple, rng.integers(-3, 12, (300, 3)).tolist()), (0, 0, 0), (0, 0, 0)]
    points = spark.createDataFrame([(i, *p, "v") for i, p in enumerate(places)] + [(999, None, 1, 1, "v")], "id int, z int, y int, x int, values string")
    got = {r.id: r.value for r in reads.read_points(chunks, points, 4, -1.0).collect()}
    for i, p in enumerate(places):
        inside = all(0 <= v < n for v, n in zip(p, field.shape, strict=True))
        assert got[i] == (float(field[p]) if inside and np.isfinite(field[p]) else -1.0)
    assert got[999] == -1.0 and len(got) == len(places) + 1
    assert reads.read_points(chunks.limit(0), points, 4, 7.0).where("value <> 7").count() == 0


def test_windows(spark):
    field, chunks = volume(spark)
    boxes = [("a", 0, 7, 0, 9, 0, 10), ("b", -2, 3, 5, 12, -1, 1), ("c", 3, 4, 3, 4, 3, 4), ("far", 50, 52, 0, 1, 0, 1), ("flat", 3, 3, 0, 2, 0, 2), ("null", None, 3, 0, 2, 0, 2)]
    df = spark.createDataFrame(boxes, "name string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    got = {r.name: r for r in reads.read_windows(chunks, df, "name", 4, -1.0).collect()}
    padded = np.full((70, 70, 70), -1.0)
    padded[5:12, 5:14, 5:15] = np.nan_to_num(field, nan=-1.0)
    for name, z0, z1, y0, y1, x0, x1 in boxes[:4]:
        want = padded[z0 + 5 : z1 + 5, y0 + 5 : y1 + 5, x0 + 5 : x1 + 5]
        assert got[name].shape == list(want.shape) and np.array_equal(np.array(got[name]["values"]).reshape(want.shape), want)
    assert got["flat"]["values"] == got["null"]["values"] == []
    assert reads.read_windows(chunks, df.limit(0), "name", 4, 0.0).count() == 0


def test_windows_over_batches(spark, capsys):
    field, chunks = volume(spark, 3)
    rng = np.random.default_rng(4)
    low = rng.integers(-3, 8, (400, 3))
    boxes = [(i, *(int(v) for c, w in zip(at, wide, strict=True) for v in (c, c + w))) for i, (at, wide) in enumerate(zip(low, rng.integers(0, 7, (400, 3)), strict=True))]
    df = spark.createDataFrame([*boxes, (None, 0, 7, 0, 9, 0, 10)], "k int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    padded = np.full((30, 30, 30), -1.0)
    padded[5:12, 5:14, 5:15] = np.nan_to_num(field, nan=-1.0)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in (3, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            found = reads.read_windows(chunks, df, "k", 4, -1.0)
            got = {r.k: r for r in found.collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        assert len(got) == len(boxes) + 1
        for k, z0, z1, y0, y1, x0, x1 in [*boxes, (None, 0, 7, 0, 9, 0, 10)]:
            want = padded[z0 + 5 : z1 + 5, y0 + 5 : y1 + 5, x0 + 5 : x1 + 5]
            assert np.array_equal(np.array(got[k]["values"]), want.ravel()) and (got[k].shape == list(want.shape) or not want.size and got[k].shape == [0, 0, 0])
    found.explain()
    assert "MapInArrow" in capsys.readouterr().out  # boxes aren't groups of their own


def test_box_distances(spark):
    rng = np.random.default_rng(2)
    boxes = {i: (o.tolist(), (o + s).tolist()) for i, (o, s) in enumerate(zip(rng.integers(-40, 60, (60, 3)), rng.integers(1, 15, (60, 3)), strict=True))}
    df = spark.createDataFrame([(i, *[v for c in range(3) for v in (a[c], b[c])]) for i, (a, b) in boxes.items()] + [(99, None, 1, 0, 1, 0, 1)], "id int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    for apart in (True, False):
        got = {r.id: (r.nearest, r.distance) for r in reads.nearest_boxes(df, df, "id", 12.5, apart).collect()}
        for i, (a, b) in boxes.items():
            near = [(math.sqrt(sum(max(p - v, u - q, 0) ** 2 for p, q, u, v in zip(a, b, *boxes[j], strict=True))), j) for j in boxes if j != i or not apart]
            d, j = min(near)
            want = (j, d) if d <= 12.5 else (None, None)
            assert got[i][0] == want[0] and (want[1] is None or abs(got[i][1] - want[1]) < 1e-9)
        assert got[99] == (None, None)


def test_crowded_boxes_are_not_paired(spark, monkeypatch):
    rng = np.random.default_rng(9)
    low = np.vstack([rng.integers(0, 30, (400, 3)), rng.integers(300, 600, (20, 3))])
    high = low + rng.integers(1, 12, low.shape)
    df = spark.createDataFrame([(f"b{i}", *(int(v) for pair in zip(a, b, strict=True) for v in pair)) for i, (a, b) in enumerate(zip(low, high, strict=True))], "id string, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long")
    written = {}

    def noted(rows, name, write=reads.materialise):
        written[name] = write(rows, name)
        return written[name]

    monkeypatch.setattr(reads, "materialise", noted)
    for apart in (True, False):
        got = {r.id: (r.nearest, r.distance) for r in reads.nearest_boxes(df, df, "id", 40.0, apart).collect()}
        for i in range(len(low)):
            gap = np.maximum(np.maximum(low[i] - high, low - high[i]), 0)
            far = sorted((d, f"b{j}") for j, d in enumerate(np.sqrt((gap**2).sum(1))) if d <= 40.0 and not (apart and i == j))
            assert got[f"b{i}"] == ((far[0][1], far[0][0]) if far else (None, None)), i
        assert 400 <= written["touching"].count() <= 420

"""Surfaces, disks, nested reports and catalogs against plain Python."""

import json
import math

import numpy as np

from lamina.operators import reports
from lamina.operators import surfaces as surf

NODE = "map string, row int, col int, z double, y double, x double, valid boolean"


def test_densify_is_bilinear_and_skips_holes(spark):
    rng = np.random.default_rng(0)
    place = {(r, c): (2.0 * r + rng.uniform(-0.3, 0.3), 2.0 * c, rng.uniform(0, 1)) for r in range(4) for c in range(5)}
    hole = (1, 1)
    rows = [("a", r, c, *map(float, p), (r, c) != hole) for (r, c), p in place.items()] + [("one", 0, 0, 1.0, 1.0, 1.0, True), ("none", 0, 0, None, None, None, True)]
    df = spark.createDataFrame(rows, NODE)
    good = set(place) - {hole}
    gaps = [math.dist(place[a], place[b]) for a in good for b in ((a[0] + 1, a[1]), (a[0], a[1] + 1)) if b in good]
    n = math.ceil(np.median(gaps) / 0.6)
    want = []
    for i in range(3 * n + 1):
        for j in range(4 * n + 1):
            r, c = i // n, j // n
            corners = [(min(r + a, 3), min(c + b, 4)) for a in (0, 1) for b in (0, 1)]
            if all(k in good for k in corners):
                p = [np.array(place[k]) for k in corners]
                u, v = i / n - r, j / n - c
                want.append(((p[0] * (1 - v) + p[1] * v) * (1 - u) + (p[2] * (1 - v) + p[3] * v) * u).tolist())
    got = sorted([r.z, r.y, r.x] for r in surf.densify(df, ("map",)).collect())
    assert np.allclose(got, sorted(want)) and len(got) == len(want)
    assert surf.densify(df.limit(0), ("map",)).count() == 0


def test_rasterize_is_the_nearest_point(spark):
    rng = np.random.default_rng(1)
    points = rng.uniform(-6, 20, (12, 3))
    seeds = np.rint(points)
    df = spark.createDataFrame([*map(tuple, points.tolist()), (None, 1.0, 1.0)], "z double, y double, x double")
    want = {}
    for c in np.ndindex(40, 40, 40):
        c = tuple(v - 12 for v in c)
        d = np.sqrt(((seeds - c) ** 2).sum(1)).min()
        if d <= 3.5:
            want[c] = 1 if d <= 1.5 else 0
    for size in ((4, 8, 16), (32, 32, 32)):
        assert {(r.z, r.y, r.x): r.label for r in surf.rasterize(df, 1.5, 3.5, size=size).collect()} == want
    veto = spark.createDataFrame([c for c in want if sum(c) % 2], "z int, y int, x int")
    assert {(r.z, r.y, r.x) for r in surf.rasterize(df, 1.5, 3.5, veto).collect()} == {c for c, v in want.items() if v or not sum(c) % 2}
    assert surf.rasterize(df.limit(0), 1.5, 3.5).count() == 0


def test_disks_and_envelope(spark):
    rng = np.random.default_rng(2)
    centres = [(int(z), int(y), int(x), float(np.float32(r))) for z, y, x, r in zip(rng.integers(0, 2, 9), rng.integers(0, 15, 9), rng.integers(0, 15, 9), [0.0, 1.0, 2.0, math.sqrt(5), math.sqrt(2), 3.3, 4.0, 1.5, math.sqrt(13)], strict=True)]
    df = spark.createDataFrame(centres, "z int, y int, x int, radius double")
    want, envelope = set(), {}
    for z, cy, cx, r in centres:
        inner = float(np.nextafter(np.float32(r), np.float32(0)))
        for y in range(15):
            for x in range(15):
                d2 = (y - cy) ** 2 + (2 * (x - cx)) ** 2
                if r > 0 and d2 < inner**2:
                    want.add((z, y, x))
                value = r - math.sqrt(d2)
                if value >= -2 and ((z, y, x) not in envelope or (value, (-cy, -cx)) > envelope[z, y, x][:2]):
                    envelope[z, y, x] = value, (-cy, -cx), r
    assert {tuple(r) for r in surf.reconstruct_disks(df, (15, 15), (1.0, 2.0)).collect()} == want
    got = {(r.z, r.y, r.x): (r.envelope, r.radius) for r in surf.radius_envelope(df, (15, 15), -2.0, (1.0, 2.0)).collect()}
    assert got.keys() == envelope.keys() and all(abs(got[k][0] - envelope[k][0]) < 1e-9 and got[k][1] == envelope[k][2] for k in got)
    wider = {tuple(r) for r in surf.reconstruct_disks(df, (15, 15), margin=0.5).collect()}
    assert wider == {(z, y, x) for z, cy, cx, r in centres for y in range(15) for x in range(15) if (y - cy) ** 2 + (x - cx) ** 2 < (r + 0.5) ** 2}


def numbers(value, path=""):
    if isinstance(value, dict):
        return {k: v for name, child in value.items() for k, v in numbers(child, f"{path}/{name}" if path else name).items()}
    return {path: float(value)} if isinstance(value, (bool, int, float)) and path else {}


def test_reports_there_and_back(spark):
    made = [{"a": 1, "b": {"c": True, "d": {"e": -2.5, "f": "text"}, "g": [1]}, "h": None, 'quo"te, ': {"x": 3}}, {}, {"deep": {"er": {"est": {"of": {"all": 1e-7}}}}}, [1, 2], 5]
    rows = [(i, json.dumps(v)) for i, v in enumerate(made)] + [(98, "no json {"), (99, None)]
    flat = reports.flatten_metrics(spark.createDataFrame(rows, "id long, report string"), "id", "report")
    want = {(i, k): v for i, r in enumerate(made) if isinstance(r, dict) for k, v in numbers(r).items()}
    assert {(r.id, r.path): r.value for r in flat.collect()} == want
    back = {r.id: json.loads(r.report) for r in reports.nest_metrics(flat, "id").collect()}
    assert {(i, k): v for i, r in back.items() for k, v in numbers(r).items()} == want
    assert reports.nest_metrics(flat.where("id < 0"), "id").count() == 0
    assert reports.flatten_metrics(spark.createDataFrame([], "id long, report string"), "id", "report").count() == 0


def test_reports_meet_once(spark, capsys, monkeypatch):
    rows = [(1, "a/x", 1.0), (1, "a", 2.0), (1, "b/c/d", 3.0), (1, "b/c/e", None), (2, "a/b", None), (3, 'a,}"]:/x', 2.5), (3, "a!/k", 1.0), (3, "a/k", 1.0), (3, "\x01/y", 0.0), (4, "", 1.0), (4, "//", 2.0), (5, "z", 3.0), (5, "a/b", 1.0), (5, "a/b/c", None), (5, None, 1.0)]
    monkeypatch.setattr(reports, "materialise", lambda *_: None)
    back = reports.nest_metrics(spark.createDataFrame(rows, "id long, path string, value double"), "id")
    back.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    want = {1: '{"a":{"x":1.0},"b":{"c":{"d":3.0}}}', 2: '{"a":{}}', 3: '{"\\u0001":{"y":0.0},"a":{"k":1.0},"a!":{"k":1.0},"a,}\\"]:":{"x":2.5}}', 4: '{"":{"":{"":2.0}}}', 5: '{"a":{"b":{}},"z":3.0}'}
    assert {r.id: r.report for r in back.collect()} == want


def test_reports_are_dealt_out_before_they_are_opened(spark, capsys, monkeypatch):
    plans = []
    write = reports.materialise

    def written(df, name):
        df.explain()
        plans.append(capsys.readouterr().out)
        return write(df, name)

    monkeypatch.setattr(reports, "materialise", written)
    df = spark.createDataFrame([(1, '{"a": {"b": 1}, "l": [{"c": 2}]}')], "id long, report string")
    assert [tuple(r) for r in reports.flatten_metrics(df, "id", "report").collect()] == [(1, "a/b", 1.0)]
    assert len(plans) == 2 and "REPARTITION_BY_COL" in plans[0]


def test_catalog_reasons(spark):
    kind = "id string, label string, scans array<struct<px:double>>, predictions array<struct<px:double,purpose:string>>, n_segments int"
    rows = [("a", None, [(7.9,), (2.4,), (7.9,), (None,)], [(2.4, "surface-prediction"), (1.0, "ink"), (None, "surface-prediction"), (3.0, None)], None), ("b", "B", None, None, 4), ("b", "B", [], [], 4), (None, None, None, None, 0), ("c", "C", [(1000.0,)], None, 1)]
    got = reports.scan_catalog(spark.createDataFrame(rows, kind), 3.0, 7.0, 10.0).collect()
    by = {(r.id, r.label): r for r in got}
    assert len(got) == 5 and by["a", "a"].fine_px_um == [2.4] and by["a", "a"].coarse_px_um == [7.9] and by["a", "a"].surface_prediction_px_um == [2.4] and by["a", "a"].reason is None
    assert by["b", "B"].reason == "duplicate id" and by[None, None].reason == "missing id" and by["c", "C"].reason == "invalid pixel size" and by["b", "B"].scan_px_um == []

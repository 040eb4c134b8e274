"""Matching of ends against plain walks in Python and numpy."""

import math

import numpy as np

from lamina.operators import joins, matching

ENDS = "id long, plane int, y int, x int, ty double, tx double, component int, skeleton int"
LABELS = "plane int, y int, x int, label int"


def pairs(spark, rows, reach=21):
    ends = spark.createDataFrame(rows, ENDS)
    return matching.end_pairs(ends, joins.pairs_within(ends, reach))


def curve(a, b, t):
    d = math.hypot(b[0] - a[0], b[1] - a[1])
    at = []
    for i in range(2):
        p, q, r, s = a[i], a[i] + d / 3 * a[i + 2], b[i] + d / 3 * b[i + 2], b[i]
        at.append((1 - t) ** 3 * p + 3 * (1 - t) ** 2 * t * q + 3 * (1 - t) * t**2 * r + t**3 * s)
    return [math.floor(v + 0.5) for v in at]


def test_gates(spark):
    facing = [(1, 0, 0, 0, 0.0, 1.0, 1, 1), (2, 0, 0, 8, 0.0, -1.0, 2, 2), (3, 0, 40, 0, 0.0, 1.0, 3, 3), (4, 0, 40, 5, 0.0, -1.0, 3, 4), (5, 0, 80, 0, 0.0, 1.0, 5, 5), (6, 0, 80, 5, 1.0, 0.0, 6, 6), (7, 1, 0, 0, 0.0, 1.0, 0, 0), (8, 1, 0, 5, 0.0, -1.0, 0, None), (9, 2, 3, 3, 0.0, 1.0, 1, 1), (10, 2, 3, 3, 0.0, 1.0, 2, 2), (11, 3, 0, 0, None, None, 1, 1), (12, 3, 0, 4, 0.0, -1.0, 2, 2)]
    rows = pairs(spark, facing)

    def reasons(**kw):
        return {(r.a, r.b): r.reason for r in matching.match_candidates(rows, **kw).collect()}

    always = {(3, 4): "same_cc", (5, 6): "tangent", (7, 8): None, (11, 12): "tangent"}
    assert reasons() == always | {(1, 2): "evidence"}
    assert reasons(provisional=True) == always | {(1, 2): None}
    assert reasons(centre=(0.0, 0.0)) == {(1, 2): "radial", (3, 4): "same_cc", (5, 6): "tangent", (7, 8): "radial", (11, 12): "tangent"}
    assert reasons(centre=(500.0, 4.0))[(1, 2)] is None
    assert matching.match_candidates(rows.limit(0)).count() == 0


def test_bodies_and_sheets_are_the_walk(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        a = rng.random() * 2 * math.pi
        rows.append((i, int(rng.integers(0, 5)), int(rng.integers(0, 40)), int(rng.integers(0, 40)), math.sin(a), math.cos(a), int(rng.integers(1, 30)), i + 1))
    cells = {(z, int(y), int(x)): int(label) for z in range(5) for (y, x), label in zip(rng.integers(0, 44, (60, 2)), rng.integers(1, 30, 60), strict=True)}
    labels = spark.createDataFrame([(*k, v) for k, v in cells.items()], LABELS)
    found = pairs(spark, rows)
    merged, crossed = set(), set()
    by_id = {r[0]: r for r in rows}
    for r in found.select("a", "b").collect():
        a, b = by_id[r.a], by_id[r.b]
        pa, pb = (a[2], a[3], a[4], a[5]), (b[2], b[3], b[4], b[5])
        d = math.hypot(pb[0] - pa[0], pb[1] - pa[1])
        if d < 0.001:
            continue
        steps = int(d * 2) + 1
        for k in range(steps + 1):
            y, x = curve(pa, pb, k / steps)
            near = [cells.get((a[1], y + i, x + j), 0) for i in range(-2, 3) for j in range(-2, 3)]
            if any(v > 0 and v not in (a[6], b[6]) for v in near):
                merged.add((r.a, r.b))
        for z in range(a[1] - 2, a[1] + 3):
            if z == a[1]:
                continue
            ends = {cells.get((z, a[2], a[3]), 0), cells.get((z, b[2], b[3]), 0)}
            met = [cells.get((z, *curve(pa, pb, k / 20)), 0) for k in range(2, 19)]
            if any(v > 0 and v not in ends for v in met):
                crossed.add((r.a, r.b))
    assert merged and crossed
    assert {(r.a, r.b) for r in matching.merged_bodies(found, labels).collect()} == merged
    assert {(r.a, r.b) for r in matching.crossed_sheets(found, labels).collect()} == crossed
    told = {(r.a, r.b): r.reason for r in matching.guarded(matching.match_candidates(found, provisional=True), labels).collect()}
    assert all(v != "cross_sheet" or k in crossed - merged for k, v in told.items()) and all(v != "merger" or k in merged for k, v in told.items())
    assert matching.merged_bodies(found, labels.limit(0)).count() == 0


def test_axes(spark):
    rng = np.random.default_rng(5)
    cells = {(0, int(y), int(x)): int(v) for (y, x), v in zip(rng.integers(0, 40, (700, 2)), rng.integers(1, 3, 700), strict=True)} | {(1, 5, x): 7 for x in range(9)} | {(2, y, y): 7 for y in range(3)}
    labels = spark.createDataFrame([(*k, v) for k, v in cells.items()], LABELS)
    rows = [(i, 0, int(y), int(x), 0.0, 0.0, 1 + i % 2, 0) for i, (y, x) in enumerate(rng.integers(0, 40, (20, 2)))] + [(90, 1, 5, 0, 0.0, 0.0, 7, 0), (91, 2, 0, 0, 0.0, 0.0, 7, 0), (92, 3, 0, 0, 0.0, 0.0, None, 0)]
    got = {r.id: r for r in matching.local_axis(spark.createDataFrame(rows, ENDS), labels).collect()}
    for i, z, y, x, _, _, owner, _ in rows:
        points = np.array([k[1:] for k, v in cells.items() if k[0] == z and v == owner and abs(k[1] - y) <= 8 and abs(k[2] - x) <= 8])
        r = got[i]
        assert r.n == len(points)
        if len(points) < 5:
            assert (r.axis_y, r.axis_x, r.anisotropy, r.outward_y, r.outward_x) == (0, 0, 0, 0, 0)
            continue
        values, vectors = np.linalg.eigh(np.cov(points.T))
        assert math.isclose(r.anisotropy, values[-1] / max(0.25, values[0]), rel_tol=1e-9)
        assert math.isclose(abs(np.dot(vectors[:, -1], (r.axis_y, r.axis_x))), 1, rel_tol=1e-6)
        out = np.array([y, x]) - points.mean(axis=0)
        assert np.allclose(out / max(1e-8, np.linalg.norm(out)), (r.outward_y, r.outward_x))


def test_axes_in_tiles(spark, capsys):
    rng = np.random.default_rng(8)
    cells = [(0, int(y), int(x), int(v)) for (y, x), v in zip(rng.integers(-80, 150, (9000, 2)), rng.integers(1, 4, 9000), strict=True)]
    rows = [(i, 0, int(y), int(x), 0.0, 0.0, 1 + i % 4, 0) for i, (y, x) in enumerate(rng.integers(-80, 150, (60, 2)))] + [(90, None, 1, 1, 0.0, 0.0, 1, 0), (91, 0, None, 1, 0.0, 0.0, 1, 0)]
    found = matching.local_axis(spark.createDataFrame(rows, ENDS), spark.createDataFrame(cells, LABELS))
    found.explain()
    assert "Generate explode([" not in capsys.readouterr().out  # no end is written once a cell around it
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(rows) and got[90].n == got[91].n == 0
    for i, _, y, x, _, _, owner, _ in rows[:60]:
        points = np.array([c[1:3] for c in cells if c[3] == owner and abs(c[1] - y) <= 8 and abs(c[2] - x) <= 8])
        assert got[i].n == len(points)
        if len(points) >= 5:
            values = np.linalg.eigvalsh(np.cov(points.T))
            assert math.isclose(got[i].anisotropy, values[-1] / max(0.25, values[0]), rel_tol=1e-9)
            out = np.array([y, x]) - points.mean(axis=0)
            assert np.allclose(out / max(1e-8, np.linalg.norm(out)), (got[i].outward_y, got[i].outward_x))


def test_path_features(spark):
    rng = np.random.default_rng(7)
    paths = {p: np.cumsum(rng.integers(-2, 3, (n, 2)), axis=0) for p, n in enumerate((1, 2, 8, 9, 60))}
    rows = [(p, i, int(y), int(x), float(rng.random()), int(rng.integers(0, 2))) for p, points in paths.items() for i, (y, x) in enumerate(points)]
    got = {r.path: r for r in matching.path_features(spark.createDataFrame(rows, "path int, i int, y int, x int, probability double, label int"), (3.0, -2.0)).collect()}
    for p, path in paths.items():
        r, gaps = got[p], [v[4] for v in rows if v[0] == p and v[5] == 0]
        length = np.linalg.norm(np.diff(path, axis=0), axis=1).sum()
        chord = np.linalg.norm(path[-1] - path[0])
        radius = np.linalg.norm(path - np.array((3.0, -2.0)), axis=1)
        turn = 0.0
        if len(path) >= 9:
            a, b = path[4:-4] - path[:-8], path[8:] - path[4:-4]
            size = np.maximum(1e-8, np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            turn = np.degrees(np.arccos(np.clip((a * b).sum(axis=1) / size, -1, 1))).max()
        want = (length, chord, length / max(1, chord), abs(radius[-1] - radius[0]), np.ptp(radius), turn)
        assert np.allclose((r.length, r.chord, r.arc_ratio, r.radial_difference, r.radial_extent, r.turn), want, atol=1e-6)
        assert r.gap_pixels == len(gaps)
        assert np.allclose((r.mean, r.least, r.p10), (np.mean(gaps), min(gaps), np.quantile(gaps, 0.1))) if gaps else r.mean is None


def test_arc_ratio_works_a_curve_out_once(spark):
    from pyspark.sql import functions as F

    from lamina.functions import geometry

    rng = np.random.default_rng(3)
    rows = [tuple(map(float, r)) for r in rng.normal(0, 10, (30, 8))] + [(1.0, 1.0, 0.6, 0.8, 1.0, 1.0, 0.6, 0.8)]
    df = spark.createDataFrame(rows, "ay double, ax double, aty double, atx double, by double, bx double, bty double, btx double")
    pairs = [[F.col(s + c) for c in ("y", "x")] if t == "" else [F.col(s + t + c) for c in ("y", "x")] for s in "ab" for t in ("", "t")]
    out = df.select("*", geometry.arc_ratio(*pairs).alias("ratio"))
    for r in out.collect():
        a, ta, b, tb = (np.array([r[s + t + c] for c in "yx"]) for s in "ab" for t in ("", "t"))
        chord, t = np.hypot(*(b - a)), np.arange(21)[:, None] / 20
        u, reach = 1 - t, chord / 3
        points = u**3 * a + 3 * u * u * t * (a + reach * ta) + 3 * u * t * t * (b + reach * tb) + t**3 * b
        assert math.isclose(r.ratio, 1.0 if chord < 0.001 else np.hypot(*np.diff(points, axis=0).T).sum() / chord, rel_tol=1e-9)
    assert out._jdf.queryExecution().analyzed().toString().lower().count("sequence(") == 0


def test_near_pairs_are_all_pairs_without_joins_back(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(2)), int(rng.integers(-60, 60)), int(rng.integers(-60, 60)), 1.0, 0.0, k, k) for k in range(200)]
    ends = spark.createDataFrame(rows, "id long, plane int, y int, x int, ty double, tx double, component long, skeleton long")
    got = matching.near_pairs(ends, 10)
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 100}
    pairs = [(r.a, r.b) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    assert set(got.columns) == set(matching.end_pairs(ends, joins.pairs_within(ends, 10)).columns)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_pairs_in_planes_over_tiles(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(2)), int(rng.choice([-512, 0, 512, 1024])) + int(rng.integers(-30, 30)), int(rng.integers(-40, 40)), 1.0, 0.0, k % 7 or None, k) for k in range(600)] + [(900, 0, None, 1, 1.0, 0.0, 1, 1), (901, None, 1, 1, 1.0, 0.0, 1, 1)]
    ends = spark.createDataFrame(rows, "id long, plane int, y int, x int, ty double, tx double, component long, skeleton long")
    got = matching.pairs_in_planes(ends, 10)
    plain = matching.near_pairs(ends, 10)
    assert set(got.columns) == set(plain.columns)
    want = sorted(map(str, plain.collect()))
    assert len(want) > 1000 and sorted(map(str, got.select(plain.columns).collect())) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_curves_are_looked_up_without_writing_their_cells(spark, capsys):
    rng = np.random.default_rng(9)
    ends = []
    for i in range(40):
        angle, z = rng.random() * 2 * math.pi, int(rng.integers(13, 19))
        ends.append((i, z, int(rng.integers(-300, 900)), int(rng.integers(-20, 60)), math.sin(angle), math.cos(angle), int(rng.integers(0, 4)), i))
    cells = {(int(rng.choice([11, 12, 13, 14, 15, 17, 18, 20])), int(rng.integers(-400, 1000)), int(rng.integers(-60, 100)), int(rng.integers(0, 6))) for _ in range(9000)}
    labels = spark.createDataFrame(sorted(cells), LABELS)
    frame = spark.createDataFrame(ends, ENDS)
    found = matching.end_pairs(frame, frame.alias("p").join(frame.alias("q"), "plane").where("p.id < q.id").selectExpr("p.id as a", "q.id as b"))
    out = matching.guarded(found.selectExpr("*", "cast(null as string) as reason"), labels)
    out.explain()
    assert "array_distinct" not in capsys.readouterr().out  # no row for a cell of a curve
    at = {}
    for z, y, x, label in cells:
        if label > 0:
            at.setdefault((z, y, x), set()).add(label)
    got, seen = {(r.a, r.b): r.reason for r in out.collect()}, set()
    for a in ends:
        for b in ends:
            if a[0] >= b[0] or a[1] != b[1]:
                continue
            pa, pb = a[2:6], b[2:6]
            steps, near, other = int(math.hypot(pb[0] - pa[0], pb[1] - pa[1]) * 2) + 1, set(), False
            for y, x in {tuple(curve(pa, pb, k / steps)) for k in range(steps + 1)} if pa[:2] != pb[:2] else ():
                near |= set().union(*(at.get((a[1], y + i, x + j), ()) for i in range(-2, 3) for j in range(-2, 3)))
            for z in (a[1] - 2, a[1] - 1, a[1] + 1, a[1] + 2):
                under = [max(at.get((z, *p[:2]), {0})) for p in (pa, pb)]
                other |= any(set(at.get((z, *curve(pa, pb, k / 20)), ())) - set(under) for k in range(2, 19))
            want = "merger" if near - {a[6], b[6]} else "cross_sheet" if other else None
            seen.add(want)
            assert got[a[0], b[0]] == want
    assert seen == {"merger", "cross_sheet", None}

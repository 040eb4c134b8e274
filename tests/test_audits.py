"""Audit figures against walks over all voxels; neighbourhoods go in chunks, not one row a step."""

import numpy as np

from lamina.operators import audits, stencils

FIELD = "z int, y int, x int, score float, target int"


def voxels(seed=0, shape=(20, 9, 70)):
    rng = np.random.default_rng(seed)
    rows = {}
    for at in np.ndindex(shape):
        if rng.random() < 0.5:
            rows[(at[0] - 3, at[1] - 2, at[2])] = (None if rng.random() < 0.05 else float(np.float32(rng.random())), int(rng.integers(0, 3)))
    rows[(0, 0, 5)] = (float("nan"), 1)
    rows[(0, 0, 6)] = (float("inf"), 1)
    return rows


def moved_rows(df, capsys):
    """Whether the plan writes a row once for each of many steps."""
    df.explain()
    return "Generate explode([" in capsys.readouterr().out


def test_recovered(spark, capsys):
    rows = voxels()
    df = spark.createDataFrame([(*at, *v) for at, v in rows.items()], FIELD)
    known = {at: s for at, (s, t) in rows.items() if t != 2}
    want = {}
    for at in known:
        near = [known.get(tuple(a + o for a, o in zip(at, step, strict=True))) for step in stencils.cross(2)]
        want[at] = max((s for s in near if s is not None and s == s), default=None)
    found = audits.recovered(df, "score", 2)
    assert not moved_rows(found, capsys)
    assert {(r.z, r.y, r.x): r.recovered for r in found.collect()} == want


def test_matched_voxels_come_with_the_scores(spark, capsys):
    rows = voxels(2)
    df = spark.createDataFrame([(*at, *v) for at, v in rows.items()], FIELD)
    known = {at for at, (_, t) in rows.items() if t != 2}
    want = {at for at in known if rows[at][1] == 1}
    for _ in range(2):
        want |= {at for at in known if any(tuple(a + o for a, o in zip(at, step, strict=True)) in want for step in stencils.cross(1))}
    found = audits.recovered(df, "score", 2, True)
    found.explain()
    assert capsys.readouterr().out.count("FlatMapGroupsInArrow") == 1
    assert {(r.z, r.y, r.x) for r in found.collect() if r.near} == want
    assert found.drop("near").exceptAll(audits.recovered(df, "score", 2)).isEmpty()


def test_survival_in_chunks(spark, capsys, monkeypatch):
    def written(*_):
        raise AssertionError("a step was written")

    monkeypatch.setattr(audits, "materialise", written)
    rows = voxels(1, (20, 8, 70))
    df = spark.createDataFrame([(*at, *v) for at, v in rows.items()], FIELD)
    known = {at: s for at, (s, t) in rows.items() if s is not None and s == s}
    found = audits.survival(df, [1, 2])
    assert not moved_rows(found, capsys)
    got = {(r.z, r.y, r.x): (r.level_0, r.level_1, r.level_2) for r in found.collect()}
    assert got.keys() == known.keys()
    for at, levels in got.items():
        for k, level in enumerate(levels):
            near = [known.get(tuple(a + o for a, o in zip(at, step, strict=True))) for step in stencils.cross(k)]
            assert level == (None if None in near else min(near))


def test_frontier_takes_all_thresholds_and_depths(spark, monkeypatch):
    from lamina.plans import audits as plans
    from lamina.plans.bindings import THRESHOLDS

    rng = np.random.default_rng(7)
    score = (rng.integers(0, 11, (16, 20, 20)) / 10).astype(np.float32)
    score[2:14, 4:16, 4:16] = 0.5  # a solid body in noise
    score[3:9, 5:11, 5:11] = 0.95
    rows = [(*map(int, at), float(score[at]), 2 if score[at] == np.float32(0.1) else 0) for at in np.ndindex(score.shape)]
    monkeypatch.setattr(plans, "field", lambda s, d: spark.createDataFrame(rows, "z int, y int, x int, score float, target int"))
    got = {r.threshold: r for r in plans.frontier(spark, "").collect()}
    assert sorted(got) == THRESHOLDS and len(got) == 17
    score[score == np.float32(0.1)] = -1
    deep = set()
    for t in THRESHOLDS:
        left = [np.pad(score >= np.float32(t), 1)]
        for _ in range(4):
            m = left[-1]
            left.append(np.logical_and.reduce([m, *(np.roll(m, o, a) for a in range(3) for o in (1, -1))]))
        n, i, d = (left[k][1:-1, 1:-1, 1:-1] for k in (0, 2, 4))
        share = np.mean([i[z : z + 8].sum() / max(1, n[z : z + 8].sum()) for z in (0, 8)])
        r = got[t]
        assert (r.foreground, r.interior_share, r.deep_share, r.mean_share) == (n.sum(), round(i.sum() / n.sum(), 6), round(d.sum() / n.sum(), 6), round(share, 6))
        deep.add(int(d.sum()))
    assert len(deep) > 1 and max(deep) > 0

"""Growing masks and seams against walks over plain sets."""

import numpy as np

from lamina.operators import growth

CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def around(c, steps=CROSS):
    return [tuple(a + b for a, b in zip(c, s, strict=True)) for s in steps]


def solid(mask):
    return {c for c in mask if all(n in mask for n in around(c))}


def walk(p, seed, threshold, steps):
    labels, todo = {}, set(seed)
    while todo:
        first = min(todo)
        stack = [first]
        while stack:
            c = stack.pop()
            if c in todo:
                todo.discard(c)
                labels[c] = first
                stack += around(c)
    allowed, counts = solid(set(seed)), []
    for step in range(1, steps + 1):
        front = {n for c in labels for n in around(c)} - set(labels)
        front = {c for c in front if p.get(c, -1) >= threshold}
        beside = {c: {labels[n] for n in around(c) if n in labels} for c in front}
        sure = {c: next(iter(v)) for c, v in beside.items() if len(v) == 1}
        apart = {c: v for c, v in sure.items() if all(sure.get(n, v) == v for n in around(c))}
        taken = dict(apart)
        while new := solid(set(labels) | set(taken)) - allowed:
            weakest = {c: min(p[n] for n in around(c) if n in taken) for c in new}
            gone = {c for c in taken if any(n in weakest and p[c] <= max(weakest[m] for m in around(c) if m in weakest) for n in around(c))}
            taken = {c: v for c, v in taken.items() if c not in gone}
        if front:
            counts.append({"step": step, "frontier": len(front), "conflicts": len(front) - len(apart), "thick": len(apart) - len(taken), "added": len(taken)})
        if not taken:
            break
        labels.update(taken)
    return labels, counts


def rows(spark, cells, kind="z int, y int, x int"):
    return spark.createDataFrame([tuple(map(int, c)) for c in cells], kind)


def test_ridge_growth_is_the_walk(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 40, (6, 9, 9)).astype(np.float32) / 40
    p = {at: float(values[at]) for at in np.ndindex(values.shape)}
    seed = {c for c in p if p[c] >= 0.8}
    seed |= {(z, y, x) for z in range(3) for y in range(3) for x in range(3)}
    field = spark.createDataFrame([(*map(int, c), v) for c, v in p.items()] + [(50, 50, 50, None)], "z int, y int, x int, p double")
    mask, counts = growth.grow_ridges(field, rows(spark, [*seed, *seed]), 0.3, 4)
    want, steps = walk(p, seed, np.float32(0.3), 4)
    number = {c: (c[0] << 42) + (c[1] << 21) + c[2] for c in p}
    assert {(r.z, r.y, r.x): r.label for r in mask.collect()} == {c: number[v] for c, v in want.items()}
    assert counts == steps and sum(c["thick"] for c in counts) and sum(c["conflicts"] for c in counts) and len(want) > len(seed)
    grown = {(r.z, r.y, r.x) for r in mask.collect()}
    assert solid(grown) == solid(seed)
    empty, none = growth.grow_ridges(field, rows(spark, []), 0.3, 2)
    assert empty.count() == 0 and none == []


def test_seams_are_the_walk(spark):
    rng = np.random.default_rng(6)
    p = {at: float(v) for at, v in np.ndenumerate(rng.integers(0, 20, (8, 8, 8)) / 20)}
    seed, whole = {c for c in p if p[c] >= 0.5}, {c for c in p if p[c] >= 0.1}
    for targets in ([(z, y, x) for z in range(2) for y in range(2) for x in range(2)], [(0, 0, 0), (1, 1, 0)]):
        own = {c for c in p if tuple(v // 4 for v in c) in targets}
        new = (solid(whole) - solid(seed)) & own
        gone = {min((p[n], n) for n in around(c) if n in whole - seed and n in own)[1] for c in new if any(n in whole - seed and n in own for n in around(c))}
        left = (solid(whole - gone) - solid(seed)) & own
        field = spark.createDataFrame([(*map(int, c), v) for c, v in p.items()], "z int, y int, x int, p double")
        chunks = rows(spark, targets, "cz int, cy int, cx int")
        removed = growth.seam_removals(rows(spark, seed), rows(spark, whole), field, chunks, 4)
        assert gone and {(r.z, r.y, r.x) for r in removed.collect()} == gone
        report = growth.seam_report(rows(spark, seed), rows(spark, whole), removed, chunks, 4).first()
        assert tuple(report) == (len(new), len(gone), len(left))
    assert growth.seam_removals(rows(spark, []), rows(spark, []), field, chunks, 4).count() == 0


def test_voxel_joins_stay_off_the_driver(spark, monkeypatch):
    field = spark.createDataFrame([(z, y, x, 0.1 * ((z + y * x) % 10)) for z in range(3) for y in range(6) for x in range(6)], "z int, y int, x int, p double")
    seed, chunks = field.where("p >= 0.6"), rows(spark, [(0, 0, 0), (0, 1, 1)], "cz int, cy int, cx int")
    plans = []

    def noted(df, name, write=growth.materialise):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(growth, "materialise", noted)
    removed = growth.seam_removals(seed, field.where("p >= 0.2"), field, chunks, 4)
    noted(growth.seam_report(seed, field.where("p >= 0.2"), removed, chunks, 4), "report")
    growth.grow_ridges(field, seed, 0.2, 1)
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)

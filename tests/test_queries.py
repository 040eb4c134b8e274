"""Every query of the library's own operators against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lamina.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


LARGER = "/root/testdata/sf0.01"
# Queries with cases that the smallest tables don't have.
RARE = ["check_qualification", "crosswrap_controls", "frontier", "greedy_matching", "refusal_reasons", "seam_removals", "transform_paths"]


def views(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return {folder: views(folder) for folder in (DATA, LARGER)}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "none"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize(("name", "folder"), [*((n, DATA) for n in sorted(catalog.oracle_sql())), *((n, LARGER) for n in RARE)])
def test_against_sql(spark, duck, name, folder):
    got = catalog.queries()[name](spark, folder)
    want = duck[folder].execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    assert sorted(rows) == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_greedy_matching_is_the_walk(spark):
    from lamina.operators import joins
    from lamina.plans.catalog import endpoints

    near = [(r.distance, r.a, r.b, r.plane) for r in joins.pairs_within(endpoints(spark, DATA), 12).collect()]
    used, want = set(), set()
    for _, a, b, _ in sorted(near):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in catalog.queries()["greedy_matching"](spark, DATA).collect()} == want


def test_empty_inputs(spark):
    from lamina.operators import graph, metrics, stencils

    voxels = spark.createDataFrame([], "z int, y int, x int, value double")
    assert graph.voxel_components(voxels).count() == 0
    assert stencils.dilate(voxels, 6).count() == stencils.erode(voxels, 6).count() == stencils.l1_depth(voxels).count() == 0
    scores = spark.createDataFrame([], "scroll string, score float, target int")
    assert metrics.threshold_counts(scores, [0.5], ["scroll"]).count() == 0


def test_component_labels_cross_borders(spark):
    rows = [(0, 0, x, 1.0) for x in range(40)] + [(0, 2, 0, 1.0), (1, 0, 39, 1.0)]
    from lamina.operators import graph

    found = graph.voxel_components(spark.createDataFrame(rows, "z int, y int, x int, value double"), 6)
    assert sorted(r.n for r in found.groupBy("component").count().withColumnRenamed("count", "n").collect()) == [1, 41]


def test_greedy_disjoint_settles_on_long_chains(spark):
    from lamina.operators import graph

    chain = [(k, k, [k, k + 1]) for k in range(12)] + [(100, 5, [3, 3]), (101, None, [1]), (102, 7, [])]
    items = spark.createDataFrame(chain, "id long, priority int, ends array<long>")
    used, want = set(), []
    for i, p, e in sorted((c for c in chain if c[1] is not None and c[2]), key=lambda c: (-c[1], c[0])):
        if not used & set(e):
            used |= set(e)
            want.append(i)
    strict = items.withColumn("priority", items.priority * 1000 - items.id)
    assert sorted(r.id for r in graph.greedy_disjoint(strict).collect()) == sorted(want)


def test_survival_is_erosion_at_every_threshold(spark):
    import numpy as np

    from lamina.operators import audits

    rng = np.random.default_rng(0)
    score = rng.random((5, 8, 8)).astype(np.float32)
    score[0, 0, 0] = np.nan
    df = spark.createDataFrame([(*map(int, at), float(score[at]), 0) for at in np.ndindex(score.shape)], "z int, y int, x int, score double, part int")
    steps = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    got = {(r.z, r.y, r.x): r for r in audits.survival(df, [1, 2]).collect()}
    for t in (np.float32(0.05), np.float32(0.2), float(score[2, 4, 4])):
        left = {at for at in np.ndindex(score.shape) if score[at] >= t}
        for k in (1, 2):
            left = {c for c in left if all(tuple(a + b for a, b in zip(c, s, strict=True)) in left for s in steps)}
            assert {c for c, r in got.items() if r[f"level_{k}"] is not None and np.float32(r[f"level_{k}"]) >= t} == left

"""Release statistics against plain Python."""

import math

from lamina.operators import release

ARM = "fam string, arm string, macro double, passed boolean"


def test_verdicts(spark):
    rows = [("a", "R_full", 0.8, False), ("a", "R_minus_x", 0.7, True), ("a", "R_minus_y", 0.7, False), ("a", "R_minus_z", 0.9, True), ("a", "R_minus_v", 0.805, True), ("a", "R_minus_n", None, True), ("a", "B0", 0.1, True), ("b", "R_minus_x", 0.5, True), ("c", "R_full", 0.8, None), ("c", "R_minus_x", 0.7, None)]
    got = {(r.fam, r.term): r.verdict for r in release.loo_verdicts(spark.createDataFrame(rows, ARM), ["fam"], 0.01).collect()}
    assert got == {("a", "x"): "no-measurable-effect", ("a", "y"): "earns-its-place", ("a", "z"): "hurts", ("a", "v"): "no-measurable-effect", ("a", "n"): "milestone-missing", ("b", "x"): "milestone-missing", ("c", "x"): "earns-its-place"}


def test_survivors_and_winner(spark):
    rows = [("a", "B0", 0.5, True), ("a", "A0", 0.9, True), ("a", "p", 0.495, True), ("a", "q", 0.48, True), ("a", "r", 0.7, False), ("a", "s", 0.6, True), ("a", "t", 0.6, True), ("b", "p", 0.9, None), ("b", "q", 0.9, False), ("c", "A0", 1.0, True)]
    arms = spark.createDataFrame(rows, ARM)
    gains = spark.createDataFrame([("a", "s", "1", 0.0), ("a", "t", "1", 0.1), ("a", "t", "2", -0.1), ("a", "p", "1", 0.2)], "fam string, arm string, scroll string, gain double")
    assert sorted(r.arm for r in release.surviving_terms(arms, gains, ["fam"], 0.01).collect()) == ["p", "s"]
    assert {r.fam: (r.arm, r.macro) for r in release.pick_winner(arms, ["fam"]).collect()} == {"a": ("s", 0.6), "b": (None, None)}


def test_operating_points(spark):
    schema = "fam string, threshold double, score double, precision double, macro double, ratio double"
    initial = spark.createDataFrame([("a", t, 0.5, 0.5, 0.5, 1.0) for t in (0.25, 0.5, 0.75)] + [("b", 0.5, 0.5, 0.5, 0.5, 1.0)], schema)
    trained = spark.createDataFrame([("a", 0.25, 0.6, 0.6, 0.5, 1.0), ("a", 0.5, 0.9, 0.6, 0.5, 1.5), ("a", 0.75, 0.6, 0.6, 0.5, 1.0), ("a", 0.9, 1.0, 1.0, 1.0, 1.0), ("b", 0.5, 0.4, 0.4, 0.4, 1.0)], schema)
    scrolls = spark.createDataFrame([(f, t, "s", 0.5, 0.6) for f, t in (("a", 0.25), ("a", 0.5), ("a", 0.75), ("a", 0.9), ("b", 0.5))], "fam string, threshold double, scroll string, before double, after double")
    rows = {(r.fam, r.threshold): r for r in release.operating_points(initial, trained, scrolls, ["fam"]).collect()}
    assert [k for k, r in sorted(rows.items()) if r.qualified] == [("a", 0.25), ("a", 0.75)]
    assert [k for k, r in sorted(rows.items()) if r.selected] == [("a", 0.25), ("b", 0.5)]
    assert not rows["a", 0.9].comparable
    gap = {r.fam: (round(r.largest, 6), r.missing) for r in release.sweep_difference(trained, initial, ["fam"]).collect()}
    assert gap == {"a": (0.0, 0), "b": (0.1, 0)}


def test_bootstrap_of_cases(spark):
    schema = "case int, metric string, value double"
    a = spark.createDataFrame([(i, "m", float(i)) for i in range(20)] + [(3, "one", 1.0), (0, "m2", math.nan), (1, "m2", None)], schema)
    b = spark.createDataFrame([(i, "m", float(i) - 1.5) for i in range(25)] + [(3, "one", 0.0), (0, "m2", 1.0), (1, "m2", 1.0)], schema)
    clusters = spark.createDataFrame([(i, i % 5) for i in range(20)], "case int, cluster int")
    got = {r.metric: r for r in release.bootstrap_cases(a, b, clusters, 30, 1).collect()}
    assert set(got) == {"m", "one"}
    r = got["m"]
    assert (r.cases, r.replicates, r.p_not_better) == (20, 30, 0.0)
    assert all(math.isclose(v, 1.5) for v in (r.delta, r.low, r.high))
    assert got["one"].replicates < 30 and got["one"].delta == 1.0
    assert release.bootstrap_cases(a.limit(0), b, clusters, 5, 1).count() == 0


def test_candidate_gate(spark):
    schema = "fam string, named_bridge long, named_deep long, named_recall double, guard_bridge long, guard_deep long, guard_recall double, fixed_dice double, calibrated_dice double"
    base = spark.createDataFrame([("a", 100, 0, 0.9, 100, 100, 0.9, 0.6, 0.6)], schema)
    candidate = spark.createDataFrame([("a", 50, 0, 0.895, 105, 111, 0.95, 0.59, None), ("b", 1, 1, 1.0, 1, 1, 1.0, 1.0, 1.0)], schema)
    failures = spark.createDataFrame([("a", "old"), ("a", "new"), ("a", "new")], "fam string, failure string")
    rows = release.candidate_gate(candidate, base, failures, failures.where("failure = 'old'"), ["fam"], release.Contract(0.5, 0.1, 0.01, 0.1, 0.1, 0.01, 0.02))
    got = {(r.fam, r.criterion): (r.value, r.passed) for r in rows.collect()}
    assert len(got) == 18
    assert got["a", "named_bridge_reduction"] == (0.5, True) and got["a", "named_deep_reduction"] == (1.0, True)
    assert [c for (f, c), (_, ok) in got.items() if f == "a" and not ok] == ["guard_deep", "calibrated_dice_delta", "new_failures"]
    assert [c for (f, c), (_, ok) in got.items() if f == "b" and ok] == ["new_failures"]


def halves(spark, folder):
    """Line items of 40 suppliers whose discounts and taxes have a mean with a half at the sixth digit; the exact means, halves up."""
    import random

    import duckdb

    rng, rows, means = random.Random(1), [], {}
    for family in range(40):
        cents = [rng.randrange(11) for _ in range(160)]
        cents[0] = sum(cents[1:]) % 2 + 1
        cents[0] += (sum(cents) + 1) % 2
        means[family] = (sum(cents) * 125 + 1) // 2 / 1e6
        rows += [(2 * k, family, 4, 10.0, v / 100, 0.01, "N", "F") for k, v in enumerate(cents)] + [(2 * k, family, 5, 1.0, 0.15, v / 100, "N", "F") for k, v in enumerate(cents)]
    names = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    return con, means


def test_winners_round_halves_up(spark, tmp_path):
    from lamina.plans import catalog

    con, means = halves(spark, tmp_path)
    want = [(k, "R_minus_t4", m) for k, m in means.items()]
    assert sorted(con.execute(catalog.oracle_sql()["winning_arms"]).fetchall()) == want
    assert sorted((r.family, r.arm, r.macro) for r in catalog.queries()["winning_arms"](spark, str(tmp_path)).collect()) == want


def test_points_round_halves_up(spark, tmp_path):
    from lamina.plans import catalog

    con, means = halves(spark, tmp_path)
    got = {(r.family, r.threshold): r.score for r in catalog.queries()["operating_points"](spark, str(tmp_path)).collect()}
    assert {k: got[k, 0.15] for k in means} == means
    assert {(f, t): score for f, t, score, *_ in con.execute(catalog.oracle_sql()["operating_points"]).fetchall()} == got

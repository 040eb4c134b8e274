"""Bootstraps against a walk, and how their draws are dealt out."""

import hashlib
import statistics

from lamina.operators import sampling
from lamina.plans import bindings
from lamina.sources import shared


def clusters(n):
    return [(f"s{i % 3}", i * 7 % 101 + 200 * (i % 2), i % 11, i % 5, i % 3) for i in range(n)]


def test_bootstrap_is_the_walk(spark):
    rows = clusters(40)
    got = {r.replicate: r.macro for r in sampling.bootstrap(spark.createDataFrame(rows, "scroll string, cluster long, tp long, fp long, fn long"), 6, 3).collect()}
    groups = {s: sorted(r for r in rows if r[0] == s) for s in ("s0", "s1", "s2")}
    for replicate in range(6):
        dice = []
        for s, own in groups.items():
            drawn = [own[int(hashlib.md5(f"3:{replicate}:{s}:{k}".encode()).hexdigest()[:8], 16) % len(own)] for k in range(len(own))]
            tp, fp, fn = (sum(r[i] for r in drawn) for i in (2, 3, 4))
            dice.append(2 * tp / max(2 * tp + fp + fn, 1))
        assert abs(got[replicate] - statistics.fmean(dice)) < 1e-12
    assert len(got) == 6


def test_draws_are_not_counted_in_tasks(spark, capsys):
    df = spark.createDataFrame(clusters(40), "scroll string, cluster long, tp long, fp long, fn long")
    sampling.bootstrap(df, 6, 3).explain()
    plan = capsys.readouterr().out
    assert "_i#" not in "".join(line for line in plan.splitlines() if "HashAggregate(keys" in line)


def test_draws_meet_their_clusters_by_number(spark, capsys):
    df = spark.createDataFrame(clusters(40), "scroll string, cluster long, tp long, fp long, fn long")
    sampling.bootstrap(df, 6, 3).explain()
    plan = capsys.readouterr().out
    assert sum("REPARTITION_BY_NUM" in line and "_i#" in line for line in plan.splitlines()) == 2


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    grid = bindings.grid(spark, "/root/testdata/sf0.001")
    assert grid.rdd.getNumPartitions() >= 50
    assert grid.count() == grid.select("z", "y", "x").distinct().count()


def test_dealt_rows_are_not_put_together(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 1000)
    grid = bindings.grid(spark, "/root/testdata/sf0.001")
    assert grid.rdd.getNumPartitions() >= 6

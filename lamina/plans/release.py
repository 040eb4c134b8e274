"""Queries of release statistics with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number_sql
from lamina.operators import release
from lamina.plans.bindings import load
from lamina.plans.registry import query

CUTS = [0.02, 0.04, 0.06, 0.08]
SWEEP = "c as (select l_returnflag as scroll, l_suppkey % 40 as cluster, t as threshold, count(*) filter (where l_discount >= t and l_linestatus = 'F') as tp, count(*) filter (where l_discount >= t and l_linestatus = 'O') as fp, count(*) filter (where l_discount < t and l_linestatus = 'F') as fn from lineitem, unnest([0.02, 0.04, 0.06, 0.08]::double[]) u(t) group by all)"
DRAWS = f"u as (select *, row_number() over (partition by scroll order by cluster) - 1 as i, count(*) over (partition by scroll) as n from (select distinct scroll, cluster from c)), w as (select scroll, rep, h % n as i, count(*) as w from (select scroll, rep, n, {hash_number_sql("'5:' || rep || ':' || scroll || ':' || i")} as h from u, unnest(range(40)) r(rep)) group by all)"


@query(f"with {SWEEP}, {DRAWS}, m as (select rep, threshold, avg(2 * tp / greatest(2 * tp + fp + fn, 1)) as macro from (select rep, threshold, w.scroll, sum(w * tp) as tp, sum(w * fp) as fp, sum(w * fn) as fn from w join u using (scroll, i) join c using (scroll, cluster) group by all) group by all), b as (select rep, max(macro) as best, max(macro) filter (where threshold = 0.04) as kept from m group by rep) select count(*) as replicates, round(avg(best), 6) as reselected, round(avg(kept), 6) as fixed, round(avg(best - kept), 6) as optimism from b")
def bootstrap_optimism(s: SparkSession, d: str) -> DataFrame:
    t = F.explode(F.array(*[F.lit(v) for v in CUTS])).alias("threshold")
    rows = load(s, d, "lineitem").select(F.col("l_returnflag").alias("scroll"), (F.col("l_suppkey") % 40).alias("cluster"), "l_discount", (F.col("l_linestatus") == "F").alias("target"), t)
    above = F.col("l_discount") >= F.col("threshold")
    counts = rows.groupBy("scroll", "cluster", "threshold").agg(F.count_if(above & F.col("target")).alias("tp"), F.count_if(above & ~F.col("target")).alias("fp"), F.count_if(~above & F.col("target")).alias("fn"))
    rows = release.optimism(counts, 0.04, 40, 5)
    return rows.select("replicates", *[F.round(c, 6).alias(c) for c in ("reselected", "fixed", "optimism")])


CASES = "c as (select o_orderkey as k, o_custkey % 60 as cluster, case when o_orderkey % 11 <> 0 then o_totalprice / 1000 end as d0, o_totalprice / 1100 + o_orderkey % 7 - 6 as d1, case when o_custkey % 60 = 4 then 1.0 end as s0, 0.5 as s1 from orders), l as (select 'dice' as metric, cluster, d0 as a, d1 as b from c union all select 'sparse', cluster, s0, s1 from c), s as (select metric, cluster, count(*) as n, sum(a) as a, sum(b) as b, sum(a - b) as d from l where a is not null group by all)"
CASE_DRAWS = f"u as (select cluster, row_number() over (order by cluster) - 1 as i, count(*) over () as n from (select distinct cluster from c)), w as (select rep, h % n as i, count(*) as w from (select rep, n, {hash_number_sql("'9:' || rep || ':' || i")} as h from u, unnest(range(40)) r(rep)) group by all)"


@query(f"with {CASES}, {CASE_DRAWS}, m as (select metric, rep, sum(w * d) / sum(w * s.n) as mean from w join u using (i) join s using (cluster) group by all) select metric, cases::bigint as cases, candidate, reference, delta, low, high, replicates, p as p_not_better from (select metric, sum(n) as cases, round(sum(a) / sum(n), 5) as candidate, round(sum(b) / sum(n), 5) as reference, round(sum(d) / sum(n), 5) as delta from s group by metric) join (select metric, round(quantile_cont(mean, 0.025), 5) as low, round(quantile_cont(mean, 0.975), 5) as high, count(*) as replicates, round(avg((mean <= 0)::int), 5) as p from m group by metric) using (metric) where replicates > 1")
def bootstrap_of_cases(s: SparkSession, d: str) -> DataFrame:
    """Two runs over the orders as cases: one metric lacks some values, one has values in a single cluster."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey") % 60, F.col("o_totalprice")
    orders = load(s, d, "orders")
    left = orders.select(k.alias("case"), F.when(k % 11 != 0, price / 1000).otherwise(float("nan")).alias("dice"), F.when(c == 4, 1.0).alias("sparse"))
    right = orders.select(k.alias("case"), (price / 1100 + k % 7 - 6).alias("dice"), F.lit(0.5).alias("sparse"))
    a, b = (r.unpivot(["case"], ["dice", "sparse"], "metric", "value") for r in (left, right))
    rows = release.bootstrap_cases(a, b, orders.select(k.alias("case"), c.alias("cluster")), 40, 9)
    return rows.select("metric", "cases", "replicates", *[F.round(n, 5).alias(n) for n in ("candidate", "reference", "delta", "low", "high", "p_not_better")])


ARMS = "arms as (select l_suppkey as family, case when l_linenumber = 1 then 'R_full' when l_linenumber = 2 then 'B0' when l_linenumber = 3 then 'A0' else 'R_minus_t' || l_linenumber end as arm, round(avg(l_discount) filter (where l_quantity > 6), 6)::double as macro, count(*) % 3 <> 0 as passed from lineitem group by all)"


def arms(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    arm = F.when(n == 1, "R_full").when(n == 2, "B0").when(n == 3, "A0").otherwise(F.concat(F.lit("R_minus_t"), n))
    return load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("family"), arm.alias("arm")).agg(F.round(F.avg(F.when(F.col("l_quantity") > 6, F.col("l_discount"))), 6).alias("macro"), (F.count("*") % 3 != 0).alias("passed"))


@query(f"with {ARMS}, f as (select family, macro as macro_full, passed as gates from arms where arm = 'R_full') select family, arm, substr(arm, 9) as term, macro_full, macro, round(macro_full - macro, 6) as delta, passed, case when macro_full - macro is null then 'milestone-missing' when macro_full - macro > 0.0011115 and not (passed and not coalesce(gates, false)) then 'earns-its-place' when macro_full - macro < -0.0011115 then 'hurts' else 'no-measurable-effect' end as verdict from arms left join f using (family) where arm like 'R\\_minus\\_%' escape '\\'")
def leave_one_out(s: SparkSession, d: str) -> DataFrame:
    """Verdicts on terms by family."""
    return release.loo_verdicts(arms(s, d), ["family"], 0.0011115).withColumn("delta", F.round("delta", 6))


@query(f"with {ARMS}, gains as (select l_suppkey as family, case when l_linenumber = 1 then 'R_full' when l_linenumber = 2 then 'B0' when l_linenumber = 3 then 'A0' else 'R_minus_t' || l_linenumber end as arm, l_returnflag as scroll, sum((l_extendedprice::bigint % 9) - 3) as gain from lineitem group by all), b as (select family, macro - 0.0011115 as floor from arms where arm = 'B0') select family, arm, macro from arms join b using (family) where passed and arm not in ('B0', 'B0r', 'A0') and macro >= floor and not exists (select * from gains g where g.family = arms.family and g.arm = arms.arm and gain < 0)")
def surviving_arms(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    arm = F.when(n == 1, "R_full").when(n == 2, "B0").when(n == 3, "A0").otherwise(F.concat(F.lit("R_minus_t"), n))
    gains = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("family"), arm.alias("arm"), F.col("l_returnflag").alias("scroll")).agg(F.sum(F.rint("l_extendedprice").cast("long") % 9 - 3).alias("gain"))
    return release.surviving_terms(arms(s, d), gains, ["family"], 0.0011115)


# Means as whole millionths, halves up: sums of doubles depend on their order, and with them the digit that a half is rounded to.
MICRO = "round({v} * 1000000)::bigint"
HALF_UP = "((2 * ({a}) + ({b})) // (2 * ({b}))) / 1000000.0::double"


def micro(column: str) -> Column:
    return F.round(F.col(column) * 1000000).cast("long")


def half_up(a: str, b: str) -> Column:
    """a / b millionths of long columns or their products, rounded to whole ones."""
    return F.expr(f"(2 * ({a}) + ({b})) div (2 * ({b}))") / 1000000.0


WHOLE_ARMS = f"arms as (select family, arm, case when n > 0 then {HALF_UP.format(a='v', b='n')} end as macro, passed from (select l_suppkey as family, case when l_linenumber = 1 then 'R_full' when l_linenumber = 2 then 'B0' when l_linenumber = 3 then 'A0' else 'R_minus_t' || l_linenumber end as arm, sum({MICRO.format(v='l_discount')}) filter (where l_quantity > 6) as v, count(l_discount) filter (where l_quantity > 6) as n, count(*) % 3 <> 0 as passed from lineitem group by all))"


@query(f"with {WHOLE_ARMS} select family, arg_min(arm, (-macro, arm)) filter (where passed and macro is not null) as arm, max(macro) filter (where passed) as macro from arms where arm <> 'A0' group by family")
def winning_arms(s: SparkSession, d: str) -> DataFrame:
    n, used = F.col("l_linenumber"), F.col("l_quantity") > 6
    arm = F.when(n == 1, "R_full").when(n == 2, "B0").when(n == 3, "A0").otherwise(F.concat(F.lit("R_minus_t"), n))
    sums = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("family"), arm.alias("arm")).agg(F.sum(F.when(used, micro("l_discount"))).alias("v"), F.count(F.when(used, F.col("l_discount"))).alias("n"), (F.count("*") % 3 != 0).alias("passed"))
    return release.pick_winner(sums.select("family", "arm", F.when(F.col("n") > 0, half_up("v", "n")).alias("macro"), "passed"), ["family"])


POINTS = "pt as (select l_suppkey as family, round(l_discount::double, 2) as threshold, round(avg(l_tax), 6) as score, round(avg(l_quantity) / 50, 6) as precision, round(avg(l_linenumber) / 3, 6) as macro, round(count(*) filter (where l_linestatus = 'F') * 2.0 / count(*), 6)::double as ratio from lineitem where {where} group by all)"


def points(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("l_suppkey").alias("family"), F.round("l_discount", 2).alias("threshold")).agg(F.round(F.avg("l_tax"), 6).alias("score"), F.round(F.avg("l_quantity") / 50, 6).alias("precision"), F.round(F.avg("l_linenumber") / 3, 6).alias("macro"), F.round(F.count_if(F.col("l_linestatus") == "F") * 2.0 / F.count("*"), 6).alias("ratio"))


WHOLE_POINTS = f"pt as (select family, threshold, {HALF_UP.format(a='tax', b='nt')} as score, {HALF_UP.format(a='quantity', b='50 * nq')} as precision, {HALF_UP.format(a='1000000 * number', b='3 * nn')} as macro, {HALF_UP.format(a='2000000 * f', b='n')} as ratio from (select l_suppkey as family, round(l_discount::double, 2) as threshold, sum({MICRO.format(v='l_tax')}) as tax, count(l_tax) as nt, sum({MICRO.format(v='l_quantity')}) as quantity, count(l_quantity) as nq, sum(l_linenumber) as number, count(l_linenumber) as nn, count(*) filter (where l_linestatus = 'F') as f, count(*) as n from lineitem where {{where}} group by all))"


def whole_points(rows: DataFrame) -> DataFrame:
    """The points with means from whole millionths."""
    sums = rows.groupBy(F.col("l_suppkey").alias("family"), F.round("l_discount", 2).alias("threshold")).agg(F.sum(micro("l_tax")).alias("tax"), F.count("l_tax").alias("nt"), F.sum(micro("l_quantity")).alias("quantity"), F.count("l_quantity").alias("nq"), F.sum("l_linenumber").alias("number"), F.count("l_linenumber").alias("nn"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("n"))
    return sums.select("family", "threshold", half_up("tax", "nt").alias("score"), half_up("quantity", "50 * nq").alias("precision"), half_up("1000000 * number", "3 * nn").alias("macro"), half_up("2000000 * f", "n").alias("ratio"))


@query(f"with t as (with {WHOLE_POINTS.format(where='l_orderkey % 2 = 0')} from pt), i as (with {WHOLE_POINTS.format(where='l_orderkey % 2 = 1')} from pt), g as (select family, threshold, min(coalesce(a - b, '-inf'::double)) as worst, bool_and(a is not null and b is not null) as whole from (select l_suppkey as family, round(l_discount::double, 2) as threshold, l_returnflag as scroll, sum(l_quantity) filter (where l_orderkey % 2 = 0) as a, sum(l_quantity) filter (where l_orderkey % 2 = 1) as b from lineitem group by all) group by all), r as (select family, threshold, t.score, t.score - i.score as score_gain, t.precision as p, t.macro as m, coalesce(t.score is not null and i.score is not null and whole, false) as comparable, coalesce(t.score is not null and i.score is not null and whole and worst >= -60 and t.precision - i.precision >= -0.05 and t.ratio between 0.8 and 1.2, false) as qualified from t full join i using (family, threshold) left join g using (family, threshold)) select family, threshold, score, round(score_gain, 6) as score_gain, comparable, qualified, comparable and row_number() over (partition by family order by comparable desc, qualified desc, score desc nulls last, p desc nulls last, m desc nulls last, abs(threshold - 0.5), threshold) = 1 as selected from r")
def operating_points(s: SparkSession, d: str) -> DataFrame:
    """Points of two sweeps by family, which are qualified and which is selected."""
    rows = load(s, d, "lineitem")
    even, odd = F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 2 == 1
    scrolls = rows.groupBy(F.col("l_suppkey").alias("family"), F.round("l_discount", 2).alias("threshold"), F.col("l_returnflag").alias("scroll")).agg(F.sum(F.when(even, F.col("l_quantity"))).alias("after"), F.sum(F.when(odd, F.col("l_quantity"))).alias("before"))
    found = release.operating_points(whole_points(rows.where(odd)), whole_points(rows.where(even)), scrolls, ["family"], release.PointGates(-60.0, -0.05, 0.8, 1.2))
    return found.select("family", "threshold", "score", F.round("score_gain", 6).alias("score_gain"), "comparable", "qualified", "selected")


@query(f"with t as (with {POINTS.format(where='l_orderkey % 2 = 0')} from pt), i as (with {POINTS.format(where='l_orderkey % 3 = 1')} from pt) select family, round(max(abs(t.macro - i.macro)), 6) as largest, count(*) filter (where t.macro is null) as missing from i left join t using (family, threshold) group by family")
def sweep_differences(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "lineitem")
    return release.sweep_difference(points(rows.where("l_orderkey % 2 = 0")), points(rows.where("l_orderkey % 3 = 1")), ["family"]).withColumn("largest", F.round("largest", 6))


FACTS = "{name} as (select l_suppkey as family, count(*) filter (where l_linenumber = 1 and l_quantity < 3) as nb, sum(l_partkey % 9) as nd, round(avg(l_tax), 6) as nr, sum(l_partkey % 7) as gb, count(*) as gd, round(avg(l_discount), 6) as gr, round(avg(l_quantity) / 50, 6) as fd, round(avg(l_linenumber) / 4, 6) as cd from lineitem where l_orderkey % 2 = {half} group by all)"


@query(f"with {FACTS.format(name='c', half=0)}, {FACTS.format(name='b', half=1)}, n as (select family, count(*) as fresh from (select distinct l_suppkey as family, l_partkey % 40 as failure from lineitem where l_orderkey % 2 = 0 and l_tax >= 0.07 except select l_suppkey, l_partkey % 40 from lineitem where l_orderkey % 2 = 1 and l_tax >= 0.02) group by family), r as (select c.family, c.nb, b.nb as bnb, c.nd, b.nd as bnd, c.nr, b.nr as bnr, c.gb, b.gb as bgb, c.gd, b.gd as bgd, c.gr, b.gr as bgr, c.fd, b.fd as bfd, c.cd, b.cd as bcd, coalesce(fresh, 0) as fresh from c left join b using (family) left join n using (family)), v as (select family, unnest([('named_bridge_reduction', case when bnb <= 0 then case when nb > 0 then 0 else 1 end else 1 - nb / bnb end, 0.1::double, null::double), ('named_deep_reduction', case when bnd <= 0 then case when nd > 0 then 0 else 1 end else 1 - nd / bnd end, 0.0::double, null), ('named_recall_drop', bnr - nr, null, 0.0005::double), ('guard_bridge', gb, null, bgb * 1.05::double), ('guard_deep', gd, null, bgd * 1.02::double), ('guard_recall_drop', bgr - gr, null, 0.0005::double), ('fixed_dice_delta', fd - bfd, -0.00505::double, null), ('calibrated_dice_delta', cd - bcd, -0.00505::double, null), ('new_failures', fresh, null, 0)]::struct(criterion varchar, value double, minimum double, maximum double)[], recursive := true) from r) select family, criterion, round(value, 6) as value, round(minimum, 6) as minimum, round(maximum, 6) as maximum, coalesce(case when minimum is not null then value >= minimum else value <= maximum end, false) as passed from v")
def candidate_gates(s: SparkSession, d: str) -> DataFrame:
    """Criteria of candidates by family against their baselines."""
    rows = load(s, d, "lineitem")

    def facts(half: int) -> DataFrame:
        part = rows.where(F.col("l_orderkey") % 2 == half).groupBy(F.col("l_suppkey").alias("family"))
        return part.agg(F.count_if((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 3)).alias("named_bridge"), F.sum(F.col("l_partkey") % 9).alias("named_deep"), F.round(F.avg("l_tax"), 6).alias("named_recall"), F.sum(F.col("l_partkey") % 7).alias("guard_bridge"), F.count("*").alias("guard_deep"), F.round(F.avg("l_discount"), 6).alias("guard_recall"), F.round(F.avg("l_quantity") / 50, 6).alias("fixed_dice"), F.round(F.avg("l_linenumber") / 4, 6).alias("calibrated_dice"))

    def failures(half: int, least: float) -> DataFrame:
        return rows.where((F.col("l_orderkey") % 2 == half) & (F.col("l_tax") >= least)).select(F.col("l_suppkey").alias("family"), (F.col("l_partkey") % 40).alias("failure"))

    gate = release.candidate_gate(facts(0), facts(1), failures(0, 0.07), failures(1, 0.02), ["family"], release.Contract(0.1, 0.0, 0.0005, 0.05, 0.02, 0.0005, 0.00505))
    return gate.select("family", "criterion", "passed", *[F.round(c, 6).alias(c) for c in ("value", "minimum", "maximum")])

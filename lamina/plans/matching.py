"""Queries of joins between curve ends with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import matching
from lamina.plans.bindings import load
from lamina.plans.registry import query
from lamina.sources.shared import dealt

LINES = "li as (select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, max(l_suppkey) as l_suppkey, max(l_discount) as l_discount from lineitem group by all)"
DIRECTIONS = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0), (0.6, 0.8), (-0.6, 0.8), (0.8, -0.6), (-0.8, -0.6)]
CENTRE = (200.0, 180.0)
ENDS = LINES + ", ends as (select l_orderkey * 8 + l_linenumber as id, (l_orderkey // 256)::int as plane, ((l_partkey * 7919 + l_orderkey * 31) % 400)::int as y, ((l_suppkey * 104729 + l_orderkey * l_linenumber) % 400)::int as x, {ty} as ty, {tx} as tx, l_partkey % 90 as component, l_partkey % 45 as skeleton from li), labels as (select plane, y, x, max(component) as label from ends group by all)".format(**{name: "[" + ", ".join(f"{d[i]}::double" for d in DIRECTIONS) + "][(l_orderkey * 3 + l_linenumber) % 8 + 1]" for i, name in enumerate(("ty", "tx"))})
PAIRS = f'''{ENDS}, pairs as (select a.plane, a.id as a, b.id as b, a.y as ay, a.x as ax, b.y as "by", b.x as bx, a.ty as aty, a.tx as atx, b.ty as bty, b.tx as btx, a.component as ac, b.component as bc, a.skeleton as sa, b.skeleton as sb, (a.id * 3 + b.id) % 10 / 10.0::double as adjacent, (a.id + b.id * 7) % 10 / 10.0::double as track, sqrt(((b.y - a.y) ** 2 + (b.x - a.x) ** 2)::double) as d from ends a, ends b where a.plane = b.plane and a.id < b.id and abs(a.y - b.y) <= 21 and abs(a.x - b.x) <= 21 and (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 441), faced as (select *, d > 6 as far, case when d > 6 then 0.866 else 0.707 end::double as need, aty * (("by" - ay) / d) + atx * ((bx - ax) / d) as cos_a, -(bty * (("by" - ay) / d) + btx * ((bx - ax) / d)) as cos_b, aty * bty + atx * btx as oppose, abs(sqrt((ay - 200) ** 2 + (ax - 180) ** 2) - sqrt(("by" - 200) ** 2 + (bx - 180) ** 2)) as radial from pairs where d >= 0.5), scored as (select *, 0.3 * exp(-d * d / 200) + 0.15 * (least(1, (cos_a - need) / (1 - need)) + least(1, (cos_b - need) / (1 - need))) + 0.15 * adjacent + 0.25 * track as score from faced)'''
CUBIC = '(1 - t) * (1 - t) * (1 - t) * a{c} + 3 * (1 - t) * (1 - t) * t * (a{c} + d / 3 * at{c}) + 3 * (1 - t) * t * t * ("b{c}" + d / 3 * bt{c}) + t * t * t * "b{c}"'
ARC = f"arcs as (select a, b, sum(sqrt((y - py) ** 2 + (x - px) ** 2)) / max(d) as arc from (select a, b, d, y, x, lag(y) over w as py, lag(x) over w as px from (select *, {CUBIC.format(c='y')} as y, {CUBIC.format(c='x')} as x from (select *, k / 20.0::double as t from scored, generate_series(0, 20) g(k) where cos_a >= need and cos_b >= need)) window w as (partition by a, b order by t)) group by a, b)"


def _ladder(gate: str, floor: float) -> str:
    return f"case when ac = bc and ac > 0 or sa = sb and sa > 0 then 'same_cc' when not (cos_a >= need and cos_b >= need and oppose <= case when far then -0.4 else 0.0 end) then 'tangent' {gate} when score < {floor} then 'score' when arc >= 1.15 then 'arc' end"


def plane() -> Column:
    return F.floor(F.col("l_orderkey") / 256).cast("int").alias("plane")


def lines(s: SparkSession, d: str, by_plane: bool = False) -> DataFrame:
    """One row for each key of an order line; with by_plane dealt by the plane of ends, which the order tells, so that planes aren't shuffled again."""
    rows, keys = load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    if by_plane:
        rows, keys = dealt(rows.select("*", plane()), rows.count(), "plane"), ["plane", *keys]
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_discount")])


def ends(s: SparkSession, d: str, by_plane: bool = False) -> DataFrame:
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    turn = ((key * 3 + n) % 8).cast("int")
    ty, tx = (F.element_at(F.array(*[F.lit(p[i]) for p in DIRECTIONS]), turn + 1) for i in range(2))
    return lines(s, d, by_plane).select((key * 8 + n).alias("id"), F.col("plane") if by_plane else plane(), ((F.col("l_partkey") * 7919 + key * 31) % 400).cast("int").alias("y"), ((F.col("l_suppkey") * 104729 + key * n) % 400).cast("int").alias("x"), ty.alias("ty"), tx.alias("tx"), (F.col("l_partkey") % 90).alias("component"), (F.col("l_partkey") % 45).alias("skeleton"))


def labels(rows: DataFrame) -> DataFrame:
    return rows.groupBy("plane", "y", "x").agg(F.max("component").alias("label"))


def pairs(s: SparkSession, d: str, by_plane: bool = False) -> DataFrame:
    rows = ends(s, d, by_plane)
    a, b = F.col("a"), F.col("b")
    found = matching.pairs_in_planes(rows, 21) if by_plane else matching.near_pairs(rows, 21)
    return found.withColumns({"adjacent": (a * 3 + b) % 10 / 10, "track": (a + b * 7) % 10 / 10})


@query(f"with {PAIRS} select plane, count(*) as n, count(*) filter (where far) as far, round(sum(cos_a), 4) as cos_a, round(sum(cos_b), 4) as cos_b, round(sum(oppose), 4) as oppose, round(sum(radial), 4) as radial, round(sum(score), 4) as score from scored group by plane")
def join_scores(s: SparkSession, d: str) -> DataFrame:
    """Geometry of all pairs of ends in a plane within 21 pixels, summed by plane."""
    rows = matching.join_geometry(pairs(s, d), centre=CENTRE).where("distance >= 0.5")
    return rows.groupBy("plane").agg(F.count("*").alias("n"), F.count_if("far").alias("far"), *[F.round(F.sum(c), 4).alias(c) for c in ("cos_a", "cos_b", "oppose", "radial", "score")])


@query(f"with {PAIRS}, {ARC}, r as (select 'open' as round, {_ladder('when far and adjacent < 0.5 and track < 0.5 then $$evidence$$'.replace('$$', chr(39)), 0.3)} as reason, score, a, b from scored left join arcs using (a, b) union all select 'radial', {_ladder('when radial > 3 then $$radial$$'.replace('$$', chr(39)), 0.3)}, score, a, b from scored left join arcs using (a, b) union all select 'provisional', {_ladder('', 0.22)}, score, a, b from scored left join arcs using (a, b)) select round, reason, count(*) as n, round(sum(score), 4) as score, sum(a)::bigint as a, sum(b)::bigint as b from r group by round, reason")
def match_reasons(s: SparkSession, d: str) -> DataFrame:
    """Pairs of ends by the gate that refuses them: without a centre, with one, and in a provisional round."""
    rows = pairs(s, d)
    rounds = {"open": matching.match_candidates(rows), "radial": matching.match_candidates(rows, centre=CENTRE), "provisional": matching.match_candidates(rows, provisional=True)}
    both = None
    for name, r in rounds.items():
        part = r.groupBy(F.lit(name).alias("round"), "reason").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        both = part if both is None else both.unionByName(part)
    return both


FLOOR = "floor({v} + 0.5)::int"
STROKE = f"c as (select * from scored left join arcs using (a, b) where {_ladder('', 0.22)} is null), stroke as (select distinct plane, a, b, ac, bc, {FLOOR.format(v=CUBIC.format(c='y'))} as y, {FLOOR.format(v=CUBIC.format(c='x'))} as x from (select *, k / (floor(d * 2) + 1) as t from (select *, unnest(generate_series(0, (floor(d * 2) + 1)::bigint)) as k from c))), merger as (select distinct s.plane, a, b from stroke s join labels l on s.plane = l.plane and l.y between s.y - 2 and s.y + 2 and l.x between s.x - 2 and s.x + 2 where label > 0 and label <> ac and label <> bc)"
CROSS = f'''middle as (select distinct plane, a, b, ay, ax, "by", bx, {FLOOR.format(v=CUBIC.format(c='y'))} as y, {FLOOR.format(v=CUBIC.format(c='x'))} as x from (select *, k / 20.0::double as t from c, generate_series(2, 18) g(k))), xsheet as (select distinct m.plane, m.a, m.b from (select * from middle, (values (-2), (-1), (1), (2)) o(dz)) m join labels l on l.plane = m.plane + dz and l.y = m.y and l.x = m.x left join labels p on p.plane = m.plane + dz and p.y = m.ay and p.x = m.ax left join labels q on q.plane = m.plane + dz and q.y = m."by" and q.x = m.bx where l.label > 0 and l.label <> coalesce(p.label, 0) and l.label <> coalesce(q.label, 0))'''


@query(f"with {PAIRS}, {ARC}, {STROKE}, {CROSS} select plane, case when m.a is not null then 'merger' when x.a is not null then 'cross_sheet' end as reason, count(*) as n, sum(a)::bigint as a, sum(b)::bigint as b from c left join merger m using (plane, a, b) left join xsheet x using (plane, a, b) group by plane, 2")
def guarded_matches(s: SparkSession, d: str) -> DataFrame:
    """Provisional candidates whose curves pass a third body in the plane or another sheet in the next ones."""
    rows = matching.match_candidates(pairs(s, d, True), provisional=True).where("reason is null")
    rows = rows.select("plane", "a", "b", *[f"{e}{c}" for e in "ab" for c in ("y", "x", "ty", "tx", "component")], "reason")
    return matching.guarded(rows, labels(ends(s, d, True))).groupBy("plane", "reason").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


AXIS_ENDS = LINES + ", e as (select l_orderkey * 8 + l_linenumber as id, (l_orderkey // 256)::int as plane, (l_partkey % 40)::int as y, ((l_orderkey + l_suppkey) % 40)::int as x, l_partkey % 3 as component from li), l as (select plane, y, x, component as label from e group by all)"


@query(f"with {AXIS_ENDS}, j as (select id, count(l.y) as n, var_samp(l.y - e.y) as a, var_samp(l.x - e.x) as c, covar_samp(l.y - e.y, l.x - e.x) as b, -avg(l.y - e.y) as oy, -avg(l.x - e.x) as ox from e left join l on l.plane = e.plane and l.label = e.component and abs(l.y - e.y) <= 8 and abs(l.x - e.x) <= 8 group by id), v as (select *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) as high, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) as low, sqrt(oy * oy + ox * ox) as away from j) select id, n, case when n >= 5 then round(high / greatest(0.25, low), 4) else 0 end::double as anisotropy, case when n >= 5 then round(abs(oy / greatest(1e-8, away)), 5) else 0 end::double as outward_y, case when n >= 5 then round(abs(ox / greatest(1e-8, away)), 5) else 0 end::double as outward_x from v")
def local_axes(s: SparkSession, d: str) -> DataFrame:
    """Axes of ends in the windows of their bodies."""
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = lines(s, d).select((key * 8 + n).alias("id"), F.floor(key / 256).cast("int").alias("plane"), (F.col("l_partkey") % 40).cast("int").alias("y"), ((key + F.col("l_suppkey")) % 40).cast("int").alias("x"), (F.col("l_partkey") % 3).alias("component"))
    axes = matching.local_axis(rows, rows.select("plane", "y", "x", F.col("component").alias("label")).distinct())
    return axes.select("id", "n", F.round("anisotropy", 4).alias("anisotropy"), *[F.round(F.abs(F.col(c)), 5).alias(c) for c in ("outward_y", "outward_x")])


@query(f"with {LINES}, p as (select l_suppkey as path, l_orderkey * 8 + l_linenumber as i, (l_partkey % 97)::int as y, (l_orderkey % 89)::int as x, l_discount::double as probability, l_linenumber % 3 as label from li), w as (select *, y - lag(y) over o as dy, x - lag(x) over o as dx, y - lag(y, 4) over o as iy, x - lag(x, 4) over o as ix, lead(y, 4) over o - y as ny, lead(x, 4) over o - x as nx, sqrt((y - 40) ** 2 + (x - 30) ** 2) as r from p window o as (partition by path order by i)), g as (select path, coalesce(sum(sqrt(dy * dy + dx * dx)), 0) as length, arg_min(y, i) as y0, arg_max(y, i) as y1, arg_min(x, i) as x0, arg_max(x, i) as x1, arg_min(r, i) as r0, arg_max(r, i) as r1, count(*) filter (where label = 0) as gap_pixels, avg(probability) filter (where label = 0) as mean, min(probability) filter (where label = 0) as least, quantile_cont(probability, 0.1) filter (where label = 0) as p10, max(r) - min(r) as extent, min((iy * ny + ix * nx) / greatest(1e-8, sqrt(iy * iy + ix * ix) * sqrt(ny * ny + nx * nx))) as c from w group by path) select path, round(length, 4) as length, round(sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2), 6) as chord, round(length / greatest(1, sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2)), 4) as arc_ratio, gap_pixels, round(mean, 6) as mean, least, round(p10, 6) as p10, round(abs(r1 - r0), 6) as radial_difference, round(extent, 6) as radial_extent, round(case when c is null then 0 else degrees(acos(least(1, greatest(-1, c)))) end, 3) as turn from g")
def path_features(s: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey")
    points = lines(s, d).select(F.col("l_suppkey").alias("path"), (key * 8 + F.col("l_linenumber")).alias("i"), (F.col("l_partkey") % 97).cast("int").alias("y"), (key % 89).cast("int").alias("x"), F.col("l_discount").alias("probability"), (F.col("l_linenumber") % 3).alias("label"))
    rows = matching.path_features(points, (40.0, 30.0))
    digits = {"length": 4, "chord": 6, "arc_ratio": 4, "mean": 6, "p10": 6, "radial_difference": 6, "radial_extent": 6, "turn": 3}
    return rows.select("path", "gap_pixels", "least", *[F.round(c, n).alias(c) for c, n in digits.items()])

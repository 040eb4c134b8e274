"""Queries of growing masks and their seams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import growth
from lamina.operators.necks import find_necks, neck_support
from lamina.plans.bindings import grid, load
from lamina.plans.registry import query
from lamina.sources.shared import materialise

DENSE = "dense as (select (l_orderkey // 1024 * 2 + l_linenumber % 2)::int as z, (l_partkey % 16)::int as y, (l_orderkey % 16)::int as x, sum(round(l_discount * 100)::bigint) / count(*) as p from lineitem group by all)"


def dense(s: SparkSession, d: str) -> DataFrame:
    """z, y, x, p: planes of 16 x 16 cells, nearly all of them known."""
    cell = [(F.floor(F.col("l_orderkey") / 1024) * 2 + F.col("l_linenumber") % 2).cast("int").alias("z"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_orderkey") % 16).cast("int").alias("x")]
    return load(s, d, "lineitem").groupBy(*cell).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*")).alias("p"))


@query()
def ridge_growth(s: SparkSession, d: str) -> DataFrame:
    """Voxels grown from the strong ones along the weaker ones, with their step and seed component."""
    field = materialise(dense(s, d), "field")
    mask, _ = growth.grow_ridges(field, field.where("p >= 6.5"), 4.0, 3)
    return mask.where("step > 0").select("z", "y", "x", "label", "step")


def seams(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    field = materialise(dense(s, d), "field")
    targets = field.select(*[F.floor(F.col(c) / 4).cast("int").alias(f"c{c}") for c in "zyx"]).distinct().where("(cz + cy + cx) % 5 <> 0")
    return field.where("p >= 5.0"), field.where("p >= 4.0"), field, targets


SEAMS = f"""{DENSE}, seed as materialized (select z, y, x from dense where p >= 5.0), cand as materialized (select z, y, x, p from dense where p >= 4.0), o as (select * from (values (0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) v(dz, dy, dx)),
seed_in as (select z + dz as z, y + dy as y, x + dx as x from seed, o group by all having count(*) = 7), cand_in as (select z + dz as z, y + dy as y, x + dx as x from cand, o group by all having count(*) = 7),
fresh as materialized (select * from cand_in anti join seed_in using (z, y, x) where (z // 4 + y // 4 + x // 4) % 5 <> 0),
added as (select * from cand anti join seed using (z, y, x) where (z // 4 + y // 4 + x // 4) % 5 <> 0), moved as materialized (select z + dz as sz, y + dy as sy, x + dx as sx, added.* from added, o),
gone as materialized (select distinct z, y, x, p from (select m.* from moved m join fresh f on f.z = sz and f.y = sy and f.x = sx qualify row_number() over (partition by sz, sy, sx order by p, m.z, m.y, m.x) = 1))"""


@query(f"with {SEAMS} select z, y, x, round(p, 6) as p from gone")
def seam_removals(s: SparkSession, d: str) -> DataFrame:
    """Additions given up at the seams of cubes."""
    return growth.seam_removals(*seams(s, d), 4).select("z", "y", "x", F.round("p", 6).alias("p"))


@query(f"with {SEAMS}, rest as (select z, y, x from cand anti join gone using (z, y, x)), rest_in as (select z + dz as z, y + dy as y, x + dx as x from rest, o group by all having count(*) = 7) select (select count(*) from fresh) as new_interior, (select count(*) from gone) as removed, (select count(*) from rest_in anti join seed_in using (z, y, x) where (z // 4 + y // 4 + x // 4) % 5 <> 0) as remaining")
def seam_report(s: SparkSession, d: str) -> DataFrame:
    """New interior voxels before and after the removals."""
    seed, candidate, field, targets = seams(s, d)
    return growth.seam_report(seed, candidate, growth.seam_removals(seed, candidate, field, targets, 4), targets, 4)


@query()
def neck_certificates(s: SparkSession, d: str) -> DataFrame:
    """Thin necks between bodies of the planes, with their support in near planes."""
    necks = materialise(find_necks(grid(s, d).select("z", F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x")).distinct(), (31.5, 30.5)), "necks")
    return neck_support(necks).withColumns({c: F.round(c, 6) for c in ("width", "dr", "radial_dot")})

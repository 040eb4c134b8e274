"""Queries of chunks with halos and of registration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import chunks
from lamina.operators import registration as reg
from lamina.plans.bindings import GRID, grid, load
from lamina.plans.registry import query

CHUNK, HALO = (4, 16, 16), (2, 2, 2)


def planes(s: SparkSession, d: str) -> int:
    """Number of planes of the grid."""
    return load(s, d, "lineitem").agg(F.max(F.floor(F.col("l_orderkey") / 1024)).alias("z")).first().z * 2 + 2


@query(f"""with {GRID}, ext as (select max(l_orderkey // 1024) * 2 + 2 as nz from lineitem), present as (select distinct z // 4 as tz, y // 16 as ty, x // 16 as tx from grid),
near as (select a.tz, a.ty, a.tx, count(*) as there from present a join present b on b.tz between floor((a.tz * 4 - 2) / 4) and floor((a.tz * 4 + 5) / 4) and abs(a.ty - b.ty) <= 1 and abs(a.tx - b.tx) <= 1 group by all),
need as (select tz, ty, tx, there, (least(tz + 1, (nz + 3) // 4 - 1) - greatest(tz - 1, 0) + 1) * (least(ty + 1, 3) - greatest(ty - 1, 0) + 1) * (least(tx + 1, 3) - greatest(tx - 1, 0) + 1) as needed from near, ext),
v as (select tz, ty, tx, count(*) as n_context, count(*) filter (where z // 4 = tz and y // 16 = ty and x // 16 = tx) as n_core, round(sum(value), 6) as total from present join grid on z between tz * 4 - 2 and tz * 4 + 5 and y between ty * 16 - 2 and ty * 16 + 17 and x between tx * 16 - 2 and tx * 16 + 17 group by all)
select tz, ty, tx, needed::bigint as needed, (needed - there)::bigint as missing, case when needed > there then 'incomplete' end as reason, n_core, n_context, total from need join v using (tz, ty, tx)""")
def halo_context(s: SparkSession, d: str) -> DataFrame:
    """Every present chunk with the state of its context and figures of the voxels in its widened box."""
    voxels = grid(s, d)
    present = voxels.select(*chunks.chunk_of(CHUNK)).distinct()
    gaps = chunks.context_gaps(present, present, CHUNK, HALO, (planes(s, d), 64, 64))
    own = F.lit(True)
    for c, t in zip(chunks.chunk_of(CHUNK), chunks.TARGET, strict=True):
        own = own & (c == F.col(t))
    facts = chunks.with_halo(voxels, CHUNK, HALO).groupBy(*chunks.TARGET).agg(F.count_if(own).alias("n_core"), F.count("*").alias("n_context"), F.round(F.sum("value"), 6).alias("total"))
    return gaps.join(facts, chunks.TARGET)


@query(f"""with {GRID}, ext as (select max(l_orderkey // 1024) * 2 + 2 as nz from lineitem), occ as (select distinct z, y // 4 as y, x // 8 as x from grid where value > 0),
cube as (select i as z, j * 8 as y, k * 8 as x from (select unnest(range(nz)) as i from ext), (select unnest(range(8)) as j), (select unnest(range(8)) as k)),
fits as (select cube.* from cube, ext where z - 1 >= 0 and z + 2 <= nz and y - 4 >= 0 and y + 12 <= 64 and x - 8 >= 0 and x + 16 <= 64)
select c.z::int as z, c.y::int as y, c.x::int as x from fits c join occ o on o.z between c.z - 1 and c.z + 1 and o.y between (c.y - 4) // 4 and (c.y + 11) // 4 and o.x between (c.x - 8) // 8 and (c.x + 15) // 8 group by all having count(*) = 3 * 4 * 3""")
def eligible_cubes(s: SparkSession, d: str) -> DataFrame:
    """Cubes whose haloed context has only occupied coarse cells."""
    occupied = chunks.occupancy(grid(s, d).where("value > 0"), (1, 4, 8))
    return chunks.eligible_cubes(occupied, (planes(s, d), 64, 64), (1, 8, 8), (1, 4, 8), (1, 4, 8))


def field_pairs(s: SparkSession, d: str) -> DataFrame:
    """pair, z, y, x, fixed, moving: slabs of 32 planes; the moving field isn't known at every voxel."""
    moving = F.when((F.col("y") + F.col("x")) % 5 != 0, F.col("other"))
    return grid(s, d).select(F.floor(F.col("z") / 32).cast("int").alias("pair"), (F.col("z") % 32).alias("z"), "y", "x", F.col("value").alias("fixed"), moving.alias("moving"))


PAIRS = f"{GRID}, pairs as (select z // 32 as pair, z % 32 as z, y, x, value as fixed, case when (y + x) % 5 <> 0 then other end as moving from grid)"
STEPS = "(select unnest(range(-2, 3)) as {0})"
NCC = f"""{PAIRS}, sizes as (select pair, least(count(fixed), count(moving)) as whole from pairs group by 1),
moved as materialized (select pair, dz, dy, dx, z - dz as z, y - dy as y, x - dx as x, fixed from pairs, {STEPS.format("dz")}, {STEPS.format("dy")}, {STEPS.format("dx")}), there as materialized (select * from pairs where moving is not null),
m as (select pair, dz, dy, dx, count(*) as n, sum(a.fixed) as a, sum(b.moving) as b, sum(a.fixed * a.fixed) as aa, sum(b.moving * b.moving) as bb, sum(a.fixed * b.moving) as ab from moved a join there b using (pair, z, y, x) group by all),
ncc as (select pair, dz::int as dz, dy::int as dy, dx::int as dx, n as overlap, case when n >= greatest(150, floor(whole * 0.05)) and sqrt(greatest(aa - a * a / n, 0) * greatest(bb - b * b / n, 0)) > 1e-8 then (ab - a * b / n) / sqrt(greatest(aa - a * a / n, 0) * greatest(bb - b * b / n, 0)) end as ncc from m join sizes using (pair))"""


def scored(s: SparkSession, d: str) -> DataFrame:
    pairs = field_pairs(s, d)
    return reg.shift_scores(reg.shift_moments(pairs, 2, ("pair",)), pairs, ("pair",), 150, 0.05)


@query(f"with {NCC} select pair, dz, dy, dx, overlap, round(ncc, 6) as ncc from ncc")
def ncc_scores(s: SparkSession, d: str) -> DataFrame:
    """Masked correlation of two fields at every integer shift of at most 2."""
    return scored(s, d).withColumn("ncc", F.round("ncc", 6))


@query(f"""with {NCC}, best as (select * from ncc where ncc is not null qualify row_number() over (partition by pair order by round(ncc, 12) desc, dz, dy, dx) = 1),
second as (select b.pair, max(n.ncc) as ncc from best b join ncc n using (pair) where greatest(abs(b.dz - n.dz), abs(b.dy - n.dy), abs(b.dx - n.dx)) > 2 group by 1),
pair as (select distinct pair from ncc), none as (select * from ncc where dz = 0 and dy = 0 and dx = 0)
select pair, b.dz, b.dy, b.dx, round(b.ncc, 6) as best, b.overlap, round(o.ncc, 6) as nominal, coalesce(o.overlap, 0) as nominal_overlap, round(b.ncc - o.ncc, 6) as gain, round(b.ncc - s.ncc, 6) as margin, greatest(abs(b.dz), abs(b.dy), abs(b.dx)) = 2 as boundary from pair left join best b using (pair) left join none o using (pair) left join second s using (pair)""")
def ncc_search(s: SparkSession, d: str) -> DataFrame:
    """Best shift of each pair with the margin to the next separated peak."""
    found = reg.shift_search(scored(s, d), 2, ("pair",)).drop("peaks")
    return found.withColumns({c: F.round(F.nanvl(c, F.lit(None)), 6) for c in ("best", "nominal", "gain", "margin")})


def anchors(s: SparkSession, d: str) -> DataFrame:
    """scroll, key, z, y, x and shifts sz, sy, sx: a small affine with noise, and outliers in two of the scrolls."""
    z, y, x = F.col("l_partkey").cast("double"), (F.col("l_orderkey") % 613).cast("double"), (F.col("l_orderkey") * 7 % 997).cast("double")
    noise = [(F.col("l_discount") - 0.05) * 8, (F.col("l_tax") - 0.04) * 6, (F.col("l_quantity") - 25) / 60]
    far = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") != "A"), 12.0).otherwise(0.0)
    shifts = [0.001 * z - 0.002 * y + 1.5 + noise[0], 0.0015 * x - 2.0 + noise[1] + far, 0.0005 * y + 0.001 * z + noise[2]]
    return load(s, d, "lineitem").select(F.col("l_returnflag").alias("scroll"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), z.alias("z"), y.alias("y"), x.alias("x"), *[v.alias(n) for v, n in zip(shifts, reg.DELTA, strict=True)])


@query("""with a as (select l_returnflag as scroll, l_partkey::double as z, (l_orderkey % 613)::double as y, (l_orderkey * 7 % 997)::double as x, (l_discount - 0.05) * 8 as n0, (l_tax - 0.04) * 6 as n1, (l_quantity - 25) / 60 as n2, case when l_linenumber = 7 and l_returnflag <> 'A' then 12.0 else 0.0 end as far from lineitem),
o as (select scroll, 0.001 * z - 0.002 * y + 1.5 + n0 as sz, 0.0015 * x - 2.0 + n1 + far as sy, 0.0005 * y + 0.001 * z + n2 as sx, z, y, x from a),
p as (select scroll, sz, sy, sx, z - sz as oz, y - sy as oy, x - sx as ox from o),
f as (select scroll, avg(oz) as mz, avg(oy) as my, avg(ox) as mx, greatest(stddev_pop(oz), 1.0) as dz, greatest(stddev_pop(oy), 1.0) as dy, greatest(stddev_pop(ox), 1.0) as dx from p group by 1),
u as (select scroll, (oz - mz) / dz as u0, (oy - my) / dy as u1, (ox - mx) / dx as u2, sz, sy, sx from p join f using (scroll))
select scroll, count(*) as n, round(sum(u0 * u0), 3) as g00, round(sum(u0 * u1), 3) as g01, round(sum(u0 * u2), 3) as g02, round(sum(u1 * u2), 3) as g12, round(sum(u0 * sz), 3) as h00, round(sum(u1 * sz), 3) as h10, round(sum(u2 * sy), 3) as h21, round(sum(u1 * sx), 3) as h12, round(sum(sz), 3) as h30 from u group by 1""")
def affine_normal_sums(s: SparkSession, d: str) -> DataFrame:
    """Normal equations of the first round of each scroll's affine fit."""
    sums = reg.normal_sums(reg.prepared(anchors(s, d), ("scroll",)), ("scroll",), F.lit(1.0))
    return sums.select("scroll", "n", *[F.round(c, 3).alias(c) for c in ("g00", "g01", "g02", "g12", "h00", "h10", "h21", "h12", "h30")])


@query()
def affine_refinement(s: SparkSession, d: str) -> DataFrame:
    """Robust affine of each scroll, judged on held-out anchors."""
    found = reg.refine(anchors(s, d), ("scroll",), "key")
    figures = ["largest_component", "largest_norm", "median_norm", "p90_norm", "rms"]
    return found.withColumns({c: F.round(c, 5) for c in figures} | {"correction": F.transform("correction", lambda v: F.round(v, 6)), "reasons": F.array_join("reasons", "; ")})


def volume_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """volumes, transforms and sources made from the suppliers; a source is the first one of a nation."""
    k = F.col("s_suppkey")
    rows = load(s, d, "supplier")
    volumes = rows.select(k.alias("volume"), F.when(k % 4 == 0, F.col("s_nationkey")).alias("grid"))
    scale = 1 + k % 5 / 10.0
    matrix = F.array(scale, F.lit(0.0), F.lit(0.0), (k % 11).cast("double"), F.lit(0.0), scale, F.lit(0.0), (k % 7).cast("double"), F.lit(0.0), F.lit(0.0), scale, F.lit(-1.0))
    transforms = rows.where(k % 3 != 0).select(k.alias("volume"), F.floor(k / 4).alias("to_volume"), matrix.alias("matrix")).unionByName(rows.where(k % 5 == 1).select(k.alias("volume"), (k + 7).alias("to_volume"), matrix.alias("matrix")))
    return volumes, transforms, rows.groupBy("s_nationkey").agg(F.min(k).alias("volume")).select("volume")


def _paths_sql(rounds: int) -> str:
    ctes = ["""v as (select s_suppkey as volume, case when s_suppkey % 4 = 0 then s_nationkey end as grid from supplier)""",
            """t as (select s_suppkey as volume, s_suppkey // 4 as next, 1 + s_suppkey % 5 / 10.0::double as s, s_suppkey % 11::double as x, s_suppkey % 7::double as y from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, s_suppkey + 7, 1 + s_suppkey % 5 / 10.0::double, s_suppkey % 11::double, s_suppkey % 7::double from supplier where s_suppkey % 5 = 1)""",
            """ends as (select t.volume, t.next, 0 as ord, s, x, y, -1.0::double as z from t semi join v on v.volume = t.next union all select t.next, t.volume, 1, 1 / s, -x / s, -y / s, 1 / s from t semi join v on v.volume = t.next)""",
            """e as (select * from ends where volume <> next qualify row_number() over (partition by volume, next order by ord, s, x, y) = 1)""",
            """f0 as (select min(s_suppkey) as source, min(s_suppkey) as volume, 0 as steps, [min(s_suppkey)] as path, 1.0::double as s, 0.0::double as x, 0.0::double as y, 0.0::double as z from supplier group by s_nationkey)""",
            "seen0 as (select source, volume from f0)"]
    for k in range(1, rounds + 1):
        p = k - 1
        ctes.append(f"""f{k} as materialized (select source, volume, {k} as steps, list_append(path, volume) as path, s, x, y, z from (select f.source, e.next as volume, f.path, e.s * f.s as s, e.s * f.x + e.x as x, e.s * f.y + e.y as y, e.s * f.z + e.z as z, 0 as rank from f{p} f join e on e.volume = f.volume
 union all select f.source, b.volume, f.path, f.s, f.x, f.y, f.z, 1 from f{p} f join v a on a.volume = f.volume join v b on a.grid = b.grid) c anti join seen{p} using (source, volume) qualify row_number() over (partition by source, volume order by path, rank) = 1)""")
        ctes.append(f"seen{k} as materialized (select * from seen{p} union all select source, volume from f{k})")
    union = " union all ".join(f"select * from f{k}" for k in range(rounds + 1))
    return f"with {', '.join(ctes)} select source, volume, steps, array_to_string(path, '-') as path, round(s, 5) as scale, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from ({union})"


@query(_paths_sql(16))
def transform_paths(s: SparkSession, d: str) -> DataFrame:
    """Shortest chains of transforms from each source volume, composed."""
    found = reg.transform_paths(*volume_graph(s, d))
    return found.select("source", "volume", "steps", F.array_join(F.transform("path", lambda v: v.cast("string")), "-").alias("path"), F.round(F.col("matrix")[0], 5).alias("scale"), *[F.round(F.col("matrix")[3 + 4 * i], 4).alias(c) for i, c in enumerate("xyz")])


# Fine to coarse on (x, y, z).
MATRIX = [0.5, 0.1, 0.0, 0.25, 0.0, 0.5, 0.0, -0.3, 0.0, 0.0, 0.5, 0.1]
FINE_PLACES = "2 * (x - 0.25) - 0.4 * (y + 0.3) as fx, 2 * (y + 0.3) as fy, 2 * (z - 0.1) as fz"
COARSE = "box as (select distinct z // 2 as z, y // 2 as y, x // 2 as x from grid)"


def coarse_box(s: SparkSession, d: str) -> DataFrame:
    return grid(s, d).select(*[F.floor(F.col(c) / 2).cast("int").alias(c) for c in reg.CELL]).distinct()


def covered(s: SparkSession, d: str) -> DataFrame:
    """All voxels of all planes but for a notch in every 24th."""
    cells = load(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 1024).cast("int").alias("p")).distinct().select(F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("z"))
    cells = cells.select("z", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y")).select("z", "y", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    return cells.where("not (z % 24 = 0 and y < 8)")


@query(f"""with {GRID}, {COARSE}, w as (select k, exp(-k * k / (2 * sg * sg)) as w from (select unnest(range(-2, 3)) as k), (select 0.5 * pow(0.125, -1 / 3.0) as sg)), n as (select k, w / (select sum(w) from w) as w from w),
sm as materialized (select g.z + a.k as z, g.y + b.k as y, g.x + c.k as x, sum(value * 10 * a.w * b.w * c.w) as v from grid g, n a, n b, n c group by all),
f as (select z, y, x, {FINE_PLACES} from box),
c as materialized (select z, y, x, floor(fz)::int + a as gz, floor(fy)::int + b as gy, floor(fx)::int + c as gx, (case when a = 1 then fz - floor(fz) else 1 - fz + floor(fz) end) * (case when b = 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * (case when c = 1 then fx - floor(fx) else 1 - fx + floor(fx) end) as w from f, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b), (select unnest([0, 1]) as c)),
q as (select c.z, c.y, c.x, sum(w * v) as p from c join sm on sm.z = gz and sm.y = gy and sm.x = gx group by all),
plane as (select distinct l_orderkey // 1024 * 2 + k as z from lineitem, (select unnest([0, 1]) as k)), cov as materialized (select z, y, x from plane, (select unnest(range(64)) as y), (select unnest(range(64)) as x) where not (z % 24 = 0 and y < 8)),
near as (select z, y, x, floor(fz + 0.5)::int as gz, floor(fy + 0.5)::int as gy, floor(fx + 0.5)::int as gx from f), cell as (select distinct gz, gy, gx from near),
d as (select unnest(range(-5, 6)) as o), ball as (select a.o as bz, b.o as "by", c.o as bx from d a, d b, d c where a.o * a.o + b.o * b.o + c.o * c.o <= 25),
around as materialized (select gz, gy, gx, gz + bz as z, gy + "by" as y, gx + bx as x from cell, ball), solid as (select gz, gy, gx from around join cov using (z, y, x) group by all having count(*) = (select count(*) from ball))
select n.z, n.y, n.x, round(least(greatest(coalesce(p, 0), 0), 1), 5) as p, s.gz is not null as valid from near n left join q using (z, y, x) left join solid s using (gz, gy, gx)""")
def pull_back(s: SparkSession, d: str) -> DataFrame:
    """A fine field smoothed and sampled at coarse voxels, with the voxels that have full coverage."""
    fine = grid(s, d).withColumn("value", F.col("value") * 10)
    return reg.pull_back(fine, "value", MATRIX, coarse_box(s, d), covered(s, d), reach=2.0).withColumn("p", F.round("p", 5))


@query(f"""with {GRID}, {COARSE}, l as (select z, y, x, case when value >= 0.09 then 1 when value >= 0.03 then 0 else 2 end as label from grid),
hit as (select distinct floor(0.5 * z + 0.1 + 0.5)::int as z, floor(0.5 * y - 0.3 + 0.5)::int as y, floor(0.5 * x + 0.1 * y + 0.25 + 0.5)::int as x from l where label = 1),
f as (select z, y, x, {FINE_PLACES} from box), near as (select z, y, x, floor(fz + 0.5)::int as gz, floor(fy + 0.5)::int as gy, floor(fx + 0.5)::int as gx from f)
select n.z, n.y, n.x, case when h.z is not null then 1 when l.label in (0, 1) then 0 else 2 end as label from near n left join hit h using (z, y, x) left join l on l.z = gz and l.y = gy and l.x = gx""")
def push_forward(s: SparkSession, d: str) -> DataFrame:
    """Labels of fine voxels on the coarse voxels that they land on."""
    label = F.when(F.col("value") >= 0.09, 1).when(F.col("value") >= 0.03, 0).otherwise(2)
    return reg.push_forward(grid(s, d).select(*reg.CELL, label.alias("label")), MATRIX, coarse_box(s, d))

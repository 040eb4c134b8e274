"""Queries of the checks over manifests, runs, chunks and meshes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number, hash_number_sql
from lamina.operators import audits as audit_ops
from lamina.operators import graph, predicates, quality
from lamina.plans.audits import MESH, mesh
from lamina.plans.bindings import LABELS, MASK, PATCHES, load, mask, patches
from lamina.plans.registry import query

# Two runs over the orders: the second lacks some rows, has some of its own and differs on others.
RUNS = f"{PATCHES}, run_a as (select patch_id, scroll, split, case when patch_id % 9 = 0 then -1.0 else score end as score, known from patches where patch_id % 11 <> 0), run_b as (select * from patches where patch_id % 13 <> 0)"


def runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = patches(s, d)
    changed = F.when(F.col("patch_id") % 9 == 0, -1.0).otherwise(F.col("score"))
    return rows.where("patch_id % 11 <> 0").withColumn("score", changed), rows.where("patch_id % 13 <> 0")


@query("select o_orderkey as patch_id, unnest(list_filter([case when o_custkey % 7 = 0 then 'record' end, case when o_custkey % 5 = 0 then 'name' end, case when o_orderkey % 6 = 0 then 'score' end], lambda f: f is not null)) as field from orders")
def check_required(s: SparkSession, d: str) -> DataFrame:
    """Blank or null fields of manifest rows."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = load(s, d, "orders").select(k.alias("patch_id"), F.when(c % 7 != 0, c).alias("record"), F.when(c % 5 == 0, "  ").otherwise("n").alias("name"), F.when(k % 6 != 0, F.col("o_totalprice")).alias("score"))
    return quality.check_required(rows, ["patch_id"], ["record", "name", "score"])


@query(f"with {PATCHES}, policy as (select scroll, case when scroll % 3 = 0 then 'test' else 'train' end as assigned, scroll % 4 = 1 as fine_forbidden from (select distinct scroll from patches where scroll <> 5)) select patch_id, case when assigned is null then 'unknown' when fine_forbidden and patch_id % 2 = 0 then 'fine forbidden' when assigned <> split then 'wrong split' end as reason from patches left join policy using (scroll) where assigned is null or (fine_forbidden and patch_id % 2 = 0) or assigned <> split")
def check_policy_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows that a policy of scrolls refuses, with the first reason."""
    rows, n = patches(s, d), F.col("scroll")
    policy = rows.where("scroll <> 5").select("scroll").distinct().select("scroll", F.when(n % 3 == 0, "test").otherwise("train").alias("assigned"), (n % 4 == 1).alias("fine_forbidden"))
    return quality.check_policy_rows(rows.withColumn("uses_fine", F.col("patch_id") % 2 == 0), policy, "scroll", "split").select("patch_id", "reason")


@query(f"with {PATCHES} select scroll, count(distinct split) as splits, string_agg(distinct split, ',' order by split) as names from patches group by 1 having count(distinct split) > 1")
def policy_overlap(s: SparkSession, d: str) -> DataFrame:
    """Scrolls that a policy names in several splits."""
    return quality.policy_overlap(patches(s, d), "scroll", "split")


@query("""with v as (select l_orderkey // 4 as patch, case when l_linenumber = 7 then 3 else l_linenumber % 3 end as target, case when l_linenumber % 3 <> 2 and l_suppkey % 41 <> 0 then 1 else 0 end as valid, l_partkey % 256 as q, case when l_partkey % 256 >= 128 and l_suppkey % 37 <> 0 then 1 else 0 end as hard, case when l_suppkey % 43 = 0 then 'nan'::double when l_suppkey % 47 = 0 then null else l_tax end as image, l_orderkey % 31 = 0 as crest from lineitem),
c as (select patch, count(*) filter (where target not in (0, 1, 2)) as labels, count(*) filter (where (valid = 1) <> (target <> 2)) as validity, count(*) filter (where valid = 1 and (hard = 1) <> (q >= 128)) as hard, count(*) filter (where image is null or isnan(image)) as image, count(*) filter (where crest and valid <> 1) as crest from v group by 1) select * from c where labels + validity + hard + image + crest > 0""")
def check_arrays(s: SparkSession, d: str) -> DataFrame:
    """Patches whose voxel arrays break a rule."""
    n, k, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey") % 256
    rows = load(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("patch"), F.when(n == 7, 3).otherwise(n % 3).alias("target"), F.when((n % 3 != 2) & (k % 41 != 0), 1).otherwise(0).alias("valid"), p.alias("q"), F.when((p >= 128) & (k % 37 != 0), 1).otherwise(0).alias("hard"), F.when(k % 43 == 0, float("nan")).when(k % 47 == 0, None).otherwise(F.col("l_tax")).alias("image"), (F.col("l_orderkey") % 31 == 0).cast("int").alias("crest"))
    return quality.check_arrays(rows, ["patch"])


@query("with a as (select o_custkey as record, 't' || (o_orderkey % 97 = 0)::int as transform, case when o_orderkey % 5 > 0 then o_orderkey % 5 end as anchor from orders), o as (select record, count(*) as outside from a where anchor not in (1, 2, 3) group by 1), f as (select record, count(distinct transform) as transforms from a group by 1) select record, transforms, coalesce(outside, 0) as outside from f left join o using (record) where transforms > 1 or outside > 0")
def check_anchors(s: SparkSession, d: str) -> DataFrame:
    """Records with several transforms or an anchor outside the candidates."""
    k = F.col("o_orderkey")
    rows = load(s, d, "orders").select(F.col("o_custkey").alias("record"), F.concat(F.lit("t"), (k % 97 == 0).cast("int").cast("string")).alias("transform"), F.when(k % 5 > 0, k % 5).alias("anchor"), F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>").alias("candidates"))
    return quality.check_anchors(rows, "record")


@query("with f as (select l_suppkey % 60 as source, count(*) as found from lineitem where l_suppkey % 60 <> 7 group by 1), m as (select l_suppkey % 60 as source, count(*) + (l_suppkey % 60 = 9)::int as rows from lineitem where l_suppkey % 60 <> 3 group by 1) select source, found, rows, case when rows is null then 'no manifest' when found is null then 'no rows' else 'count' end as reason from f full join m using (source) where found is distinct from rows")
def check_lineage(s: SparkSession, d: str) -> DataFrame:
    """Source manifests that are missing, unused or of another count."""
    rows = load(s, d, "lineitem").select((F.col("l_suppkey") % 60).alias("source"))
    manifests = rows.where("source <> 3").groupBy("source").agg((F.count("*") + F.max((F.col("source") == 9).cast("int"))).alias("rows"))
    return quality.check_lineage(rows.where("source <> 7"), manifests, "source")


@query("with a as (select p_partkey as path, p_size as bytes, sha256(p_name || case when p_partkey % 17 = 0 then 'x' else '' end) as sha from part where p_partkey % 11 <> 0), b as (select p_partkey as path, case when p_partkey % 19 = 0 then 0 else p_size end as bytes, sha256(p_name) as sha from part where p_partkey % 13 <> 0) select path, case when a.sha is null then 'missing' when b.sha is null then 'not expected' when a.bytes <> b.bytes then 'size' else 'content' end as reason from a full join b using (path) where a.sha is null or b.sha is null or a.bytes <> b.bytes or a.sha <> b.sha")
def check_hashes(s: SparkSession, d: str) -> DataFrame:
    """Files of an inventory that are missing, not expected or changed."""
    k, name = F.col("p_partkey"), F.col("p_name")
    part = load(s, d, "part")
    listing = part.where(k % 11 != 0).select(k.alias("path"), F.col("p_size").alias("bytes"), F.sha2(F.concat(name, F.when(k % 17 == 0, "x").otherwise("")), 256).alias("sha256"))
    expected = part.where(k % 13 != 0).select(k.alias("path"), F.when(k % 19 == 0, 0).otherwise(F.col("p_size")).alias("bytes"), F.sha2(name, 256).alias("sha256"))
    return quality.check_hashes(listing, expected)


STORE = "store as (select p_partkey as chunk, p_size % 4 as known, p_partkey % 5 * 100 as bytes, p_brand as content from part)"


def store(s: SparkSession, d: str) -> DataFrame:
    """chunk, known, bytes, content: chunks of a label store."""
    k = F.col("p_partkey")
    return load(s, d, "part").select(k.alias("chunk"), (F.col("p_size") % 4).alias("known"), (k % 5 * 100).alias("bytes"), F.col("p_brand").alias("content"))


@query(f"with {STORE} select * from store where not (known = 0 and bytes > 0 and chunk in (select l_partkey from lineitem where l_tax > 0.02))")
def compacted_store(s: SparkSession, d: str) -> DataFrame:
    """A label store without the supported chunks that hold no known voxel."""
    return quality.compact(store(s, d), load(s, d, "lineitem").where("l_tax > 0.02").select(F.col("l_partkey").alias("chunk")), ["chunk"])


@query(f"with {STORE}, pruned as (select chunk from store where chunk % 7 = 0 or known = 0 and chunk % 3 <> 0), after as (select chunk, known, case when chunk % 23 = 0 then 'x' else content end as content from store where (known > 0 or chunk % 10 = 1) and chunk % 29 <> 0 union all select -1, 0, 'x') select chunk, case when a.content is null then 'new' when p.chunk is not null and a.known > 0 then 'pruned although known' when p.chunk is null and a.known = 0 then 'kept although unknown' when p.chunk is not null and b.content is not null then 'not pruned' when p.chunk is null and b.content is null then 'lost' when b.content is not null and a.content <> b.content then 'changed' end as reason from store a full join after b using (chunk) left join pruned p using (chunk) where reason is not null")
def check_compaction(s: SparkSession, d: str) -> DataFrame:
    """What a compaction of a label store got wrong."""
    before, k = store(s, d), F.col("chunk")
    pruned = before.where("chunk % 7 = 0 or known = 0 and chunk % 3 <> 0")
    after = before.where("(known > 0 or chunk % 10 = 1) and chunk % 29 <> 0").select("chunk", "known", F.when(k % 23 == 0, "x").otherwise(F.col("content")).alias("content"))
    extra = before.agg(F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("known"), F.lit("x").alias("content"))
    return quality.check_compaction(before, after.unionByName(extra), pruned, ["chunk"])


@query(f"with {PATCHES}, a as (select scroll, count(*)::double as n, round(sum(score), 2) as total from patches where scroll <> 2 group by 1), b as (select scroll, count(*)::double + (scroll = 4)::int * 1e-6 as n, round(sum(score), 2) as total from patches where scroll <> 3 group by 1), la as (unpivot a on n, total into name name value summary), lb as (unpivot b on n, total into name name value audit) select scroll, name, round(summary, 2) as summary, round(audit, 2) as audit from la full join lb using (scroll, name) where summary is null or audit is null or abs(summary - audit) > 1e-9")
def check_qualification(s: SparkSession, d: str) -> DataFrame:
    """Figures of a summary that its audit lacks or has otherwise."""
    rows = patches(s, d)
    facts = rows.groupBy("scroll").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("score"), 2).alias("total"))
    other = facts.where("scroll <> 3").withColumn("n", F.col("n") + F.when(F.col("scroll") == 4, 1e-6).otherwise(0.0))
    found = quality.check_qualification(facts.where("scroll <> 2"), other, ["scroll"], ["n", "total"])
    return found.select("scroll", "name", F.round("summary", 2).alias("summary"), F.round("audit", 2).alias("audit"))


@query(f"with {RUNS}, a as (select patch_id, score as now from run_a), b as (select patch_id, score as was from run_b) select patch_id, now, was from a full join b using (patch_id) where now is null or was is null or now - was < 0")
def regressions(s: SparkSession, d: str) -> DataFrame:
    """Patches that lost against a baseline or that one side lacks."""
    return quality.regressions(*runs(s, d), "patch_id", "score")


@query(f"with {RUNS}, a as (select coalesce(scroll::varchar, '*') as scroll, sum(score > 1e5)::bigint as high, sum(known::int)::bigint as known from run_a group by grouping sets ((scroll), ())), b as (select coalesce(scroll::varchar, '*') as scroll, sum(score > 1e5)::bigint as high, sum(known::int)::bigint as known from patches group by grouping sets ((scroll), ())) select scroll, a.high as sum_high, a.known as sum_known, b.high, b.known from a full join b using (scroll) where a.high is distinct from b.high or a.known is distinct from b.known")
def check_reconcile(s: SparkSession, d: str) -> DataFrame:
    """Groups whose counts over rows differ from the recorded sweep."""
    counted = lambda df: df.select("scroll", (F.col("score") > 1e5).cast("int").alias("high"), F.col("known").cast("int").alias("known"))
    sweep = counted(patches(s, d)).groupingSets([["scroll"], []], "scroll").agg(F.sum("high").alias("high"), F.sum("known").alias("known"))
    sweep = sweep.withColumn("scroll", F.coalesce(F.col("scroll").cast("string"), F.lit("*")))
    return quality.check_reconcile(counted(runs(s, d)[0]), sweep, "scroll", ["high", "known"])


@query(f"with {RUNS} select patch_id, case when a.split is null then 'right only' when b.split is null then 'left only' else 'differs' end as reason from run_a a full join run_b b using (patch_id) where a.split is null or b.split is null or a.score is distinct from b.score or a.known is distinct from b.known")
def align_runs(s: SparkSession, d: str) -> DataFrame:
    """Patches that two runs don't share or have otherwise."""
    return quality.align_runs(*runs(s, d), ["patch_id"], ["score", "known"])


@query(f"with {RUNS} select patch_id, score from run_a where patch_id in (select patch_id from run_b)")
def matched_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of a run that its baseline has too."""
    return quality.matched(*runs(s, d), ["patch_id"]).select("patch_id", "score")


@query("with c as (select l_orderkey as cube, case when l_linestatus = 'F' then 255 when l_suppkey % 29 = 0 then 7 else 0 end as value from lineitem where l_orderkey % 31 <> 0), f as (select cube, count(*) as n, count(*) filter (where value not in (0, 255)) as odd from c group by 1), d as (select o_orderkey as cube from orders where o_orderkey % 37 <> 0) select cube, case when f.n is null then 'missing' when d.cube is null then 'not declared' when n <> 4 then 'size' else 'values' end as reason from f full join d using (cube) where f.n is null or d.cube is null or n <> 4 or odd > 0")
def check_grid(s: SparkSession, d: str) -> DataFrame:
    """Cubes of a grid that are missing, not declared, of another size or with other values."""
    value = F.when(F.col("l_linestatus") == "F", 255).when(F.col("l_suppkey") % 29 == 0, 7).otherwise(0)
    cubes = load(s, d, "lineitem").where("l_orderkey % 31 <> 0").select(F.col("l_orderkey").alias("cube"), value.alias("value"))
    return quality.check_grid(cubes, load(s, d, "orders").where("o_orderkey % 37 <> 0").select(F.col("o_orderkey").alias("cube")), "cube", 4, [0, 255])


@query("select l_orderkey as run, count(*) as rows, count(distinct l_linenumber - 1) as epochs, min(l_linenumber - 1) as first, max(l_linenumber - 1) as last from lineitem group by 1 having count(*) <> 4 or count(distinct l_linenumber) <> 4 or min(l_linenumber) <> 1 or max(l_linenumber) <> 4")
def check_history(s: SparkSession, d: str) -> DataFrame:
    """Runs whose epochs aren't 0 to 3."""
    return quality.check_history(load(s, d, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).alias("epoch")), "run", "epoch", 4)


@query(f"with {RUNS}, f as (select 'split' as dim, split as level, count(*) as found from run_a group by 2 union all select 'scroll', scroll::varchar, count(*) from run_a group by 2), e as (select 'split' as dim, split as level, count(*) as expected from patches where scroll <> 1 group by 2 union all select 'scroll', scroll::varchar, count(*) from patches where scroll <> 1 group by 2) select dim, level, found, expected from f full join e using (dim, level) where found is distinct from expected")
def check_scope(s: SparkSession, d: str) -> DataFrame:
    """Splits and scrolls whose counts differ from the contract."""
    rows = patches(s, d).where("scroll <> 1")
    contract = rows.groupBy(F.lit("split").alias("dim"), F.col("split").alias("level")).agg(F.count("*").alias("n")).unionByName(rows.groupBy(F.lit("scroll").alias("dim"), F.col("scroll").cast("string").alias("level")).agg(F.count("*").alias("n")))
    return quality.check_scope(runs(s, d)[0], contract, ["split", "scroll"])


@query(f"""with {MESH}, whole as (select * from faces where a <> b and b <> c and a <> c), sides as (select mesh_id, unnest([a, b, c]) as p, unnest([b, c, a]) as q from whole), edges as (select mesh_id, least(p, q) as lo, greatest(p, q) as hi, count(*) as n, sum(sign(q - p)) as turns from sides group by all)
select f.mesh_id, faces, degenerate, coalesce(crowded, 0) as crowded, coalesce(wound_alike, 0) as wound_alike, coalesce(boundary, 0) as boundary from (select mesh_id, count(*) as faces, count(*) filter (where a = b or b = c or a = c) as degenerate from faces group by 1) f left join (select mesh_id, count(*) filter (where n > 2) as crowded, count(*) filter (where n = 2 and turns <> 0) as wound_alike, count(*) filter (where n = 1) as boundary from edges group by 1) e using (mesh_id)""")
def check_mesh(s: SparkSession, d: str) -> DataFrame:
    """Edges of each mesh that are crowded, wound alike or on the boundary."""
    return quality.check_mesh(mesh(s, d)[1])


@query(f"with {PATCHES}, m as (select patch_id, scroll, split from patches union all select patch_id, scroll, split from patches where patch_id % 100 = 0) select 'repeated' as reason, patch_id::varchar as what from m group by patch_id having count(*) > 1 union all select 'several splits', scroll::varchar from m group by scroll having count(distinct split) > 1")
def check_merged(s: SparkSession, d: str) -> DataFrame:
    """Repeated patches and split scrolls of merged manifests."""
    rows = patches(s, d)
    return quality.check_merged(rows.unionByName(rows.where("patch_id % 100 = 0")), "patch_id", "scroll", "split")


@query("with c as (select p_partkey as k from part where p_partkey % 10 <> 9), p as (select distinct l_partkey as k from lineitem where l_linenumber < 3), h as (select p_partkey as k from part where p_size % 6 = 0) select k as chunk, case when c.k is null then 'not in the catalog' when p.k is not null and h.k is not null then 'both' when p.k is not null then 'planned' when h.k is not null then 'held out' else 'unaccounted' end as disposition from c full join p using (k) full join h using (k)".replace("select k as chunk", "select coalesce(c.k, p.k, h.k) as chunk").replace("full join p using (k) full join h using (k)", "full join p on c.k = p.k full join h on h.k = coalesce(c.k, p.k)"))
def account(s: SparkSession, d: str) -> DataFrame:
    """Disposition of every chunk of a catalog."""
    part = load(s, d, "part").withColumnRenamed("p_partkey", "chunk")
    planned = load(s, d, "lineitem").where("l_linenumber < 3").select(F.col("l_partkey").alias("chunk"))
    return quality.account(part.where("chunk % 10 <> 9"), planned, part.where("p_size % 6 = 0"), "chunk")


@query(f"with {PATCHES}, a as (select patch_id, source as category, scroll from patches where patch_id % 3 = 0), m as (select patch_id, scroll as unit, case when patch_id % 21 = 0 then 'x' else source end as cat from patches where patch_id % 5 <> 0) select patch_id, case when cat is null then 'missing' when cat <> category then 'other category' when unit in (3, 8) then 'held out' end as reason from a left join m using (patch_id)")
def resolve_allocations(s: SparkSession, d: str) -> DataFrame:
    """Allocations with what is wrong about their manifest rows."""
    rows, k = patches(s, d), F.col("patch_id")
    manifests = rows.where(k % 5 != 0).select("patch_id", F.col("scroll").alias("unit"), F.when(k % 21 == 0, "x").otherwise(F.col("source")).alias("category"))
    held = rows.where("scroll in (3, 8)").select(F.col("scroll").alias("unit"))
    return quality.resolve_allocations(rows.where(k % 3 == 0).select("patch_id", F.col("source").alias("category")), manifests, held, ["patch_id"], "unit").select("patch_id", "reason")


@query(f"with {RUNS} select a.patch_id, case when b.patch_id is null then 'make' when a.score is not distinct from b.score and a.known is not distinct from b.known then 'reuse' else 'refuse' end as action, 'archive-' || b.patch_id as reused_archive from run_a a left join run_b b using (patch_id)")
def merge_reused(s: SparkSession, d: str) -> DataFrame:
    """What happens to each source row: reuse, make or refuse."""
    source, reused = runs(s, d)
    reused = reused.withColumn("archive", F.concat(F.lit("archive-"), F.col("patch_id").cast("string")))
    return quality.merge_reused(source, reused, "patch_id", ["score", "known"]).select("patch_id", "action", "reused_archive")


@query(f"with {PATCHES} select p.patch_id, case when b.patch_id is null then 'missing' when b.patch_id % 8 = 0 then 'stale' else 'scored' end as state, case when b.patch_id % 8 <> 0 then b.score end as score from patches p left join (select * from patches where patch_id % 9 <> 0) b using (patch_id)")
def attach_scores(s: SparkSession, d: str) -> DataFrame:
    """Patches with their score where identity agrees."""
    rows, k = patches(s, d), F.col("patch_id")
    scores = rows.where(k % 9 != 0).select("patch_id", F.when(k % 8 == 0, "old").otherwise("new").alias("identity"), "score")
    return quality.attach_scores(rows.select("patch_id", F.lit("new").alias("identity")), scores, "patch_id", "identity").select("patch_id", "state", "score")


@query(f"with {MASK}, sparse as (select z, y, x from grid where other >= 0.08), {LABELS.format(name='cand', src='strong')}, {LABELS.format(name='refs', src='sparse')}, big as (select label from refs group by label having count(*) >= 1), pairs as (select c.label as c, r.label as r, count(*) as n from cand c join refs r using (z, y, x) where r.label in (select label from big) group by all), first as (select label, min(z) as z from cand group by 1) select z, count(*) as n, sum(k)::bigint as refs, sum(voxels)::bigint as voxels from (select c, count(*) as k, sum(n) as voxels from pairs group by c having count(*) > 1) b join first on first.label = b.c group by z")
def merging_components(s: SparkSession, d: str) -> DataFrame:
    """Candidate components over several reference components, counted by plane."""
    cand, ref = graph.voxel_components(mask(s, d, 0.09), 4), graph.voxel_components(mask(s, d, 0.08, "other"), 4)
    found = audit_ops.merging_components(cand, ref, 1)
    return found.groupBy(F.shiftright("candidate", 42).cast("int").alias("z")).agg(F.count("*").alias("n"), F.sum("references").alias("refs"), F.sum("voxels").alias("voxels"))


@query(f"with p as (select o_orderkey as patch, o_custkey % 20 / 20 as pathology, o_orderkey % 97 as density from orders), r as (select *, row_number() over (order by pathology desc, {hash_number_sql('patch')}, patch) - 1 as place, count(*) over () as n from p), q as (select *, row_number() over (partition by place >= ceil(n / 3) order by density desc, patch) - 1 as second from r) select patch, case when place < ceil(n / 3) then 'high-pathology' when second < ceil(n / 6) then 'dense-positive' else 'random' end as strategy from q")
def strategies(s: SparkSession, d: str) -> DataFrame:
    """Strategy of each patch: worst third, densest sixth of all among the rest, random."""
    k = F.col("o_orderkey")
    rows = load(s, d, "orders").select(k.alias("patch"), (F.col("o_custkey") % 20 / 20).alias("pathology"), (k % 97).alias("density"))
    return predicates.strategies(rows, "pathology", "density", hash_number(F.col("patch")), "patch").select("patch", "strategy")

"""Checks that return violation rows (empty means passed), and set operations on manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def check_leakage(df: DataFrame, unit: str, split: str) -> DataFrame:
    """Units that stand in two or more splits."""
    return df.groupBy(unit).agg(F.count_distinct(split).alias("splits"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("names")).where("splits > 1")


def check_policy(df: DataFrame, allowed: DataFrame, unit: str, split: str) -> DataFrame:
    """Rows whose unit is unknown to the policy (unit, assigned) or stands in another split, with the first reason."""
    joined = df.join(allowed.select(unit, "assigned"), unit, "left")
    reason = F.when(F.col("assigned").isNull(), "unknown").when(F.col("assigned") != F.col(split), "wrong split")
    return joined.withColumn("reason", reason).where("reason is not null")


def check_stats(df: DataFrame, recorded: DataFrame, key: str, column: str, tolerance: float) -> DataFrame:
    """Keys whose recomputed statistic is missing or differs from the recorded one."""
    both = df.select(key, F.col(column).alias("now")).join(recorded.select(key, F.col(column).alias("recorded")), key, "full")
    return both.where("now is null or recorded is null or abs(now - recorded) > " + str(tolerance))


def merge_manifests(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows with the name of their source."""
    return reduce(DataFrame.unionByName, [df.withColumn("origin", F.lit(name)) for name, df in parts.items()])


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, repeated ones too, that only one side has."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def reconcile(inventory: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """key, state (both, inventory only, listing only), counted by state."""
    a, b = inventory.select(key).distinct().withColumn("_a", F.lit(1)), listing.select(key).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "listing only").when(F.col("_b").isNull(), "inventory only").otherwise("both")
    return a.join(b, key, "full").groupBy(state.alias("state")).agg(F.count("*").alias("keys"))


def corpus_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension alone, by the first two together, and overall: dim, level, n."""
    cube = df.groupingSets([[d] for d in dims] + [dims[:2], []], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return cube.select(*[F.coalesce(F.col(d).cast("string"), F.lit("*")).alias(d) for d in dims], "n")


def check_required(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with a null or, of texts, blank field, one for each such field."""
    kinds = dict(df.dtypes)
    bad = [F.when(F.col(c).isNull() | (F.trim(c) == "") if kinds[c] == "string" else F.col(c).isNull(), c) for c in columns]
    return df.select(*key, F.explode(F.array_compact(F.array(*bad))).alias("field"))


def check_policy_rows(df: DataFrame, policy: DataFrame, unit: str, split: str) -> DataFrame:
    """Rows that a policy (unit, assigned, fine_forbidden) refuses, with the first reason: unknown, fine forbidden or wrong split."""
    joined = df.join(policy.select(unit, "assigned", "fine_forbidden"), unit, "left")
    reason = F.when(F.col("assigned").isNull(), "unknown").when(F.col("fine_forbidden") & F.col("uses_fine"), "fine forbidden").when(F.col("assigned") != F.col(split), "wrong split")
    return joined.withColumn("reason", reason).where("reason is not null")


def policy_overlap(policy: DataFrame, unit: str, split: str) -> DataFrame:
    """Units that a policy names in several splits."""
    return check_leakage(policy.select(unit, split).distinct(), unit, split)


def check_arrays(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Patches whose voxels (target, valid, q, hard, image, crest) break a rule, with the number of breaks of each.

    Labels are 0, 1 or 2; valid is set where the label isn't 2; hard is q >= 128 where valid; image is finite; crest lies in valid.
    """
    valid = F.col("valid") == 1
    rules = {
        "labels": ~F.coalesce(F.col("target").isin(0, 1, 2), F.lit(False)),
        "validity": valid != (F.col("target") != 2),
        "hard": valid & ((F.col("hard") == 1) != (F.col("q") >= 128)),
        "image": F.col("image").isNull() | F.isnan("image") | (F.abs("image") == float("inf")),
        "crest": (F.col("crest") == 1) & ~valid,
    }
    counts = voxels.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return counts.where(" + ".join(rules) + " > 0")


def check_anchors(df: DataFrame, record: str) -> DataFrame:
    """Records whose rows name different transforms or an anchor that isn't among its candidates."""
    out = df.where(F.col("anchor").isNotNull() & ~F.coalesce(F.array_contains("candidates", F.col("anchor")), F.lit(False)))
    facts = df.groupBy(record).agg(F.count_distinct("transform").alias("transforms")).join(out.groupBy(record).agg(F.count("*").alias("outside")), record, "left").fillna(0)
    return facts.where("transforms > 1 or outside > 0")


def check_lineage(rows: DataFrame, manifests: DataFrame, source: str) -> DataFrame:
    """Sources that rows name and no manifest has, manifests without rows, and those whose row count differs."""
    both = rows.groupBy(source).agg(F.count("*").alias("found")).join(manifests.select(source, "rows"), source, "full")
    reason = F.when(F.col("rows").isNull(), "no manifest").when(F.col("found").isNull(), "no rows").when(F.col("found") != F.col("rows"), "count")
    return both.withColumn("reason", reason).where("reason is not null")


def check_hashes(listing: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Files (path, bytes, sha256) that are missing, not expected or changed."""
    a, b = (df.select(key, F.col("bytes").alias(f"bytes_{n}"), F.col("sha256").alias(f"sha_{n}"), F.lit(True).alias(f"in_{n}")) for n, df in (("a", listing), ("b", expected)))
    both = a.join(b, key, "full")
    reason = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_b").isNull(), "not expected").when(~F.col("bytes_a").eqNullSafe(F.col("bytes_b")), "size").when(~F.col("sha_a").eqNullSafe(F.col("sha_b")), "content")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def check_compaction(before: DataFrame, after: DataFrame, pruned: DataFrame, key: list[str]) -> DataFrame:
    """What a compaction of chunks (key, known, content) got wrong: pruned although known, kept although unknown, lost, changed, new."""
    a, b = (df.select(*key, F.col("known").alias(f"known_{n}"), F.col("content").alias(f"content_{n}"), F.lit(True).alias(f"in_{n}")) for n, df in (("a", before), ("b", after)))
    every = a.join(b, key, "full").join(pruned.select(*key).distinct().withColumn("gone", F.lit(True)), key, "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~has("in_a"), "new").when(has("gone") & (F.col("known_a") > 0), "pruned although known").when(~has("gone") & (F.col("known_a") == 0), "kept although unknown").when(has("gone") & has("in_b"), "not pruned").when(~has("gone") & ~has("in_b"), "lost").when(has("in_b") & ~F.col("content_a").eqNullSafe(F.col("content_b")), "changed")
    return every.select(*key, reason.alias("reason")).where("reason is not null")


def compact(chunks: DataFrame, support: DataFrame, key: list[str]) -> DataFrame:
    """Chunks with known voxels or no bytes, as they are; others that the support names go."""
    unknown = chunks.where("known = 0 and bytes > 0").join(support.select(*key).distinct(), key, "left_semi").select(*key)
    return chunks.join(unknown, key, "left_anti")


def check_qualification(summary: DataFrame, audit: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Figures of a summary that the audit lacks or has otherwise: one row (key, name, summary, audit) each."""
    long = lambda df, alias: df.unpivot(key, columns, "name", alias)
    both = long(summary, "summary").join(long(audit, "audit"), [*key, "name"], "full")
    return both.where(F.col("summary").isNull() | F.col("audit").isNull() | (F.abs(F.col("summary") - F.col("audit")) > tolerance))


def regressions(trained: DataFrame, initial: DataFrame, key: str, value: str, least: float = 0.0) -> DataFrame:
    """Keys whose value gained less than least, or that one side lacks."""
    both = trained.select(key, F.col(value).alias("now")).join(initial.select(key, F.col(value).alias("was")), key, "full")
    return both.where(F.col("now").isNull() | F.col("was").isNull() | (F.col("now") - F.col("was") < least))


def check_reconcile(counts: DataFrame, sweep: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Groups and the total ("*") whose sums over rows differ from the recorded ones."""
    sums = counts.groupingSets([[by], []], by).agg(*[F.sum(c).alias(f"sum_{c}") for c in columns])
    both = sums.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("*"))).join(sweep.select(by, *columns), by, "full")
    return both.where(reduce(lambda a, b: a | b, [~F.col(f"sum_{c}").eqNullSafe(F.col(c)) for c in columns]))


def align_runs(a: DataFrame, b: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """Keys that two runs don't share, or on which columns that have to be equal differ."""
    left, right = (df.select(*key, F.lit(True).alias(f"in_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in same]) for n, df in (("a", a), ("b", b)))
    both = left.join(right, key, "full")
    differs = reduce(lambda x, y: x | y, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in same])
    reason = F.when(F.col("in_a").isNull(), "right only").when(F.col("in_b").isNull(), "left only").when(differs, "differs")
    return both.select(*key, reason.alias("reason")).where("reason is not null")


def matched(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a whose key the baseline has too."""
    return a.join(b.select(*key).distinct(), key, "left_semi")


def check_grid(cubes: DataFrame, declared: DataFrame, key: str, size: int, values: list[int]) -> DataFrame:
    """Cubes that are missing, not declared, of another size, or with other values."""
    found = cubes.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~F.col("value").isin(values)).alias("odd"), F.lit(True).alias("_here"))
    both = found.join(declared.select(key).distinct().withColumn("_declared", F.lit(True)), key, "full")
    reason = F.when(F.col("_here").isNull(), "missing").when(F.col("_declared").isNull(), "not declared").when(F.col("n") != size, "size").when(F.col("odd") > 0, "values")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def check_history(history: DataFrame, run: str, epoch: str, n: int) -> DataFrame:
    """Runs whose epochs aren't exactly 0 to n - 1."""
    facts = history.groupBy(run).agg(F.count("*").alias("rows"), F.count_distinct(epoch).alias("epochs"), F.min(epoch).alias("first"), F.max(epoch).alias("last"))
    return facts.where((F.col("rows") != n) | (F.col("epochs") != n) | (F.col("first") != 0) | (F.col("last") != n - 1))


def check_scope(df: DataFrame, contract: DataFrame, dims: list[str]) -> DataFrame:
    """Values of each dimension that the rows and the contract (dim, level, n) don't share or count differently."""
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in dims])).alias("s")
    found = df.select(levels).groupBy("s.dim", "s.level").agg(F.count("*").alias("found"))
    return found.join(contract.select("dim", "level", F.col("n").alias("expected")), ["dim", "level"], "full").where(~F.col("found").eqNullSafe(F.col("expected")))


def check_mesh(faces: DataFrame) -> DataFrame:
    """For each mesh (mesh_id, a, b, c): edges of more than two faces, shared edges wound alike, degenerate faces and boundary edges."""
    sides = F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")
    flat = (F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c"))
    edges = faces.where(~flat).select("mesh_id", sides).select("mesh_id", F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi"), F.signum(F.col("e.q") - F.col("e.p")).alias("turn"))
    once = edges.groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))
    facts = once.groupBy("mesh_id").agg(F.count_if(F.col("n") > 2).alias("crowded"), F.count_if((F.col("n") == 2) & (F.col("turns") != 0)).alias("wound_alike"), F.count_if(F.col("n") == 1).alias("boundary"))
    return faces.groupBy("mesh_id").agg(F.count("*").alias("faces"), F.count_if(flat).alias("degenerate")).join(facts, "mesh_id", "left").fillna(0)


def check_merged(df: DataFrame, key: str, unit: str, split: str) -> DataFrame:
    """What is wrong with merged manifests: repeated keys, and units in several splits."""
    again = check_unique(df, [key]).select(F.lit("repeated").alias("reason"), F.col(key).cast("string").alias("what"))
    return again.unionByName(check_leakage(df, unit, split).select(F.lit("several splits").alias("reason"), F.col(unit).cast("string").alias("what")))


def account(catalog: DataFrame, planned: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """The disposition of every key of a catalog: planned, held out, both or unaccounted; and planned keys that it lacks."""
    flags = [df.select(key).distinct().withColumn(n, F.lit(True)) for n, df in (("_catalog", catalog), ("_planned", planned), ("_held", held_out))]
    every = reduce(lambda a, b: a.join(b, key, "full"), flags).fillna(False)
    state = F.when(~F.col("_catalog"), "not in the catalog").when(F.col("_planned") & F.col("_held"), "both").when(F.col("_planned"), "planned").when(F.col("_held"), "held out").otherwise("unaccounted")
    return every.select(key, state.alias("disposition"))


def resolve_allocations(allocations: DataFrame, manifests: DataFrame, held_out: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Allocations with their manifest rows and what is wrong: missing, other category, held out; null if nothing is."""
    joined = allocations.join(manifests.select(*keys, unit, F.col("category").alias("_category")), keys, "left").join(held_out.select(unit).distinct().withColumn("_held", F.lit(True)), unit, "left")
    reason = F.when(F.col("_category").isNull(), "missing").when(F.col("_category") != F.col("category"), "other category").when(F.col("_held"), "held out")
    return joined.withColumn("reason", reason).drop("_category", "_held")


def merge_reused(source: DataFrame, reused: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Source rows with action reuse, make (nothing to reuse) or refuse (a fact differs), and the reused row's archive."""
    joined = source.join(reused.select(key, F.col("archive").alias("reused_archive"), F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in facts]), key, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in facts])
    action = F.when(F.col("_has").isNull(), "make").when(same, "reuse").otherwise("refuse")
    return joined.withColumn("action", action).drop("_has", *[f"_{c}" for c in facts])


def attach_scores(patches: DataFrame, scores: DataFrame, key: str, identity: str) -> DataFrame:
    """Patches with their score where identity agrees, and state scored, missing or stale."""
    joined = patches.join(scores.select(key, F.col(identity).alias("_identity"), "score"), key, "left")
    state = F.when(F.col("_identity").isNull(), "missing").when(F.col("_identity") == F.col(identity), "scored").otherwise("stale")
    return joined.withColumn("state", state).withColumn("score", F.when(F.col("state") == "scored", F.col("score"))).drop("_identity")

"""Chat formatting: cumulative snapshots of a conversation collapse into the longest one before rendering. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialise

ROLES = ("system", "user", "assistant", "tool")


def render(turns: Column) -> Column:
    """One text of all turns (role, text), each between a header with the role and an end mark."""
    one = F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n")))
    return F.array_join(one, "")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the conversations that no other one extends.

    turns has conv_id, turn, role, text. A conversation's turns are ordered by turn, then role and text; a null role is "unknown", a
    null text empty, and repeated rows of a turn count once. The prefix hash of a turn is the exclusive or of two 64-bit hashes of
    the turns so far, each with its position. A conversation whose last prefix hash is that of an earlier turn of another one is
    a snapshot and goes; of equal conversations the smallest conv_id stays and n_copies counts them all. Rows without
    conv_id or turn are ignored. An empty table gives no rows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null and turn is not null").dropDuplicates()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    chain = [F.bit_xor(F.xxhash64(F.lit(seed), "place", "role", "text")).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    whole = Window.partitionBy("conv_id")
    prefixes = placed.select("conv_id", "place", *chain, F.max("place").over(whole).alias("n_turns"))
    prefixes = materialise(prefixes, "prefixes")
    ends = prefixes.where("place = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where("place < n_turns").select("h1", "h2", F.col("place").alias("n_turns")).distinct()
    kept = ends.join(inner, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")
    texts = placed.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    return kept.join(texts, "conv_id").select("conv_id", F.col("n_turns").cast("long"), "n_copies", render(F.col("turns")).alias("rendered"))


COLLAPSE_SQL = """
with r as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
p as (select *, row_number() over (partition by conv_id order by turn, role, text) as place from r),
c as (select conv_id, count(*) as n_turns, list(md5(role || chr(1) || text) order by place) as turns,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' order by place) as rendered from p group by conv_id),
u as (select min(conv_id) as conv_id, n_turns, count(*) as n_copies, any_value(rendered) as rendered, turns from c group by turns, n_turns),
inner_prefix as (select distinct array_to_string(turns[1:k], ',') as prefix from (select turns, unnest(range(1, n_turns)) as k from u))
select conv_id, n_turns, n_copies, length(rendered) as n_chars, sha256(rendered) as text_sha256
from u where array_to_string(turns, ',') not in (select prefix from inner_prefix)"""

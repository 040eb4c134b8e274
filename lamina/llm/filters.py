"""How the filters of a corpus overlap: what each removes, alone and after the others, for every order of them.

A filter is a bit of a document's mask. Four of them look at the text alone; the last one, copies of a document with a smaller id, is
found with a counting Bloom sketch: texts with a counter below two are unique for certain and never move, only the others are grouped
by their whole text. All figures of all orders then come from the number of documents for each part and mask.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
# A block of 64 counters for so many documents; a document has one counter in each of four lanes of 16.
DOCUMENTS_A_BLOCK = 4
# Blocks (16 bytes each) of which the sketch may consist to be sent to every task; a larger one is joined by shuffle.
SENT_BLOCKS = 1 << 20


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 50, F.lit(100) * distinct < F.lit(65) * n, F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def _block(blocks: int) -> Column:
    return F.col("h").bitwiseAND(F.lit(blocks - 1)).alias("block")


def _slots() -> list[Column]:
    """One counter of each lane of a block, from the upper bits of the text's hash."""
    return [(F.shiftrightunsigned("h", 48 + 4 * lane).bitwiseAND(F.lit(15)) + 16 * lane).cast("int") for lane in range(4)]


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot)


def counted_twice(hashes: DataFrame, blocks: int) -> DataFrame:
    """The sketch of a column h: block and the bits (twice) of its counters of two or more. Counters of one leave no trace."""
    counter = F.explode(F.array(*[_block(blocks) * 64 + s for s in _slots()])).alias("counter")
    full = hashes.select(counter).groupBy("counter").agg(F.count("*").alias("n")).where("n > 1")
    bit = _bit(F.col("counter").bitwiseAND(F.lit(63)).cast("int"))
    return full.groupBy(F.shiftright("counter", 6).alias("block")).agg(F.bit_or(bit).alias("twice"))


def _repeats(df: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """Rows of df whose counters are all of two or more: every row whose text stands elsewhere, and few others."""
    own = _bit(_slots()[0])
    for s in _slots()[1:]:
        own = own.bitwiseOR(_bit(s))
    return df.withColumns({"block": _block(blocks), "own": own}).join(sketch, "block").where(F.col("twice").bitwiseAND(F.col("own")) == F.col("own")).drop("block", "own", "twice")


def failures(documents: DataFrame, sent_blocks: int = SENT_BLOCKS) -> DataFrame:
    """doc_id, part and mask for each row of documents (doc_id, text, source).

    mask has bit 1 << k for each failed filter of LETTERS. Null texts are empty, a null source is the part "". A row is a copy (E) if
    the same text stands in a row of a smaller doc_id, so rows of one text and one doc_id aren't copies of each other; rows
    without a doc_id are neither copies nor originals. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    # Two hashes: with the doc_id they name a row's text where a doc_id comes with several texts.
    whole = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    hashed = whole.withColumns({"h": F.xxhash64("text"), "g": F.hash("text")})
    flags = materialise(hashed.select("doc_id", "part", "h", "g", text_failures(F.col("text")).alias("mask")), "flags")
    blocks = 1 << max(0, (max(1, flags.count()) - 1) // DOCUMENTS_A_BLOCK).bit_length()
    sketch = materialise(counted_twice(flags.where("doc_id is not null").select("h"), blocks), "sketch")
    if sketch.count() <= sent_blocks:
        sketch = F.broadcast(sketch)
    texts = _repeats(hashed.where("doc_id is not null").drop("part"), sketch, blocks)
    first = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("g").alias("g"))
    first = first.select("doc_id", "h", "g", F.lit(True).alias("original")).distinct()
    maybe = _repeats(flags.where("doc_id is not null").select("doc_id", "h", "g").distinct(), sketch, blocks)
    copies = maybe.join(first, ["doc_id", "h", "g"], "left_anti").select("doc_id", "h", "g", F.lit(1 << LETTERS.index("E")).alias("copy"))
    return flags.join(copies, ["doc_id", "h", "g"], "left").select("doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"))


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from failures() and labels (doc_id, quality, toxic).

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley count documents. A document with several label rows is
    good or toxic if one of them says so; labels without a doc_id are ignored. Every step of every order is there for each part.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counts = failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))
    steps = counts.select("*", F.explode(F.lit(ORDERS)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    own = sum((F.when(F.instr("filter_order", c) == F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(LETTERS)), F.lit(0))
    earlier = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(LETTERS)), F.lit(0))
    rows = steps.withColumns({"fails": F.col("mask").bitwiseAND(own) > 0, "gone": F.col("mask").bitwiseAND(earlier) > 0, "alone": F.col("mask") == own})

    def total(condition: Column, column: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0).cast("long")))

    now = F.col("fails") & ~F.col("gone")
    # A document that fails k filters is removed by each of them in the same number of orders.
    share = F.col("n") * F.floor(F.lit(len(ORDERS)) / F.greatest(F.bit_count("mask"), F.lit(1)))
    figures = {"kept": total(~F.col("fails") & ~F.col("gone")), "removed": total(now), "redundant": total(F.col("fails") & F.col("gone")), "unique_fails": total(F.col("alone")), "good_lost": total(now, "n_good"), "toxic_lost": total(now, "n_toxic"), "shapley": F.sum(F.when(F.col("fails"), share).otherwise(F.lit(0).cast("long")))}
    return rows.groupBy("part", "filter_order", "step").agg(*[c.alias(name) for name, c in figures.items()])


def audit_sql() -> str:
    orders = ", ".join(f"('{o}')" for o in ORDERS)
    own = " + ".join(f"case when instr(filter_order, '{c}') = step then {1 << k} else 0 end" for k, c in enumerate(LETTERS))
    earlier = " + ".join(f"case when instr(filter_order, '{c}') < step then {1 << k} else 0 end" for k, c in enumerate(LETTERS))
    return f"""with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{WORD}') as words, min(doc_id) over (partition by text) as least from t),
f as (select doc_id, part, (case when len(words) < 50 then 1 else 0 end) + (case when 100 * list_unique(words) < 65 * len(words) then 2 else 0 end)
 + (case when 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) then 4 else 0 end) + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
 + (case when doc_id > least then 16 else 0 end) as mask from w),
m as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by 1),
c as (select part, mask, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where toxic) as n_toxic from f left join m using (doc_id) group by all),
o as (select filter_order, unnest(range(1, 6)) as step from (values {orders}) v(filter_order)),
b as (select *, {own} as own, {earlier} as earlier from o),
r as (select c.*, filter_order, step, mask & own > 0 as fails, mask & earlier > 0 as gone, mask = own as alone from c, b)
select part, filter_order, step::int as step, coalesce(sum(n) filter (where not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (where fails and not gone), 0)::bigint as removed, coalesce(sum(n) filter (where fails and gone), 0)::bigint as redundant,
 coalesce(sum(n) filter (where alone), 0)::bigint as unique_fails, coalesce(sum(n_good) filter (where fails and not gone), 0)::bigint as good_lost, coalesce(sum(n_toxic) filter (where fails and not gone), 0)::bigint as toxic_lost,
 coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) filter (where fails), 0)::bigint as shapley from r group by part, filter_order, step"""

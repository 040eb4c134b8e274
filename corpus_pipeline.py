"""A corpus pipeline of five stages; each takes what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, langid, minhash, packing, registry, repeats
from lamina.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a hash of the whole row: rows of one doc_id and different texts are told apart, and rows without an id have one."""
    return docs.withColumn("row_key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS]))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text has a language, and writes the language found into lang.

    Texts without a letter go. Where no row is left to learn from, lang stays as it is.
    """
    found = langid.run(docs.select(*COLUMNS), ("text", "lang", "source", "n_chars"))
    kept = found.where(F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.when(F.col("lang_pred") == langid.UNKNOWN, F.col("lang")).otherwise(F.col("lang_pred"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates, also of rows that are equal in every column."""
    rows = keyed(docs)
    gone = minhash.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("row_key")).distinct()
    left = rows.join(gone, "row_key", "left_anti")
    several = rows.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key")
    once = left.join(several, "row_key", "left_anti").unionByName(left.join(several, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return once.select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated byte strings out of the texts, and with them the characters that they cut. Documents emptied by it go."""
    rows = docs.select(*COLUMNS, F.col("text").isNull().alias("none"))
    cut = repeats.remove(rows, characters=True, keep=("lang", "source", "n_chars", "none"))
    text = F.when(~F.col("none"), F.col("kept").cast("string"))
    kept = cut.withColumn("text", text).where("n_removed = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    rows = keyed(docs)
    leaked = decontaminate.leaks(rows.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(leaked, "row_key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), registry.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]
# Trained models, signatures and tokens are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

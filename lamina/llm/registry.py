"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import chat, decontaminate, embeddings, filters, langid, licenses, minhash, packing, pieces, repeats, toxicity, vectors, wrappers
from lamina.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chat.collapse(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return kept.select("conv_id", "n_turns", "n_copies", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("text_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.run(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.run(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings; one row for each kept vector."""
    coded, books = vectors.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    rows = vectors.with_label_errors(coded)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vectors.fingerprint(books)).alias("codebooks_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents; one row for each."""
    coded = pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), spans=False)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of five filters of all documents, for each source, order and step."""
    return filters.audit(filters.failures(table(spark, sf_dir, "documents", "doc_id", "text", "source")), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_chat_formatting, op3_minhash_near_dedup, op4_suffix_array_dedup, op5_language_id, op6_benchmark_decontamination, op7_toxicity, op8_best_fit_packing, op9_html_extraction, op10_embedding_near_dedup, op11_vector_codes, op12_sentencepiece, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.scan_sql(), "op2_chat_formatting": chat.COLLAPSE_SQL, "op11_vector_codes": vectors.compress_sql(), "op13_filter_audit": filters.audit_sql()}

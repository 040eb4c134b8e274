"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
from lamina.llm import decontaminate, minhash, repeats
from lamina.llm.common import materialise, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents").select(*corpus_pipeline.COLUMNS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialise(stage(spark, docs, DATA), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = (before, docs)
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    before, after = seen["language ID"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
    before, after = seen["MinHash near-dedup"]
    classes = {r.doc_id: r.component_id for r in minhash.near_duplicates(before).collect()}
    kept = [classes[r.doc_id] for r in after.collect()]
    assert len(kept) == len(set(kept)) == len(set(classes.values())) < before.count()
    before, after = seen["benchmark decontamination"]
    leaked = {r.doc_id for r in decontaminate.leaks(before, table(spark, DATA, "benchmark")).collect()}
    assert leaked and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked
    before, after = seen["suffix-array dedup"]
    assert repeats.remove(before).selectExpr("sum(n_removed)").first()[0] > 0
    assert after.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
    assert rows.count() > 0


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", None, "s", 0), (3, "123 456", "en", "s", 7), (4, "one text with words", "en", "s", 19), (4, "one text with words", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA), "odd")
    assert {r.doc_id for r in docs.collect()} == {4}
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_rows_that_share_an_id(spark):
    one, two = "the first text of this id has words of its own " * 3, "another text says something else about stones and rivers " * 3
    rows = [(1, one, "en", "s", len(one)), (1, two, "en", "s", len(two)), (None, "a row without an id stays as it is", "en", "s", 5), (2, "\ufffd keeps its mark", "en", "s", 17), (3, two, "en", "t", len(two)), (3, two, "en", "t", len(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = materialise(corpus_pipeline.drop_near_copies(spark, docs, DATA), "odd")
    assert sorted(r.text for r in once.collect()) == sorted({one, two, "a row without an id stays as it is", "\ufffd keeps its mark"})
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.remove_repeats(spark, once, DATA).collect()}
    assert (None, "a row without an id stays as it is") in cut and (2, "\ufffd keeps its mark") in cut and len(cut) == 4

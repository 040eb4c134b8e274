"""Vector codes, SentencePiece and the filter audit against brute force, the library, and on awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import filters, pieces, registry, vectors

DATA = "/root/testdata/sf0.001"


# Vector codes


def brute_codes(rows):
    """(vec_id, code, error, label_error) of each kept row, and the codebooks, by plain loops over all entries."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(kept[0][1]) // 4
    parts = [[tuple(v[p * size : (p + 1) * size]) for _, v, _ in kept] for p in range(4)]
    books = [[list(v) for v in part[:256]] for part in parts]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            members = defaultdict(list)
            for v in parts[p]:
                members[near(v, books[p])[1]].append(v)
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    found = [[near(parts[p][n], books[p]) for p in range(4)] for n in range(len(kept))]
    totals = Counter()
    for (_, _, label), f in zip(kept, found, strict=True):
        totals[label] += sum(d for d, _ in f)
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), totals[label]) for (i, _, label), f in zip(kept, found, strict=True)), books


def made_vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 8)).round(2)
    base[1::3] = base[0]  # a third of all rows is one vector
    rows = [(1000 - i, list(map(float, v)), i % 3 if i % 5 else None) for i, v in enumerate(base)]
    return [*rows, rows[5], (None, [0.5] * 8, 1), (3, None, 1), (4, [1.0] * 7 + [None], 1), (5, [1.0] * 7 + [float("nan")], 1), (6, [1.0] * 7 + [float("inf")], 1), (7, [], 1)]


def test_vector_codes_are_brute_force(spark):
    rows = made_vectors(400)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, code int, error string").repartition(7)
    rounded = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, books = brute_codes(rounded)
    coded, got_books = vectors.compress(df)
    got = sorted((str(r.vec_id), r.code.hex(), r.error, r.label_error) for r in vectors.with_label_errors(coded).collect())
    assert got == want
    assert [b.tolist() for b in got_books] == books
    assert vectors.fingerprint(got_books) == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_vector_codes_of_few_wide_and_no_rows(spark):
    kind = "vec_id long, embedding array<double>, label int"
    few = [(i, [float(i), -0.001, 1e6, 1e300], 0) for i in range(3)] + [(9, [1.0, 2.0], 0)]
    coded, books = vectors.compress(spark.createDataFrame(few, kind))
    assert sorted((r.vec_id, r.error) for r in coded.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert books[1][0, 0] == -2 and books[2][0, 0] == vectors.BOUND and books[3][0, 0] == vectors.BOUND
    coded, books = vectors.compress(spark.createDataFrame([], kind))
    assert coded.count() == 0 and vectors.with_label_errors(coded).count() == 0 and vectors.fingerprint(books) == hashlib.sha256(b"").hexdigest()


def test_nearest_takes_the_first_of_equals():
    index, error = vectors.nearest(np.array([[5, 5], [0, 0]]), np.array([[4, 5], [6, 5], [4, 5]]))
    assert index.tolist() == [0, 0] and error.tolist() == [1, 41]
    index, error = vectors.nearest(np.array([[1 << 26]]), np.array([[-(1 << 26)], [0]]))
    assert index.tolist() == [1] and error.tolist() == [1 << 52]


# SentencePiece


def library(charsmap=None, squeeze=False):
    """The library's processor and the model, with the character map of one of its rules if named."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(registry.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    if charsmap:
        rules = sentencepiece_model_pb2.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=charsmap).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
    blob = proto.SerializeToString()
    return sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.Model(blob)


def odd_texts(n=400):
    rng = random.Random(1)
    letters = list(" ▁  abetnéñ漢字日本\n\t\x00\U0001f600é①㌔ﬁ<s></s>a 　ÀÅ½")
    words = "the of and river Straße königin eau Licensed 2.0 http://x.example/a?b=1 ▁▁ ".split(" ")
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)] + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*made, "", " ", "   ", " a ", "▁", "a" * 300, "x" * 70 + " " + "ab" * 90, "�"]


@pytest.mark.parametrize(("charsmap", "squeeze"), [(None, False), ("nfkc", True), ("nmt_nfkc_cf", False), ("nmt_nfkc", True)])
def test_pieces_are_the_librarys(charsmap, squeeze):
    lib, m = library(charsmap, squeeze)
    texts = odd_texts()
    offsets, ids, begins, ends, decoded = pieces.encode_texts(pieces.Units(m), texts)
    for k, text in enumerate(texts):
        part = slice(offsets[k], offsets[k + 1])
        want = lib.encode(text, return_type="proto").pieces
        assert ids[part].tolist() == [p.id for p in want], repr(text)
        assert list(zip(begins[part].tolist(), ends[part].tolist(), strict=True)) == [(p.begin, p.end) for p in want], repr(text)
        assert decoded[k] == lib.decode([p.id for p in want]), repr(text)


def test_sentencepiece_of_documents(spark):
    lib, _ = library()
    path = registry.tokenizer_path("piece_bpe_32k.model")
    long = ("Über allen Gipfeln " * 60_000) + "z" * 200_000
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (4, long), *enumerate(odd_texts(30), 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "decoded", "begins")})
    got = sorted(pieces.encode(df, path).collect(), key=lambda r: (str(r.doc_id), r.decoded))
    rows.sort(key=lambda r: (str(r[0]), lib.decode(lib.encode(r[1] or ""))))
    for r, (key, text) in zip(got, rows, strict=True):
        raw = (text or "").encode()
        assert (r.doc_id, r.ids) == (key, lib.encode(text or "")) and r.decoded == lib.decode(r.ids)
        covered = b"".join(raw[a:b] for a, b in zip(r.begins, r.ends, strict=True))
        assert covered == raw
    assert pieces.encode(df.limit(0), path, spans=False).count() == 0
    found = {r.doc_id: r for r in registry.op12_sentencepiece(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect():
        ids = lib.encode(r.text or "")
        f = found[r.doc_id]
        assert (f.n_tokens, f.ids_sha256, f.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


# Filters


def brute_audit(rows, labels):
    import re

    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "".join(c for c, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]), strict=True) if bad)
        fails.append((s or "", f, i in good, i in toxic))
    out = {}
    shapley = Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                now = [f for f in left if c in f[1]]
                early = [f for f in mine if c in f[1] and any(e in f[1] for e in order[: step - 1])]
                left = [f for f in left if c not in f[1]]
                out[part, order, step] = [len(left), len(now), len(early), sum(f[1] == c for f in mine), sum(f[2] for f in now), sum(f[3] for f in now)]
                shapley[part, c] += len(now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("sent", [filters.SENT_BLOCKS, 0])
def test_filter_audit_is_brute_force(spark, sent):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a bb ccc Dd EE f|g h#".split()) + str(rng.randrange(9) if n % 2 else rng.randrange(999)) for _ in range(rng.choice([0, 3, 49, 50, 80]))) for n in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["web", "wiki", None, ""])) for i in range(200)] + [(500 + i, texts[1], "hot") for i in range(100)]
    rows += [(900, None, "web"), (901, "", "web"), (None, texts[2], "web"), (None, None, None), (7, texts[3], "web"), (7, texts[4], "web"), (7, texts[4], "web"), (950, "x" * 300_000, "web"), (951, "\x0b\x0c a b 　 " * 60, "web")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 400, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, part int").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in filters.audit(filters.failures(docs, sent), marks).collect()}
    assert got == brute_audit(rows, labels)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar); create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    con.executemany("insert into labels values (?, ?, ?)", labels)
    cursor = con.execute(filters.audit_sql())
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in want} == got
    assert filters.audit(filters.failures(docs.limit(0), sent), marks).count() == 0
    alone = filters.audit(filters.failures(docs.limit(1)), marks.limit(0)).agg(F.sum("good_lost").alias("g")).first()
    assert alone.g == 0


def test_sketch_never_clears_a_repeated_text(spark):
    hashes = spark.range(5000).select(F.xxhash64((F.col("id") % 4000).cast("string")).alias("h"))
    for blocks in (1, 64, 2048):
        kept = filters._repeats(hashes, filters.counted_twice(hashes, blocks), blocks)
        counts = {r.h: r.n for r in kept.groupBy("h").agg(F.count("*").alias("n")).collect()}
        repeated = {r.h for r in hashes.groupBy("h").count().where("count > 1").collect()}
        assert repeated <= set(counts) and all(counts[h] == 2 for h in repeated)
        assert blocks < 2048 or len(counts) < 1400

"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from lamina.llm import chat, decontaminate, embeddings, langid, licenses, minhash, packing, registry, repeats, toxicity, wrappers

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = {"en": "the of and that with for hand stone river night", "de": "der und nicht mit über straße königin wälder schön groß"}
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "!!! ???"), (None, "no id at all here"), (6, "x" * 5000), (7, "é漢\U0001f600 " * 300)]


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def prose(rng, lang, n):
    return " ".join(rng.choice(LETTERS[lang].split()) + rng.choice(["", "", "er", "en"]) for _ in range(n))


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(1) for c in ("words", "node", "key", "label", "shard", "h")})
    return df


def test_licenses_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    rng = random.Random(1)
    lines = ["Licensed under the Apache License, Version 2.0", "GNU General Public License v3 or later", "CC-BY-SA 4.0", "MIT License. MIT License", "(c) Copyright 2020 All rights reserved", "SPDX-License-Identifier: BSD-3-Clause", "Kelvin MIT LICENſE", "cc by cc by"]
    rows = [*AWKWARD, *[(100 + i, prose(rng, "en", rng.randrange(30)) + " " + " ".join(rng.sample(lines, rng.randrange(1, 4)))) for i in range(60)]]
    con.execute("create table made(doc_id bigint, text varchar)")
    con.executemany("insert into made values (?, ?)", rows)
    for source, df in (("documents", spark.read.parquet(f"{DATA}/documents.parquet")), ("made", documents(spark, rows, True))):
        want = con.execute(licenses.scan_sql(source)).fetchall()
        got = [tuple(r) for r in licenses.scan(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert any("apache" in r[6] for r in got) and any("gpl-3.0" in r[6] for r in got)


def test_licenses_need_no_stem(spark):
    want = {"Released under Apache 2.0": "apache-2.0", "MPL 2.0": "mpl-2.0", "BSD 3-Clause": "bsd-3-clause", "simplified BSD": "bsd-2-clause", "FreeBSD": "bsd-2-clause", "CeCILL-B": "cecill", "MIT No Attribution": "mit-0", "This program is free software": "gpl", "proprietary and confidential": "proprietary", "Permission to use, copy, modify and/or distribute this software for any purpose": "isc", "a gpl v of no number": "gpl"}
    got = {r.doc_id: r for r in licenses.scan(documents(spark, list(enumerate(want)))).collect()}
    assert [got[i].labels for i in range(len(want))] == list(want.values()) and all(r.score > 0 and r.n_detections == 1 for r in got.values())


def test_chat_collapse(spark):
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"), (4, 0, None, None), (5, 0, "user", "hello"), (5, 0, "user", "hello"), (None, 0, "user", "x"), (6, 0, "user", "hi"), (6, 1, "assistant", "other")]
    got = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [2, 4, 5, 6] and got[2].n_copies == 2 and got[5].n_turns == 1
    assert got[6].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def classes(rows, size=5, threshold=0.8):
    bags = {}
    for i, t in rows:
        w = split(t)
        bags[i] = collections.Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else collections.Counter([tuple(w)] if w else [])
    top = {i: i for i in bags}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                common = sum((bags[a] & bags[b]).values())
                if common >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - common) - 1e-9:
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 6, 300), rng.integers(0, 9, 300)
    e = rng.integers(1, 2**63, 300).astype(np.uint64)
    has = b > 0
    h = minhash.bag_minhash(np.concatenate([np.zeros(300, int), np.ones(has.sum(), int)]), np.concatenate([e, e[has]]), np.concatenate([a, b[has]]), 2, 8192)
    assert abs((h[0] == h[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025


def test_near_duplicates_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.choice([4, 60, 150]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows, True)).collect()}
    assert got == classes(rows)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_group_sort():
    rng = random.Random(5)
    for _ in range(200):
        texts = [[*(rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 50))), 0] for _ in range(rng.randint(1, 30))]
        lanes = np.cumsum([0, *map(len, texts)])
        found = repeats.group_sort(np.concatenate([np.array(t) for t in texts]), lanes)
        for t, a in zip(texts, lanes.tolist(), strict=False):
            assert (found[a : a + len(t)] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = True
        out.append((i, len(b), int(mask.sum()), len(repeats.runs(mask)), np.frombuffer(b, np.uint8)[~mask].tobytes()))
    return out


@pytest.mark.parametrize(("piece", "block"), [(1 << 20, 512), (700, 3)])
def test_repeats_are_exact(spark, monkeypatch, piece, block):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(6)
    shared = [prose(rng, "de", 60) for _ in range(4)]
    rows = [(i, prose(rng, "en", rng.randrange(60)) + rng.choice([*shared, ""]) + prose(rng, "en", rng.randrange(40))) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "z" * 201), (102, "z" * 200), (103, prose(rng, "en", 900)), (104, rows[3][1]), (104, rows[3][1])]
    rows += [(200 + i, t) for i, (_, t) in enumerate(AWKWARD)] + [(None, shared[0] * 2)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove(documents(spark, rows, True)).collect()]
    assert sorted(got, key=str) == sorted(removed(rows, 200), key=str)


def test_language_is_learned(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, lang, rng.randrange(20, 200)), lang) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [(1000 + i, t, None) for i, (_, t) in enumerate(AWKWARD)]
    got = {r.doc_id: r for r in langid.run(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 300 + len(AWKWARD)
    held = [i for i in range(300) if got[i].held_out]
    assert held == [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert {got[1000 + i].lang_pred for i in (0, 1, 2, 5)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.run(empty).count() == 0


def test_leaks_are_found(spark):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "nd", "m")]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(rng.randrange(15, 60))) for i in range(40)]
    rows, want = [], set()
    for d in range(300):
        w = text(rng.randrange(0, 200))
        if d % 5 == 0:
            i, x = items[rng.randrange(40)]
            x = [rng.choice(vocab) if d % 2 and rng.random() < 0.2 else y for y in x]
            if not (d % 2 and x[-5:] != items[i][1][-5:]):
                want.add((d, i))
            at = rng.randrange(len(w) + 1)
            w = w[:at] + x + w[at:]
        rows.append((d, " ".join(w)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    bench = spark.createDataFrame([*[(i, " ".join(x)) for i, x in items], (90, None), (91, ""), (None, "a b c d e f"), (92, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows, True), bench).collect()}
    assert want <= got and all(d % 5 == 0 for d, _ in got)
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0


def test_common_length():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_length(a, b) == t[-1][-1]


def test_toxic_words_are_learned(spark):
    rng = random.Random(10)
    bad, rows, labels = ["vile", "rotten", "filthy"], [], []
    for i in range(600):
        w, toxic = prose(rng, "en", rng.randrange(5, 80)).split(), rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    table = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.run(documents(spark, rows, True), table).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.95
    spans = [(rows[i][1].encode()[s.start : s.end].decode(), labels[i][1]) for i in held for s in got[i].spans]
    assert spans and all(any(b in s for b in bad) and t for s, t in spans)
    none = toxicity.run(documents(spark, rows[:3]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == 3 and all(0 <= r.score <= 1 and r.spans == [] for r in none)


def test_marginals_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "CHAIN", 3)
    rng = np.random.default_rng(11)
    sizes = [5, 1, 9, 3, 7]
    e, t = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    cell, doc, at = [], [], 0
    for d, n in enumerate(sizes):
        rows = -(-n // 3)
        cell += [(len(doc) + i // 3) * 3 + i % 3 for i in range(n)]
        doc += [d] * rows
    p, pairs = toxicity.marginals(e, t, np.array(cell), np.array(doc))
    want, want_pairs = [], np.zeros((2, 2))
    for n in sizes:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(1 << n):
            tags = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(e[at + i] * tags[i] for i in range(n)) + sum(t[tags[i], tags[i + 1]] for i in range(n - 1)))
            total, one = total + w, one + w * np.array(tags)
            for i in range(n - 1):
                two[tags[i], tags[i + 1]] += w
        want += list(one / total)
        want_pairs += two / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    rows = [(i, prose(rng, "en", int(rng.paretovariate(0.6)) % 4000)) for i in range(400)] + [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    rows += [(2000, "a <|endoftext|> b"), (2001, " " * 1_000_000), (2002, "x" + "\n" * 300_000 + "y"), (2003, "don't\u3000\u00a0 1234 \U0001f600<|endoftext|>"), (2004, "word " * 200_000)]
    path = registry.tokenizer_path("byte_bpe_50k.json")
    got = packing.pack(documents(spark, rows, True), path).collect()
    ids = {i: [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length <= 1024 and zlib.crc32(part.tobytes()) == r.ids_crc32
    for i, x in ids.items():
        p = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and sum(r.length for r in p) == len(x) and all(r.length == 1024 for r in p[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_plan_places_every_piece():
    rng = random.Random(13)
    for _ in range(15):
        histogram = collections.Counter(rng.choice([rng.randrange(1, 1025), rng.randrange(1, 200), 700]) for _ in range(rng.randrange(1, 3000)))
        runs, sequences = packing.plan(dict(histogram))
        count, room = collections.Counter(), collections.Counter()
        for length, first, n, sequence, offset in runs:
            assert first == count[length]
            count[length] += n
            for k in range(n):
                room[sequence + k] += length
        assert count == histogram and max(room.values()) <= 1024 and len(room) == sequences
    assert packing.plan({}) == ([], 0)


def test_packing_of_an_empty_table_and_a_missing_id(spark):
    path = registry.tokenizer_path("byte_bpe_50k.json")
    assert packing.pack(documents(spark, []), path).count() == 0
    rows = packing.pack(documents(spark, [(None, "a b"), (None, "a b"), (1, None)]), path).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 3), (0, 3), (1, 1)] and len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_the_fast_encoder_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    encode, plain = packing.encoder(path), Tokenizer.from_file(path)
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += [f"a{chr(c)}b {chr(c)}1{chr(c)} \n{chr(c)} x" for c in [*range(0xD800), *range(0xE000, 0x30000, 7)]]
    assert all(encode(t) == e.ids for t, e in zip(texts, plain.encode_batch_fast(texts, add_special_tokens=False), strict=True))


def test_wrappers(spark):
    rng = random.Random(14)
    rows, want = [], {}
    for i in range(24):
        body = [prose(rng, "en", rng.randrange(10, 40)) for _ in range(rng.randrange(1, 5))]
        notice = "<p>Read our <b>magazine</b> every week for more stories of this kind.</p>"
        html = f"<html><head><title>t{i}</title></head><body><nav><a href=/>home</a></nav><div>{notice}" + "".join(f"<p>{p} &amp; co<br>x" for p in body) + f"</div><div class='comments'><p>nice {i}</p></div><footer>© {i}</footer></body></html>"
        rows.append((i, f"https://User@WWW.Host.example:80/p{i}?q", html))
        want[i] = " ".join(f"{p} & co x" for p in body)
    rows += [(100, None, None), (101, "", ""), (102, "http://other.example/", "<article><h1>A</h1>b<i>c</i></article>"), (103, "nonsense", "<p>only & text <"), (104, "http://other.example/", "x" * 3000)]
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].text for i in want} == want
    assert got[100].text == got[101].text == "" and got[102].text == "A bc" and got[104].n_chars == 3000


def brute_links(rows, threshold=0.98):
    good = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = collections.Counter()
    for a, (x, p) in good.items():
        for b, (y, q) in good.items():
            out[a] += a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold
    return out


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(15)
    rows = []
    for g in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 2, 40], p=[0.5, 0.4, 0.1]))):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.12])], int(g % 3)))
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None] * 8, 1), (5003, [float("nan")] * 16, 1), (5004, rows[0][1], None), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (5007, [], 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute_links(rows)
    assert set(got) == {r[0] for r in rows}
    assert all(got[i].n_links <= want[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values())
    assert got[5005].n_links == 1 and got[5006].component_id == 5005 and not got[5006].kept and got[5004].n_links == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_registered_queries(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, DATA)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(str, want.fetchall()))
    digest = {r.doc_id: r.kept_sha256 for r in registry.op4_suffix_array_dedup(spark, DATA).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert digest == {i: hashlib.sha256(kept).hexdigest() for i, _, _, _, kept in removed(rows, 200)}


def extracted(spark, pages):
    rows = [(i, f"http://{h}/{i}", html) for i, (h, html) in enumerate(pages)]
    return [r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_wrappers_count_every_page(spark):
    rng = random.Random(16)
    body = [prose(rng, "en", 30) for _ in range(48)]
    late = "<i></i>" * 600 + "<u></u>" * 30_000
    pages = []
    for i, x in enumerate(body):
        notice = "<p>Our stories are read in every town.</p>" if i % 12 else "<section><p>Letters go to the office by the river.</p></section>"
        if i % 2:
            notice += "<div><section><p>Half of the pages hold this.</p></section></div>"
        pages.append(("kinds.example", f"<body><div><p>{x}</p>{late if i < 12 else ''}{notice}</div></body>"))
    assert extracted(spark, pages) == body


def test_wrappers_know_copies_from_template(spark):
    rng = random.Random(17)
    notice = "<p>" + prose(rng, "en", 200) + "</p>"
    body = [prose(rng, "en", 12) for _ in range(6)]
    long_notices = [("long.example" if i < 4 else "two.example", f"<body><div><p>{x}</p>{notice}</div></body>") for i, x in enumerate(body)]
    assert extracted(spark, long_notices) == body
    copies = [("copies.example", f"<body><div><p>{body[0]}</p><p>Seen {i} times</p></div></body>") for i in range(4)]
    assert all(body[0] in x for x in extracted(spark, copies))


@pytest.mark.parametrize("cells", [4 << 20, 40])
def test_leaks_are_all_that_the_plain_test_finds(spark, monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "CELLS", cells, raising=False)
    rng = random.Random(18)
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "er", "ist", "ond", "um")]
    common = ["the", "of", "and", "to", "in"]
    text = lambda n: [rng.choice(common if rng.random() < 0.4 else vocab) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 4, 5, 6, 8, 10, 12, 16, 20, 24, 30, 40, 60] * 2)]
    rows = []
    for d in range(240):
        w, x = text(rng.randrange(0, 150)), items[d % 32][1]
        x = [y if rng.random() >= (d % 4) * 0.12 else rng.choice(vocab) for y in x]
        at = rng.randrange(len(w) + 1)
        rows.append((d, w[:at] + x + w[at:]))
    want = set()
    for d, w in rows:
        for i, x in items:
            n = len(x)
            for start in range(0, max(len(w) - 16, 1), 16):
                near = w[max(0, start - n) : start + 32 + n]
                if n < 5:
                    found = any(near[k : k + n] == x for k in range(len(near) - n + 1))
                else:
                    share = decontaminate.common_length(x, near) / n
                    found = share >= 0.8 or share >= 0.6 and decontaminate.common_length(x[-5:], near) / 5 >= 0.6
                if found:
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, [(d, " ".join(w)) for d, w in rows]), bench).collect()}
    assert got == want


def test_repeats_with_many_segments_of_one_gram(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 4)
    rng = random.Random(19)
    line, passage = "this very common line stands in a great many of the texts, " * 2, prose(rng, "de", 70)
    rows = [(i, prose(rng, "en", 12) + line + prose(rng, "en", 12)) for i in range(60)]
    rows += [(100 + i, prose(rng, "en", 20) + passage + prose(rng, "en", 20)) for i in range(60)]
    near = prose(rng, "en", 120).split()
    for i in range(40):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
        rows.append((200 + i, " ".join(copy)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(removed(rows, 200))


def test_repeats_of_long_texts_and_odd_ids(spark):
    rng = random.Random(20)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(-(1 << 62), long), (5, long[1_000_000:1_000_300] + "!"), (6, "q" * 300_000), (7, None)]
    got = {r.doc_id: r for r in repeats.remove(documents(spark, rows)).collect()}
    assert got[-(1 << 62)].n_removed == 300 and got[-(1 << 62)].n_spans == 1 and bytes(got[5].kept) == b"!"
    assert got[6].n_removed == 300_000 and got[7].n_bytes == 0
    assert repeats.remove(documents(spark, [])).count() == 0


def test_whole_characters():
    raw = np.frombuffer("aé漢x".encode(), np.uint8)
    mask = np.zeros(len(raw), bool)
    mask[[2, 3]] = True
    assert raw[~repeats.whole_characters(raw, mask)].tobytes() == b"ax"


def test_embeddings_of_any_size(spark):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(50):
        v = rng.normal(size=8)
        rows += [(2 * i, [float(x) for x in v], 1), (2 * i + 1, [float(x) for x in v * 1.0001 + rng.normal(size=8) * 0.01], 1)]
    rows += [(500, [1e-200] * 8, 1), (501, [2e-200] * 8, 1), (502, [1e200] * 8, 1), (503, [1e200] * 7 + [9e199], 1), (504, [5e-324, 0.0] * 4, 1), (504, [5e-324, 0.0] * 4, 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, cell int, query int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert sum(got[i] for i in range(100)) >= 98 and got[500] == got[501] == got[502] == got[503] == 3 and got[504] == 1


def test_traversal_is_in_order():
    rng = np.random.default_rng(22)
    for _ in range(40):
        a, b = rng.random(9), rng.random(7)
        a, b = a - a.min(), b - b.min()
        cells = list(embeddings.traverse((a, b), 0.8))
        want = sorted((a[i] + b[j], i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.8)
        assert cells == [(i, j) for _, i, j in want]


def test_pages_of_any_depth_and_class(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    pages = [
        ("", deep),
        ("", "<b>" * 20_000 + "bold" + "</i>" * 20_000),
        ("a.example", '<article><p>One.</p><div class="copyright-law"><p>Two.</p></div><p class="related-work">Three.</p><div class="share-buttons">no</div><div class="comments">no</div></article>'),
        ("b.example", '<body><p><a href="/x">A whole paragraph that is one link.</a></p></body>'),
        ("c.example", "<body><ul><li><a>one</a><li><a>two</a></ul><p>Text.</p></body>"),
        ("d.example", "\x00<!-- <p>no</p> --><p>&#x41;&amp;&notanentity;&eacute; x y</p><script>no</script>"),
    ]
    rows = [(i, f"http://{h}/{i}" if h else None, html, "x") for i, (h, html) in enumerate(pages)]
    df = spark.createDataFrame([*rows, rows[2], (99, None, None, "x")], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text) for r in wrappers.main_text(df).orderBy("page_id").collect()]
    texts = dict(got)
    assert texts[0] == "deep text" and texts[1] == "bold" and texts[2] == "One. Two. Three." and texts[3] == "A whole paragraph that is one link."
    assert texts[4] == "Text." and texts[5] == "A&¬anentity;é x y" and texts[99] == "" and [i for i, _ in got].count(2) == 2
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_one_id_may_have_several_texts(spark):
    rng = random.Random(23)
    a, b = prose(rng, "en", 80), prose(rng, "de", 80)
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, prose(rng, "en", 50))]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(documents(spark, rows, True)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_segment_sums_are_plain_sums():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(50, 3)).astype(np.float32)
    size = np.array([1, 3, 200, 64, 65, 2, 1, 16])
    rows, first = rng.integers(0, 50, size.sum()), np.cumsum(size) - size
    want = [table[rows[a : a + n]].sum(0) for a, n in zip(first, size, strict=True)]
    assert np.allclose(decontaminate.segment_sums(table, rows, first), want, atol=1e-4)
    assert np.allclose(decontaminate.segment_sums(table, rows[:1], first[:1]), table[rows[:1]])

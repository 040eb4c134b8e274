"""Benchmark decontamination: word counts that every leak must reach, longest common subsequences, an answer check and latent cosines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import Words, chunks, text_bytes, words

# Buckets that stand in more than exp(-STOP) of the half passages carry no weight, the others the square of their idf.
BUCKET_BITS, RANK, HALF, SLICE, STOP = 14, 64, 16, 256, 2.0
SHARE, SURE, ANSWER_WORDS, ANSWER_SHARE = 0.6, 0.8, 5, 0.6
# Of an item's words the rarest are counted: as many as a leak may lack, and GATE of them more, which it has to have.
ITEMS_PER_PASS, CHARS_PER_PASS, CHUNK, GATE, CELLS = 512, 256 << 10, 512 << 10, 0.3, 4 << 20
# Rows of a segment that are added beside those of other segments.
LONG = 64


class Space(NamedTuple):
    idf: np.ndarray
    map: np.ndarray  # buckets to whitened latent coordinates


class Gate(NamedTuple):
    word: np.ndarray  # hashes of the counted words, sorted
    first: np.ndarray  # of each word: its place in item and times
    item: np.ndarray
    times: np.ndarray
    needed: np.ndarray  # of each item: count that a leak has at least


class Halves(NamedTuple):
    words: Words
    bucket: np.ndarray  # of each word
    half: np.ndarray  # of each word: half passages of HALF words that stay within a document
    first: np.ndarray  # first word of each half
    passage: np.ndarray  # first half of each passage: two halves in a row, or the only one of a document
    last: np.ndarray  # second half of each passage


def halves(raw: np.ndarray, offsets: np.ndarray) -> Halves:
    w = words(raw, offsets)
    count = np.diff(w.first)
    rows = -(-count // HALF)
    base = np.cumsum(rows) - rows
    half = base[w.doc] + (np.arange(len(w.doc)) - w.first[w.doc]) // HALF
    first = np.flatnonzero(np.diff(half, prepend=-1)) if len(half) else np.zeros(0, np.int64)
    doc = w.doc[first]
    passage = np.flatnonzero((np.append(doc[1:], -1) == doc) | (rows[doc] == 1))
    last = np.where(rows[doc[passage]] == 1, passage, passage + 1)
    return Halves(w, (w.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), half, first, passage, last)


def segment_sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over segments of rows, none of them empty, that begin at first.

    Segments are taken by size, so that those with a k-th row are the first ones, and their k-th rows are added at once; what is beyond LONG rows is
    summed segment by segment.
    """
    size = np.diff(np.append(first, len(rows)))
    order = np.argsort(-size, kind="stable")
    size, first = size[order], first[order]
    total = table[rows[first]]
    for k in range(1, min(size[0], LONG)):
        m = np.searchsorted(-size, -k)
        total[:m] += table[rows[first[:m] + k]]
    for i in range(np.searchsorted(-size, -LONG)):
        total[i] += table[rows[first[i] + LONG : first[i] + size[i]]].sum(0)
    out = np.empty_like(total)
    out[order] = total
    return out


def sums(h: Halves, weight: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each passage the weighted sum of its words' rows of the table, and the norm of its weights."""
    if not len(h.first):
        return np.zeros((0, table.shape[1]), np.float32), np.zeros(0)
    at = np.flatnonzero(weight[h.bucket])
    bucket = h.bucket[at]
    first = np.searchsorted(at, h.first)
    size = np.diff(np.append(first, len(at)))
    some = np.flatnonzero(size)
    each, square = np.zeros((len(first), table.shape[1]), np.float32), np.zeros(len(first))
    if len(some):
        each[some] = segment_sums(table * weight[:, None], bucket, first[some])
        square[some] = np.add.reduceat(weight[bucket].astype(float) ** 2, first[some])
    double = (h.last > h.passage)[:, None]
    return each[h.passage] + np.where(double, each[h.last], 0), np.sqrt(square[h.passage] + np.where(double[:, 0], square[h.last], 0)) + 1e-9


def summed(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Sums binary float64 vectors of equal key over all rows; there are as many keys as slices of the hash buckets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(vector.as_buffer(), np.float32).astype(float)
                total[key] = total[key] + x if key in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["key", "vector"])

    rows = parts.repartition("key").mapInArrow(add, "key int, vector binary").collect()
    return {r.key: np.frombuffer(bytes(r.vector), float).reshape(-1, width) for r in rows}


def _slices(table: np.ndarray) -> pa.RecordBatch:
    n = len(table) // SLICE
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in table.reshape(n, SLICE, -1)], pa.binary())], ["key", "vector"])


def fit(docs: DataFrame, seed: int = 3) -> Space:
    """Document frequencies and a randomised SVD of the TF-IDF passages, both over all documents.

    With A the passages' weights, one pass sums AᵀA times a random matrix; the Nyström form of the randomised decomposition
    gives the right singular vectors and singular values from that. The driver holds tables of hash buckets times RANK numbers.
    """
    size = 1 << BUCKET_BITS
    texts = docs.select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, 1)), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets, CHUNK):
                h = halves(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                pair = np.unique((h.half * size + h.bucket).astype(np.int32 if len(h.first) < 1 << 16 else np.int64))
                total[:, 0] += np.bincount(pair % size, minlength=size)
                n += len(h.first)
        yield _slices(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array([n], np.float32).tobytes()], pa.binary())], ["key", "vector"])

    got = summed(texts.mapInArrow(count, "key int, vector binary"), 1)
    n = float(got.pop(-1, np.ones((1, 1)))[0, 0])
    df = np.concatenate([got[k] for k in sorted(got)])[:, 0] if got else np.zeros(size)
    idf = np.log((n + 1024) / (df + 1)).astype(np.float32)
    idf = np.where(idf < STOP, 0, idf**2)  # squared: words of middling frequency would outweigh the rare ones
    omega = np.random.default_rng(seed).normal(size=(size, RANK)).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((idf, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega = sent.value
        total = np.zeros((size, RANK))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets, CHUNK):
                h = halves(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h.first):
                    continue
                z, norm = sums(h, idf, omega)
                z = (z / np.maximum(norm, 1.0)[:, None] ** 2).astype(np.float32)
                back = np.zeros((len(h.first), RANK), np.float32)
                back[h.passage] += z
                double = h.last > h.passage
                back[h.last[double]] += z[double]
                order = np.flatnonzero(idf[h.bucket])
                order = order[np.argsort(h.bucket[order].astype(np.int16), kind="stable")]
                bucket = h.bucket[order]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                if len(at):
                    total[bucket[at]] += segment_sums(back, h.half[order], at) * idf[bucket[at]][:, None]
        yield _slices(total)

    got = summed(texts.mapInArrow(sketch, "key int, vector binary"), RANK)
    y = np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros((size, RANK))
    shift = np.linalg.norm(y) * 1e-6 + 1e-9
    y = y + shift * omega
    core = omega.T.astype(float) @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 1e-12) * 1e-9
    u, s, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return Space(idf, (u / np.maximum(s, s.max() * 1e-3)).astype(np.float32))


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of whole numbers."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame, space: Space | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share: items of the benchmark that a document holds, also paraphrased.

    Every passage of every text of docs (doc_id, text) is compared with every item, in passes of ITEMS_PER_PASS items or CHARS_PER_PASS characters.
    It is a leak if the longest common subsequence with the words around the passage has SURE of the item's words, or SHARE of them
    and the item's last ANSWER_WORDS words are there by ANSWER_SHARE. Items of fewer than ANSWER_WORDS words have to stand there word
    for word. Null and empty texts and items and rows without an id match nothing. Repeated rows give one row. cosine is the best
    latent cosine of a window of the item and a passage that it leaks to; it decides nothing.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    space = space or fit(texts)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").dropDuplicates()
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    out = None
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_blocks = max(1, -(-size.n // ITEMS_PER_PASS), -(-size.chars // CHARS_PER_PASS))
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    for k in range(n_blocks):
        rows = sorted((r.item_id, r.text) for r in blocks.where(F.col("block") == k).collect())
        raw, offsets = text_bytes(pa.array([t for _, t in rows], pa.string()))
        w = words(raw, offsets)
        known = [(i, w.hash[w.first[j] : w.first[j + 1]]) for j, (i, _) in enumerate(rows) if w.first[j + 1] > w.first[j]]
        sent = spark.sparkContext.broadcast((space, known, *_windows(known, space), _gate(known, space)))
        found = texts.mapInArrow(_searcher(sent), schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")])


def _windows(items: list[tuple[int, np.ndarray]], space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The items' windows of two halves, half by half and from the end: unit latent vectors and where each item's begin."""
    vectors, first = [], [0]
    for _, hashes in items:
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        n = len(bucket)
        for a in sorted({*range(0, max(n - HALF, 1), HALF), max(0, n - 2 * HALF)}):
            own = bucket[a : a + 2 * HALF]
            vectors.append((space.map[own] * space.idf[own][:, None]).sum(0))
        first.append(len(vectors))
    table = np.array(vectors, np.float32).reshape(len(vectors), space.map.shape[1])
    return table / (np.linalg.norm(table, axis=1, keepdims=True) + 1e-12), np.array(first)


def least(n: int) -> int:
    """Words of an item of n words that any leak of it has."""
    return n if n < ANSWER_WORDS else next(c for c in range(n + 1) if c / n >= SHARE)


def _gate(items: list[tuple[int, np.ndarray]], space: Space) -> Gate:
    """A leak lacks at most n - least(n) of an item's n words, so of that many and x more words it has x at least."""
    rows, needed = [], []
    for k, (_, hashes) in enumerate(items):
        n = len(hashes)
        x = min(least(n), max(1, round(GATE * n)))
        rare = np.lexsort((hashes, -space.idf[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
        word, times = np.unique(hashes[rare[: n - least(n) + x]], return_counts=True)
        rows.append((word, np.full(len(word), k), times))
        needed.append(x)
    word, item, times = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
    order = np.argsort(word, kind="stable")
    known, first = np.unique(word[order], return_index=True)
    return Gate(known, np.append(first, len(order)), item[order], times[order], np.array(needed, int))


def _candidates(h: Halves, gate: Gate, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(passage, item) where the words around the passage have the count that the gate needs."""
    n, m = len(h.first), len(sizes)
    at = np.minimum(np.searchsorted(gate.word, h.words.hash), len(gate.word) - 1)
    on = np.flatnonzero(gate.word[at] == h.words.hash)
    half, word = np.divmod(np.unique(h.half[on] * len(gate.word) + at[on]), len(gate.word))
    count = gate.first[word + 1] - gate.first[word]
    place = np.arange(count.sum()) + np.repeat(gate.first[word] - np.cumsum(count) + count, count)
    half, item, times = np.repeat(half, count), gate.item[place], gate.times[place]
    doc = h.words.doc[h.first]
    begin, end = (np.searchsorted(doc, doc[h.passage], side) for side in ("left", "right"))
    reach = -(-sizes // HALF)
    step = max(1, CELLS // n)
    for x in range(0, m, step):
        some = slice(None) if step >= m else np.flatnonzero((item >= x) & (item < x + step))
        width = min(step, m - x)
        total = np.zeros((n + 1, width), np.int32)
        np.cumsum(np.bincount(half[some] * width + item[some] - x, times[some], n * width).astype(np.int32).reshape(n, width), axis=0, out=total[1:])
        for r in np.unique(reach[x : x + width]):
            own = np.flatnonzero(reach[x : x + width] == r)
            part = total[:, own]
            around = part[np.minimum(h.passage + 2 + r, end)] - part[np.maximum(h.passage - r, begin)]
            for p, q in zip(*np.nonzero(around >= gate.needed[x + own]), strict=True):
                yield int(p), x + int(own[q])


def _searcher(sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items, table, windows, gate = sent.value
        lists = [x.tolist() for _, x in items]
        sizes, fewest = np.array([len(x) for x in lists], int), [least(len(x)) for x in lists]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offsets = text_bytes(batch.column(1))
            out: list[tuple] = []
            for a, b in chunks(offsets, CHUNK):
                h = halves(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h.first) or not len(sizes):
                    continue
                for p, item in _candidates(h, gate, sizes):
                    start, n = int(h.first[h.passage[p]]), len(lists[item])
                    doc = int(h.words.doc[start])
                    lo = max(int(h.words.first[doc]), start - n)
                    hi = min(int(h.words.first[doc + 1]), start + 2 * HALF + n)
                    near = h.words.hash[lo:hi].tolist()
                    if sum(map(set(near).__contains__, lists[item])) < fewest[item]:
                        continue
                    if n < ANSWER_WORDS:
                        share = answer = float(any(near[i : i + n] == lists[item] for i in range(len(near) - n + 1)))
                    else:
                        share = common_length(lists[item], near) / n
                        answer = common_length(lists[item][-ANSWER_WORDS:], near) / ANSWER_WORDS if share >= SHARE else 0.0
                    if share >= SURE or share >= SHARE and answer >= ANSWER_SHARE:
                        bucket = h.bucket[start : min(int(h.words.first[doc + 1]), start + 2 * HALF)]
                        z = (space.map[bucket] * space.idf[bucket][:, None]).sum(0)
                        cosine = float((table[windows[item] : windows[item + 1]] @ z).max() / (np.linalg.norm(z) + 1e-12))
                        out.append((ids[a + doc], items[item][0], cosine, share, answer))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return search

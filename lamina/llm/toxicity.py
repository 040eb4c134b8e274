"""Toxic spans by a linear-chain conditional random field; its marginals add up to document scores. Trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.text import LOWER, Words, chunks, mix, powers, prefix_hash, text_bytes, words

FEATURE_BITS, PREFIXES, CHAIN, EPOCHS = 18, (4, 5, 6, 7, 8), 64, 30
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 1800, 8_000
SEEN, ODDS, SPAN = 3, 30.0, 0.5


class Model(NamedTuple):
    emission: np.ndarray  # of the tag toxic, against the other one, by feature
    transition: np.ndarray  # log potentials, from tag to tag
    document: np.ndarray  # logistic weights of the aggregates


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words and, for each, the buckets of the word and of its first bytes; a missing prefix repeats the word."""
    w = words(raw, offsets)
    h, inverse = prefix_hash(LOWER[raw]), powers(len(raw) + 1)[1]
    out = np.empty((len(w.start), 1 + len(PREFIXES)), np.int32)
    shift = np.uint64(64 - FEATURE_BITS)
    out[:, 0] = w.hash >> shift
    for i, k in enumerate(PREFIXES):
        end = np.minimum(w.start + k, w.end)
        part = mix((h[end] - h[w.start]) * inverse[w.start] + np.uint64(1000 + k))
        out[:, i + 1] = np.where(w.end - w.start >= k, part, w.hash) >> shift
    return w, out


def chains(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's cell in a table of rows of CHAIN words, and each row's document; a document's rows follow each other."""
    count = np.diff(w.first)
    rows = -(-count // CHAIN)
    place = np.arange(len(w.doc)) - w.first[w.doc]
    row = (np.cumsum(rows) - rows)[w.doc] + place // CHAIN
    return row * CHAIN + place % CHAIN, np.repeat(np.arange(len(count)), rows)


def _carried(product: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before each row of a document and the one after it, from the rows' products of transitions."""
    rows = len(doc)
    ahead, behind = np.zeros((rows, 2)), np.ones((rows, 2))
    ahead[:, 0] = 1
    new = np.ones(rows, bool)
    new[1:] = doc[1:] != doc[:-1]
    rank = np.arange(rows) - np.flatnonzero(new)[np.cumsum(new) - 1]
    order = np.argsort(rank, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(rank)))
    for k in range(1, len(bounds) - 1):
        at = order[bounds[k] : bounds[k + 1]]
        x = (ahead[at - 1][:, None] @ product[at - 1])[:, 0]
        ahead[at] = x / x.sum(1, keepdims=True)
    for k in range(len(bounds) - 2, 0, -1):
        at = order[bounds[k] : bounds[k + 1]]
        x = (product[at] @ behind[at][:, :, None])[:, :, 0]
        behind[at - 1] = x / x.sum(1, keepdims=True)
    return ahead, behind


def marginals(emission: np.ndarray, transition: np.ndarray, cell: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over whole documents: P(toxic) of each word, and the expected transitions (2, 2).

    All rows of the table are worked on at once: first the product of each row's transitions, then the states carried from row to
    row of a document, then each row from the states at its ends.
    """
    rows = len(doc)
    table, inside = np.zeros((rows, CHAIN)), np.zeros((rows, CHAIN), bool)
    table.reshape(-1)[cell] = np.clip(emission, -30, 30)
    inside.reshape(-1)[cell] = True
    table, inside = np.ascontiguousarray(table.T), np.ascontiguousarray(inside.T)
    potential, step = np.stack([np.ones((CHAIN, rows)), np.exp(table)], 2), np.exp(transition)
    start = np.ones(rows, bool)
    start[1:] = doc[1:] != doc[:-1]
    product = np.where(start[:, None, None], 1.0, step[None]) * potential[0][:, None, :]  # a document begins in either tag alike
    for t in range(1, CHAIN):
        x = (product @ step) * potential[t][:, None, :]
        product = np.where(inside[t][:, None, None], x / x.sum((1, 2), keepdims=True), product)
    ahead, behind = _carried(product, doc)
    alpha = np.zeros((CHAIN, rows, 2))
    alpha[0] = np.where(start[:, None], 1.0, ahead @ step) * potential[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, CHAIN):
        a = (alpha[t - 1] @ step) * potential[t]
        alpha[t] = np.where(inside[t][:, None], a / a.sum(1, keepdims=True), alpha[t - 1])
    beta, out, pairs = behind, np.zeros((rows, CHAIN)), np.zeros((2, 2))
    for t in range(CHAIN - 1, -1, -1):
        both = alpha[t] * beta
        out[:, t] = both[:, 1] / both.sum(1)
        b = beta * potential[t]
        joint = (alpha[t - 1] if t else ahead)[:, :, None] * step[None] * b[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += joint[inside[t] & (t > 0 or ~start)].sum(0)
        if t:
            back = b @ step.T
            beta = np.where(inside[t][:, None], back / back.sum(1, keepdims=True), beta)
    return out.reshape(-1)[cell], pairs


def aggregates(w: Words, p: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document: 1, the largest marginal, the sum of the marginals (damped), the share of likely words (damped)."""
    top = np.zeros(n_docs)
    np.maximum.at(top, w.doc, p)
    total = np.bincount(w.doc, weights=p, minlength=n_docs)
    likely = np.bincount(w.doc, weights=p >= SPAN, minlength=n_docs)
    share = likely / np.maximum(np.diff(w.first), 1)
    return np.stack([np.ones(n_docs), top, np.log1p(total), np.log1p(likely), np.log1p(1000 * share)], 1)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Labels tokens from the documents' labels, fits the field to them, then the document weights to its marginals.

    A token of a toxic document is labelled toxic if a feature of it stands in at least SEEN toxic documents and is ODDS times as
    frequent there as in the others.
    """
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    w, f = features(raw, offsets)
    size, n = 1 << FEATURE_BITS, [max(1, int((toxic == k).sum())) for k in (0, 1)]
    count = np.zeros((2, size))
    for i, (a, b) in enumerate(zip(w.first, w.first[1:], strict=False)):
        count[toxic[i], np.unique(f[a:b])] += 1
    strong = (count[1] >= SEEN) & (count[1] / n[1] >= ODDS * (count[0] + 0.3) / n[0])
    tag = (strong[f].any(1) & (toxic[w.doc] == 1)).astype(float)
    cell, row_doc = chains(w)
    emission, transition = np.zeros(size), np.zeros((2, 2))
    gain_e, gain_t = np.full(size, 1e-3), np.full((2, 2), 1e-3)
    base = np.log((tag.sum() + 1) / (len(tag) + 2))
    emission_bias = np.full(1, base)
    gain_b = np.full(1, 1e-3)
    same = w.doc[1:] == w.doc[:-1]
    observed = np.zeros((2, 2))
    np.add.at(observed, (tag[:-1][same].astype(int), tag[1:][same].astype(int)), 1)
    for _ in range(EPOCHS):
        p, pairs = marginals(emission[f].sum(1) + emission_bias[0], transition, cell, row_doc)
        miss = tag - p
        g = np.bincount(f.reshape(-1), weights=np.repeat(miss, f.shape[1]), minlength=size) - 0.02 * emission
        gain_e += g * g
        emission += 0.7 * g / np.sqrt(gain_e)
        g = observed - pairs - 0.1 * transition
        gain_t += g * g
        transition += 0.3 * g / np.sqrt(gain_t)
        g = np.array([miss.sum()])
        gain_b += g * g
        emission_bias += 0.3 * g / np.sqrt(gain_b)
    emission[:] += emission_bias[0] / f.shape[1]
    p, _ = marginals(emission[f].sum(1), transition, cell, row_doc)
    x, y = aggregates(w, p, len(texts)), toxic.astype(float)
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(weights))
        weights += np.linalg.solve(hessian, x.T @ (y - q) - 0.5 * weights)
    return Model(emission.astype(np.float32), transition, weights)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents of at most SAMPLE_CHARS characters, the first by a hash."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = []
    for value, limit in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        picked = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        rows += texts.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").select("text", "toxic").limit(limit).collect()
    if len({r.toxic for r in rows}) < 2:
        return None
    return fit([r.text for r in rows], np.array([r.toxic for r in rows]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, spans for each row of docs (doc_id, text).

    spans has the (start, end) byte offsets in the UTF-8 text of maximal runs of words whose marginal is at least SPAN. A null or
    empty text, and any text if there is no model, has no spans; its score is that of no marginals. Repeated rows are scored
    alike.
    """
    kind = "array<struct<start:long,end:long>>"

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            out, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for a, b in chunks(offsets) if model else ():
                w, f = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cell, row_doc = chains(w)
                p = marginals(model.emission[f].sum(1), model.transition, cell, row_doc)[0] if len(row_doc) else np.zeros(0)
                z = aggregates(w, p, b - a) @ model.document
                out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                last = -2
                for i in np.flatnonzero(p >= SPAN).tolist():
                    doc, at = a + int(w.doc[i]), int(offsets[a + w.doc[i]] - offsets[a])
                    if i == last + 1 and i and w.doc[i] == w.doc[i - 1]:
                        spans[doc][-1]["end"] = int(w.end[i]) - at
                    else:
                        spans[doc].append({"start": int(w.start[i]) - at, "end": int(w.end[i]) - at})
                    last = i
            types = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(spans, types)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tag, f"doc_id long, score double, spans {kind}")


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: labels count only where their document is not held out."""
    model = train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

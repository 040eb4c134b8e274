"""Language identification by a byte convolutional network, trained in numpy on a bounded sample of labelled windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.text import chunks, text_bytes

WINDOW, WIDTHS, FILTERS, DEPTH = 192, (2, 3, 4, 5), 12, 8
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES, EPOCHS, BATCH, RATE = 600, 1536, 6, 64, 4e-3
UNKNOWN = "und"


class ByteNet:
    """Byte embedding, filters of several widths, the largest response over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"e": rng.normal(0, 0.5, (257, DEPTH)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * DEPTH), (w * DEPTH, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def pooled(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        emb = self.p["e"][x]
        n, length, _ = emb.shape
        flat, parts, kept = emb.reshape(n, length * DEPTH), [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.as_strided(flat, (n, length - w + 1, w * DEPTH), (flat.strides[0], DEPTH * flat.itemsize, flat.itemsize))
            out = np.matmul(view, self.p[f"f{w}"])
            if keep:
                best = out.argmax(1)
                kept.append(best)
                out = np.take_along_axis(out, best[:, None], 1)[:, 0]
            else:
                out = out.max(1)
            parts.append(np.maximum(out + self.p[f"b{w}"], 0))
        return np.concatenate(parts, 1), kept

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x)[0] @ self.p["o"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        h, best = self.pooled(x, keep=True)
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z *= (weight / len(y))[:, None]
        g = {"o": h.T @ z, "c": z.sum(0), "e": np.zeros_like(self.p["e"])}
        dh = (z @ self.p["o"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            places = x[np.arange(len(x))[:, None, None], best[i][:, :, None] + np.arange(w)]
            seen = self.p["e"][places].reshape(len(x), FILTERS, w * DEPTH)
            g[f"f{w}"], g[f"b{w}"] = np.einsum("nfd,nf->df", seen, d), d.sum(0)
            back = d[:, :, None] * self.p[f"f{w}"].T[None]
            np.add.at(g["e"], places.reshape(-1), back.reshape(-1, DEPTH))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> ByteNet:
        rng = np.random.default_rng(seed)
        count = np.bincount(y, minlength=len(self.labels))
        weight = (len(y) / np.maximum(count, 1) / len(self.labels))[y].astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, EPOCHS * -(-len(y) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                at = order[a : a + BATCH]
                t += 1
                for k, g in self.gradients(x[at], y[at], weight[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - RATE * (1 - t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of WINDOW bytes of each text, the last one filled up with symbol 256, and the document of each."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    first = np.repeat(offsets[:-1], count) + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    at = first[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][doc][:, None]
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)] if len(raw) else 0, 256).astype(np.int16), doc


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> ByteNet | None:
    """Fits the network on at most SAMPLE_PER_LANGUAGE rows of each language, SAMPLE_BYTES characters from the middle of each.

    docs has text and lang. The rows are different texts with the smallest hashes, so the sample is the same whatever the
    partitions and copies take no room in it. None if no row has a text and a language.
    """
    known = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    # about twice the rows wanted, so that the ranks are of few rows
    share = {lang: int(min(1, 2 * SAMPLE_PER_LANGUAGE / max(n, 1)) * (1 << 30)) for lang, n in sizes.items()}
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    few = known.where(F.pmod(F.col("h"), F.lit(1 << 30)) <= bound).dropDuplicates(["lang", "h"])
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_BYTES) / 2).cast("int")), F.lit(SAMPLE_BYTES))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = few.withColumn("place", place).where(F.col("place") <= SAMPLE_PER_LANGUAGE).select("lang", middle.alias("text"), "h").collect()
    rows.sort(key=lambda r: (r.lang, r.h))
    languages = sorted(sizes)
    if not rows:
        return None
    raw, offsets = text_bytes(pa.array([r.text for r in rows], pa.string()))
    x, doc = windows(raw, offsets)
    y = np.array([languages.index(r.lang) for r in rows])[doc]
    return ByteNet(languages).train(x, y)


def identify(docs: DataFrame, net: ByteNet | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns to keep for each row of docs (doc_id, text): the mean log probability over all windows of the text decides.

    score is the share of the winner among the languages. A null text and one without a letter are "und" with score 0, as is every
    text if there is no network. Repeated rows give repeated rows.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw, offsets = text_bytes(batch.column(1))
            best, score = np.zeros(n, int), np.zeros(n)
            letters = np.asarray(batch.column(2), bool) if n else np.zeros(0, bool)
            if net:
                for a, b in chunks(offsets, 256 << 10):
                    x, doc = windows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if not len(x):
                        continue
                    each = np.concatenate([net.log_probabilities(x[k : k + 64]) for k in range(0, len(x), 64)])
                    z = np.zeros((b - a, len(net.labels)))
                    np.add.at(z, doc, each)
                    z /= np.maximum(np.bincount(doc, minlength=b - a), 1)[:, None]
                    p = np.exp(z - z.max(1, keepdims=True))
                    best[a:b], score[a:b] = z.argmax(1), (p / p.sum(1, keepdims=True)).max(1)
            names = np.array([*(net.labels if net else []), UNKNOWN], object)
            best = np.where(letters & bool(net), best, len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.where(letters & bool(net), score, 0.0)), *(batch.column(k) for k in keep)], ["doc_id", "lang_pred", "score", *keep])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), "text", letters.alias("letters"), *(k for k in keep if k != "text"))
    kept = "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(predict, f"doc_id long, lang_pred string, score double{kept}")


def run(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns to keep: trained on the rows of docs that are not held out."""
    net = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs, net, keep).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *keep)

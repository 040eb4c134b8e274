"""Near-duplicate embeddings by an inverted multi-index: product codebooks, multi-sequence traversal, exact verification."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import components, materialise

THRESHOLD, RECALL, SAMPLE, PER_CELL, BLOCK = 0.98, 0.995, 8192, 16, 256


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(1)
        total, count = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(total, near, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]


def codebooks(sample: np.ndarray, cells: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """A codebook for each half of unit vectors, and how much farther than the nearest cell a query has to look.

    That radius is the RECALL quantile of the excess (squared distance over that of the nearest cell) of the home cells of
    vectors at exactly THRESHOLD from sampled ones, the hardest that have to be found.
    """
    rng, half = np.random.default_rng(seed), sample.shape[1] // 2
    k = int(max(2, round(np.sqrt(cells))))
    left, right = _kmeans(sample[:, :half], k, rng), _kmeans(sample[:, half:], k, rng)
    base = sample[rng.choice(len(sample), 4096)]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    other = THRESHOLD * base + np.sqrt(1 - THRESHOLD**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    excess = np.zeros(len(base))
    for part, book in ((slice(0, half), left), (slice(half, None), right)):
        d, home = _distances(base[:, part], book), _distances(other[:, part], book).argmin(1)
        excess += d[np.arange(len(base)), home] - d.min(1)
    return left, right, float(np.quantile(excess, RECALL))


def traverse(excess: tuple[np.ndarray, np.ndarray], radius: float) -> Iterator[tuple[int, int]]:
    """Cells of the product grid from the nearest one up to the radius: the multi-sequence algorithm over two sorted lists.

    A heap holds the next cells: a cell goes in once both cells before it, along either list, have been visited.
    """
    first, second = (np.flatnonzero(x <= radius) for x in excess)
    first, second = first[np.argsort(excess[0][first], kind="stable")], second[np.argsort(excess[1][second], kind="stable")]
    a, b = excess[0][first].tolist(), excess[1][second].tolist()
    heap, seen = [(a[0] + b[0], 0, 0)] if a and b else [], set()
    while heap and heap[0][0] <= radius:
        _, i, j = heapq.heappop(heap)
        seen.add((i, j))
        yield int(first[i]), int(second[j])
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in seen):
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in seen):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is scaled to 1 first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and not null and the cosine is at least the threshold. Null or zero vectors, vectors with
    null or non-finite components and rows without a label link with nothing; nor do vectors of different lengths. Equal vectors
    are one node of the index and count as links of each other. A pair of different vectors is looked for once, by the one with
    the smaller vec_id in the home cell of the other. Cells of more than BLOCK rows are dealt into blocks, each pair of blocks
    to a group of its own, and a group returns counts and a spanning forest, never its pairs.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    keyed = base.withColumn("valid", valid).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    real = keyed.where("valid")
    nodes = materialise(real.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    sizes = nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()
    found = None
    for row in sorted(sizes, key=lambda r: r.dim):
        part = _linked(nodes.where(F.size("v") == row.dim), row.dim, row.n, row.labels, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node long, other long, links long")
    found = materialise(found, "links")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_node = nodes.select("label", "k1", "k2", "node", "copies").join(links, "node", "left").join(classes, "node", "left")
    of_node = of_node.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = real.select("vec_id", "label", "k1", "k2").join(of_node, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(nodes: DataFrame, dim: int, n: int, labels: int, threshold: float) -> DataFrame:
    """Rows (node, null, links) to be summed, and rows (node, other, 0): edges of spanning forests."""
    cells, h = n / labels / PER_CELL, F.xxhash64("k1", F.lit(3))
    # about twice the sample passes the bound, so that few vectors go to the driver from however many partitions
    few = nodes.where(F.pmod(h, F.lit(1 << 30)) <= int(min(1, 2 * SAMPLE / n) * (1 << 30)))
    picked = few.select("v").orderBy(h, "node").limit(SAMPLE).collect()
    sample = _unit(np.array([r.v for r in picked], float))
    if dim == 1:
        sample = np.hstack([sample, np.zeros_like(sample)])
    left, right, radius = codebooks(sample, cells)
    half = sample.shape[1] // 2

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(np.asarray(batch.column(3).flatten(), float).reshape(batch.num_rows, dim))
            padded = np.hstack([unit, np.zeros_like(unit)]) if dim == 1 else unit
            excess = [_distances(padded[:, :half], left), _distances(padded[:, half:], right)]
            home = excess[0].argmin(1) * len(right) + excess[1].argmin(1)
            excess = [x - x.min(1, keepdims=True) for x in excess]
            rows, cell = [np.arange(batch.num_rows)], [home]
            for i in range(batch.num_rows):
                visited = [a * len(right) + b for a, b in traverse((excess[0][i], excess[1][i]), radius)]
                rows.append(np.full(len(visited), i))
                cell.append(np.array(visited, np.int64))
            query = np.arange(sum(map(len, rows))) >= batch.num_rows
            at = pa.array(np.concatenate(rows))
            taken = batch.take(at)
            yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(np.concatenate(cell).astype(np.int64)), pa.array(query), *taken.columns[1:]], ["label", "cell", "query", "node", "copies", "v"])

    placed = materialise(nodes.select("label", "node", "copies", "v").mapInArrow(cells_of, "label string, cell long, query boolean, node long, copies long, v array<double>"), "cells")
    counts = placed.groupBy("label", "cell").agg(F.count_if("query").alias("queries"), F.count_if(~F.col("query")).alias("data")).where("data > 0")
    blocks = counts.select("label", "cell", F.ceil(F.col("queries") / BLOCK).cast("int").alias("q"), F.ceil(F.col("data") / BLOCK).cast("int").alias("d"))
    dealt = placed.join(blocks, ["label", "cell"])
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("query"), F.col("q")).otherwise(F.col("d"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.greatest(F.when(F.col("query"), F.col("d")).otherwise(F.col("q")), F.lit(1)) - 1))
    dealt = dealt.withColumn("own", own).withColumn("every", every)
    dealt = dealt.select("label", "cell", F.when(F.col("query"), F.col("own")).otherwise(F.col("every")).alias("qb"), F.when(F.col("query"), F.col("every")).otherwise(F.col("own")).alias("db"), "query", "node", "copies", "v")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        query, data = group[group["query"]], group[~group["query"]]
        nothing = pd.DataFrame({"node": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="Int64"), "links": pd.Series([], dtype="int64")})
        if query.empty or data.empty:
            return nothing
        cosine = _unit(np.stack(query["v"].to_list())) @ _unit(np.stack(data["v"].to_list())).T
        qn, dn = query["node"].to_numpy(), data["node"].to_numpy()
        i, j = np.nonzero((cosine >= threshold) & (qn[:, None] < dn[None]))
        if not len(i):
            return nothing
        one = np.concatenate([qn[i], dn[j]])
        weight = np.concatenate([data["copies"].to_numpy()[j], query["copies"].to_numpy()[i]])
        ids, at = np.unique(one, return_inverse=True)
        total = np.bincount(at, weights=weight).astype(np.int64)
        parent = {x: x for x in ids.tolist()}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        forest = []
        for x, y in zip(qn[i].tolist(), dn[j].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                forest.append((x, y))
        edges = np.array(forest, np.int64)
        return pd.DataFrame({"node": np.concatenate([ids, edges[:, 0]]), "other": pd.array([*[None] * len(ids), *edges[:, 1]], dtype="Int64"), "links": np.concatenate([total, np.zeros(len(edges), np.int64)])})

    return dealt.groupBy("label", "cell", "qb", "db").applyInPandas(verify, "node long, other long, links long")

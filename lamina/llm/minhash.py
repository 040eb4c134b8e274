"""Near-duplicate documents: BagMinHash signatures of word-shingle multisets, bands, and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import components, materialise, small_batches
from lamina.llm.text import chunks, mix, shingles, text_bytes, words

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
# A pair whose signatures agree this much less often than the threshold is not compared: four standard deviations of the estimate.
SLACK = 4 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
BLOCK = 512


def multiset(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts. doc is ascending."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return doc[at], shingle[at], np.diff(np.append(at, len(doc)))


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Signatures whose registers agree with a probability of the weighted Jaccard similarity.

    Weights are discretised at the whole numbers. The levels [0, 1), [1, 2), [2, 4), [4, 8), ... of an element each have a Poisson
    process of their width as rate; a point falls on a random level and register, and counts for weights above its level. So
    documents that share an element share the points below the smaller weight. A process ends once its time passes the largest
    register of its document; points beyond it can't change the signature. Documents without elements have inf everywhere.
    """
    h = np.full((n_docs, size), np.inf)
    at, low, width = [np.arange(len(doc))], [np.zeros(len(doc), np.int64)], [np.ones(len(doc), np.int64)]
    step = 1
    while (over := np.flatnonzero(weight > step)).size:
        at, low, width = [*at, over], [*low, np.full(len(over), step)], [*width, np.full(len(over), step)]
        step *= 2
    at, low, width = np.concatenate(at), np.concatenate(low), np.concatenate(width)
    d, limit = doc[at], weight[at]
    seed = mix(element[at] ^ mix(low.astype(np.uint64) + np.uint64(0x51ED27)))
    time, point = np.zeros(len(at)), 0
    while len(d):
        many = 1 if len(d) > 20_000 else 4 if len(d) > 2_000 else 24
        for _ in range(many):
            bits = mix(seed + np.uint64(point * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
            bits = mix(bits + np.uint64(0xA24BAED4963EE407))
            register = (bits >> np.uint64(32)).astype(np.int64) * size >> 32
            level = low + ((bits & np.uint64(0xFFFFFFFF)).astype(np.int64) * width >> 32)
            counts = level < limit
            np.minimum.at(h.reshape(-1), (d * size + register)[counts], time[counts])
            point += 1
        going = time < h.max(1)[d]
        d, limit, seed, time, low, width = (x[going] for x in (d, limit, seed, time, low, width))
    return h


def row_hash() -> Column:
    """Tells rows of different ids or texts apart; one id may stand in rows of several texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), n_words, k1 and k2 (hashes of the words), bands (empty without words), sketch (16 bits of each register)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                w = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = b - a
                count = np.diff(w.first)
                keys = np.zeros((2, n), np.uint64)
                place = np.arange(len(w.doc), dtype=np.uint64) - w.first[w.doc].astype(np.uint64)
                for k in range(2):
                    np.add.at(keys[k], w.doc, mix(w.hash + mix(place * np.uint64(2) + np.uint64(k + 1))))
                d, s, c = multiset(*shingles(w, SHINGLE))
                h = bag_minhash(d, s, c, n, BANDS * ROWS).view(np.uint64).reshape(n, BANDS, ROWS)
                band = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(0xD6E8FEB86659FD93) + h[:, :, r])
                band += np.arange(BANDS, dtype=np.uint64)
                has = np.flatnonzero(count)
                sketch = [x.tobytes() for x in mix(h.reshape(n, -1)).astype("<u2")]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, BANDS, 0))]).astype(np.int32)), pa.array(mix(band[has].reshape(-1)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(count.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists, pa.array(sketch, pa.binary())], ["doc_id", "row", "n_words", "k1", "k2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", row_hash()).mapInArrow(sign, "doc_id long, row long, n_words long, k1 long, k2 long, bands array<long>, sketch binary")


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule the threshold out."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for i in (2, 3))
            yield batch.filter(pa.array((one == two).mean(1) >= threshold - SLACK)).select(["a", "b"])

    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("one")), "a")
    two = one.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("two")), "b")
    return two.select("a", "b", "one", "two").mapInArrow(agree, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle multisets overlap enough: the sum of the smaller counts over that of the larger ones."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (2, 3):
                raw, offsets = text_bytes(batch.column(column))
                parts = []
                for a, b in chunks(offsets):
                    d, s = shingles(words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), SHINGLE)
                    parts.append((d + a, s))
                d, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                sides.append(multiset(d, s))
            n = batch.num_rows
            total = sum(np.bincount(d, weights=c, minlength=n) for d, _, c in sides)
            d, s, c = (np.concatenate([x, y]) for x, y in zip(*sides, strict=True))
            order = np.lexsort((s, d))
            d, s, c = d[order], s[order], c[order]
            both = np.flatnonzero((d[1:] == d[:-1]) & (s[1:] == s[:-1]))
            common = np.bincount(d[both], weights=np.minimum(c[both], c[both + 1]), minlength=n)
            yield batch.filter(pa.array(common >= threshold * (total - common) - 1e-9)).select(["a", "b"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    held = ends.join(texts, "doc_id").groupBy("a", "b").agg(F.min_by("text", "doc_id").alias("text_a"), F.max_by("text", "doc_id").alias("text_b"))
    return held.mapInArrow(overlap, "a long, b long")


def first_labels(links: DataFrame) -> DataFrame:
    """node, component: a start on the components of the links, one step towards the smallest neighbour of each pivot."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    step = links.join(least.select("a", F.col("m").alias("component")), "a").select(F.col("b").alias("node"), "component")
    own = least.select(F.col("a").alias("node"), F.col("m").alias("component"))
    return step.unionByName(own).groupBy("node").agg(F.min("component").alias("component"))


def leftover(member: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between nodes of different labels that share a bucket: what the pivots left open.

    In each bucket the nodes outside the most frequent label are compared with all others, by signature and then by their shingles.
    Both sides are dealt into blocks of BLOCK, each pair of blocks to a group of its own; a pair is compared in the first
    band that it shares. Texts go only to groups that have a likely pair, and a group returns a spanning forest of its links.
    """
    labelled = member.select("band", "key", "node").join(labels, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("component"))
    spread = labelled.groupBy("band", "key", "component").agg(F.count("*").alias("m"))
    mixed = spread.groupBy("band", "key").agg(F.sum("m").alias("n"), F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most")).where("n > most")
    mixed = mixed.select("band", "key", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("q"), F.ceil(F.col("n") / BLOCK).cast("int").alias("d"))
    open_ = labelled.join(mixed, ["band", "key"]).withColumn("minor", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("node", F.lit(13)), F.lit(1 << 30))
    roles = F.when(F.col("minor"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    dealt = open_.withColumn("query", F.explode(roles)).withColumn("every", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("d")).otherwise(F.col("q")) - 1)))
    dealt = dealt.select("band", "key", F.when(F.col("query"), (own % F.col("q")).cast("int")).otherwise(F.col("every")).alias("qb"), F.when(F.col("query"), F.col("every")).otherwise((own % F.col("d")).cast("int")).alias("db"), "query", "minor", "node", "component")
    columns = ["band", "key", "qb", "db", "query", "minor", "node", "component", "bands", "sketch"]
    dealt = dealt.join(nodes.select("node", "bands", "sketch"), "node").select(*columns)
    keys = ["band", "key", "qb", "db"]

    def near(group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows of queries with the rows of their likely partners and the estimates, best first."""
        query, minor = (np.asarray(group.column(i)) for i in (4, 5))
        node, label = (np.asarray(group.column(i)) for i in (6, 7))
        bands = np.asarray(group.column(8).combine_chunks().flatten()).reshape(-1, BANDS)
        sketch = np.frombuffer(b"".join(group.column(9).to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
        band, d = group.column(0)[0].as_py(), np.flatnonzero(~query)
        for i in np.flatnonzero(query).tolist():
            at = d[(label[d] != label[i]) & (~minor[d] | (node[d] > node[i]))]
            share = (sketch[at] == sketch[i]).mean(1)
            keep = (share >= threshold - SLACK) & ((bands[at] == bands[i]).argmax(1) == band)
            order = np.argsort(-share[keep], kind="stable")
            if len(order):
                yield i, at[keep][order], share[keep][order]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            used = np.zeros(group.num_rows, bool)
            for i, at, _ in near(group):
                used[i] = used[at] = True
            if used.any():
                yield from group.filter(pa.array(used)).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            node, label = (np.asarray(group.column(i)).tolist() for i in (6, 7))
            text = group.column(10)
            bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            parent = {x: x for x in label}

            def top(x: int, parent: dict[int, int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            def bag(i: int, bags: dict = bags, text: pa.ChunkedArray = text, node: list[int] = node) -> tuple[np.ndarray, np.ndarray]:
                if node[i] not in bags:
                    raw, offsets = text_bytes(pa.array([text[i].as_py()], pa.string()))
                    bags[node[i]] = multiset(*shingles(words(raw, offsets), SHINGLE))[1:]
                return bags[node[i]]

            ones, twos = [], []
            for i, at, _ in near(group):
                s, c = bag(i)
                for j in at.tolist():
                    if top(label[i]) == top(label[j]):
                        continue
                    t, e = bag(j)
                    _, x, y = np.intersect1d(s, t, assume_unique=True, return_indices=True)
                    common = int(np.minimum(c[x], e[y]).sum())
                    if common >= threshold * (int(c.sum() + e.sum()) - common) - 1e-9:
                        parent[max(top(label[i]), top(label[j]))] = min(top(label[i]), top(label[j]))
                        ones.append(min(node[i], node[j]))
                        twos.append(max(node[i], node[j]))
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], ["a", "b"])

    def kind(df: DataFrame) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    likely_ = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(screen, kind(dealt))
    held = likely_.join(texts.select(F.col("doc_id").alias("node"), "text"), "node").select(*columns, "text")
    return held.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of one value of the first columns at a time, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, component_id, kept for each row of docs (doc_id, text): classes of near-duplicate documents.

    Documents of equal word sequences are one node. Nodes that share a band are compared through two pivots of the bucket, then, where
    a bucket still holds several classes, with all nodes of the others. So every pair of a bucket ends in one class or has been
    compared. A class's id is its smallest doc_id. A text without words, null and empty ones too, is a class of its own; a
    null doc_id is kept and has no class. Rows of one doc_id and different texts are compared as different documents.
    """
    small_batches(docs.sparkSession)
    signed = materialise(signatures(docs), "signatures")
    real = signed.where("n_words > 0 and doc_id is not null")
    nodes = real.groupBy("k1", "k2", "n_words").agg(F.min(F.struct("doc_id", "row")).alias("one"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes.select("k1", "k2", "n_words", F.col("one.row").alias("node"), F.col("one.doc_id").alias("least"), "bands", "sketch"), "nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("p1"), F.min(F.struct(F.xxhash64("node"), "node")).alias("p2")).where("n > 1").drop("n")
    member = materialise(buckets.join(shared, ["band", "key"]), "buckets")
    texts = docs.where("doc_id is not null").select(row_hash().alias("doc_id"), "text")
    pairs = member.select("node", F.explode(F.array("p1", "p2.node")).alias("pivot")).where("node <> pivot")
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = materialise(verified(likely(pairs, nodes, threshold), texts, threshold), "links")
    labels = materialise(first_labels(links), "labels")
    links = links.unionByName(materialise(leftover(member, labels, nodes, texts, threshold), "leftover"))
    classes = components(links)
    of_node = nodes.select("k1", "k2", "n_words", "node", "least").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = of_node.join(ids, "component").select("k1", "k2", "n_words", "component_id")
    out = real.select("doc_id", "n_words", "k1", "k2").join(of_node, ["k1", "k2", "n_words"]).select("doc_id", "n_words", "component_id")
    alone = signed.where("n_words = 0 or doc_id is null").select("doc_id", "n_words", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", "n_words", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Packing of tokenised documents into sequences by a linear grouping scheme.

The lengths' histogram (at most one row per length) goes to the driver, which plans runs of equal sequences; the pieces
themselves stay on the executors and look their place up by length and rank.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialise

END_ID = 2
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LARGE, GROUPS, SHARDS, SHARD_ROWS, SPACES = 8, 96, 256, 100_000, 1000


@cache
def encoder(path: str):
    """The encode function of a byte-level BPE file of the tokenizers library, without special tokens added around a text.

    A rank table read from the same file gives the same ids several times as fast. It isn't used for texts that hold an added token
    or a run of SPACES white-space characters, on which its pattern would need too deep a stack.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # the printable stand-ins of bytes in such files: themselves where they are printable, else the next ones from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte[c] for c in token): number for token, number in tokenizer.get_vocab(with_added_tokens=False).items()}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    odd = re.compile("|".join([rf"\s{{{SPACES}}}", *map(re.escape, added)]))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids if odd.search(text) else fast(text)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only the first piece of a longer document may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                head = (len(ids) - 1) % capacity + 1
                for k, (a, b) in enumerate([(0, head), *((x, x + capacity) for x in range(head, len(ids), capacity))]):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole multiples of configurations of a few sizes, from the linear programme solved by generating its columns."""
    k = len(sizes)
    size, demand = np.array(sizes), np.array(counts, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, back = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            fits = np.flatnonzero(size <= c)
            value = best[c - size[fits]] + price[fits]
            j = int(value.argmax())
            best[c], back[c] = (value[j], fits[j]) if value[j] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if back[c] < 0:
                c -= 1
            else:
                column[back[c]] += 1
                c -= sizes[back[c]]
        used, now = np.linalg.solve(basis, column), np.linalg.solve(basis, demand)
        ratio = np.where(used > 1e-9, np.maximum(now, 0) / np.where(used > 1e-9, used, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.linalg.solve(basis, demand)
    return [({int(i): int(basis[i, j]) for i in np.flatnonzero(basis[:, j])}, int(times[j] + 1e-9)) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences.

    Lengths above capacity / LARGE are dealt into GROUPS groups of equal cardinality and rounded up to the largest of their
    group; the configurations for these few sizes are filled with the actual lengths. What rounding leaves over and the small
    lengths go where they fit best, run by run. The plan's size depends on the capacity, not on the number of documents.
    """
    rank: dict[int, int] = defaultdict(int)
    left = {n: c for n, c in histogram.items() if c}
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left over: runs of sequences (first, count)
    rooms: list[int] = []
    sequences = 0

    def put(length: int, count: int, first: int, room: int) -> None:
        runs.append((length, rank[length], count, first, capacity - room))
        rank[length] += count
        left[length] -= count

    def keep(room: int, first: int, count: int) -> None:
        if room:
            if not free[room]:
                insort(rooms, room)
            free[room].append((first, count))

    large = sorted((n for n in left if n * LARGE > capacity and n < capacity), reverse=True)
    total = sum(left[n] for n in large)
    members: list[list[list[int]]] = []
    for n in large:
        rest = left[n]
        while rest:
            if not members or sum(c for _, c in members[-1]) >= -(-total // GROUPS):
                members.append([])
            take = min(rest, -(-total // GROUPS) - sum(c for _, c in members[-1]))
            members[-1].append([n, take])
            rest -= take
    if members:
        sizes = [m[0][0] for m in members]
        for slots, times in _configurations(sizes, [sum(c for _, c in m) for m in members], capacity):
            groups = [g for g, c in slots.items() for _ in range(c)]
            while times:
                need: dict[int, int] = defaultdict(int)
                for g in groups:
                    need[g] += 1
                m = min([times, *(members[g][0][1] // c for g, c in need.items() if members[g])])
                if any(not members[g] for g in groups):
                    break
                taken: list[int] = []
                if m:
                    for g in groups:
                        taken.append(members[g][0][0])
                        members[g][0][1] -= m
                else:  # a length runs out within one sequence
                    m = 1
                    for g in groups:
                        while members[g] and not members[g][0][1]:
                            members[g].pop(0)
                        if members[g]:
                            taken.append(members[g][0][0])
                            members[g][0][1] -= 1
                for g in need:
                    while members[g] and not members[g][0][1]:
                        members[g].pop(0)
                room = capacity
                for n in taken:
                    put(n, m, sequences, room)
                    room -= n
                keep(room, sequences, m)
                sequences += m
                times -= m
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                m, per = left[n], capacity // n  # new sequences hold as many of this length as they can
                full = max(1, m // per)
                for k in range(min(per, m)):
                    put(n, full, sequences, capacity - k * n)
                keep(capacity - min(per, m) * n, sequences, full)
                sequences += full
                continue
            room = rooms[at]
            first, count = free[room].pop()
            m = min(count, left[n])
            if count > m:
                free[room].append((first + m, count - m))
            if not free[room]:
                rooms.pop(at)
            put(n, m, first, room)
            keep(room - n, first, m)
    return runs, sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """Packs all documents (doc_id, text; null text is empty) into as few sequences of at most capacity tokens as it can.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Each document ends with END_ID, so
    an empty text is one token. Repeated rows are packed once each; a null doc_id stays null; an empty table gives no rows.
    """
    cut = materialise(pieces(docs, tokenizer_path, capacity), "pieces")
    total = cut.count()
    shards = int(min(4096, max(SHARDS, total // SHARD_ROWS)))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    counts = cut.groupBy("length", "shard").agg(F.count("*").alias("n"))
    counts = materialise(counts, "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "shard").orderBy("doc_id", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = np.int64(total + 1)
        keys = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(keys, length * stride + rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table[at, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

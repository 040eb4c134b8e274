"""Product codes of vectors in whole numbers: codebooks by rounds of nearest entries, distances from per-dimension dictionaries.

A batch lists the distinct integers of each dimension and tabulates their squared differences to all codebook entries; the distances of
a part are then gathers and sums over the dictionary codes of its dimensions. Every figure is an integer, so results don't depend on
how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lamina.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Integers are held within this bound so that all sums of squares fit 64 bits; it is reached by components beyond 65536 only.
BOUND = 1 << 26
BLOCK = 1024


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ints (floor of SCALE times each component) of the vectors that have only finite components.

    Vectors that are null or empty, or whose length can't be cut into PARTS, are left out, and so are those of another length than
    the first one by (vec_id, ints).
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.when(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0), finite).otherwise(False)
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int"))
    kept = materialise(vectors.where(good).select("vec_id", "label", whole.alias("ints")), "ints")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "ints").select(F.size("ints").alias("n")).limit(1).collect()
    return kept.where(F.size("ints") == first[0].n) if first else kept


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book for each row (the smaller index on ties) and the squared distance."""
    reach = int(np.abs(rows).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.int32 if reach * reach * rows.shape[1] < 1 << 31 else np.int64
    codes, tables = [], []
    for d in range(rows.shape[1]):
        values, code = np.unique(rows[:, d], return_inverse=True)
        difference = values.astype(np.int64)[:, None] - book[None, :, d]
        codes.append(code)
        tables.append((difference * difference).astype(kind))
    index, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for at in range(0, len(rows), BLOCK):
        part = slice(at, at + BLOCK)
        total = tables[0][codes[0][part]]
        for table, code in zip(tables[1:], codes[1:], strict=True):
            total += table[code[part]]
        index[part] = total.argmin(1)
        error[part] = np.take_along_axis(total, index[part, None], 1)[:, 0]
    return index, error


def _parts(column: pa.Array, dims: int) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    return np.split(flat, PARTS, axis=1)


def _sums(books: list[np.ndarray], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((PARTS, len(books[0]), dims // PARTS), np.int64)
        for batch in batches:
            for p, rows in enumerate(_parts(batch.column(0), dims)):
                if len(rows):
                    index, _ = nearest(rows, books[p])
                    order = np.argsort(index, kind="stable")
                    present, start = np.unique(index[order], return_index=True)
                    total[p, present] += np.add.reduceat(rows[order], start, axis=0)
                    count[p] += np.bincount(index, minlength=len(books[0]))
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [nearest(rows, books[p]) for p, rows in enumerate(_parts(batch.column(2), dims))]
                code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def train(ints: DataFrame) -> list[np.ndarray]:
    """The PARTS codebooks (entries x dimensions) after ROUNDS rounds over all rows; empty books if there are no rows.

    Only the ENTRIES first rows and the sums of each entry reach the driver.
    """
    seeds = np.array([r.ints for r in ints.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(ENTRIES).collect()], np.int64)
    if not len(seeds):
        return [np.zeros((0, 0), np.int64)] * PARTS
    books = np.split(seeds, PARTS, axis=1)
    dims = seeds.shape[1]
    for _ in range(ROUNDS):
        sums = ints.select("ints").mapInArrow(_sums(books, dims), "part int, entry int, n long, sums array<long>")
        total = sums.select("part", "entry", "n", F.posexplode("sums").alias("d", "s")).groupBy("part", "entry", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in total.collect():
            books[r.part][r.entry, r.d] = r.s // r.n
    return books


def fingerprint(books: list[np.ndarray]) -> str:
    """sha256 of all entries' integers by part, entry and dimension, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (PARTS bytes) and error for each kept row of vectors (vec_id, embedding, label), and the codebooks.

    Kept is what integers() keeps. Rows of one vec_id are all coded; where they take part in the first books they are ordered by their
    integers, and rows without a vec_id come last. With fewer rows than ENTRIES the books are as short. Other columns are ignored.
    """
    ints = integers(vectors)
    books = train(ints)
    schema = StructType([ints.schema["vec_id"], ints.schema["label"], StructField("code", BinaryType()), StructField("error", LongType())])
    return materialise(ints.mapInArrow(_codes(books, sum(b.shape[1] for b in books)), schema), "codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows of the same label; rows without a label are together."""
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def compress_sql() -> str:
    """The same in SQL; a round is a join of all parts with all entries."""
    ctes = [
        "kept as (select vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::double)::bigint) as ints from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        "parts as (select vec_id, p, ints[p * len(ints) // 4 + 1 : (p + 1) * len(ints) // 4] as v from kept, (select unnest(range(4)) as p))",
        "book0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from parts qualify e < 256)",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"near{k} as materialized (select a.vec_id, a.p, any_value(a.v) as v, min({{'d': list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': b.e}}) as best from parts a join book{k} b using (p) group by a.vec_id, a.p)")
        if k < ROUNDS:
            ctes.append(f"sum{k} as (select p, e, list(m order by i) as v from (select p, e, i, floor_div(sum(x)::bigint, count(*)) as m from (select p, best.e as e, unnest(v) as x, generate_subscripts(v, 1) as i from near{k}) group by all) group by p, e)")
            ctes.append(f"book{k + 1} as materialized (select p, e, coalesce(s.v, b.v) as v from book{k} b left join sum{k} s using (p, e))")
    last = f"near{ROUNDS}"
    text = "\n, ".join(ctes).replace("floor_div(sum(x)::bigint, count(*))", "((sum(x)::bigint - ((sum(x)::bigint % count(*)) + count(*)) % count(*)) // count(*))")
    return f"""with {text}
, coded as (select vec_id, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from {last} group by 1)
, sha as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS})
select c.vec_id, code, error, (sum(error) over (partition by k.label))::bigint as label_error, codebooks_sha256 from coded c join kept k using (vec_id), sha"""

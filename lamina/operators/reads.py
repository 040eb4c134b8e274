"""Reads of a chunked volume: windows with fill beyond what is stored, values at listed points; distances of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.sources.shared import materialise

CELL = ["z", "y", "x"]
BOUNDS = ["z0", "z1", "y0", "y1", "x0", "x1"]


def read_points(chunks: DataFrame, points: DataFrame, size: int, fill: float) -> DataFrame:
    """points (any columns, z, y, x) with value: what the chunk payloads have there, fill where nothing is stored or known.

    chunks has cz, cy, cx and values (size ** 3 of them in row-major order, null where unknown). Points meet chunks by chunk, so each payload is
    read once whatever the number of its points is; a point with a null place has fill too. Repeated points stay.
    """
    place = ((F.col("z") % size) * size + F.col("y") % size) * size + F.col("x") % size
    keyed = points.withColumns({f"_c{c}": F.floor(F.col(c) / size).cast("int") for c in CELL} | {"_at": F.when((F.col("z") >= 0) & (F.col("y") >= 0) & (F.col("x") >= 0), place).cast("int")})
    stored = chunks.select(*[F.col(f"c{c}").alias(f"_c{c}") for c in CELL], F.col("values").alias("_values"))
    joined = keyed.join(stored, [f"_c{c}" for c in CELL], "left")
    return joined.select(*points.columns, F.coalesce(F.try_element_at("_values", F.col("_at") + 1), F.lit(fill)).alias("value"))


def read_windows(chunks: DataFrame, boxes: DataFrame, key: str, size: int, fill: float) -> DataFrame:
    """key, shape and values (row-major) of each half-open box z0, z1, y0, y1, x0, x1; fill where nothing is stored or known.

    A box asks for the chunks that it meets and gets only the cells of each that it needs; boxes are put together batch by batch, so one of
    them is held at least. Boxes may reach outside the volume and overlap. Boxes with a null, or without extent along an axis, give an empty array.
    """
    kind = boxes.schema[key].dataType.simpleString()
    number = chunks.schema["values"].dataType.elementType.simpleString()
    valid = F.lit(True)
    for c in CELL:
        valid = valid & (F.col(f"{c}0") < F.col(f"{c}1"))
    reach = boxes.select(key, *BOUNDS).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    for c in CELL:
        span = F.sequence(F.floor(F.col(f"{c}0") / size).cast("int"), F.floor((F.col(f"{c}1") - 1) / size).cast("int"))
        reach = reach.select("*", F.explode(F.when(F.col("_valid"), span).otherwise(F.array(F.lit(0)))).alias(f"c{c}"))
    # Chunks that no box meets stay out of the join: where few are asked for by many boxes, they are sent to the boxes.
    place = ["cz", "cy", "cx"]
    stored = chunks.select(*place, "values").join(reach.where("_valid").select(*place).distinct(), place, "left_semi")
    joined = reach.join(stored, place, "left")
    for c in CELL:
        joined = joined.withColumns({f"_{c}0": F.greatest(F.col(f"{c}0") - F.col(f"c{c}") * size, F.lit(0)).cast("int"), f"_{c}1": F.least(F.col(f"{c}1") - F.col(f"c{c}") * size, F.lit(size)).cast("int")})
    rows = lambda z: F.flatten(F.transform(F.sequence(F.col("_y0"), F.col("_y1") - 1), lambda y: F.slice("values", (z * size + y) * size + F.col("_x0") + 1, F.col("_x1") - F.col("_x0"))))
    part = F.when(F.col("_valid") & F.col("values").isNotNull(), F.flatten(F.transform(F.sequence(F.col("_z0"), F.col("_z1") - 1), rows)))
    parts = joined.select(key, "_valid", *[F.col(b).cast("long").alias(b) for b in BOUNDS], *place, part.alias("part"))

    def numbered(table: pa.Table) -> np.ndarray:
        """Number of the box of each row: rows of one key and the same bounds stand together."""
        new = np.diff(table.column(key).combine_chunks().dictionary_encode("encode").indices.to_numpy()) != 0
        for b in BOUNDS:
            new |= np.diff(table.column(b).fill_null(0).to_numpy()) != 0
        return np.r_[0, np.cumsum(new)]

    def put_together(table: pa.Table, box: np.ndarray) -> pa.RecordBatch:
        """One row for each box; every known value of a part goes to its cell of the box."""
        first = np.flatnonzero(np.r_[True, np.diff(box) != 0])
        bounds = {b: table.column(b).fill_null(0).to_numpy() for b in BOUNDS}
        whole = table.column("_valid").to_numpy(zero_copy_only=False).astype(bool)[first]
        shape = np.stack([np.where(whole, bounds[f"{c}1"][first] - bounds[f"{c}0"][first], 0) for c in CELL])
        starts = np.r_[0, np.cumsum(shape.prod(0))]
        out = np.full(starts[-1], fill, float)
        lists = table.column("part").combine_chunks()
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        left = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = starts[box[row]]
        low = {c: np.maximum(bounds[f"{c}0"], table.column(f"c{c}").to_numpy() * size) for c in CELL}
        wide = {c: np.minimum(bounds[f"{c}1"], (table.column(f"c{c}").to_numpy() + 1) * size) - low[c] for c in CELL}
        stride = {"z": shape[1] * shape[2], "y": shape[2], "x": np.ones_like(shape[2])}
        for c in reversed(CELL):
            at = at + (left % wide[c][row] + (low[c] - bounds[f"{c}0"])[row]) * stride[c][box[row]]
            left = left // wide[c][row]
        known = ~np.isnan(values)
        out[at[known]] = values[known]
        arrays = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out, pa.float64())).cast(pa.list_(wanted))
        shapes = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * 3, pa.int32()), pa.array(shape.T.ravel(), pa.int32()))
        names = table.column(key).take(pa.array(first))
        return pa.RecordBatch.from_arrays([names.combine_chunks(), shapes, arrays], [key, "shape", "values"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            box = numbered(table)
            # The last box may go on in the next batch.
            n = int(np.searchsorted(box, box[-1]))
            if n:
                yield put_together(table.slice(0, n), box[:n])
                held = table.slice(n).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield put_together(table, numbered(table))

    from pyspark.sql.pandas.types import to_arrow_type

    wanted = to_arrow_type(chunks.schema["values"].dataType.elementType)
    dealt = parts.repartition(key).sortWithinPartitions(key, *BOUNDS)
    return dealt.mapInArrow(fetch, f"`{key}` {kind}, shape array<int>, values array<{number}>")


def _gap(a: str, b: str) -> Column:
    """Distance of two half-open boxes in structs; 0 if they touch or overlap."""
    parts = []
    for c in CELL:
        parts.append(F.greatest(F.col(f"{a}.{c}0") - F.col(f"{b}.{c}1"), F.col(f"{b}.{c}0") - F.col(f"{a}.{c}1"), F.lit(0)))
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


# Others that a box is held against at once when the first touching one is looked for.
BLOCK = 64


def _first_touching(key: str, kind: str, asks: DataFrame, others: DataFrame, apart: bool) -> DataFrame:
    """a and b: for each cell and box a of it the smallest key b of the cell's others that touch or overlap it."""
    cell = [f"g{c}" for c in CELL]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("b")
        mine, theirs = (np.stack([t.column(c).to_numpy() for c in BOUNDS]) for t in (left, right))
        names, keys = (t.column(n).to_numpy(zero_copy_only=False) for t, n in ((left, "a"), (right, "b")))
        found, open_ = np.full(len(names), -1), np.arange(len(names))
        for x in range(0, len(keys) if len(names) else 0, BLOCK):
            some = slice(x, x + BLOCK)
            touch = names[open_][:, None] != keys[some] if apart else np.ones((len(open_), len(keys[some])), bool)
            for low, high in ((0, 1), (2, 3), (4, 5)):
                touch &= (mine[low][open_][:, None] <= theirs[high][some]) & (theirs[low][some] <= mine[high][open_][:, None])
            hit = touch.any(1)
            found[open_[hit]] = x + touch[hit].argmax(1)
            open_ = open_[~hit]
            if not len(open_):
                break
        at = np.flatnonzero(found >= 0)
        return pa.table({"a": left.column("a").take(pa.array(at)), "b": right.column("b").take(pa.array(found[at]))})

    return asks.groupBy(*cell).cogroup(others.groupBy(*cell)).applyInArrow(run, f"a {kind}, b {kind}")


def nearest_boxes(boxes: DataFrame, others: DataFrame, key: str, reach: float, apart: bool = False) -> DataFrame:
    """key, nearest and distance for each box (z0, z1, y0, y1, x0, x1, half-open): its distance to the nearest of the others within reach.

    Touching and overlapping boxes have distance 0; equally near ones go by key; nearest is null if none is within reach. With apart,
    others of the same key don't count. Boxes that touch meet in narrow cells, where the others are gone through by key up to the first
    that touches; only boxes that touch none are paired with all others of cells as wide as the reach. So crowded boxes aren't paired.
    """
    wide = max(1.0, float(reach))
    kind = boxes.schema[key].dataType.simpleString()

    def cells(df: DataFrame, name: str, width: float, more: float) -> DataFrame:
        out = df.dropna(subset=[key, *BOUNDS]).select(F.col(key).alias(name), *BOUNDS)
        for c in CELL:
            span = F.sequence(F.floor((F.col(f"{c}0") - more) / width), F.floor((F.col(f"{c}1") + more) / width))
            out = out.select("*", F.explode(span).alias(f"g{c}"))
        return out

    def boxed(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.struct(*BOUNDS).alias(f"{name}_box"), *[f"g{c}" for c in CELL])

    narrow = max(1.0, wide / 3)
    touching = _first_touching(key, kind, cells(boxes, "a", narrow, 0.0), cells(others, "b", narrow, 0.0), apart).where(F.lit(reach) >= 0)
    touching = materialise(touching.groupBy("a").agg(F.min("b").alias("b")).withColumn("d", F.lit(0.0)), "touching")
    alone = boxes.join(touching.select(F.col("a").alias(key)), key, "left_anti")
    near = boxed(cells(alone, "a", wide, wide), "a").join(boxed(cells(others, "b", wide, 0.0), "b"), [f"g{c}" for c in CELL])
    if apart:
        near = near.where("a <> b")
    near = near.withColumn("d", _gap("a_box", "b_box")).where(F.col("d") <= reach)
    best = touching.select("a", F.struct("d", "b").alias("m")).unionByName(near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")))
    best = best.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias(key), F.col("m.b").alias("nearest"), F.col("m.d").alias("distance"))
    return boxes.select(key).distinct().join(best, key, "left")

"""Joins between curve ends: geometry, candidate gates with one reason a pair, checks against other bodies, axes and path features."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lamina.functions import geometry
from lamina.sources.shared import large, materialise

# Width of the tiles whose ends are answered at once.
TILE = 64
# Least side of the tiles in which pairs are sought and curves looked up, planes whose curves are looked up at once, and how many
# comparisons a task holds.
SIDE, DEPTH, BLOCK = 512, 16, 1 << 18


class Gates(NamedTuple):
    """Limits of a join. The defaults; near limits hold up to safe pixels, far ones beyond."""

    safe: float = 6.0
    facing_near: float = 0.707
    facing_far: float = 0.866
    oppose_near: float = 0.0
    oppose_far: float = -0.4
    radial: float = 3.0
    sigma: float = 10.0
    distance_weight: float = 0.30
    direction_weight: float = 0.30
    adjacent_weight: float = 0.15
    track_weight: float = 0.25
    adjacent: float = 0.5
    track: float = 0.5
    score: float = 0.30
    provisional: float = 0.22
    arc: float = 1.15


def end_pairs(ends: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of both ends (id, plane, y, x, ty, tx, component, skeleton), prefixed with a and b."""
    names = ["y", "x", "ty", "tx", "component", "skeleton"]
    sides = [ends.select(F.col("id").alias(s), *(["plane"] if s == "a" else []), *[F.col(n).alias(s + n) for n in names]) for s in "ab"]
    return pairs.drop("plane", "distance").join(sides[0], "a").join(sides[1], "b")


def near_pairs(ends: DataFrame, reach: int) -> DataFrame:
    """end_pairs of all ends a < b of a plane at a distance of at most reach.

    Ends meet with all their columns in tiles of four times the reach; the first goes to each tile that it reaches, so few copies are
    shuffled and no pair is.
    """
    names = ["y", "x", "ty", "tx", "component", "skeleton"]
    size = 4 * reach
    spread = ends.select("plane", F.col("id").alias("a"), *[F.col(n).alias(f"a{n}") for n in names])
    for c in "yx":
        tiles = F.sequence(F.floor((F.col(f"a{c}") - reach) / size), F.floor((F.col(f"a{c}") + reach) / size))
        spread = spread.select("*", F.explode(tiles).alias(f"_{c}"))
    own = ends.select("plane", F.col("id").alias("b"), *[F.col(n).alias(f"b{n}") for n in names], *[F.floor(F.col(c) / size).alias(f"_{c}") for c in "yx"])
    dy, dx = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    return spread.join(large(own), ["plane", "_y", "_x"]).where("a < b").where(dy * dy + dx * dx <= reach * reach).drop("_y", "_x")


def _spans(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each k with every j from start[k] up to stop[k], BLOCK of them at a time or those of one k."""
    count = np.maximum(stop - start, 0)
    total = np.cumsum(count)
    first = 0
    while first < len(count):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + BLOCK, "right")))
        n = count[first:last]
        k = np.repeat(np.arange(first, last), n)
        yield k, start[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        first = last


def pairs_in_planes(ends: DataFrame, reach: int) -> DataFrame:
    """near_pairs found by tasks that hold a tile of a plane: ends move once with hardly a copy, or stay where they are dealt by plane."""
    names = ["y", "x", "ty", "tx", "component", "skeleton"]
    side, width = max(SIDE, 4 * reach), reach * (1 + 1e-6)
    rows = ends.select("plane", "id", *names).dropna(subset=["plane", "id", "y", "x"])
    for c in "yx":
        rows = rows.select("*", F.explode(F.sequence(F.floor(F.col(c) / side), F.floor((F.col(c) + reach) / side))).alias(f"_{c}"))
    kinds = {f.name: f.dataType for f in ends.schema}
    columns = {"plane": "plane"} | {s + (n if n != "id" else ""): n for s in "ab" for n in ("id", *names)}
    schema = StructType([StructField(name, kinds[n]) for name, n in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks().to_batches()[0]
        ids, y, x = rows.column("id").to_numpy(), *(rows.column(c).to_numpy().astype(float) for c in "yx")
        finite = np.flatnonzero(np.isfinite(y) & np.isfinite(x))
        if len(finite) < 2:
            return
        # Cells are as wide as the reach: partners stand in the rest of a cell, the next one, and three of the next row.
        cy, cx = (np.floor(v[finite] / width).astype(np.int64) for v in (y, x))
        row = np.ptp(cx) + 3
        code = (cy - cy.min()) * row + cx - cx.min() + 1
        order = np.argsort(code, kind="stable")
        code, order, n = code[order], finite[order], len(order)
        start = np.concatenate([np.arange(n) + 1, np.searchsorted(code, code + row - 1)])
        stop = np.concatenate([np.searchsorted(code, code + 2), np.searchsorted(code, code + row + 2)])
        tile = [rows.column(f"_{c}")[0].as_py() for c in "yx"]
        for k, j in _spans(start, stop):
            p, q = order[k % n], order[j]
            dy, dx = y[q] - y[p], x[q] - x[p]
            near = dy * dy + dx * dx <= reach * reach
            p, q = p[near], q[near]
            # A pair is told in the tile of its upper corner, which holds both ends.
            mine = (ids[p] != ids[q]) & (np.floor(np.maximum(y[p], y[q]) / side) == tile[0]) & (np.floor(np.maximum(x[p], x[q]) / side) == tile[1])
            p, q = p[mine], q[mine]
            swap = ids[p] > ids[q]
            at = {"a": pa.array(np.where(swap, q, p)), "b": pa.array(np.where(swap, p, q))}
            yield pa.RecordBatch.from_arrays([rows.column(n).take(at["b" if name[0] == "b" else "a"]) for name, n in columns.items()], list(columns))

    return rows.groupBy("plane", "_y", "_x").applyInArrow(run, schema)


def _side(side: str, names: str = "y x") -> list[Column]:
    return [F.col(side + n) for n in names.split()]


def _curve(samples: int = 20) -> Column:
    return geometry.bezier(_side("a"), _side("a", "ty tx"), _side("b"), _side("b", "ty tx"), samples)


def join_geometry(pairs: DataFrame, gates: Gates = Gates(), centre: tuple[float, float] | None = None) -> DataFrame:
    """Adds distance, far, cos_a, cos_b, oppose, radial (null without a centre) and score.

    Facing is the cosine between an end's outward tangent and the chord; the score weighs nearness, facing beyond the limit, and the
    columns adjacent and track (0 where they are null or missing). Ends at one place have no direction: their cosines and score are null.
    """
    extra = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in pairs.columns else F.lit(0.0) for c in ("adjacent", "track")}
    dy, dx = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    rows = pairs.withColumns(extra | {"distance": F.sqrt(dy * dy + dx * dx)})
    d = F.nullif(F.col("distance"), F.lit(0.0))
    rows = rows.withColumns({
        "far": F.col("distance") > gates.safe,
        "cos_a": F.col("aty") * (dy / d) + F.col("atx") * (dx / d),
        "cos_b": -(F.col("bty") * (dy / d) + F.col("btx") * (dx / d)),
        "oppose": F.col("aty") * F.col("bty") + F.col("atx") * F.col("btx"),
    })
    if centre:
        ra, rb = (F.sqrt((F.col(s + "y") - centre[0]) * (F.col(s + "y") - centre[0]) + (F.col(s + "x") - centre[1]) * (F.col(s + "x") - centre[1])) for s in "ab")
        rows = rows.withColumn("radial", F.abs(ra - rb))
    else:
        rows = rows.withColumn("radial", F.lit(None).cast("double"))
    need = F.when(F.col("far"), gates.facing_far).otherwise(gates.facing_near)
    facing = [F.when(c.isNotNull(), F.least(F.lit(1.0), (c - need) / (1 - need))) for c in (F.col("cos_a"), F.col("cos_b"))]
    near = F.exp(-(F.col("distance") * F.col("distance")) / (2 * gates.sigma * gates.sigma))
    score = gates.distance_weight * near + gates.direction_weight * (0.5 * (facing[0] + facing[1])) + gates.adjacent_weight * F.col("adjacent") + gates.track_weight * F.col("track")
    return rows.withColumn("score", score)


def match_candidates(pairs: DataFrame, gates: Gates = Gates(), centre: tuple[float, float] | None = None, provisional: bool = False) -> DataFrame:
    """Pairs of ends with their geometry and reason: the first gate that refuses the pair, null for candidates.

    Pairs under half a pixel apart have nothing to join and are left out. With a centre, the radial gate certifies far joins; without it
    they need evidence from adjacent planes or tracks, unless the round is provisional (its score floor is lower too). A component of
    0 or null is unknown and is like no other.
    """
    rows = join_geometry(pairs, gates, centre).where("distance >= 0.5")
    need, most = (F.when(F.col("far"), a).otherwise(b) for a, b in ((gates.facing_far, gates.facing_near), (gates.oppose_far, gates.oppose_near)))
    same = F.lit(False)
    for c in ("component", "skeleton"):
        same = same | F.coalesce((F.col(f"a{c}") == F.col(f"b{c}")) & (F.col(f"a{c}") > 0), F.lit(False))
    ladder = [
        (same, "same_cc"),
        (~F.coalesce((F.col("cos_a") >= need) & (F.col("cos_b") >= need) & (F.col("oppose") <= most), F.lit(False)), "tangent"),
    ]
    if centre:
        ladder.append((F.col("radial") > gates.radial, "radial"))
    elif not provisional:
        ladder.append((F.col("far") & (F.col("adjacent") < gates.adjacent) & (F.col("track") < gates.track), "evidence"))
    ladder.append((F.col("score") < (min(gates.score, gates.provisional) if provisional else gates.score), "score"))
    rows = rows.withColumn("reason", F.coalesce(*[F.when(c, F.lit(name)) for c, name in ladder], F.lit(None).cast("string")))
    bent = geometry.arc_ratio(_side("a"), _side("a", "ty tx"), _side("b"), _side("b", "ty tx")) >= gates.arc
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("reason").isNull() & bent, F.lit("arc"))))


def _points(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Pixels of cubic curves at t; -2**40 where there is none."""
    u = 1 - t
    v = np.floor(u * u * u * p + 3 * u * u * t * q + 3 * u * t * t * r + t * t * t * s + 0.5)
    return np.where(np.abs(v) < 1e9, v, -(2.0**40)).astype(np.int64)


def _meet(pairs: pa.Table, labels: pa.Table, margin: int, planes: int, samples: int) -> np.ndarray:
    """Whether the curve of each pair passes a third body and crosses a sheet, by the labels of its surroundings in order of their cells."""
    ay, ax, aty, atx, by, bx, bty, btx = (pairs.column(c).cast("double").to_numpy() for c in ("ay", "ax", "aty", "atx", "by", "bx", "bty", "btx"))
    plane = pairs.column("plane").to_numpy().astype(np.int64)
    own = [pc.fill_null(pairs.column(f"{s}component").cast("int64"), 0).to_numpy() for s in "ab"]
    cells = [labels.column(c).to_numpy() for c in ("plane", "y", "x")]
    low, size = [int(c.min()) for c in cells], [int(np.ptp(c)) + 1 for c in cells]
    code = ((cells[0] - low[0]) * size[1] + cells[1] - low[1]) * size[2] + cells[2] - low[2]
    order = np.argsort(code, kind="stable")
    code, label = code[order], labels.column("label").to_numpy()[order]
    chord = np.sqrt((by - ay) ** 2 + (bx - ax) ** 2)
    reach = chord / 3
    curves = (ay, ay + reach * aty, by + reach * bty, by), (ax, ax + reach * atx, bx + reach * btx, bx)
    merged, crossed = np.zeros((2, len(plane)), bool)

    def found(z: np.ndarray, y: np.ndarray, x: np.ndarray, side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of z, y, x and the labels up to side beside them in their row."""
        z, y = z - low[0], y - low[1]
        row = np.where((z >= 0) & (z < size[0]) & (y >= 0) & (y < size[1]), (z * size[1] + y) * size[2], -size[2])
        start, stop = (np.searchsorted(code, row + np.clip(x + o - low[2], 0, size[2])) for o in (-side, side + 1))
        for k, j in _spans(start, stop):
            yield k, label[j]

    steps = np.floor(np.where(chord >= 0.001, chord, 0) * 2).astype(np.int64) + 1
    for k, i in _spans(np.zeros(len(plane), np.int64), np.where(chord >= 0.001, steps + 1, 0)):
        t = i / steps[k]
        y, x = (_points(*(v[k] for v in c), t) for c in curves)
        for o in range(-margin, margin + 1):
            for at, body in found(plane[k], y + o, x, margin):
                who = k[at]
                merged[who[(body != own[0][who]) & (body != own[1][who])]] = True

    dz = np.array([o for o in range(-planes, planes + 1) if o])
    t = np.arange(samples // 10, samples - samples // 10 + 1) / float(samples)
    apart = np.flatnonzero((ay != by) | (ax != bx))
    for first in range(0, len(apart), max(1, BLOCK // max(1, len(dz) * len(t)))):
        k = apart[first : first + max(1, BLOCK // max(1, len(dz) * len(t)))]
        z = (plane[k] + dz[:, None]).ravel()
        under = np.zeros((2, len(z)), np.int64)
        for s, (y, x) in enumerate(((ay, ax), (by, bx))):
            spot = [np.tile(np.where(np.abs(v[k]) < 1e9, np.trunc(v[k]), -(2.0**40)).astype(np.int64), len(dz)) for v in (y, x)]
            for at, body in found(z, *spot, 0):
                np.maximum.at(under[s], at, body)
        y, x = (np.tile(_points(*(v[k][:, None] for v in c), t), (len(dz), 1)) for c in curves)
        for at, body in found(np.repeat(z, len(t)), y.ravel(), x.ravel(), 0):
            at = at // len(t)
            crossed[k[at[(body != under[0][at]) & (body != under[1][at])] % len(k)]] = True
    return np.stack([merged, crossed])


def _looked_up(pairs: DataFrame, labels: DataFrame, margin: int = 2, planes: int = 2, samples: int = 20) -> DataFrame:
    """pairs with _merger and _crossed: whether the curve meets a third body in its plane, or a sheet in the next ones.

    Pairs and labels meet in blocks of DEPTH planes and tiles; a pair goes to the one tile that holds all labels near its curve, and no cell
    of a curve is written. pairs are read twice.
    """
    reach = F.sqrt((F.col("by") - F.col("ay")) ** 2 + (F.col("bx") - F.col("ax")) ** 2) / 3
    box = {}
    for c in "yx":
        controls = [F.col(f"a{c}").cast("double"), F.col(f"a{c}") + reach * F.col(f"at{c}"), F.col(f"b{c}") + reach * F.col(f"bt{c}"), F.col(f"b{c}").cast("double")]
        # A curve lies between its control points.
        known = [F.when(F.abs(v) < 1e9, v) for v in controls]
        box[c] = F.floor(F.least(*known)) - margin - 1, F.floor(F.greatest(*known)) + margin + 2
    wide = pairs.agg(F.max(F.greatest(*[high - low for low, high in box.values()]))).first()[0] or 0
    side, place = max(SIDE, 4 * wide), ["_tz", "_ty", "_tx"]
    left = pairs.select("*", F.floor(F.col("plane") / DEPTH).alias("_tz"), *[F.floor(box[c][1] / side).alias(f"_t{c}") for c in "yx"])
    right = labels.where("label > 0").select(*[F.col(c).cast("long").alias(c) for c in ("plane", "y", "x", "label")])
    for c, size, before, after in (("plane", DEPTH, planes, planes), ("y", side, 0, wide), ("x", side, 0, wide)):
        right = right.select("*", F.explode(F.sequence(F.floor((F.col(c) - before) / size), F.floor((F.col(c) + after) / size))).alias(f"_t{c}" if c != "plane" else "_tz"))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        told = _meet(mine, theirs, margin, planes, samples) if mine.num_rows and theirs.num_rows else np.zeros((2, mine.num_rows), bool)
        return mine.drop_columns(place).append_column("_merger", pa.array(told[0])).append_column("_crossed", pa.array(told[1]))

    schema = StructType(list(pairs.schema.fields)).add("_merger", "boolean").add("_crossed", "boolean")
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(run, schema)


def merged_bodies(pairs: DataFrame, labels: DataFrame, margin: int = 2) -> DataFrame:
    """Pairs (plane, a, b) whose curve passes within margin pixels (a square) of a third body of labels (plane, y, x, label).

    Curves are sampled twice a pixel.
    """
    return _looked_up(pairs, labels, margin, 0).where("_merger").select("plane", "a", "b").distinct()


def crossed_sheets(pairs: DataFrame, labels: DataFrame, planes: int = 2, samples: int = 20) -> DataFrame:
    """Pairs (plane, a, b) whose curve, but for a tenth at either end, meets in one of the next planes a body that lies under neither end."""
    return _looked_up(pairs, labels, 0, planes, samples).where("_crossed").select("plane", "a", "b").distinct()


def guarded(candidates: DataFrame, labels: DataFrame, margin: int = 2, planes: int = 2) -> DataFrame:
    """Candidates with the reasons merger and cross_sheet added; only pairs that no other gate refused are looked up."""
    candidates = materialise(candidates, "candidates")
    told = _looked_up(candidates.where("reason is null"), labels, margin, planes)
    told = told.withColumn("reason", F.when(F.col("_merger"), "merger").when(F.col("_crossed"), "cross_sheet"))
    return candidates.where("reason is not null").unionByName(told.drop("_merger", "_crossed"))


def local_axis(ends: DataFrame, labels: DataFrame, radius: int = 8, least: int = 5) -> DataFrame:
    """Main direction of an end's own body in the square window around it: id, n, axis_y, axis_x, anisotropy, outward_y, outward_x.

    The axis points to positive y (or x); outward is the unit vector from the body's mean to the end. With fewer than least pixels all are 0.
    Whole coordinates. Labels go to the tiles that their windows meet, ends to their own; a tile answers its ends from tables of box sums.
    """
    complete = F.lit(True)
    for name in ("plane", "y", "x", "component"):
        complete = complete & F.col(name).isNotNull()
    own = [F.when(complete, F.floor(F.col(c) / TILE)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1024))).alias(f"t{c}") for c in "yx"]
    left = ends.select("id", "plane", *own, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.when(complete, F.col("component")).alias("label"))
    right = labels.dropna(subset=["plane", "y", "x", "label"]).select("plane", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("label").cast(left.schema["label"].dataType).alias("label"))
    for c in "yx":
        right = right.select("*", F.explode(F.sequence(F.floor((F.col(c) - radius) / TILE), F.floor((F.col(c) + radius) / TILE))).alias(f"t{c}"))
    side = TILE + 2 * radius
    kinds = ["n", "sy", "sx", "syy", "sxx", "syx"]

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = np.zeros((6, mine.num_rows), np.int64)
        if mine.num_rows and theirs.num_rows:
            names = pc.unique(theirs.column("label"))
            whose, label = (pc.fill_null(pc.index_in(t.column("label"), names), -1).to_numpy() for t in (mine, theirs))
            low = [theirs.column(f"t{c}")[0].as_py() * TILE - radius for c in "yx"]
            ey, ex, y, x = (pc.fill_null(t.column(c), 0).to_numpy() - o for t in (mine, theirs) for c, o in zip("yx", low, strict=True))
            gy, gx = np.mgrid[:side, :side]
            for k in np.unique(whose[whose >= 0]):
                at, of = whose == k, label == k
                pixels = np.bincount(y[of] * side + x[of], minlength=side * side).reshape(side, side)
                sums = np.zeros((6, side + 1, side + 1), np.int64)
                sums[:, 1:, 1:] = np.stack([pixels, pixels * gy, pixels * gx, pixels * gy * gy, pixels * gx * gx, pixels * gy * gx]).cumsum(1).cumsum(2)
                a, b = ey[at] - radius, ex[at] - radius
                c, d = a + 2 * radius + 1, b + 2 * radius + 1
                n, sy, sx, syy, sxx, syx = sums[:, c, d] - sums[:, a, d] - sums[:, c, b] + sums[:, a, b]
                v, u = ey[at], ex[at]
                out[:, at] = n, sy - n * v, sx - n * u, syy - 2 * v * sy + n * v * v, sxx - 2 * u * sx + n * u * u, syx - v * sx - u * sy + n * v * u
        return pa.table({"id": mine.column("id"), **dict(zip(kinds, map(pa.array, out), strict=True))})

    place = ["plane", "ty", "tx"]
    rows = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(run, f"id {ends.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in kinds))
    n = F.col("n")
    a, c, b = ((n * F.col(p) - F.col(q) * F.col(r)) / (n * (n - 1)) for p, q, r in (("syy", "sy", "sy"), ("sxx", "sx", "sx"), ("syx", "sy", "sx")))
    rows = rows.withColumn("_ok", n >= least)
    rows = rows.withColumns({name: F.when(F.col("_ok"), e) for name, e in (("_a", a), ("_b", b), ("_c", c))})
    half = F.sqrt((F.col("_a") - F.col("_c")) * (F.col("_a") - F.col("_c")) / 4 + F.col("_b") * F.col("_b"))
    mean = (F.col("_a") + F.col("_c")) / 2
    rows = rows.withColumns({"_high": mean + half, "_low": mean - half})
    # The vector of the larger value, from the row of the matrix that doesn't vanish.
    vy = F.when(F.col("_a") >= F.col("_c"), F.col("_high") - F.col("_c")).otherwise(F.col("_b"))
    vx = F.when(F.col("_a") >= F.col("_c"), F.col("_b")).otherwise(F.col("_high") - F.col("_a"))
    rows = rows.withColumns({"_vy": vy, "_vx": vx}).withColumn("_v", F.sqrt(F.col("_vy") * F.col("_vy") + F.col("_vx") * F.col("_vx")))
    sign = F.when((F.col("_vy") < 0) | ((F.col("_vy") == 0) & (F.col("_vx") < 0)), -1.0).otherwise(1.0)
    out = [-F.col(s) / n for s in ("sy", "sx")]
    away = F.greatest(F.lit(1e-8), F.sqrt(out[0] * out[0] + out[1] * out[1]))
    flat = F.col("_v") == 0
    cells = {
        "axis_y": F.when(flat, 1.0).otherwise(sign * F.col("_vy") / F.nullif("_v", F.lit(0.0))),
        "axis_x": F.when(flat, 0.0).otherwise(sign * F.col("_vx") / F.nullif("_v", F.lit(0.0))),
        "anisotropy": F.col("_high") / F.greatest(F.lit(0.25), F.col("_low")),
        "outward_y": out[0] / away,
        "outward_x": out[1] / away,
    }
    return rows.select("id", "n", *[F.when(F.col("_ok"), e).otherwise(0.0).alias(name) for name, e in cells.items()])


def path_features(points: DataFrame, centre: tuple[float, float], span: int = 4) -> DataFrame:
    """Features of ordered paths (path, i, y, x, probability, label): one row a path.

    length, chord, arc_ratio (chords under 1 count as 1), gap_pixels (label 0) with the mean, least and tenth percentile of their
    probability (null without gaps), difference of the ends' radii and extent of all radii about centre, and the sharpest turn in
    degrees between steps of span points (0 for shorter paths).
    """
    w = Window.partitionBy("path").orderBy("i")
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    dy, dx = y - F.lag(y).over(w), x - F.lag(x).over(w)
    step = F.sqrt(dy * dy + dx * dx)
    into = [c - F.lag(c, span).over(w) for c in (y, x)]
    onto = [F.lead(c, span).over(w) - c for c in (y, x)]
    size = F.sqrt(into[0] * into[0] + into[1] * into[1]) * F.sqrt(onto[0] * onto[0] + onto[1] * onto[1])
    cosine = (into[0] * onto[0] + into[1] * onto[1]) / F.greatest(F.lit(1e-8), size)
    radius = F.sqrt((y - centre[0]) * (y - centre[0]) + (x - centre[1]) * (x - centre[1]))
    rows = points.withColumns({"_step": step, "_cos": cosine, "_r": radius})
    gap = F.when(F.col("label") == 0, F.col("probability").cast("double"))
    first, last = F.min_by(F.struct("y", "x", "_r"), "i").alias("_first"), F.max_by(F.struct("y", "x", "_r"), "i").alias("_last")
    sums = rows.groupBy("path").agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), first, last, F.count_if(F.col("label") == 0).alias("gap_pixels"), F.avg(gap).alias("mean"), F.min(gap).alias("least"), F.percentile(gap, 0.1).alias("p10"), (F.max("_r") - F.min("_r")).alias("radial_extent"), F.min("_cos").alias("_cos"))
    cy, cx = F.col("_last.y") - F.col("_first.y"), F.col("_last.x") - F.col("_first.x")
    rows = sums.withColumn("chord", F.sqrt((cy * cy + cx * cx).cast("double")))
    turn = F.when(F.col("_cos").isNull(), 0.0).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_cos"))))))
    return rows.select("path", "length", "chord", (F.col("length") / F.greatest(F.lit(1.0), F.col("chord"))).alias("arc_ratio"), "gap_pixels", "mean", "least", "p10", F.abs(F.col("_last._r") - F.col("_first._r")).alias("radial_difference"), "radial_extent", turn.alias("turn"))

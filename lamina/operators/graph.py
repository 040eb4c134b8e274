"""Connected components and greedy selection, as joins and map-side combined aggregations."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.chunks import Block, over_chunks
from lamina.sources.shared import large, materialise

# Voxels of a chunk along z, y and x.
CHUNK = (16, 64, 64)


def components(edges: DataFrame, big: bool = False) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) per node of an edge.

    component is the smallest node. Alternates the large-star and the small-star step until the edges are stars around their
    smallest nodes; every round is a written table. Null ends and loops are ignored. With big, none goes
    through the driver for a join.
    """
    pair = edges.where("a is not null and b is not null and a <> b")
    side = large if big else (lambda df: df)
    now = pair.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    for turn in count():
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        higher = both.join(side(least), "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = higher.groupBy("hi").agg(F.min("lo").alias("m"))
        small = higher.join(side(least), "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialise(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), f"stars{turn}")
        leaves = now.select(F.col("hi").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
        ends = leaves.unionByName(now.select(F.col("lo").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if not ends.where("leaf > 1 or (leaf = 1 and centre = 1)").take(1):
            break
    centres = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))


# Neighbours by connectivity: (dz, dy, dx) with at most so many steps; 4 and 8 stay in a plane.
def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Neighbour offsets of 4, 8, 6, 18 or 26 connectivity."""
    planar, steps = {4: (True, 1), 8: (True, 2), 6: (False, 1), 18: (False, 2), 26: (False, 3)}[connectivity]
    cube = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    return [o for o in cube if 0 < sum(map(abs, o)) <= steps and not (planar and o[0])]


def voxel_components(mask: DataFrame, connectivity: int = 6) -> DataFrame:
    """z, y, x, component for each voxel of mask: component is the smallest voxel number of the connected set.

    Voxels are numbered z * 2**42 + y * 2**21 + x. Each chunk labels its own voxels; then only the neighbours across chunk borders give
    edges, between the labels. A voxel without neighbours is a component of its own; an empty mask gives no rows.
    """
    half = [o for o in offsets(connectivity) if o > (0, 0, 0)]

    def work(block: Block) -> dict[str, np.ndarray]:
        there = np.isfinite(block.arrays["mask"])
        cells = np.argwhere(there)
        index = np.full(there.shape, -1)
        index[there] = np.arange(len(cells))
        ends = []
        for step in half:
            one = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(step, there.shape, strict=True))
            two = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(step, there.shape, strict=True))
            both = there[one] & there[two]
            ends.append((index[one][both], index[two][both]))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        label = np.arange(len(cells))
        while len(a):
            # The larger root of each edge goes below the smaller one, then paths are halved until they are flat.
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
        place = (cells + np.array(block.origin)).astype(np.int64)
        number = (place[:, 0] << 42) + (place[:, 1] << 21) + place[:, 2]
        return {**{c: place[:, i].astype(np.int32) for i, c in enumerate("zyx")}, "label": number[label]}

    labelled = materialise(over_chunks(mask.select("z", "y", "x", F.lit(1.0).alias("mask")), ["mask"], CHUNK, (0, 0, 0), work, "z int, y int, x int, label long"), "labels")
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(o, "zyx", strict=True)]) for o in half])).alias("o")
    near = labelled.select("z", "y", "x", F.col("label").alias("a"), moves)
    out = [(F.floor((F.col(c) + F.col(f"o.d{c}")) / n) != F.floor(F.col(c) / n)) for c, n in zip("zyx", CHUNK, strict=True)]
    across = near.where(out[0] | out[1] | out[2]).select("a", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "zyx"])
    edges = across.join(large(labelled.select("z", "y", "x", F.col("label").alias("b"))), ["z", "y", "x"]).select("a", "b").distinct()
    found = components(edges, big=True).select(F.col("node").alias("label"), "component")
    return labelled.join(large(found), "label", "left").select("z", "y", "x", F.coalesce("component", "label").alias("component"))


def component_facts(labels: DataFrame, by: list[str], least: int) -> DataFrame:
    """components, meaningful (of at least so many voxels), largest and its fraction for each group of labelled voxels."""
    sizes = labels.groupBy(*by, "component").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.count("*").alias("components"), F.count_if(F.col("n") >= least).alias("meaningful"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("fraction"))


def greedy_select(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Ids that a greedy walk in order of priority would accept, skipping what conflicts with an accepted one.

    items has id and priority (a strict order, larger first); conflicts has pairs a, b. In each round an undecided item
    is taken if no undecided neighbour has a higher priority, and its neighbours are refused: the same set as the walk.
    """
    pairs = conflicts.where("a <> b").select("a", "b")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    open_, chosen = materialise(items.select("id", "priority"), "open"), None
    for turn in count():
        edge = pairs.join(open_.select(F.col("id").alias("a"), F.col("priority").alias("pa")), "a").join(open_.select(F.col("id").alias("b"), F.col("priority").alias("pb")), "b")
        beaten = edge.where("pb > pa").select(F.col("a").alias("id")).distinct()
        taken = materialise(open_.join(beaten, "id", "left_anti").select("id"), f"taken{turn}")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        refused = pairs.join(taken.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        open_ = materialise(open_.join(taken, "id", "left_anti").join(refused, "id", "left_anti"), f"open{turn}")
        if not open_.take(1):
            return chosen


def greedy_disjoint(items: DataFrame) -> DataFrame:
    """Ids that a greedy walk in order of priority would accept where items that share an end exclude each other.

    items has id, priority (a strict order, larger first) and ends (an array). In each round an item is taken if it is the best open one
    at all its ends; then the items at these ends go. Each round groups by end, so the items of an end are never paired. Items without
    ends or priority are ignored.
    """
    open_ = materialise(items.where("priority is not null and size(ends) > 0").select("id", "priority", F.array_distinct("ends").alias("ends")), "open")
    chosen = None
    for turn in count():
        sides = open_.select("id", "priority", "ends", F.explode("ends").alias("end"))
        best = sides.groupBy("end").agg(F.max_by("id", "priority").alias("id"))
        wins = best.groupBy("id").agg(F.count("*").alias("wins"))
        taken = materialise(open_.join(wins, "id").where(F.col("wins") == F.size("ends")).select("id", "ends"), f"taken{turn}")
        chosen = taken.select("id") if chosen is None else chosen.unionByName(taken.select("id"))
        used = taken.select(F.explode("ends").alias("end")).distinct()
        gone = sides.join(used, "end", "left_semi").select("id").distinct()
        open_ = materialise(open_.join(gone, "id", "left_anti"), f"open{turn}")
        if not open_.take(1):
            return chosen

"""Masks that grow along a field without joining components or gaining thickness, and the repair of seams between separately grown cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.graph import offsets, voxel_components
from lamina.operators.stencils import CELL, shifted
from lamina.sources.shared import large, materialise

FACES = offsets(6)
CROSS = [(0, 0, 0), *FACES]


def interior(mask: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Voxels of the mask whose six neighbours are in it too; with near only those that are or touch a voxel of near."""
    cells = mask.select(*CELL).distinct()
    if near is None:
        full = shifted(cells, CROSS).groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") == len(CROSS))
        return full.select(*CELL)
    spots = shifted(near.select(*CELL), CROSS).distinct().select(F.struct(*CELL).alias("spot"), *CELL)
    seen = shifted(spots, CROSS, "spot").join(large(cells), CELL).groupBy("spot").agg(F.count("*").alias("n")).where(F.col("n") == len(CROSS))
    return seen.select("spot.*")


def _without_new_interior(occupied: DataFrame, additions: DataFrame, allowed: DataFrame, step: int) -> DataFrame:
    """additions (z, y, x, label, p) without those that would give the mask an interior voxel that isn't allowed.

    Around each such voxel the additions with the smallest p go, and so does every other addition there with no larger p than
    the largest of these minima around it; again until none is left.
    """
    turn = 0
    while True:
        new = interior(occupied.select(*CELL).unionByName(additions.select(*CELL)), additions).join(large(allowed), CELL, "left_anti")
        weakest = shifted(additions, CROSS, "p").join(large(new), CELL, "left_semi").groupBy(*CELL).agg(F.min("p").alias("p"))
        weakest = materialise(weakest, f"weakest{step}_{turn}")
        if not weakest.take(1):
            return additions
        limit = shifted(weakest, CROSS, "p").groupBy(*CELL).agg(F.max("p").alias("limit"))
        kept = additions.join(large(limit), CELL, "left").where("limit is null or p > limit").drop("limit")
        additions = materialise(kept, f"additions{step}_{turn}")
        turn += 1


def grow_ridges(field: DataFrame, seed: DataFrame, threshold: float, steps: int) -> tuple[DataFrame, list[dict[str, int]]]:
    """The seed grown along a field: z, y, x, label and step (0 for the seed), and the counts of each step.

    field has z, y, x and p (single precision; null and missing voxels give no support). In each step the voxels of at least the threshold that
    touch the mask are looked at. One is taken if all mask voxels beside it belong to one component of the seed, no other voxel
    taken with it for another component touches it, and the mask gets no interior voxel that the seed hasn't. label is the component of
    the seed (6 neighbours). Counts: frontier, conflicts, thick (refused for each reason) and added; the last step may add nothing.
    """
    seed = seed.select(*CELL).distinct()
    support = field.select(*CELL, F.col("p").cast("float").alias("p")).where(F.col("p") >= F.lit(threshold).cast("float"))
    support = materialise(support.groupBy(*CELL).agg(F.max("p").alias("p")).join(large(seed), CELL, "left_anti"), "support")
    occupied = materialise(voxel_components(seed, 6).select(*CELL, F.col("component").alias("label"), F.lit(0).alias("step")), "occupied0")
    allowed = materialise(interior(seed), "interior")
    counts = []
    for step in range(1, steps + 1):
        around = shifted(occupied, FACES, "label").groupBy(*CELL).agg(F.min("label").alias("label"), F.max("label").alias("other"))
        front = materialise(around.join(large(support), CELL).join(large(occupied.select(*CELL)), CELL, "left_anti"), f"front{step}")
        sure = front.where("label = other").drop("other")
        clash = shifted(sure.withColumn("theirs", F.col("label")), FACES, "theirs").join(large(sure), CELL).where("theirs <> label").select(*CELL).distinct()
        apart = materialise(sure.join(large(clash), CELL, "left_anti"), f"apart{step}")
        taken = _without_new_interior(occupied, apart, allowed, step)
        n_front, n_apart, n_taken = front.count(), apart.count(), taken.count()
        if n_front:
            counts.append({"step": step, "frontier": n_front, "conflicts": n_front - n_apart, "thick": n_apart - n_taken, "added": n_taken})
        if not n_taken:
            break
        occupied = occupied.unionByName(taken.select(*CELL, "label", F.lit(step).alias("step")))
    return occupied, counts


def seam_removals(seed: DataFrame, candidate: DataFrame, field: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """z, y, x, p of the additions that go so that no cube of the targets gets an interior voxel that the seed hasn't.

    candidate is the seed grown cube by cube; targets has the chunks (cz, cy, cx) of the size that may change. For each new interior
    voxel of a target the addition in its cross that lies in a target and has the smallest (p, z, y, x) goes; voxels without p count
    as 0. Removals are decided together on the candidate as it came.
    """
    inside = [F.floor(F.col(c) / size).cast("int").alias(f"c{c}") for c in CELL]
    chunk = [f"c{c}" for c in CELL]
    targets = targets.select(*chunk).distinct()
    seed = seed.select(*CELL).distinct()
    added = candidate.select(*CELL).distinct().join(large(seed), CELL, "left_anti")
    whole = seed.unionByName(added)
    new = interior(whole, added).join(large(interior(seed, added)), CELL, "left_anti").select(*CELL, *inside).join(large(targets), chunk, "left_semi").select(*CELL)
    ours = added.select(*CELL, *inside).join(large(targets), chunk, "left_semi").select(*CELL)
    values = field.groupBy(*CELL).agg(F.max("p").alias("p"))
    ranked = ours.join(large(values), CELL, "left").select(*CELL, F.struct(F.coalesce("p", F.lit(0.0)).alias("p"), *CELL).alias("choice"))
    first = shifted(ranked, CROSS, "choice").join(large(new), CELL, "left_semi").groupBy(*CELL).agg(F.min("choice").alias("choice"))
    return first.select("choice.*").distinct().select(*CELL, "p")


def seam_report(seed: DataFrame, candidate: DataFrame, removals: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """new_interior, removed and remaining voxels of the targets; remaining is 0 if every new interior voxel had an addition to give up."""
    inside = [F.floor(F.col(c) / size).cast("int").alias(f"c{c}") for c in CELL]
    chunk = [f"c{c}" for c in CELL]
    seed = seed.select(*CELL).distinct()
    added = materialise(candidate.select(*CELL).distinct().join(large(seed), CELL, "left_anti"), "added")
    removals, targets = materialise(removals.select(*CELL), "removals"), targets.select(*chunk).distinct()
    parts = []
    for name, more in (("new_interior", added), ("remaining", added.join(large(removals), CELL, "left_anti"))):
        new = interior(seed.unionByName(more), more).join(large(interior(seed, more)), CELL, "left_anti").select(*CELL, *inside).join(large(targets), chunk, "left_semi")
        parts.append(new.select(F.lit(name).alias("what")))
    parts.append(removals.select(F.lit("removed").alias("what")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*[F.count_if(F.col("what") == n).alias(n) for n in ("new_interior", "removed", "remaining")])

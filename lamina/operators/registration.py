"""Registration of volumes: shift searches, robust affine fits, transform paths, and fields moved from one lattice to another."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import geometry
from lamina.operators.chunks import Block, Three, over_chunks
from lamina.sources.shared import large, materialise

CELL = ["z", "y", "x"]
SHIFT = ["dz", "dy", "dx"]
MOMENTS = ["n", "a", "b", "aa", "bb", "ab"]


# Shift search


def shift_moments(pairs: DataFrame, radius: int, by: tuple[str, ...], size: Three = (32, 32, 32)) -> DataFrame:
    """by, dz, dy, dx and six sums (n, a, b, aa, bb, ab) over the voxels where both fields are known, for each shift up to the radius.

    pairs has by, z, y, x, fixed and moving, null where unknown. The moving field moved by a shift meets the fixed field. Each chunk sums
    all shifts from its own fixed voxels and the moving ones of its halo; sums of chunks are added.
    """
    steps = range(-radius, radius + 1)

    def work(block: Block) -> dict[str, np.ndarray] | None:
        a, b = block.arrays["fixed"][block.core], block.arrays["moving"]
        ka, kb = np.isfinite(a), np.isfinite(b)
        if not ka.any() or not kb.any():
            return None
        a, b = np.where(ka, a, 0.0), np.where(kb, b, 0.0)
        fields = np.stack([ka.astype(float), a, a * a]).reshape(3, -1)
        out = []
        for dz in steps:
            for dy in steps:
                for dx in steps:
                    place = tuple(slice(radius - d, radius - d + n) for d, n in zip((dz, dy, dx), a.shape, strict=True))
                    k, v = kb[place].astype(float), b[place]
                    n, sa, saa = fields @ k.ravel()
                    if n:
                        _, sb, sab = 0, *(fields[:2] @ v.ravel())
                        out.append((dz, dy, dx, n, sa, sb, saa, fields[0] @ (v * v).ravel(), sab))
        got = np.array(out).reshape(-1, 9)
        return {**{s: got[:, i].astype(np.int32) for i, s in enumerate(SHIFT)}, "n": got[:, 3].astype(np.int64), **{m: got[:, i + 3] for i, m in enumerate(MOMENTS) if i}}

    sums = over_chunks(pairs, ["fixed", "moving"], size, (radius,) * 3, work, "dz int, dy int, dx int, n long, a double, b double, aa double, bb double, ab double", by)
    return sums.groupBy(*by, *SHIFT).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def shift_scores(moments: DataFrame, pairs: DataFrame, by: tuple[str, ...], least: int = 2048, share: float = 0.2) -> DataFrame:
    """by, dz, dy, dx, overlap and ncc: the correlation of the fields at each shift.

    ncc is null below an overlap of least voxels or of a share of the smaller field, and where a field is constant.
    """
    sizes = pairs.groupBy(*by).agg(F.least(F.count("fixed"), F.count("moving")).alias("whole"))
    n = F.col("n")
    spread = F.sqrt(F.greatest(F.col("aa") - F.col("a") * F.col("a") / n, F.lit(0.0)) * F.greatest(F.col("bb") - F.col("b") * F.col("b") / n, F.lit(0.0)))
    enough = n >= F.greatest(F.lit(least), F.floor(F.col("whole") * share))
    ncc = F.when(enough & (spread > 1e-8), (F.col("ab") - F.col("a") * F.col("b") / n) / spread)
    return moments.join(sizes, list(by)).select(*by, *SHIFT, n.alias("overlap"), ncc.alias("ncc"))


def shift_search(scores: DataFrame, radius: int, by: tuple[str, ...], peaks: int = 5, apart: int = 2) -> DataFrame:
    """One row for each pair: the best shift, its gain over none, the separated peaks and the margin to the second of them.

    Peaks are taken from the highest score down, each more than apart steps from those before along some axis. Equal scores (to 12
    places) go to the smaller shift (by dz, dy, dx). A pair without any score has no best shift. A pair's scores are at most
    (2 * radius + 1) ** 3 rows.
    """
    kind = scores.select(*by).schema
    peak = "dz:int,dy:int,dx:int,ncc:double,overlap:bigint"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), "dz int, dy int, dx int, best double, overlap long, nominal double, nominal_overlap long, gain double, margin double, boundary boolean", f"peaks array<struct<{peak}>>"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        own = {b: df[b].iloc[0] for b in by}
        none = df[(df.dz == 0) & (df.dy == 0) & (df.dx == 0)]
        nominal = none.ncc.iloc[0] if len(none) else np.nan
        good = df[df.ncc.notna()].assign(score=lambda d: d.ncc.round(12)).sort_values(["score", *SHIFT], ascending=[False, True, True, True])
        shifts, taken = good[SHIFT].to_numpy(), []
        open_ = np.ones(len(good), bool)
        while open_.any() and len(taken) < peaks:
            k = int(open_.argmax())
            taken.append(k)
            open_ &= np.abs(shifts - shifts[k]).max(axis=1) > apart
        found = [{**{s: int(shifts[k][i]) for i, s in enumerate(SHIFT)}, "ncc": float(good.ncc.iloc[k]), "overlap": int(good.overlap.iloc[k])} for k in taken]
        row = {**own, "nominal": nominal, "nominal_overlap": int(none.overlap.iloc[0]) if len(none) else 0, "peaks": found}
        if found:
            top = found[0]
            row |= {s: top[s] for s in SHIFT} | {"best": top["ncc"], "overlap": top["overlap"], "gain": top["ncc"] - nominal, "boundary": max(abs(top[s]) for s in SHIFT) == radius}
            row["margin"] = top["ncc"] - found[1]["ncc"] if len(found) > 1 else None
        columns = [*by, *SHIFT, "best", "overlap", "nominal", "nominal_overlap", "gain", "margin", "boundary", "peaks"]
        return pd.DataFrame([{c: row.get(c) for c in columns}]).astype({c: "Int32" for c in SHIFT} | {"overlap": "Int64"}).astype({c: "float64" for c in ("best", "nominal", "gain", "margin")})

    return scores.groupBy(*by).applyInPandas(run, schema)


# Robust affine fit

AXES = ["z", "y", "x"]
OLD, DELTA = [f"o{c}" for c in AXES], [f"s{c}" for c in AXES]
COEFFICIENTS = [f"c{i}{j}" for i in range(4) for j in range(3)]


def _design() -> list[Column]:
    return [*((F.col(o) - F.col(f"m{o}")) / F.col(f"d{o}") for o in OLD), F.lit(1.0)]


def _residual(prefix: str = "") -> list[Column]:
    """What the coefficients leave of each component of a shift."""
    design = _design()
    return [F.col(s) - sum((design[i] * F.col(f"{prefix}c{i}{j}") for i in range(1, 4)), design[0] * F.col(f"{prefix}c0{j}")) for j, s in enumerate(DELTA)]


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def normal_sums(anchors: DataFrame, by: tuple[str, ...], weight: Column, *more: Column) -> DataFrame:
    """The normal equations of a weighted fit for each group: g_ij (i <= j) of the design with itself and h_ij with the shifts.

    more are further aggregates of the same pass.
    """
    x = _design()
    grams = [F.sum(weight * x[i] * x[j]).alias(f"g{i}{j}") for i in range(4) for j in range(i, 4)]
    rights = [F.sum(weight * x[i] * F.col(s)).alias(f"h{i}{j}") for i in range(4) for j, s in enumerate(DELTA)]
    return anchors.groupBy(*by).agg(F.count("*").alias("n"), *grams, *rights, *more)


def _solve(sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Coefficients of each row of normal equations, and the rank of its design; the columns by stay."""
    kind = sums.select(*by).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), *(f"{c} double" for c in COEFFICIENTS), "rank int"])

    def run(batches):
        for df in batches:
            g = np.zeros((len(df), 4, 4))
            for i in range(4):
                for j in range(i, 4):
                    g[:, i, j] = g[:, j, i] = df[f"g{i}{j}"]
            h = df[[f"h{i}{j}" for i in range(4) for j in range(3)]].to_numpy().reshape(-1, 4, 3)
            out = df[list(by)].copy()
            found = [np.linalg.lstsq(a, b, rcond=1e-13)[0] for a, b in zip(g, h, strict=True)]
            out[COEFFICIENTS] = np.array(found).reshape(-1, 12)
            # The design is scaled, so its Gram matrix is near the identity times n unless the anchors lie in a plane.
            out["rank"] = [int(np.linalg.matrix_rank(a, tol=1e-9 * max(a.trace(), 1e-300), hermitian=True)) for a in g]
            yield out

    return sums.mapInPandas(run, schema)


def prepared(anchors: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """anchors (by, z, y, x and shifts sz, sy, sx) with the old places oz, oy, ox and each group's mean and spread of them.

    The facts of the groups are written, so that the anchors of a large group stay where they are unless there are very many groups.
    """
    old = anchors.withColumns({o: F.col(c) - F.col(s) for o, c, s in zip(OLD, AXES, DELTA, strict=True)})
    facts = old.groupBy(*by).agg(*[F.avg(o).alias(f"m{o}") for o in OLD], *[F.greatest(F.stddev_pop(o), F.lit(1.0)).alias(f"d{o}") for o in OLD])
    return old.join(materialise(facts, "places"), list(by))


def huber_fit(anchors: DataFrame, by: tuple[str, ...], delta: float = 1.5, rounds: int = 25, settled: float = 1e-5) -> DataFrame:
    """Coefficients of the affine from old to fixed places for each group of anchors, by reweighted least squares.

    An anchor weighs 1 up to a residual of delta and delta / residual beyond. A group stops when no weight moves by settled; all groups
    stop after so many rounds. One pass a round sums the normal equations of every group; only those sums are solved, in tasks.
    Returns by, the scaling of the design, the twelve coefficients, rank, n and rounds. Null shifts aren't anchors.
    """
    ready = materialise(prepared(anchors.dropna(subset=[*AXES, *DELTA]).select(*by, *AXES, *DELTA), by), "anchors")
    facts = ready.select(*by, *[f"{p}{o}" for p in "md" for o in OLD]).distinct()
    now = materialise(_solve(normal_sums(ready, by, F.lit(1.0)), by).withColumns({"before": F.lit(None).cast("array<double>"), "rounds": F.lit(1), "open": F.lit(True)}), "fit")
    names = [*COEFFICIENTS, "rank"]

    def weight(prefix: str = "") -> Column:
        return F.least(F.lit(1.0), F.lit(delta) / F.greatest(_norm(_residual(prefix)), F.lit(1e-12)))

    for turn in range(2, rounds + 1):
        if not now.where("open").take(1):
            break
        # The weights of this round against those that the coefficients before gave (1 in the first round).
        both = ready.join(now.where("open"), list(by))
        both = both.withColumns({f"q{c}": F.col("before")[i] for i, c in enumerate(COEFFICIENTS)})
        both = both.withColumn("weight", weight()).withColumn("moved", F.abs(F.col("weight") - F.when(F.col("before").isNull(), 1.0).otherwise(weight("q"))))
        solved = _solve(normal_sums(both, by, F.col("weight"), F.max("moved").alias("moved")), (*by, "moved"))
        old = now.select(*by, F.array(*COEFFICIENTS).alias("kept"), F.col("rank").alias("old_rank"), "rounds", "open", F.col("before").alias("earlier"))
        step = old.join(solved, list(by), "left")
        goes_on = F.col("open") & (F.coalesce("moved", F.lit(0.0)) >= settled)
        picked = {c: F.when(goes_on, F.col(c)).otherwise(F.col("kept")[i]) for i, c in enumerate(COEFFICIENTS)}
        now = materialise(step.select(*by, *[v.alias(c) for c, v in picked.items()], F.when(goes_on, F.col("rank")).otherwise(F.col("old_rank")).alias("rank"), F.when(goes_on, F.col("kept")).otherwise(F.col("earlier")).alias("before"), F.when(goes_on, F.lit(turn)).otherwise(F.col("rounds")).alias("rounds"), goes_on.alias("open")), f"fit{turn}")
    counts = ready.groupBy(*by).agg(F.count("*").alias("n"))
    return now.select(*by, *names, "rounds").join(facts, list(by)).join(counts, list(by))


def correction(fit: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by and the 3x4 correction in (z, y, x) as an array of 12: place after = A * place before."""
    rows = []
    for j in range(3):
        slopes = [F.col(f"c{i}{j}") / F.col(f"d{o}") for i, o in enumerate(OLD)]
        rows += [s + (1.0 if i == j else 0.0) for i, s in enumerate(slopes)]
        rows.append(F.col(f"c3{j}") - sum((s * F.col(f"m{o}") for s, o in zip(slopes[1:], OLD[1:], strict=True)), slopes[0] * F.col(f"m{OLD[0]}")))
    return fit.select(*by, F.array(*rows).alias("correction"), "rank", "n", "rounds")


def _quantiles(rows: DataFrame, by: tuple[str, ...], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and the exact interpolated quantiles of a column of numbers of at least 0, as percentile gives them.

    A histogram by size tells in which bins the ranks lie (64 bins an octave); only these bins' values are put in order, equal ones once.
    """
    v = F.col(value)
    size = F.when(F.isnan(v), F.lit(2**31 - 1)).otherwise(F.coalesce(F.floor(F.when(v > 0, F.least(F.log2(v) * 64, F.lit(1e9)))).cast("int"), F.lit(-(2**31))))
    binned = rows.where(v.isNotNull()).select(*by, v.alias("_v"), size.alias("_bin"))
    up, whole = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    bins = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c")).select("*", (F.sum("_c").over(up) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    place = {name: F.lit(q) * (F.col("_n") - 1) for name, q in wanted.items()}
    ranks = F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)])
    held = bins.where(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))
    few = binned.join(materialise(held.drop("_c"), "bins"), [*by, "_bin"]).groupBy(*by, "_bin", "_before", "_n", "_v").agg(F.count("*").alias("_c"))
    ordered = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("_end", F.col("_before") + F.sum("_c").over(ordered))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v")))

    ends = few.groupBy(*by, "_n").agg(*[at(f(p)).alias(f"_{name}{k}") for name, p in place.items() for k, f in enumerate((F.floor, F.ceil))])
    between = {name: F.when(F.floor(p) == F.ceil(p), F.col(f"_{name}0")).otherwise((F.ceil(p) - p) * F.col(f"_{name}0") + (p - F.floor(p)) * F.col(f"_{name}1")) for name, p in place.items()}
    return ends.select(*by, *[v.alias(name) for name, v in between.items()])


def residual_facts(anchors: DataFrame, corrections: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """count, largest component, norms (median, 90th percentile, largest) and rms of what the corrections leave at the anchors."""
    joined = anchors.join(corrections, list(by))
    m = [F.col("correction")[i] for i in range(12)]
    old = [F.col(c) - F.col(s) for c, s in zip(AXES, DELTA, strict=True)]
    left = [F.col(c) - (m[4 * i] * old[0] + m[4 * i + 1] * old[1] + m[4 * i + 2] * old[2] + m[4 * i + 3]) for i, c in enumerate(AXES)]
    rows = materialise(joined.select(*by, _norm(left).alias("norm"), F.greatest(*[F.abs(v) for v in left]).alias("component")), "residuals")
    facts = rows.groupBy(*by).agg(F.count("*").alias("count"), F.max("component").alias("largest_component"), F.max("norm").alias("largest_norm"), F.sqrt(F.sum(F.col("norm") * F.col("norm")) / (3 * F.count("*"))).alias("rms"))
    return facts.join(_quantiles(rows, by, "norm", {"median_norm": 0.5, "p90_norm": 0.9}), list(by), "left")


def hold_out(anchors: DataFrame, by: tuple[str, ...], key: str, modulus: int = 3) -> DataFrame:
    """anchors with held: the first eight bytes of the key's sha256, read from the last one, are a multiple of the modulus.

    Groups with fewer than max(4, n / (modulus + 1)) held rows hold their first rows by sha256 instead, and groups that would fit on
    fewer than five rows every modulus-th row by key.
    """
    sha = F.sha2(F.col(key).cast("string"), 256)
    digits = F.concat(*[F.substring(sha, 2 * k + 1, 2) for k in range(7, -1, -1)])
    marked = anchors.withColumn("sha", sha).withColumn("held", F.conv(digits, 16, 10).cast("decimal(20,0)") % modulus == 0)
    facts = marked.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("held").alias("k"))
    need = F.greatest(F.lit(4), F.floor(F.col("n") / (modulus + 1)))
    facts = facts.withColumn("need", need).withColumn("few", F.col("k") < F.col("need"))
    facts = facts.withColumn("thin", F.col("n") - F.when(F.col("few"), F.least("need", "n")).otherwise(F.col("k")) < 5)
    rows = marked.join(materialise(facts.select(*by, "need", "few", "thin"), "sizes"), list(by))
    plain = rows.where("not few and not thin")
    odd = rows.where("few or thin")
    by_sha, by_key = (Window.partitionBy(*by).orderBy(*c) for c in (["sha", key], [key, "sha"]))
    odd = odd.withColumn("held", F.when(F.col("thin"), (F.row_number().over(by_key) - 1) % modulus == 0).otherwise(F.row_number().over(by_sha) <= F.col("need")))
    return plain.unionByName(odd).drop("sha", "need", "few", "thin")


def refine(anchors: DataFrame, by: tuple[str, ...], key: str, least: int = 12, modulus: int = 3, delta: float = 1.5, component: float = 2.0, norm: float = 3.0, median: float = 1.75) -> DataFrame:
    """One row for each group of eligible anchors: status, reasons, correction (z, y, x), counts and held-out figures.

    A fit on the anchors not held out has to predict the held ones within the three limits; the correction returned is then fitted on
    all anchors. Groups that fail keep it as a first guess for local registration. A group of fewer than least anchors isn't fitted.
    """
    known = anchors.dropna(subset=[*AXES, *DELTA, key])
    sizes = materialise(known.groupBy(*by).agg(F.count("*").alias("eligible")), "eligible")
    enough = materialise(hold_out(known.join(sizes.where(F.col("eligible") >= least).select(*by), list(by), "left_semi"), by, key, modulus), "anchors")
    # Both fits of all groups go through the rounds together.
    both = enough.select("*", F.explode(F.lit(["all", "fit"])).alias("rows")).where("rows = 'all' or not held")
    done = materialise(correction(huber_fit(both, (*by, "rows"), delta), (*by, "rows")), "fits")
    fits = {name: done.where(F.col("rows") == name).drop("rows") for name in ("all", "fit")}
    held = enough.where("held")
    span = _solve(normal_sums(prepared(held, by), by, F.lit(1.0)), by).select(*by, F.col("rank").alias("held_rank"))
    facts = residual_facts(held, fits["fit"].select(*by, "correction"), by)
    out = sizes.join(fits["all"].select(*by, "correction"), list(by), "left").join(fits["fit"].select(*by, F.col("rank").alias("fit_rank"), F.col("n").alias("fitted")), list(by), "left").join(span, list(by), "left").join(facts, list(by), "left")
    spans = (F.col("fit_rank") == 4) & (F.col("held_rank") == 4)
    reasons = F.filter(F.array(
        F.when(F.col("eligible") < least, "too few anchors"),
        F.when(F.col("fit_rank") < 4, "fit anchors do not span a 3-D affine"),
        F.when(F.col("held_rank") < 4, "held-out anchors do not span a 3-D affine"),
        F.when(spans & (F.col("largest_component") > component), "held-out component error exceeds tolerance"),
        F.when(spans & (F.col("largest_norm") > norm), "held-out residual norm exceeds tolerance"),
        F.when(spans & (F.col("median_norm") > median), "held-out median residual norm exceeds tolerance"),
    ), lambda r: r.isNotNull())
    status = F.when(F.size("reasons") == 0, "global-affine-candidate").otherwise("local-registration-required")
    return out.withColumn("reasons", reasons).select(*by, status.alias("status"), "reasons", "eligible", F.coalesce("fitted", F.lit(0)).alias("fitted"), F.coalesce("count", F.lit(0)).alias("held"), "correction", "largest_component", "largest_norm", "median_norm", "p90_norm", "rms")


# Transform paths


def _product(a: Column, b: Column) -> Column:
    """The 3x4 matrix (an array of 12) that does b first and then a."""
    cells = []
    for i in range(3):
        for j in range(4):
            cell = a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j]
            cells.append(cell + a[4 * i + 3] if j == 3 else cell)
    return F.array(*cells)


def _inverse(m: Column) -> Column:
    """The inverse of a 3x4 matrix (an array of 12); null if its determinant is below 1e-12."""
    a = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    minor = [[a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = a[0][0] * minor[0][0] + a[0][1] * minor[0][1] + a[0][2] * minor[0][2]
    rows = []
    for i in range(3):
        row = [minor[j][i] / det for j in range(3)]
        rows += [*row, -(row[0] * m[3] + row[1] * m[7] + row[2] * m[11])]
    return F.when(F.abs(det) >= 1e-12, F.array(*rows))


def transform_paths(volumes: DataFrame, transforms: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """source, volume, steps, path and matrix for every volume that a chain of transforms reaches from a source.

    volumes has volume and grid (volumes of one grid, if not null, share their voxel coordinates); transforms has volume, to_volume and
    matrix (12 numbers); sources has volume. Every transform counts both ways; ends that aren't in volumes, nulls and singular matrices
    are ignored. A path has as few steps as can be, and among those the smallest sequence of volumes. The search goes breadth
    first from all sources at once, a join and a written table a step; a grid's volumes are joined once for each source, not in pairs.
    """
    known = volumes.select("volume").distinct()
    usable = transforms.where("volume is not null and to_volume is not null and size(matrix) = 12").withColumn("back", _inverse(F.col("matrix"))).where("back is not null")
    usable = usable.join(known, "volume", "left_semi").join(known.select(F.col("volume").alias("to_volume")), "to_volume", "left_semi")
    forward = usable.select("volume", F.col("to_volume").alias("next"), "matrix", F.lit(0).alias("order"))
    backward = usable.select(F.col("to_volume").alias("volume"), F.col("volume").alias("next"), F.col("back").alias("matrix"), F.lit(1).alias("order"))
    edges = forward.unionByName(backward).where("volume <> next")
    # Of several transforms between two volumes one is used, at every step: direct ones before inverted ones, then the smaller matrix.
    edges = materialise(edges.groupBy("volume", "next").agg(F.min_by("matrix", F.struct("order", "matrix")).alias("matrix")), "edges")
    grids = volumes.where("grid is not null").select("grid", "volume").distinct()
    identity = F.array(*[F.lit(1.0 if i in (0, 5, 10) else 0.0) for i in range(12)])
    start = sources.select("volume").distinct().join(known, "volume", "left_semi")
    front = materialise(start.select(F.col("volume").alias("source"), "volume", F.lit(0).alias("steps"), F.array("volume").alias("path"), identity.alias("matrix")), "front")
    found, opened, step = front, None, 0
    while rounds is None or step < rounds:
        step += 1
        by_edge = front.join(edges.withColumnRenamed("matrix", "move"), "volume").select("source", F.col("next").alias("volume"), "path", _product(F.col("move"), F.col("matrix")).alias("matrix"), F.lit(0).alias("rank"))
        own = front.join(grids, "volume")
        if opened is not None:
            own = own.join(opened, ["source", "grid"], "left_anti")
        first = own.groupBy("source", "grid").agg(F.min_by(F.struct("path", "matrix"), "path").alias("f"))
        first = materialise(first, f"grids{step}")
        by_grid = first.join(grids, "grid").select("source", "volume", F.col("f.path").alias("path"), F.col("f.matrix").alias("matrix"), F.lit(1).alias("rank"))
        new = by_edge.unionByName(by_grid).withColumn("path", F.concat("path", F.array("volume")))
        new = new.join(found.select("source", "volume"), ["source", "volume"], "left_anti")
        best = new.groupBy("source", "volume").agg(F.min_by(F.struct("path", "matrix"), F.struct("path", "rank", "matrix")).alias("f"))
        front = materialise(best.select("source", "volume", F.lit(step).alias("steps"), F.col("f.path").alias("path"), F.col("f.matrix").alias("matrix")), f"front{step}")
        if not front.take(1):
            break
        found = found.unionByName(front)
        seen = first.select("source", "grid")
        opened = seen if opened is None else opened.unionByName(seen)
    return found


# Fields on another lattice


def smoothed(field: DataFrame, value: str, sigma: float, size: Three = (32, 32, 32), reach: float = 4.0) -> DataFrame:
    """z, y, x, v: the field, zero where unknown, after a Gaussian; every cell within its reach of a known one."""
    radius = int(reach * sigma + 0.5)
    if radius == 0:
        return field.select(*CELL, F.col(value).cast("double").alias("v")).where("v is not null")
    weights = np.array([math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)])
    weights /= weights.sum()

    def work(block: Block) -> dict[str, np.ndarray]:
        out = np.nan_to_num(block.arrays[value], nan=0.0)
        near = np.isfinite(block.arrays[value])
        for axis in range(3):
            n = out.shape[axis] - 2 * radius
            parts = [(np.take(out, range(k, k + n), axis), np.take(near, range(k, k + n), axis)) for k in range(2 * radius + 1)]
            out = sum(w * p for w, (p, _) in zip(weights, parts, strict=True))
            near = np.logical_or.reduce([k for _, k in parts])
        return block.rows(near, v=out)

    return over_chunks(field, [value], size, (radius,) * 3, work, "z int, y int, x int, v double")


def eroded_coverage(coverage: DataFrame, distance: int, size: Three = (32, 32, 32)) -> DataFrame:
    """The covered voxels z, y, x that lie farther than distance from every voxel that isn't covered."""
    if distance <= 0:
        return coverage.select(*CELL).distinct()
    d = range(-distance, distance + 1)
    ball = [(a, b, c) for a in d for b in d for c in d if 0 < a * a + b * b + c * c <= distance * distance]

    def work(block: Block) -> dict[str, np.ndarray]:
        there = np.isfinite(block.arrays["one"])
        kept = there[block.core].copy()
        for step in ball:
            kept &= there[tuple(slice(distance + o, distance + o + n) for o, n in zip(step, kept.shape, strict=True))]
        return block.rows(kept)

    return over_chunks(coverage.select(*CELL, F.lit(1.0).alias("one")), ["one"], size, (distance,) * 3, work, "z int, y int, x int")


def _fine_place(matrix: list[float]) -> list[Column]:
    """Fine (z, y, x) of the coarse voxel in the columns z, y, x under the inverse of a fine-to-coarse matrix on (x, y, z)."""
    x, y, z = geometry.apply_affine([F.col("x"), F.col("y"), F.col("z")], geometry.invert_affine(matrix))
    return [z, y, x]


def pull_back(fine: DataFrame, value: str, matrix: list[float], box: DataFrame, coverage: DataFrame | None = None, sigma_scale: float = 0.5, reach: float = 4.0, margin: int = 0) -> DataFrame:
    """z, y, x, p and valid for each coarse voxel of box: the smoothed fine field at its place, between eight neighbours.

    matrix goes from fine to coarse on (x, y, z). The Gaussian is sigma_scale coarse voxels wide; fine voxels that aren't there count
    as zero; p is held between 0 and 1. valid says whether the nearest fine voxel is covered farther than the filter's margin (its
    3 sigma and 2 more) plus margin; without coverage every voxel is valid.
    """
    ratio = geometry.affine_scale(matrix)
    sigma = sigma_scale * ratio
    filtered = smoothed(fine, value, sigma, reach=reach)
    place = _fine_place(matrix)
    coarse = box.select(*CELL).distinct().withColumns({f"f{c}": p for c, p in zip(CELL, place, strict=True)})
    corner = coarse.withColumn("o", F.explode(F.array(*[F.struct(*[F.lit(b).alias(f"d{c}") for b, c in zip(bits, CELL, strict=True)]) for bits in np.ndindex(2, 2, 2)])))
    weight = F.lit(1.0)
    cells = {}
    for c in CELL:
        base = F.floor(f"f{c}")
        part = F.col(f"f{c}") - base
        weight = weight * F.when(F.col(f"o.d{c}") == 1, part).otherwise(1 - part)
        cells[f"g{c}"] = (base + F.col(f"o.d{c}")).cast("int")
    corner = corner.select(*CELL, *[v.alias(n) for n, v in cells.items()], weight.alias("w")).where("w > 0")
    fields = filtered.select(*[F.col(c).alias(f"g{c}") for c in CELL], "v")
    sums = corner.join(large(fields), [f"g{c}" for c in CELL]).groupBy(*CELL).agg(F.sum(F.col("w") * F.col("v")).alias("p"))
    out = coarse.join(large(sums), CELL, "left").withColumn("p", F.least(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    if coverage is None:
        return out.select(*CELL, "p", F.lit(True).alias("valid"))
    solid = eroded_coverage(coverage, math.ceil(3 * sigma) + 2 + margin)
    nearest = [F.floor(F.col(f"f{c}") + 0.5).cast("int").alias(f"g{c}") for c in CELL]
    solid = solid.select(*[F.col(c).alias(f"g{c}") for c in CELL], F.lit(True).alias("solid"))
    return out.select(*CELL, "p", *nearest).join(large(solid), [f"g{c}" for c in CELL], "left").select(*CELL, "p", F.coalesce("solid", F.lit(False)).alias("valid"))


def push_forward(fine: DataFrame, matrix: list[float], box: DataFrame) -> DataFrame:
    """z, y, x, label for each coarse voxel of box: 1 if a positive fine voxel lands on it, 0 if its nearest fine voxel is known, else 2.

    fine has z, y, x and label (0, 1, 2 is unknown; voxels that aren't there are unknown). A voxel lands on the coarse voxel nearest to
    its image, halves up.
    """
    image = geometry.apply_affine([F.col("x"), F.col("y"), F.col("z")], matrix)
    landed = fine.where("label = 1").select(*[F.floor(v + 0.5).cast("int").alias(c) for c, v in zip(("x", "y", "z"), image, strict=True)]).distinct().withColumn("hit", F.lit(True))
    nearest = [F.floor(p + 0.5).cast("int").alias(f"g{c}") for c, p in zip(CELL, _fine_place(matrix), strict=True)]
    known = fine.where("label in (0, 1)").select(*[F.col(c).alias(f"g{c}") for c in CELL], F.lit(True).alias("known")).distinct()
    out = box.select(*CELL).distinct().select(*CELL, *nearest).join(large(known), [f"g{c}" for c in CELL], "left").join(large(landed), CELL, "left")
    return out.select(*CELL, F.when(F.col("hit"), 1).when(F.col("known"), 0).otherwise(2).alias("label"))

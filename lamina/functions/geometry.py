"""Scalar functions: cube ids, chunk numbers, Morton keys, affines, curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.hashing import hash_number


def cube_id(z: Column, y: Column, x: Column) -> Column:
    return F.format_string("z%05d_y%05d_x%05d", z, y, x)


def parse_cube_id(text: Column) -> list[Column]:
    return [F.regexp_extract(text, r"^z(\d{5})_y(\d{5})_x(\d{5})$", i).cast("int").alias(c) for i, c in ((1, "z"), (2, "y"), (3, "x"))]


def chunk_id(cz: Column, cy: Column, cx: Column, gy: int, gx: int) -> Column:
    return ((cz * gy + cy) * gx + cx).cast("long")


def _spread(v: Column) -> Column:
    """Bits of a 21-bit number with two gaps between them."""
    v = v.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(z: Column, y: Column, x: Column) -> Column:
    return F.shiftleft(_spread(z), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(x))


def apply_affine(point: list[Column], m: list[float]) -> list[Column]:
    """A 3x4 row-major matrix on (x, y, z)."""
    return [m[4 * i] * point[0] + m[4 * i + 1] * point[1] + m[4 * i + 2] * point[2] + m[4 * i + 3] for i in range(3)]


def invert_affine(m: list[float]) -> list[float]:
    """The inverse 3x4 matrix; a determinant below 1e-12 is refused."""
    a, b, c, d, e, f, g, h, i = m[0], m[1], m[2], m[4], m[5], m[6], m[8], m[9], m[10]
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if abs(det) < 1e-12:
        raise ValueError("the affine is singular")
    r = [(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det, (f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det, (d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]
    t = [m[3], m[7], m[11]]
    return [v for k in range(3) for v in (*r[3 * k : 3 * k + 3], -sum(r[3 * k + j] * t[j] for j in range(3)))]


def normalise_ct(v: Column, mean: float = 106.0, std: float = 53.0, top: float = 212.0) -> Column:
    """Clipped to [0, top], centred and scaled; not-a-number is 0 before that."""
    return (F.least(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), F.lit(top)) - mean) / std


def quantise(p: Column) -> Column:
    return F.bround(p * 255).cast("smallint")


def parse_region(text: Column) -> Column:
    """A struct z0, z1, y0, y1, x0, x1, reason of "z0:z1,y0:y1,x0:x1": reason is null if the half-open box is valid."""
    form = r"^\s*(-?\d+):(-?\d+),(-?\d+):(-?\d+),(-?\d+):(-?\d+)\s*$"
    names = ("z0", "z1", "y0", "y1", "x0", "x1")
    parts = {n: F.when(text.rlike(form), F.regexp_extract(text, form, i + 1).cast("long")) for i, n in enumerate(names)}
    reason = F.when(~F.coalesce(text.rlike(form), F.lit(False)), "form")
    for axis in "zyx":
        reason = reason.when(parts[f"{axis}0"] < 0, f"negative {axis}").when(parts[f"{axis}0"] >= parts[f"{axis}1"], f"empty {axis}")
    return F.struct(*[c.alias(n) for n, c in parts.items()], reason.alias("reason"))


def chunk_coordinate(number: Column, gy: int, gx: int) -> list[Column]:
    """cz, cy, cx of a chunk's number."""
    return [F.floor(number / (gy * gx)).alias("cz"), (F.floor(number / gx) % gy).alias("cy"), (number % gx).alias("cx")]


def level_shape(size: Column, level: Column) -> Column:
    """Voxels along an axis after level halvings, rounded up."""
    step = F.pow(F.lit(2.0), level)
    return F.ceil(size / step)


def record_seed(seed: int, record: Column, index: Column) -> Column:
    """A 32-bit seed of a record and an index."""
    return hash_number(F.concat_ws(":", F.lit(seed), record, index))


def canonical_sha(columns: list[str]) -> Column:
    """sha256 of the row's JSON with keys in the order of their names; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def compose_affine(a: list[float], b: list[float]) -> list[float]:
    """The 3x4 matrix that does b first and then a."""
    out = []
    for i in range(3):
        row = a[4 * i : 4 * i + 4]
        out += [sum(row[k] * b[4 * k + j] for k in range(3)) + (row[3] if j == 3 else 0) for j in range(4)]
    return out


def affine_scale(m: list[float]) -> float:
    """How many source units make one target unit along an axis: the determinant to the power of -1/3."""
    det = m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])
    return abs(det) ** (-1 / 3)


def box_image(origin: list[Column], shape: list[Column], m: list[float], margin: float = 0.0) -> list[Column]:
    """lo and hi (x, y, z) of a box's image under an affine, by the signs of its coefficients rather than eight corners."""
    lo, hi = [], []
    for i in range(3):
        start = sum((m[4 * i + j] * origin[j] for j in range(3)), F.lit(m[4 * i + 3]))
        lo.append(start + sum((min(m[4 * i + j], 0.0) * shape[j] for j in range(3)), F.lit(-margin)))
        hi.append(start + sum((max(m[4 * i + j], 0.0) * shape[j] for j in range(3)), F.lit(margin)))
    return [*lo, *hi]


def window_steps(size: Column, patch: int, overlap: float) -> Column:
    """First places of windows that cover an axis at even distances with at least that overlap; halves round to even."""
    step = max(1, round(patch * (1.0 - overlap)))
    count = F.ceil((size - patch) / step) + 1
    steps = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.bround(i * (size - patch) / (count - 1)).cast("int"))
    return F.when(size <= patch, F.array(F.lit(0))).otherwise(steps)


def teacher_steps(size: Column, patch: int, share: float) -> Column:
    """The same with a step of a share of the window, cut to a whole number, and no place beyond the last one."""
    step = max(1, int(patch * share))
    count, most = F.ceil((size - patch) / step) + 1, size - patch
    steps = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.least(F.bround(most / (count - 1) * i), most).cast("int"))
    return F.when(most <= 0, F.array(F.lit(0))).otherwise(steps)


def importance(distances: list[Column], sigma: float, least: float = 1e-4) -> Column:
    """Gaussian weight of a voxel by its distances from a window's centre."""
    square = sum((d * d for d in distances[1:]), distances[0] * distances[0])
    return F.greatest(F.exp(-square / (2 * sigma * sigma)), F.lit(least))


def local_origin(centre: list[Column], key: Column, volume: list[int], patch: int, window: int, inset: int) -> list[Column]:
    """First voxel of a patch around a centre, moved by hashes of a key so that the centre stays in the central window."""
    low, high = max((patch - window) // 2 + inset, 0), min((patch + window) // 2 - inset, patch - 1)
    room = max(1, high - low + 1)
    out = []
    for i, c in enumerate(centre):
        local = low + hash_number(F.concat_ws(":", key, F.lit(i))) % room
        out.append(F.least(F.greatest(F.bround(c).cast("long") - local, F.lit(0)), F.lit(volume[i] - patch)))
    return out


def crosswrap(b: list[Column], centre: tuple[float, float], pitch: float) -> list[Column]:
    """An end (y, x) pushed away from the centre by the pitch and rounded; null within a distance of 1."""
    dy, dx = b[0] - centre[0], b[1] - centre[1]
    size = F.sqrt(dy * dy + dx * dx)
    return [F.when(size >= 1.0, F.bround(c + pitch * d / size).cast("int")) for c, d in ((b[0], dy), (b[1], dx))]


def bezier(a: list[Column], ta: list[Column], b: list[Column], tb: list[Column], samples: int = 20) -> Column:
    """An array of samples + 1 points (t, y, x) of the cubic curve between two ends with outward tangents."""
    reach = F.sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) / 3
    controls = [(a[i], a[i] + reach * ta[i], b[i] + reach * tb[i], b[i]) for i in range(2)]

    def at(i: Column) -> Column:
        t = i / float(samples)
        u = 1 - t
        y, x = (u * u * u * p + 3 * u * u * t * q + 3 * u * t * t * r + t * t * t * s for p, q, r, s in controls)
        return F.struct(t.alias("t"), y.alias("y"), x.alias("x"))

    return F.transform(F.sequence(F.lit(0), F.lit(samples)), at)


def polyline_length(points: Column) -> Column:
    """Length of an array of points (y, x)."""
    n = F.size(points)
    pairs = F.arrays_zip(F.slice(points, F.lit(1), n - 1).alias("p"), F.slice(points, F.lit(2), n - 1).alias("q"))
    step = F.transform(pairs, lambda s: F.sqrt((s.q.y - s.p.y) ** 2 + (s.q.x - s.p.x) ** 2))
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + v)


def arc_ratio(a: list[Column], ta: list[Column], b: list[Column], tb: list[Column], samples: int = 20) -> Column:
    """Length of the curve over that of its chord; 1 for ends at one place.

    The polynomial's coefficients are worked out once a curve; a step between two samples is their sum weighted with constants.
    """
    chord = F.sqrt((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)
    reach, powers = chord / 3, {}
    for i, c in enumerate("yx"):
        p, q, r, s = a[i], a[i] + reach * ta[i], b[i] + reach * tb[i], b[i]
        powers |= {f"{c}1": 3 * (q - p), f"{c}2": 3 * (r - 2 * q + p), f"{c}3": s - 3 * r + 3 * q - p}
    curve = F.struct(*[v.cast("double").alias(n) for n, v in powers.items()])
    t = [k / samples for k in range(samples + 1)]
    steps = F.array(*[F.struct(F.lit(v * v - u * u).alias("d2"), F.lit(v * v * v - u * u * u).alias("d3")) for u, v in zip(t, t[1:], strict=False)])

    def length(w: Column) -> Column:
        def step(total: Column, d: Column) -> Column:
            dy, dx = (w[f"{c}1"] / samples + w[f"{c}2"] * d["d2"] + w[f"{c}3"] * d["d3"] for c in "yx")
            return total + F.sqrt(dy * dy + dx * dx)

        return F.aggregate(steps, F.lit(0.0), step)

    return F.when(chord < 0.001, 1.0).otherwise(F.transform(F.array(curve), length)[0] / chord)

"""Necks against plain loops over small masks."""

import math

import numpy as np

from lamina.operators import necks


def picture(z=0, gap=4, shift=0):
    """Two squares of 9 joined by a bar that is one pixel high, and a tail that joins nothing."""
    out = {(z, y, x) for y in range(9) for x in range(9)} | {(z, y, x + 9 + gap) for y in range(9) for x in range(9)}
    return {(a, b + shift, c) for a, b, c in out | {(z, 4, 9 + k) for k in range(gap)} | {(z, 9 + k, 2) for k in range(5)}}


def widths(mask, reach=4):
    half = {}
    for z, y, x in mask:
        d = [math.hypot(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if math.hypot(a, b) <= reach and (z, y + a, x + b) not in mask]
        half[z, y, x] = min(d, default=reach)
    return {(z, y, x): max([half[z, y, x], *(h for (q, v, u), h in half.items() if q == z and math.hypot(v - y, u - x) < h)]) for z, y, x in mask}


def rows(spark, cells):
    return spark.createDataFrame(sorted(cells), "z int, y int, x int")


def test_widths_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    mask = {tuple(map(int, c)) for c in np.argwhere(rng.random((2, 16, 16)) < 0.85)}
    got = {(r.z, r.y, r.x): r.width for r in necks.local_width(rows(spark, mask)).collect()}
    want = widths(mask)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_necks_are_found_certified_and_persistent(spark):
    mask = picture(0) | picture(3) | picture(5, shift=1) | picture(40) | picture(60, gap=20)
    found = necks.find_necks(rows(spark, mask), centre=(4.0, -50.0))
    got = {r.z: r for r in necks.neck_support(found).collect()}
    assert sorted(got) == [0, 3, 5, 40]  # the long bar is none
    one = got[0]
    assert one.bodies == 2 and one.certified and one.width <= 1.9 and abs(one.my - 4) <= 1 and 9 <= one.mx <= 12 and one.ax < one.bx and one.length <= 6
    assert [got[z].support for z in (0, 3, 5, 40)] == [3, 3, 3, 1] and [got[z].persistent for z in (0, 40)] == [True, False]
    across = necks.find_necks(rows(spark, picture(0)), centre=(-500.0, 11.0)).first()
    assert not across.certified and across.radial_dot < 0.2
    assert necks.find_necks(rows(spark, picture(0))).where("not certified and dr is null").count() == 1
    tail = {c for c in picture(0) if c[2] < 9}
    assert necks.find_necks(rows(spark, tail), centre=(0.0, 0.0)).count() == 0
    assert necks.neck_support(necks.find_necks(rows(spark, []), centre=(0.0, 0.0))).count() == 0

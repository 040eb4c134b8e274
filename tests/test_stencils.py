"""Stencils whose neighbourhoods and views are dealt out."""

from lamina.operators import stencils


def test_mirrored_views_are_dealt_out_first(spark, capsys):
    rows = [(z, y, x, f, float(z + y * 3 + x * 7 + f)) for z in range(3) for y in range(4) for x in range(5) for f in range(8)]
    got = stencils.mirror_average(spark.createDataFrame(rows, "z int, y int, x int, flip int, p double"), (3, 4, 5))
    got.explain()
    plan = capsys.readouterr().out
    assert plan.index("partial_avg(p") < plan.index("REPARTITION_BY_NUM")  # the plan reads from the last step to the first
    back = lambda v, n, f, bit: n - 1 - v if f >> bit & 1 else v
    for r in got.collect():
        seen = [back(r.z, 3, f, 0) + back(r.y, 4, f, 1) * 3 + back(r.x, 5, f, 2) * 7 + f for f in range(8)]
        assert abs(r.p - sum(seen) / 8) < 1e-6 and r.views == 8


def test_voxels_beside_a_mask(spark, capsys):
    mask = {(0, 0, 0), (15, 3, 63), (16, 3, 63), (-1, -1, 5), (4, 4, 4), (4, 4, 6)}
    got = stencils.beside(spark.createDataFrame([*mask, (0, 0, 0)], "z int, y int, x int"), 6)
    want = {tuple(a + b for a, b in zip(at, step, strict=True)) for at in mask for step in [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]}
    rows = [tuple(r) for r in got.select("z", "y", "x").collect()]
    assert set(rows) == want and len(rows) == len(want)

"""Typed scans of text files: line numbers, reasons, odd lines and empty files."""

import json

import pytest

from lamina.sources import records


def write(folder, name, lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def found(scan):
    return sorted((r.line, r.reason) for r in scan.violations.collect())


def test_line_numbers_over_blocks(spark, tmp_path):
    for name, n in (("a.txt", 700), ("b.txt", 3)):
        write(tmp_path, name, [f"{name} {i + 1}" for i in range(n)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = records.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 703
    assert all(r.value == f"{r.file.rsplit('/', 1)[1]} {r.line}" for r in rows)


PAIR = {"record_id": "r", "scroll_id": "s", "split": "train", "coarse": {"scan_id": "c", "voxel_um": 7}, "fine": {"scan_id": "f", "voxel_um": "2.5"}, "surfaces": [{"surface_id": "a", "coarse_tifxyz": "x", "fine_tifxyz": "/y"}]}


def test_pairs(spark, tmp_path):
    lines = [json.dumps(PAIR), "", "# note", '{"record_id": 1}}', "[]", "null", '"text"', json.dumps(PAIR | {"record_id": 5}), json.dumps(PAIR | {"record_id": " "}), json.dumps(PAIR | {"record_id": "t", "fine": None}), json.dumps(PAIR | {"record_id": "u", "surfaces": [None]}), json.dumps(PAIR | {"record_id": "v", "surfaces": "no"}), json.dumps(PAIR | {"record_id": "w", "coarse": {"scan_id": "c", "voxel_um": "nan"}}), json.dumps(PAIR | {"record_id": "x", "extra": {"file": 1}, "line": "clash"}), json.dumps(PAIR) + "," + json.dumps(PAIR), json.dumps(PAIR) + "],[1", json.dumps(PAIR | {"record_id": "y" * 50_000})]
    scan = records.scan_pairs(records.numbered_lines(spark, write(tmp_path, "pairs.jsonl", lines)))
    rows = {r.record_id[:2]: r for r in scan.rows.collect()}
    assert sorted(rows) == ["5", "r", "x", "yy"] and rows["x"].line == 14
    assert rows["r"].fine.voxel_um == 2.5 and rows["r"].surfaces[0].sheet_id == "a" and rows["r"].surfaces[0].supervision_weight == 1.0
    assert rows["r"].surfaces[0].coarse_tifxyz.endswith(f"{tmp_path}/x") and rows["r"].surfaces[0].fine_tifxyz == "/y"
    no = "not a JSON object"
    assert found(scan) == [(4, no), (5, no), (6, no), (7, no), (9, "record_id is required"), (10, "fine.scan_id is required"), (11, "surfaces: surface_id is required"), (12, "surfaces must be a non-empty array"), (13, "coarse.voxel_um must be positive"), (15, no), (16, no)]


def test_repeated_keys_and_empty_files(spark, tmp_path):
    scan = records.scan_pairs(records.numbered_lines(spark, write(tmp_path, "p.jsonl", [json.dumps(PAIR)] * 2)))
    assert scan.rows.count() == 0 and found(scan.__class__(scan.rows, scan.violations.where("line is not null"))) == [(1, "record_id repeated"), (2, "record_id repeated")]
    empty = records.numbered_lines(spark, write(tmp_path, "e.jsonl", ["", "# note"]))
    for read in (records.scan_pairs, records.scan_patches):
        assert [tuple(r) for r in read(empty).violations.collect()] == [(None, None, "no rows")]
    assert found(records.scan_sites(empty.where("line = 1"))) == [(None, "no rows")]
    assert records.scan_history(empty.limit(0)).rows.count() == 0 and records.read_joins(empty.limit(0)).count() == 0


def test_inventory(spark, tmp_path):
    rows = [{"kind": "chunk", "relative_path": "a/0/1/2", "known_voxels": 0, "size": 3}, {"kind": "chunk", "relative_path": "a/0.1.3"}, {"kind": "chunk", "relative_path": "b/0/1/2"}, {"kind": "chunk", "relative_path": "a/.zarray"}, {"kind": "chunk", "coordinate_zyx": [0, 0, 9], "size": 1}, {"kind": "chunk", "coordinate_zyx": [1, 0, 0], "size": 0, "positive_voxels": "4"}, {"kind": "chunk", "coordinate_zyx": [0, 0]}, {"kind": "array"}, {"kind": "chunk", "relative_path": "a\\1\\1\\1", "size": "x"}, {"kind": "chunk", "relative_path": None}]
    scan = records.scan_inventory(records.numbered_lines(spark, write(tmp_path, "i.jsonl", map(json.dumps, rows))), (2, 2, 4), "a")
    assert sorted((r.chunk_id, r.state, r.positive) for r in scan.rows.collect()) == [(6, "unknown", 0), (7, "retained", 0), (8, "zero_byte", 4)]
    assert found(scan) == [(5, "coordinate outside the grid"), (7, "coordinate isn't three-dimensional"), (9, "size must be a number from 0")]
    assert {r.state: (r.chunks, r.bytes) for r in records.inventory_summary(scan.rows).collect()} == {"unknown": (1, 3), "retained": (1, 0), "zero_byte": (1, 0)}


def test_cases(spark, tmp_path):
    write(tmp_path, "a.csv", ["id,dice,voi", "1,0.5,nan", "2,,3"])
    write(tmp_path, "b.csv", ["id,dice,voi", "3,0.7,x"])
    means = {r.metric: (r.n, round(r.mean, 6)) for r in records.case_means(records.read_cases(spark, str(tmp_path))).collect()}
    assert means == {"dice": (2, 0.6), "voi": (1, 3.0)}
    write(tmp_path, "c.csv", ["id,voi,dice", "4,1,1"])
    with pytest.raises(Exception, match="header|schema"):
        records.read_cases(spark, str(tmp_path)).collect()


def test_history_and_rejects(spark, tmp_path):
    lines = [json.dumps({"epoch": e}) for e in (1, 2, 4, "x")] + ["{", json.dumps({"epoch": 6})]
    scan = records.scan_history(records.numbered_lines(spark, write(tmp_path, "h.jsonl", lines)))
    assert sorted(r.epoch for r in scan.rows.collect()) == [1, 2, 6]
    assert found(scan) == [(3, "expected epoch 3"), (4, "epoch must be an integer"), (5, "not a JSON object")]
    joins = [{"z": 1, "a": {"y": 2, "x": i}, "b": {"y": 4, "x": 5}, "reason": r} for i, r in enumerate(["tangent", "radial", "tangent", "evidence", "tangent"])]
    numbered = records.numbered_lines(spark, write(tmp_path, "r.jsonl", map(json.dumps, joins)))
    got = [(r.line, r.row_id) for r in records.read_rejects(numbered, ["tangent", "evidence"], 3).collect()]
    assert got == [(1, "reject:tangent_z1_a2_0_b4_5"), (3, "reject:tangent_z1_a2_2_b4_5"), (4, "reject:evidence_z1_a2_3_b4_5")]
    assert records.read_joins(numbered).count() == 0 and records.read_joins(numbered, kept_only=False).count() == 5


def test_surface_points(spark):
    nan = float("nan")
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0), (2, 0, nan, 1.0, 1.0), (2, 2, None, 1.0, 1.0), (4, 0, -1.0, -1.0, -1.0), (1, 0, 5.0, 5.0, 5.0), (4, 4, 5.0, 5.0, 5.0)], "row int, col int, x double, y double, z double")
    assert sorted((r.row, r.col) for r in records.surface_points(cells, 2).collect()) == [(0, 2), (4, 4)]
    masked = cells.selectExpr("*", "if(row = 4, 0, 1) as mask")
    assert sorted((r.row, r.col) for r in records.surface_points(masked, 2).collect()) == [(0, 0), (0, 2)]


def test_lines_are_parsed_few_times(spark, capsys):
    texts = ['{"schema_version": 1}', '\t {"a": 1}', "[1]", "1", '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1}, "b": 2', '{"a": 1}] [{"b": 2}', '{"a": 1, "a": 2}', "{", '"{"']
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line long, value string")
    marked = records.screened(lines, records.PAIR, [])
    assert [r.reason is None for r in marked.orderBy("line").collect()] == [True, True] + [False] * 9
    marked.explain("extended")
    plan = capsys.readouterr().out
    physical = plan[plan.index("== Physical Plan ==") :]
    assert max(line.count("VariantExpressionEvalUtils") for line in physical.splitlines()) <= 2

"""Sources with failures of their own, and header rows found in sheets."""

from quillstream.sources import isolated

LABELS = {"code": ["Employee Id", "Emp Code"], "name": ["Full Name"], "pay": ["Annual CTC (₹)"]}


def test_each_source_fails_alone(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/good")
    spark.range(5).write.parquet(f"{tmp_path}/damaged")
    for f in (tmp_path / "damaged").glob("part-*"):
        f.write_bytes(b"PAR1 not parquet PAR1")
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": \n{"a": "x"}\n{"a": 3}\n')
    (tmp_path / "rows.csv").write_text("1,x\nno number,y\n2,z\n")
    S = isolated.Source
    got = isolated.gather(spark, [S("good", f"{tmp_path}/good", "id long"), S("damaged", f"{tmp_path}/damaged", "id long"), S("gone", f"{tmp_path}/gone", "id long"), S("lines", f"{tmp_path}/lines.json", "a int", "json"), S("rows", f"{tmp_path}/rows.csv", "n int, s string", "csv"), S("none", "x", "id long", wanted=False)])
    report = {r.source: r for r in got.report.collect()}
    assert {n: (r.state, r.rows, r.corrupt) for n, r in report.items()} == {"good": ("ok", 5, 0), "damaged": ("failed", 0, 0), "gone": ("failed", 0, 0), "lines": ("partial", 2, 2), "rows": ("partial", 2, 1), "none": ("skipped", 0, 0)}
    assert report["gone"].error == "PATH_NOT_FOUND" and report["damaged"].error and report["good"].error is None
    assert sorted(r.id for r in got.tables["good"].collect()) == list(range(5)) and got.tables["gone"].columns == ["id"] and got.tables["gone"].count() == 0
    assert [r[0] for r in got.corrupt["rows"].collect()] == ["no number,y"]


def test_headers_in_sheets(spark, tmp_path):
    (tmp_path / "master.csv").write_text('Employee Id,Full Name,Grade\n E1 ,"Roy, A ""Ann""",L5\n,,\nE2,,L6\n')
    (tmp_path / "pay.csv").write_text("Compensation 2026\n\nnote,Full Name\nFULL NAME,emp-code,Annual CTC (₹)\nB,E2,100\n")
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    rows = isolated.delimited(spark, f"{tmp_path}/*.csv")
    found = {r.file.rsplit("/", 1)[1]: (r.header, r.columns) for r in isolated.header_rows(rows, LABELS).collect()}
    assert found == {"master.csv": (0, {"code": 0, "name": 1}), "pay.csv": (3, {"code": 1, "name": 0, "pay": 2})}
    values, without = isolated.sheet_records(rows, LABELS)
    assert sorted((r.code, r.name or "", r.pay or "") for r in values.collect()) == [("E1", 'Roy, A "Ann"', ""), ("E2", "", ""), ("E2", "B", "100")]
    assert [r.file.rsplit("/", 1)[1] for r in without.collect()] == ["other.csv"]

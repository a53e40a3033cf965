"""Guards of uploads, redaction in tables and listing counters, by the rules they must follow."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docketry.functions import tables, text
from docketry.operators import review
from docketry.sources import files


def archive(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return zipfile.ZipFile(io.BytesIO(b.getvalue()))


RELS = "word/_rels/document.xml.rels"


@pytest.mark.parametrize(
    ("parts", "reason"),
    [
        ({"word/embeddings/oleObject1.bin": "x", "word/charts/chart1.xml": "<c/>"}, None),  # an ordinary chart
        ({RELS: '<R Target="https://example.org" TargetMode="External"/>'}, None),
        ({RELS: '<R Target="file:///x"/>'}, None),  # not to the outside
        ({RELS: '<R Target="ms-msdt:/id" TargetMode="External"/>'}, "unsafe relationship"),
        ({RELS: '<R TargetMode="External" Target="FILE:///x"/>'}, "unsafe relationship"),
        ({RELS: "<R TargetMode = 'external' Target='javascript:x'/>"}, "unsafe relationship"),
        ({RELS: " " * (2 << 20) + '<R TargetMode="External" Target="file:///x"/>'}, None),  # too large to be read as relations
        *(({f"word/a{x}": "x"}, "active content") for x in (".cmd", ".scr", ".com", ".exe", ".dll", ".bat", ".ps1", ".vbs", ".JS", "/vbaProject.bin")),
        ({"a/../../b": "x"}, "path leaves"),
        ({"a\\..\\b": "x"}, "path leaves"),
        ({"/abs": "x"}, "path leaves"),
        ({"a..b/c:d": "x"}, None),
        ({"big": b"\0" * (251 << 20)}, "archive expands"),
        ({"large": b"\0" * (249 << 20)}, None),
        ({str(i): "" for i in range(10_001)}, "archive expands"),
    ],
)
def test_archives(parts, reason):
    got = files.unsafe_archive(archive(parts))
    assert got is None if reason is None else got.startswith(reason)


def test_large_files_are_listed_without_their_content(spark, tmp_path, monkeypatch):
    assert files.MAX_BYTES == 52_428_800
    monkeypatch.setattr(files, "MAX_BYTES", 10)
    (tmp_path / "a.txt").write_text("0123456789")
    (tmp_path / "b.txt").write_text("0123456789x")
    pages = files.read_pages(spark, f"file://{tmp_path}")
    assert sorted((r.filename, r.error) for r in pages.collect()) == [("a.txt", None), ("b.txt", "file is too large")]
    scans = [line for line in pages._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan binaryFile" in line]
    small, large = sorted(scans, key=lambda s: "GreaterThan(length" in s)
    assert "LessThanOrEqual(length" in small and "GreaterThan(length" in large and "content" not in large


def test_cells_are_redacted(spark):
    rows = [["name", "tel 13812345678"], ["联系人：某某", " a  b "], ["", None], ["<td>０２１-12345678</td>", "11010119900101123X"]]
    frame = spark.createDataFrame([(1, 0, rows, "name tel 13812345678 a b")], "doc int, seq int, rows array<array<string>>, page_text string")
    got = frame.select(tables.clean_rows(F.col("rows"))).first()[0]
    assert got == [["name", "tel ［已隐去电话］"], ["［已隐去联系人/评审专家姓名］", "a b"], ["<td>［已隐去电话］</td>", "［已隐去证件号］"]]
    assert got[0][1] == frame.select(text.redact(F.lit("tel 13812345678"))).first()[0]
    # a table whose number is only in the page is no longer supported by it
    phones = spark.createDataFrame([(1, 0, [["alpha", "13812345678"], ["beta", "gamma"]], "alpha 13812345678 beta gamma"), (2, 0, [["alpha", "delta"], ["beta", "gamma"]], "alpha delta beta gamma")], frame.schema)
    assert [r.doc for r in tables.first_supported(phones, "doc", "seq").collect()] == [2]


def test_grid_cells_are_redacted_and_become_html(spark):
    lines = spark.createDataFrame([(1, 0, "电话 138", 0.0, 0.0, 10.0, 8.0), (1, 1, "12345678", 0.5, 1.0, 10.0, 9.0), (1, 2, "plain & <b>", 20.0, 0.0, 30.0, 8.0)], "page int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    grid = spark.createDataFrame([(1, r, c, c * 20.0, r * 10.0, c * 20.0 + 12, r * 10.0 + 9) for r in range(2) for c in range(2)], "page int, row int, col int, x0 double, y0 double, x1 double, y1 double")
    filled = tables.lines_in_grid(lines, grid, "page")
    assert {(r.row, r.col): r.text for r in filled.collect()} == {(0, 0): "电话 ［已隐去电话］", (0, 1): "plain & <b>"}
    html = tables.grid_html(filled, grid, "page").first().html
    assert html == "<table><thead><tr><th>电话 ［已隐去电话］</th><th>plain &amp; &lt;b&gt;</th></tr></thead><tbody><tr><td></td><td></td></tr></tbody></table>"


def test_listing_counters(spark):
    req = [(1, c, s) for c in ("FATAL", "QUALIFICATION", "SCORING") for s in ("PASS", "FAIL", "UNKNOWN", "NEEDS_REVIEW")]
    requirements = spark.createDataFrame(req, "run_id int, category string, status string")
    runs = spark.createDataFrame([(1, 99, 99, 99, 99), (2, 5, 4, None, 2)], "run_id int, requirement_count int, unresolved_count int, blocker_count int, fatal_risk_count int")
    got = {r.run_id: (r.total, r.unresolved, r.blockers, r.fatal) for r in review.run_summaries(runs, requirements).collect()}
    assert got == {1: (12, 6, 6, 4), 2: (5, 4, 0, 2)}
    assert [tuple(r) for r in review.run_summaries(runs.select("run_id").filter("run_id = 2"), requirements).collect()] == [(2, 0, 0, 0, 0)]

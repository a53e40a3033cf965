"""Every registered query against its oracle, the rest of the library against small cases."""

import glob
import io
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from docketry.functions import metrics, text
from docketry.operators import evaluate, rules, store, timewin, validate
from docketry.plans import catalog
from docketry.sources import files


def plain(rows):
    return sorted(tuple("N" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(got.select(*cols).collect()) == plain(want)


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(*columns).first()


def test_text(spark):
    r = one(spark, text.norm(F.col("a")), text.redact(F.col("b")), text.html_to_text(F.col("c")), F.to_json(text.key_fields(F.col("d"))), text.is_toc(F.col("e")), a="Ａ B　c D", b="电话13812345678\n联系人：某某\n金额", c="<p>a &amp;  b</p><br>c", d="项目编号：AB-2024-001\n采购人：医院\n预算金额：13812345678", e="目\n录\n一")
    assert r[0] == "abcd" and r[1] == "电话［已隐去电话］\n［已隐去联系人/评审专家姓名］\n金额" and r[2] == "a & b\nc" and r[4]
    assert r[3] == '[{"name":"project_code","value":"AB-2024-001"},{"name":"purchaser","value":"医院"}]'
    r = one(spark, text.redact(F.col("b")), text.page_types(F.col("c")), b="<table><tr><td>联系人：某某</td><td>x</td></tr></table>", c="公章 目录")
    assert r[0] == "<table><tr><td>［已隐去联系人/评审专家姓名］</td><td>x</td></tr></table>" and r[1] == ["seal", "toc"]


def test_metrics(spark):
    line_edits = lambda a, b: tuple(one(spark, metrics.line_edit_counts("a", "b"), a=a, b=b)[0])
    assert line_edits("ab\ncd", "cd\nab") == (0, 4) and line_edits("abcdefghij", "abcdxxxxij") == (4, 10)
    assert line_edits("", "x") == (1, 1) and line_edits("ab", "ab\nzz") == (2, 2) and line_edits("", " \n") == (0, 0)
    assert line_edits("ＡＢ c\r\nx\x1cy", "y\u2028x\x85a bC") == (0, 5) and line_edits("ab", "") == (2, 2)
    a, b = "<table><tr><td>1</td><td>2</td></tr></table>", "<table><tr><td>1</td><td>3</td></tr></table>"
    assert metrics.table_similarity(a, a) == 1 and metrics.table_similarity("", a) == 0 and metrics.table_similarity(None, None) == 1
    assert metrics.table_similarity(a, b) == 0.75 and metrics.table_similarity(b + a, a) == 1
    assert one(spark, metrics.wer("a", "b"), metrics.toc_lines(F.split("c", "\n")), a="x，y z", b="x q z", c="目\n录\n第一章\n总则......\n3\n正文") == (1 / 3, ["目录", "第一章总则3", "正文"])
    gates = [metrics.gate(line_cer=F.lit(x), key_field_f1=F.lit(0.98), teds=F.lit(y)) for x, y in ((0.01, 0.95), (0.03, 0.95), (0.01, None))]
    assert list(spark.range(1).select(*gates).first()) == ["GATE_PASS", "GATE_FAIL", "GATE_FAIL"]


def test_rules_and_evidence(spark):
    pages = spark.createDataFrame([(1, 1, "投标人资格要求：资质证书，资质证书。投标截止"), (1, 2, "废标")], "doc int, page int, text string")
    found = rules.scan(pages, "doc", "page", "text")
    assert [(r.seq, r.category, r["at"], r.hit) for r in found.orderBy("seq").collect()] == [(1, "QUALIFICATION", 0, "投标人资格"), (2, "DEADLINE", 18, "投标截止"), (3, "CREDENTIAL", 8, "资质证书"), (4, "CREDENTIAL", 13, "资质证书"), (5, "FATAL", 0, "废标")]
    assert sorted(r.seq for r in rules.first_wins(found, "doc", "page").collect()) == [1, 2, 3, 5]
    req = spark.createDataFrame([(1, "a", "资质证书", "CREDENTIAL"), (1, "b", "保函", "BOND"), (1, "c", "评分", "SCORING"), (2, "d", "x", "BOND")], "doc int, requirement_id string, title string, category string")
    ev = spark.createDataFrame([(1, 1, "保证金保函", "FAILED"), (1, 2, "资 质", None), (1, 3, "证书", None)], "doc int, page int, text string, ocr_status string")
    got = {r.requirement_id: (r.status, r.evidence_page, r.suggested_status) for r in rules.match_evidence(req, ev).collect()}
    assert got == {"a": ("NEEDS_REVIEW", 2, "PASS"), "b": ("UNKNOWN", None, None), "c": (None, None, None), "d": ("UNKNOWN", None, None)}


def test_candidate_score_and_overlaps(spark):
    rows = [("BOND", "保证金金额 5 万元"), ("BOND", "按时到账"), ("CREDENTIAL", "资质证书"), ("SCORING", "每提供一项得 2 分"), ("DEADLINE", "开标时间 2024 年 5 月 1 日"), ("FATAL", "废标" + "." * 21), ("NONE", "废标")]
    got = spark.createDataFrame(rows, "category string, quote string").select(rules.candidate_score(F.col("category"), F.col("quote"))).collect()
    assert [r[0] for r in got] == [12, 4, 10, 12, 14, -96, 0]
    boxes = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 1.0, 3.0), (1, 3, 3.0, 4.0), (2, 1, 0.0, 9.0)], "page int, item int, lo double, hi double")
    assert {tuple(r) for r in rules.overlaps(boxes, boxes, "page", "item").collect()} == {(1, 1, 1, 1.0), (1, 2, 1, 1.0), (1, 3, 0, 0.0), (2, 1, 0, 0.0)}


def test_accuracy_status(spark):
    rows = [("X", True, True, True)] * 18 + [("X", True, False, True)] * 2 + [("Y", True, True, False)] * 25
    a = {r.category: r for r in evaluate.accuracy(spark.createDataFrame(rows, "category string, predicted boolean, actual boolean, complete boolean")).collect()}
    assert a["X"].status == "MEASURABLE" and a["X"].precision == 0.9 and a["X"].miss == 0 and a["Y"].status == "INSUFFICIENT" and a["Y"].false_positive is None


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, revision int, v string")
    assert {tuple(r) for r in store.compare_and_set(old, spark.createDataFrame([("a", 1), ("b", 1)], "k string, revision int"), "k").collect()} == {("a", 2, "APPLIED"), ("b", 2, "CONFLICT")}
    assert {tuple(r) for r in store.merge_non_null(old, spark.createDataFrame([("a", None), ("b", "z")], "k string, v string"), "k").collect()} == {("a", 1, "x"), ("b", 2, "z")}
    assert store.delete_cascade({"t": old}, "k", old.filter("k = 'a'"))["t"].count() == 1
    assert [r.k for r in store.page_after(old, ["revision", "k"], [2, "b"], 5).collect()] == ["a"]


def test_fixed_window_and_chain(spark):
    e = spark.sql("select * from values ('u', 1, timestamp'2024-01-01 00:00:00'), ('u', 2, timestamp'2024-01-01 00:00:05'), ('u', 3, timestamp'2024-01-01 00:00:09'), ('u', 4, timestamp'2024-01-01 00:00:10'), ('v', 5, timestamp'2024-01-01 00:00:03') t(k, id, ts)")
    assert [(r.id, r.hits, r.allowed) for r in timewin.fixed_windows(e, "k", "ts", "id", 10, 1).orderBy("id").collect()] == [(1, 1, True), (2, 2, False), (3, 2, False), (4, 1, True), (5, 1, True)]
    assert timewin.due_alerts(spark.createDataFrame([("2024-01-05",), ("bad",), ("2024-02-01",)], "d string"), "d", F.lit("2024-01-03").cast("date")).count() == 1


def test_validators(spark):
    rows = [("d", 1, "body", "t", [("n", "v")]), ("d", 1, "body", "t", []), ("", 0, "odd", None, [("", "v")])]
    got = validate.annotations(spark.createDataFrame(rows, "doc_id string, page int, page_type string, text_gt string, fields array<struct<name:string,value:string>>"))
    assert sorted(tuple(r.issues) for r in got.collect()) == [("doc_id", "page", "page_type", "text_gt", "fields"), ("duplicate",), ("duplicate",)]
    with pytest.raises(Exception, match="rejected"):
        validate.fail_closed(got).collect()


def test_files(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    made = {"a.docx": {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}, "b.xlsx": {"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>one</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c></row></sheetData></worksheet>'}, "c.pptx": {"ppt/slides/slide1.xml": '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sld>'}}
    for name, parts in made.items():
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(b.getvalue())
    (tmp_path / "d.txt").write_text("x\n\ny")
    (tmp_path / "e.docx").write_text("not a zip")
    (tmp_path / "f.doc").write_text("old")
    got = {(r.filename, r.page, r.kind, r.text) for r in files.read_pages(spark, f"file://{tmp_path}").collect() if not r.error}
    assert got == {("a.docx", 1, "paragraph", "Hello"), ("a.docx", 2, "table_cell", "cell"), ("b.xlsx", 1, "sheet", "A1: one | B1: 2"), ("c.pptx", 1, "slide", "Title"), ("d.txt", 1, "line_range", "x\n\ny")}
    assert files.read_pages(spark, f"file://{tmp_path}").filter("error is not null").count() == 2
    assert [files.column_label(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_stream(spark, tmp_path):
    from docketry.streaming import limiter

    src = tmp_path / "in"
    src.mkdir()
    spark.sql("select 'u' as key, timestamp'2024-01-01 00:00:00' + make_dt_interval(0,0,0,id*4) as ts from range(4)").coalesce(1).write.mode("append").parquet(f"file://{src}")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"file://{src}")
    q = limiter.fixed_window(stream, 10, 2).writeStream.format("memory").queryName("limits").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.hits, r.allowed) for r in spark.table("limits").collect()] == [(1, True)]

"""Readers and writers. Binary formats are parsed in Arrow batches from Spark's binaryFile source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import iso_valid

PAGE = "filename string, page int, kind string, label string, text string, blocks array<string>, error string"
#: Bounds of an upload and of an archive, suffixes and schemes that are refused.
MAX_BYTES = 50 * 1024 * 1024
MAX_EXPANDED = 250 * 1024 * 1024
MAX_PARTS = 10_000
MAX_RELATIONS = 2 * 1024 * 1024
MAX_PAGES = 500
REFUSED_SUFFIXES = (".exe", ".dll", ".com", ".scr", ".bat", ".cmd", ".ps1", ".vbs", ".js")
REFUSED_SCHEMES = (b"javascript:", b"file:", b"ms-msdt:")
MAGIC = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304"}


def _inside(node: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if x.tag.rpartition("}")[2] == tag]


def _text(node: ElementTree.Element) -> str:
    return "".join("".join(t.itertext()) for t in _inside(node, "t"))


def column_label(n: int) -> str:
    """1 -> A, 27 -> AA."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _docx(z: zipfile.ZipFile) -> Iterator[tuple[str, str, str, list[str]]]:
    body = _inside(ElementTree.fromstring(z.read("word/document.xml")), "body")[0]
    p = t = 0
    for child in body:
        kind = child.tag.rpartition("}")[2]
        if kind == "p" and (v := _text(child).strip()):
            p += 1
            yield "paragraph", f"段落 {p}", v, [v]
        elif kind == "tbl":
            t += 1
            rows = [x for x in child if x.tag.rpartition("}")[2] == "tr"]
            for r, row in enumerate(rows, 1):
                for c, cell in enumerate((x for x in row if x.tag.rpartition("}")[2] == "tc"), 1):
                    if v := " ".join(s for x in _inside(cell, "t") if (s := "".join(x.itertext()).strip())):
                        yield "table_cell", f"表格 {t} · 第 {r} 行 · 第 {c} 列", v, [v]


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple[str, str, str, list[str]]]:
    names = z.namelist()
    shared = [_text(x) for x in _inside(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    titles = [x.attrib.get("name", "").strip() for x in _inside(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")] if "xl/workbook.xml" in names else []
    for n, name in enumerate(sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=_number), 1):
        lines, cells = [], []
        for r, row in enumerate(_inside(ElementTree.fromstring(z.read(name)), "row"), 1):
            line = []
            for c, cell in enumerate(_inside(row, "c"), 1):
                value = next(("".join(x.itertext()) for tag in ("v", "t") for x in _inside(cell, tag)), "").strip()
                if cell.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)].strip()
                if value:
                    line.append(f"{cell.attrib.get('r') or column_label(c) + row.attrib.get('r', str(r))}: {value}")
            if line:
                lines.append(" | ".join(line))
                cells += line
        yield "sheet", titles[n - 1] if n <= len(titles) and titles[n - 1] else f"工作表 {n}", "\n".join(lines), cells


def _pptx(z: zipfile.ZipFile) -> Iterator[tuple[str, str, str, list[str]]]:
    for n, name in enumerate(sorted((x for x in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=_number), 1):
        blocks = [v for x in _inside(ElementTree.fromstring(z.read(name)), "p") if (v := _text(x).strip())]
        yield "slide", f"幻灯片 {n}", "\n".join(blocks), blocks


def unsafe_archive(z: zipfile.ZipFile) -> str | None:
    """Why an archive must not be opened: it expands too far, leaves its folder, or holds macros, programs or links
    to the outside by a scheme that runs or reads something. Embedded objects are allowed."""
    parts = z.infolist()
    if len(parts) > MAX_PARTS or sum(i.file_size for i in parts) > MAX_EXPANDED:
        return "archive expands too far"
    for i in parts:
        path = i.filename.replace("\\", "/")
        low = path.casefold()
        if path.startswith("/") or ".." in path.split("/"):
            return f"path leaves the archive: {i.filename}"
        if low.endswith(("vbaproject.bin", *REFUSED_SUFFIXES)):
            return f"active content: {i.filename}"
        if low.endswith(".rels") and i.file_size <= MAX_RELATIONS:
            relations = z.read(i).lower()
            if re.search(rb"targetmode\s*=\s*[\"']external[\"']", relations) and any(x in relations for x in REFUSED_SCHEMES):
                return f"unsafe relationship: {i.filename}"
    return None


def parse(name: str, content: bytes) -> Iterator[tuple]:
    """Page rows of one file; a file that can't be read is one row with an error."""
    kind = name.rpartition(".")[2].lower()
    try:
        if kind in ("txt", "md"):
            text = content.decode("utf-8", "replace")
            pages = [("line_range", "全文", text, [x.strip() for x in text.splitlines() if x.strip()])]
        elif kind in ("docx", "xlsx", "pptx"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if reason := unsafe_archive(z):
                    raise ValueError(reason)
                pages = list({"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](z)) or [("empty", "", "", [])]
        else:
            raise ValueError(f"unsupported type: {kind}")
    except Exception as e:  # one bad file must not stop the table; the row says why
        yield name, None, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    if kind == "pptx" and len(pages) > MAX_PAGES:
        yield name, None, None, None, None, None, "too many pages"
        return
    for n, (k, label, text, blocks) in enumerate(pages, 1):
        yield name, n, k, label, text, blocks, None


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder -> page rows. Suffix, size and magic bytes are tested before a file is opened; a file that
    is refused is one row that says why. Files that are too large are listed by a scan of their names and sizes alone,
    so their content, which may be of any size, is never loaded."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"[^/]+$", 0).alias("name")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    magic = F.lit(True)
    for kind, start in MAGIC.items():
        magic = magic & ((suffix != kind) | F.startswith("content", F.unhex(F.lit(start))))
    names = [x.split(" ")[0] for x in PAGE.split(", ")]
    large = every.filter(F.col("length") > MAX_BYTES).select(*(name.alias(n) if n == "filename" else F.lit("file is too large" if n == "error" else None).cast(kind).alias(n) for n, kind in (x.split(" ") for x in PAGE.split(", "))))
    files = every.filter(F.col("length") <= MAX_BYTES).select(name, F.when(magic, F.col("content")).alias("content"), F.when(~magic, F.lit("content does not fit the suffix")).alias("unsafe"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, c, e in zip(f["name"], f["content"], f["unsafe"], strict=True):
                rows = parse(n, bytes(c)) if e is None else [(n, None, None, None, None, None, e)]
                yield pd.DataFrame(rows, columns=names).astype({"page": "Int32"})

    return files.mapInPandas(run, PAGE).unionByName(large)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Strict: a bad line fails the action. Lenient: it is dropped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_ledger(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV of strings whose header must be exactly the contract's."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def unfinished(tasks: DataFrame, done: DataFrame, keys: Sequence[str], retry_failed: bool = False) -> DataFrame:
    """Resume: tasks without a result; with retry_failed also those whose result failed."""
    closed = done.filter(F.col("status") == "EXTRACTED") if retry_failed else done
    return tasks.join(closed.select(*keys), list(keys), "left_anti")


def read_cached(spark: SparkSession, path: str, schema: str = "page int, status string, provider string, text string") -> DataFrame:
    """Finished results of a folder of JSON pages."""
    return spark.read.schema(schema).json(path, multiLine=True).filter(F.col("status") == "EXTRACTED")


def read_or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """What `read` gives, or an empty table of the schema where the path is missing."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON report's one row; no row where it is missing, nulls where it is invalid."""
    return read_or_empty(lambda: spark.read.schema(schema).json(path, multiLine=True), spark, schema)


AUDIT_COLUMNS = ("event_id", "workspace_id", "run_id", "user_id", "event_type", "payload", "created_at", "outcome", "event_hash")
BOM = "\ufeff"


def _contract(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if tuple(df.columns) != tuple(columns):
        raise ValueError(f"columns must be {list(columns)}, not {df.columns}")
    return df


def write_report(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV of exactly the report's columns."""
    _contract(df, columns).write.mode("overwrite").csv(path, header=True)


def write_audit(df: DataFrame, path: str) -> None:
    """CSV of exactly the audit columns, the payload as JSON; each file begins with a byte-order mark, on its header."""
    rows = _contract(df, AUDIT_COLUMNS).withColumn("payload", F.to_json("payload"))
    rows.withColumnRenamed(AUDIT_COLUMNS[0], BOM + AUDIT_COLUMNS[0]).write.mode("overwrite").csv(path, header=True)


def append_ledger(df: DataFrame, path: str, columns: Sequence[str], key: str | None = None, times: Sequence[str] = (), dates: Sequence[str] = ()) -> DataFrame:
    """Append rows of exactly the ledger's columns and return the ledger; one there must have the same header. All or
    nothing: a row without its key, or with a time or (where it is given) a date that is none, keeps all of them out."""
    spark = df.sparkSession
    there = read_or_empty(lambda: read_ledger(spark, path, columns), spark, ", ".join(f"`{c}` string" for c in columns))
    there.limit(1).collect()  # fails on another header
    rows = _contract(df, columns)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    wrong = F.lit(False)
    if key:
        wrong = wrong | blank(key)
    for c in times:
        wrong = wrong | ~F.coalesce(iso_valid(F.col(c)), F.lit(False))
    for c in dates:
        wrong = wrong | (~blank(c) & ~F.coalesce(iso_valid(F.col(c)), F.lit(False)))
    if key or times or dates:
        bad = rows.filter(wrong).limit(1).collect()
        if bad:
            raise ValueError(f"a row lacks its {key or 'key'}, or a time or date is none: {bad[0].asDict()}")
    rows.write.mode("append").csv(path, header=True)
    return read_ledger(spark, path, columns)


def refuse_ledger(path: str) -> str:
    """The path, unless it looks like a business ledger, which reports must never overwrite."""
    if re.search(r"ledger", path.rpartition("/")[2], re.I):
        raise ValueError(f"refusing to write over a ledger: {path}")
    return path


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(refuse_ledger(path))


def write_snapshot(df: DataFrame, path: str, digest: str) -> None:
    """Content-addressed: a snapshot that is there is never written over."""
    df.write.mode("ignore").parquet(f"{path}/digest={digest}")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

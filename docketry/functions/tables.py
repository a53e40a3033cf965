"""Tables: HTML to cells and back, support by a text layer, and recognised lines dealt over a grid of cells."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docketry.functions import text as texts
from docketry.operators import boxes


class _Cells(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__()
        self.rows, self.text, self.open = 0, [], None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows += 1
        elif tag in ("td", "th"):
            self.open = []

    def handle_data(self, data):
        if self.open is not None:
            self.open.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.open is not None:
            self.text.append("".join(self.open))
            self.open = None


@pandas_udf(T.StructType([T.StructField("rows", T.IntegerType()), T.StructField("text", T.ArrayType(T.StringType()))]))
def cells(html: pd.Series) -> pd.DataFrame:
    """How many rows a table's HTML has, and its cells' texts in order."""
    found = [_Cells(x or "") for x in html]
    return pd.DataFrame({"rows": [f.rows for f in found], "text": [f.text for f in found]})


def escaped(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rows_to_html(rows: Column, header: bool = True) -> Column:
    """An array of arrays of cells as one HTML table; ragged rows are filled up with empty cells."""

    def html(rows: Column, width: Column) -> Column:
        def line(row: Column, tag: str) -> Column:
            whole = F.concat(row, F.array_repeat(F.lit(""), (width - F.size(row)).cast("int")))
            return F.concat(F.lit("<tr>"), F.array_join(F.transform(whole, lambda c: F.concat(F.lit(f"<{tag}>"), escaped(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

        body = F.slice(rows, 2, F.size(rows)) if header else rows
        head = F.concat(F.lit("<thead>"), line(F.get(rows, 0), "th"), F.lit("</thead>")) if header else F.lit("")
        table = F.concat(F.lit("<table>"), head, F.lit("<tbody>"), F.array_join(F.transform(body, lambda r: line(r, "td")), ""), F.lit("</tbody></table>"))
        return F.when(F.coalesce(width, F.lit(0)) > 0, table).otherwise("<table></table>")

    return texts.given(rows, lambda r: texts.given(F.array_max(F.transform(r, F.size)), lambda width: html(r, width)))


def clean_rows(rows: Column) -> Column:
    """Cells with white space squeezed and personal data taken out; rows without any text are dropped."""
    squeezed = F.transform(rows, lambda r: F.transform(r, lambda c: texts.squeezed(F.coalesce(c, F.lit("")))))
    return texts.redact_rows(F.filter(squeezed, lambda r: F.exists(r, lambda c: c != "")))


def support(cells_n: Column, text_n: Column) -> Column:
    """The share of the cells (normalised, empty ones aside) that stand in the text; 0 for fewer than two."""
    some = F.filter(cells_n, lambda c: c != "")
    return F.when(F.size(some) < 2, 0.0).otherwise(F.size(F.filter(some, lambda c: text_n.contains(c))) / F.size(some))


def first_supported(tables: DataFrame, doc: str, seq: str, least: float = 0.8) -> DataFrame:
    """Of tables (doc, seq, rows, page_text) the first of each document of two rows and columns at least, without
    personal data, whose cells stand in the page's text."""
    rows = tables.withColumn("rows", clean_rows(F.col("rows"))).withColumn("flat", F.flatten("rows"))
    fits = (F.size("rows") >= 2) & (F.size(F.get("rows", 0)) >= 2) & ~F.exists("flat", texts.is_pii)
    rows = rows.withColumns({"flat_n": texts.norm_each(F.col("flat")), "text_n": texts.norm(F.col("page_text"))})
    rows = rows.withColumn("share", support(F.col("flat_n"), F.col("text_n"))).filter(fits & (F.col("share") >= least))
    return rows.groupBy(doc).agg(F.min_by(F.struct(seq, "rows", "share"), seq).alias("t")).select(doc, "t.*")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The length that [a, b] and [c, d] share."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def split_over(text: Column, spans: Column) -> Column:
    """The text cut in as many parts as there are spans, in proportion to them: whole characters first, then one
    more each by largest remainder, then by largest span, then the earliest; all parts empty where the spans are 0."""
    total = F.aggregate(spans, F.lit(0.0), lambda s, x: s + x)
    raw = F.transform(spans, lambda x: F.length(text) * x / total)
    own = F.transform(raw, lambda r: F.floor(r).cast("int"))
    left = F.length(text) - F.aggregate(own, F.lit(0), lambda s, x: s + x)
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.struct(-(F.get(raw, i) - F.get(own, i)), -F.get(spans, i), i.alias("i"))))
    more = F.slice(F.transform(F.filter(ranked, lambda r: F.get(spans, r["i"]) > 0), lambda r: r["i"]), 1, F.greatest(left, F.lit(0)))
    size = F.transform(own, lambda n, i: n + F.array_contains(more, i).cast("int"))
    parts = F.transform(size, lambda n, i: F.substring(text, F.aggregate(F.slice(size, 1, i), F.lit(1), lambda s, x: s + x), n))
    return F.when((total > 0) & (F.length(text) > 0), parts).otherwise(F.transform(spans, lambda _: F.lit("")))


def lines_in_grid(lines: DataFrame, grid: DataFrame, page: str) -> DataFrame:
    """Lines (page, line, text, x0, y0, x1, y1) into cells (page, row, col, x0, y0, x1, y1) -> (page, row, col, text).

    A line goes to the row that shares most of its height, if that is half of it at least, and is split over that
    row's cells by the widths it shares with them; a cell's parts are joined by height, then by left edge, and personal
    data is taken out of what they make."""
    rows = grid.groupBy(page, "row").agg(F.array_sort(F.collect_list(F.struct("col", "x0", "y0", "x1", "y1"))).alias("cells"))
    heights = grid.groupBy(page, "row").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    both = boxes.met(lines, heights, page, [("y0", "y1")]).select("a.*", "b.row").join(rows, [page, "row"])
    tall = F.array_max(F.transform("cells", lambda c: overlap(F.col("y0"), F.col("y1"), c["y0"], c["y1"])))
    both = both.withColumn("shared", tall).filter((F.col("shared") > 0) & (F.col("shared") >= 0.5 * F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))))
    best = both.groupBy(page, "line").agg(F.max_by(F.struct("row", "cells", "text", "x0", "x1", "y0", "y1"), F.struct("shared", -F.col("row"))).alias("b")).select(page, "line", "b.*")
    spans = F.transform("cells", lambda c: overlap(F.col("x0"), F.col("x1"), c["x0"], c["x1"]))
    parts = best.withColumn("part", F.explode(F.arrays_zip(F.col("cells.col").alias("col"), split_over(F.col("text"), spans).alias("text"))))
    parts = parts.select(page, "row", "part.col", F.struct(((F.col("y0") + F.col("y1")) / 2).alias("at"), F.col("x0"), F.trim("part.text").alias("text")).alias("p")).filter(F.col("p.text") != "")
    whole = parts.groupBy(page, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("text"))
    return whole.withColumn("text", texts.squeezed(texts.redact(F.col("text"))))


def grid_html(filled: DataFrame, grid: DataFrame, page: str) -> DataFrame:
    """The rows of `lines_in_grid` as one HTML table a page, with an empty cell where nothing was recognised."""
    cells = grid.select(page, "row", "col").join(filled, [page, "row", "col"], "left")
    rows = cells.groupBy(page, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))), lambda c: c["text"]).alias("cells"))
    tables = rows.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"))
    return tables.select(page, rows_to_html(F.col("rows")).alias("html"))


def line_boxes(lines: DataFrame, *keys: str) -> DataFrame:
    """Recognised lines (keys, lines array<struct<text, confidence, box array<array<double>>>>) -> one row a line with
    its number and the box around its corners; lines without text or corners are left out."""
    each = lines.select(*keys, F.posexplode("lines").alias("line", "l")).filter((F.trim("l.text") != "") & (F.size("l.box") > 0))
    edge = lambda f, k: f(F.transform("l.box", lambda p: F.get(p, k)))
    return each.select(*keys, "line", F.trim("l.text").alias("text"), F.col("l.confidence").alias("confidence"), edge(F.array_min, 0).alias("x0"), edge(F.array_min, 1).alias("y0"), edge(F.array_max, 0).alias("x1"), edge(F.array_max, 1).alias("y1"))


def best_overlap(tables: DataFrame, doc: str, seq: str, least: float = 0.5) -> DataFrame:
    """Of tables (doc, seq, rows, page_text) the one whose cells stand in the page's text most, the first of equals, if
    that share is `least` at least."""
    rows = tables.withColumn("flat", F.flatten(clean_rows(F.col("rows"))))
    rows = rows.withColumns({"flat_n": texts.norm_each(F.col("flat")), "text_n": texts.norm(F.col("page_text"))})
    rows = rows.withColumn("share", support(F.col("flat_n"), F.col("text_n"))).filter(F.col("share") >= least)
    return rows.groupBy(doc).agg(F.max_by(F.struct(seq, "share"), F.struct("share", -F.col(seq))).alias("t")).select(doc, "t.*")

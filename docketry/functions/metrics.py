"""Quality metrics. Spark's levenshtein counts code points, and tokens that stand for one each; what it can't say runs
in pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docketry.functions.text import LINE_END, compact, given, nfkc, nfkc_each

TAGS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}
GATES = (("line_cer", "max", 0.02), ("key_field_f1", "min", 0.97), ("teds", "min", 0.9))


def cer(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's length, of texts already normalised; an empty reference gives 0 or 1."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


def plain(text: str | None) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text or "")).lower()


def _as_text(tokens: Column, vocabulary: Column) -> Column:
    """A text with one character for each token, equal ones for equal tokens, so that the built-in edit distance of
    characters is that of tokens."""

    def step(acc: Column, token: Column) -> Column:
        code = F.array_position(acc["known"], token) + 255
        code = F.when(code >= 0xD800, code + 0x800).otherwise(code)  # no halves of pairs
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.struct(acc["known"].alias("known"), F.concat(acc["text"], character).alias("text"))

    return F.aggregate(tokens, F.struct(vocabulary.alias("known"), F.lit("").alias("text")), step, lambda acc: acc["text"])


def line_edit_counts(ref: Column | str, hyp: Column | str) -> Column:
    """struct<edits, chars>: each reference line in turn takes the unused line nearest to it, if that is nearer than
    nothing at all; the lines left over count whole. Lines are compared in normal form, without white space."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    lines = lambda x: F.filter(F.transform(nfkc_each(F.split(F.coalesce(col(x), F.lit("")), LINE_END, -1)), lambda y: compact(F.regexp_replace(y, "[\x1c-\x1f]", ""))), lambda y: y != "")
    refs, rest = lines(ref), lines(hyp)

    def step(acc: Column, line: Column) -> Column:
        def nearest(distances: Column) -> Column:
            def taken(least: Column) -> Column:
                near = F.coalesce(least < F.length(line), F.lit(False))
                at = F.array_position(distances, least).cast("int")
                others = F.concat(F.slice(acc["rest"], F.lit(1), at - 1), F.slice(acc["rest"], at + 1, F.size(distances)))
                return F.struct(F.when(near, others).otherwise(acc["rest"]).alias("rest"), (acc["edits"] + F.when(near, least).otherwise(F.length(line))).cast("long").alias("edits"))

            return given(F.array_min(distances), taken)

        return given(F.transform(acc["rest"], lambda h: F.levenshtein(line, h)), nearest)

    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    edits = F.aggregate(refs, F.struct(rest.alias("rest"), F.lit(0).cast("long").alias("edits")), step, lambda acc: acc["edits"] + total(acc["rest"]))
    extra = F.when(F.size(rest) > 0, 1).otherwise(0).cast("long")
    none = F.size(refs) == 0
    return F.struct(F.when(none, extra).otherwise(edits).alias("edits"), F.when(none, extra).otherwise(total(refs)).alias("chars"))


def wer(ref: Column | str, hyp: Column | str) -> Column:
    """Edit distance of tokens over the reference's tokens; an empty reference gives 0 or 1."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    tokens = lambda x: F.filter(F.split(nfkc(F.coalesce(col(x), F.lit(""))), r"(?U)[\s\x1c-\x1f，。；、：:；,.!！？?\n]+", -1), lambda t: t != "")
    a, b = tokens(ref), tokens(hyp)
    known = F.array_distinct(F.concat(a, b))
    distance = F.levenshtein(_as_text(a, known), _as_text(b, known))
    return F.when(F.size(a) == 0, F.when(F.size(b) > 0, 1.0).otherwise(0.0)).otherwise(distance / F.size(a))


class _Table(HTMLParser):
    """Nested [label, children] lists; a later table at top level takes the place of an earlier one."""

    def __init__(self, text: str) -> None:
        super().__init__()
        self.top, self.open, self.cell = None, [], None
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in TAGS:
            node = [tag, []]
            if self.open:
                self.open[-1][1].append(node)
            else:
                self.top = node
            self.open.append(node)
            if tag in ("td", "th"):
                self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in TAGS and self.open:
            node = self.open.pop()
            if tag in ("td", "th") and self.cell is not None:
                node[0], self.cell = f"{tag}:{plain(''.join(self.cell))}", None


def _size(node) -> int:
    return 1 + sum(map(_size, node[1]))


def _align(a: list, b: list) -> int:
    """Cheapest alignment of two rows of siblings: dropping or adding one costs its whole subtree."""
    drop, add = [_size(x) for x in a], [_size(y) for y in b]
    row = [sum(add[:j]) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        corner, row[0] = row[0], row[0] + drop[i]
        for j, y in enumerate(b):
            pair = corner + (x[0] != y[0]) + _align(x[1], y[1])
            corner, row[j + 1] = row[j + 1], min(row[j + 1] + drop[i], row[j] + add[j], pair)
    return row[-1]


def table_similarity(hyp: str | None, ref: str | None) -> float:
    a, b = _Table(hyp or "").top, _Table(ref or "").top
    if a is None or b is None:
        return float(a is b)
    return min(1.0, max(0.0, 1 - _align([a], [b]) / max(_size(a), _size(b))))


@pandas_udf(T.DoubleType())
def teds(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([table_similarity(h, r) for h, r in zip(hyp, ref, strict=True)], dtype=float)


@pandas_udf(T.ArrayType(T.StringType()))
def toc_lines(lines: pd.Series) -> pd.Series:
    """Contents lines with leaders dropped, the heading joined, chapter marks joined to titles, page numbers to both."""
    chapter, page = re.compile(r"第[0-9一二三四五六七八九十百]+章"), re.compile(r"\d{1,4}")

    def one(raw):
        rows = [plain(re.sub(r"^[.．,，、]+|[.．,，、]+$", "", re.sub(r"[.．。·∙•…]{2,}", "", x or ""))) for x in (raw if raw is not None else ())]
        rows = [x for x in rows if x]
        heading = {i for i, pair in enumerate(zip(rows, rows[1:], strict=False)) if pair == ("目", "录")}
        rows = ["目录" if i in heading else x for i, x in enumerate(rows) if i - 1 not in heading]
        out: list[str] = []
        open_mark = False  # the last line is a chapter mark without its title
        for x in rows:
            number, mark = page.fullmatch(x), chapter.fullmatch(x)
            if number and out and not out[-1].endswith(x):
                out[-1], open_mark = out[-1] + x, False
            elif open_mark and not mark and not number:
                out[-1], open_mark = out[-1] + x, False
            else:
                out.append(x)
                open_mark = bool(mark)
        return out

    return lines.map(one)


def nearest_rank(values: Column, floor_of_last: bool) -> Column:
    """The two p95 of sorted values: index int(0.95 * (n - 1)), or max(0, int(n * 0.95) - 1)."""
    n = F.size(values)
    at = F.floor(F.lit(0.95) * (n - 1)) if floor_of_last else F.greatest(F.lit(0), F.floor(n * F.lit(0.95)) - 1)
    return F.try_element_at(F.sort_array(values), (at + 1).cast("int"))


def gate(**metrics: Column) -> Column:
    """GATE_PASS only if each metric is there and within its bound."""
    ok = F.lit(True)
    for name, kind, bound in GATES:
        m = metrics[name]
        ok = ok & F.coalesce(m <= bound if kind == "max" else m >= bound, F.lit(False))
    return F.when(ok, F.lit("GATE_PASS")).otherwise(F.lit("GATE_FAIL"))


def prepared(text: Column, lines: Column) -> Column:
    """A page's lines before line CER: of a contents page they are cut and joined anew, of the others each is redacted;
    no page is left out. `text` is the truth's, which says what kind of page it is."""
    from docketry.functions.text import is_toc, norm_each, redact_each

    clean = redact_each(lines)
    kept = F.filter(F.arrays_zip(clean.alias("x"), norm_each(clean).alias("n")), lambda z: z["n"] != "")
    return F.when(is_toc(text), toc_lines(clean)).otherwise(F.transform(kept, lambda z: z["x"]))

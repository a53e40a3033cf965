"""Text hygiene as Column expressions; pandas UDFs only where no built-in function exists."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

SPACE = r"(?U)\s+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"

#: Lines that hold personal data.
PII_LINES = (r"1[3-9]\d{9}", r"0\d{2,3}-?\d{7,8}", r"\d{17}[\dXx]", r"[一-鿿]{1,3}(?:女士|先生|主任|科长)", r"(?:联系人|电话|地址|邮箱|E-?mail)\s*[:：]", r"(?i)https?://|www\.")
#: Page classes that must not leave the premises, and hints that a page is hard.
BLOCKED = (("seal", r"公章|印章|鲜章|骑缝章"), ("id_card", r"居民身份证|身份证号|身份证复印件"), ("license_scan", r"营业执照副本|医疗器械(经营|生产)许可证|注册证复印件|许可证复印件"), ("bank_receipt", r"开户许可证|银行回单|汇款凭证"), ("handwritten_signature", r"亲笔签名|手写签名"), ("contact_sheet", r"采购人信息|代理机构信息|联系方法|联系人\s*[:：]"))
HINTS = (("toc", r"目录|目\s*录"), ("dense_table", r"开标一览表|报价明细|偏离表|评分表|技术参数表"))
#: What redaction takes out, in this order, and what it leaves.
REDACTIONS = (
    (r"(?m)^.*(?:联系人|项目联系人|法定代表人姓名|授权代表姓名|评审专家)\s*[:：].*$|^.*评审专家名单.*$", "［已隐去联系人/评审专家姓名］"),
    (r"(?<!\d)1[3-9](?:[\s\-]\d){9}(?!\d)", "［已隐去电话］"),
    (r"(?<!\d)0\d{2,3}-\s*\d{7,8}(?!\d)", "［已隐去电话］"),
    (r"(?<!\d)(?:1[3-9]\d{9}|0\d{2,3}-?\d{7,8})(?!\d)", "［已隐去电话］"),
    (r"(?<!\d)\d{17}[\dXx](?!\d)", "［已隐去证件号］"),
)
#: Key fields and where their values stand.
FIELDS = (
    ("project_code", r"项目编号[:：]\s*([A-Za-z0-9][A-Za-z0-9\-]{4,40})"),
    ("project_name", r"项目名称[:：]\s*([^\n]{4,80})"),
    ("budget", r"预算(?:总)?金额(?:（元）)?[:：]\s*([^\n]{2,48})"),
    ("ceiling", r"最高限价(?:（如有）|（元）)?[:：]\s*([^\n]{2,48})"),
    ("procurement_method", r"采购方式[:：]\s*([^\s\n]{2,12})"),
    ("purchaser", r"采购人[:：]\s*([^\n]{2,40})"),
    ("agent", r"(?:采购代理机构|代理机构)[:：]\s*([^\n]{2,40})"),
    ("deadline", r"(?:提交投标文件截止时间|递交响应文件截止时间|提交响应文件截止时间|开标时间)[:：]\s*([^\n]{6,48})"),
    ("contract_end", r"合同(?:履行|履约)期限[:：]\s*([^\n]{4,80})"),
    ("bid_bond", r"(?:投标保证金|谈判保证金|竞谈保证金)[:：]\s*([^\n]{2,40})"),
    ("qualification_ref", r"(政府采购法》?第二十二条)"),
    ("device_license", r"(医疗器械(?:生产|经营)(?:许可证|备案凭证|备案))"),
    ("device_registration", r"(医疗器械注册证)"),
)
BLANK_FIELDS = ("/", "无", "详见", "详见招标文件", "详见采购需求")


@pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, which neither Spark nor its Java functions offer as a column."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(s: pd.Series) -> pd.Series:
    """Of an array of texts, each by itself."""
    return s.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


@pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def given(value: Column, f) -> Column:
    """f(value), with the value reckoned once: inside a lambda Spark would do so at each mention, and not at all where it
    comes from Python."""
    return F.get(F.transform(F.array(value), f), 0)


def squeezed(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stripped(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """Without white space, lower case; the built-in part of `norm`."""
    return F.lower(F.regexp_replace(text, SPACE, ""))


def norm(text: Column) -> Column:
    return compact(nfkc(F.coalesce(text, F.lit(""))))


def norm_each(texts: Column) -> Column:
    return F.transform(nfkc_each(F.coalesce(texts, F.array().cast("array<string>"))), lambda x: compact(F.coalesce(x, F.lit(""))))


def counted(text: Column) -> Column:
    """How many characters count: white space aside, case kept."""
    return F.length(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), SPACE, ""))


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def needs_mask(line: Column, patterns: Sequence[str] = PII_LINES) -> Column:
    return any_match(F.coalesce(line, F.lit("")), patterns)


def page_types(text: Column) -> Column:
    named = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in BLOCKED + HINTS)))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("body")))


def escalation(text: Column, confidence: Column, height: Column, minimum: float = 0.8) -> Column:
    """Why a page is sent on, or is not: blocked:..., local_ok, or comma-joined reasons."""
    blocked = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in BLOCKED)))
    hints = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in HINTS)))
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    reasons = F.array_compact(F.array(F.when(confidence < minimum, F.lit("low_confidence")), F.when(n < 40, F.lit("short_text")), F.when((height >= 700) & (n < 500), F.lit("possible_truncation")), F.when(F.size(hints) > 0, F.concat(F.lit("hint:"), F.array_join(hints, ",")))))
    return F.when(F.size(blocked) > 0, F.concat(F.lit("blocked:"), F.array_join(blocked, ","))).when(F.size(reasons) == 0, F.lit("local_ok")).otherwise(F.array_join(reasons, ","))


def redact_plain(text: Column) -> Column:
    out = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "　", " ")
    for pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def redact_nodes(text: Column) -> Column:
    """Redact between tags only. The raw text is cut at its tags first and each node is normalised by itself, so a
    full-width bracket in a node never becomes a tag; tags and nodes alternate and are zipped again."""
    raw = F.coalesce(text, F.lit(""))
    tags, nodes = F.regexp_extract_all(raw, F.lit("<[^>]+>"), F.lit(0)), nfkc_each(F.split(raw, "<[^>]+>", -1))

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, "　", " ")
        for pattern, mark in REDACTIONS:
            x = F.regexp_replace(x, pattern, mark)
        return x

    return F.array_join(F.flatten(F.transform(F.arrays_zip(F.transform(nodes, clean).alias("n"), tags.alias("t")), lambda z: F.array_compact(F.array(z["n"], z["t"])))), "")


def redact(text: Column) -> Column:
    return F.when(text.rlike(TABLE_TAG), redact_nodes(text)).otherwise(redact_plain(text))


TABLE_TAG = r"(?i)</?(?:table|thead|tbody|tr|td|th)\b"


def _redacted(value: str) -> str:
    def node(x: str) -> str:
        x = unicodedata.normalize("NFKC", x).replace("　", " ")
        for pattern, mark in REDACTIONS:
            x = re.sub(pattern, mark, x)
        return x

    if not re.search(TABLE_TAG, value):
        return node(value)
    parts = re.split("(<[^>]+>)", value)
    return "".join(x if k % 2 else node(x) for k, x in enumerate(parts))


@pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def redact_rows(s: pd.Series) -> pd.Series:
    """`redact` of each cell of a table by itself."""
    return s.map(lambda rows: None if rows is None else [[_redacted(c or "") for c in r] for r in rows])


def html_to_text(raw: Column) -> Column:
    """Tags to line breaks, entities resolved, blanks squeezed, empty lines dropped; script bodies stay."""
    text = F.regexp_replace(unescape(F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", "\n")), r"[ \t]+", " ")
    return F.array_join(F.filter(F.transform(F.split(text, LINE_END), stripped), lambda x: x != ""), "\n")


def is_pii(value: Column) -> Column:
    """A phone or identity number, which has ten digits and more."""
    return (F.length(value) >= 10) & F.regexp_replace(value, SPACE, "").rlike(f"{REDACTIONS[3][0]}|{REDACTIONS[4][0]}")


def key_fields(text: Column, fields: Sequence[tuple[str, str]] = FIELDS) -> Column:
    """array<struct<name, value>>: each field's first match, cleaned; empty, stock and personal values dropped. Each step is
    an array of its own, so no pattern is matched twice, and the text is made once for all patterns. The fixed fields
    are found in Arrow slices, as thirteen searches of a text take Python about a sixth of the time that they take Java."""
    return fixed_fields(text) if fields is FIELDS else listed_fields(text, fields)


def listed_fields(text: Column, fields: Sequence[tuple[str, str]]) -> Column:
    named = lambda f, value: F.struct(f["name"].alias("name"), value.alias("value"))
    found = given(text, lambda t: F.array(*(F.struct(F.lit(name).alias("name"), F.regexp_extract(t, pattern, 1).alias("value")) for name, pattern in fields)))
    met = F.filter(found, lambda f: F.length(f["value"]) >= 2)
    clean = F.transform(met, lambda f: named(f, F.btrim(F.regexp_replace(f["value"], SPACE, " "), F.lit(" ：:;"))))
    kept = F.filter(clean, lambda f: (F.length(f["value"]) >= 2) & ~f["value"].isin(*BLANK_FIELDS) & ~is_pii(f["value"]))
    return F.transform(kept, lambda f: named(f, F.left(f["value"], F.lit(80))))


_SEARCH = tuple((name, re.compile(pattern, re.ASCII).search) for name, pattern in FIELDS)
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # as SPACE
_PII = re.compile(f"{REDACTIONS[3][0]}|{REDACTIONS[4][0]}", re.ASCII)


@arrow_udf(T.ArrayType(T.StructType().add("name", T.StringType()).add("value", T.StringType())))
def fixed_fields(texts: pa.Array) -> pa.Array:
    """`listed_fields` by FIELDS, whose patterns Python and Java read alike."""
    names, values, ends = [], [], [0]
    for text in texts.to_pylist():
        for name, search in _SEARCH:
            met = search(text or "")
            if met is None:
                continue
            value = _SPACES.sub(" ", met[1]).strip(" ：:;")
            if len(value) >= 2 and value not in BLANK_FIELDS and not (len(value) >= 10 and _PII.search(value.replace(" ", ""))):
                names.append(name)
                values.append(value[:80])
        ends.append(len(names))
    fields = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)


def is_toc(text: Column) -> Column:
    """A contents heading (in one line or two), or three lines with long leaders."""
    lines = F.filter(norm_each(F.split(text, "\n")), lambda x: x != "")
    split_heading = F.exists(F.arrays_zip(lines.alias("a"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("b")), lambda z: (z["a"] == "目") & (z["b"] == "录"))
    leaders = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[.．。·…]{8,}")))
    return F.array_contains(lines, "目录") | split_heading | (leaders >= 3)


def replaced(text: Column, names: dict[str, str]) -> Column:
    """Literal replacements, longest key first."""
    for key in sorted(names, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(key), F.lit(names[key]))
    return text


def residual_hits(text: Column, pattern: str, most: int = 20) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))), 1, most)


def without_fences(text: Column) -> Column:
    """Recognised text without code fences and tags, entities resolved, blank lines collapsed."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```[A-Za-z]*\s*$", "")
    return stripped(F.regexp_replace(unescape(F.regexp_replace(text, "<[^>]+>", "")), r"\n{3,}", "\n\n"))


def better_of(local: Column, cloud: Column) -> Column:
    """The cloud's text if it is at least 1.05 times as long."""
    return F.when(F.length(F.trim(cloud)) >= F.length(F.trim(local)) * 1.05, cloud).otherwise(local)


#: Fixed value: landline numbers, masked after names.
LANDLINE = r"(?<!\d)0\d{2,3}-?\d{7,8}(?!\d)"


def masked_names(text: Column, names: dict[str, str], mark: str = "［已隐去电话］") -> Column:
    """Names by their placeholders, longest first, then landline numbers."""
    return F.regexp_replace(replaced(text, names), LANDLINE, mark)


def rehydrated(text: Column, names: dict[str, str]) -> Column:
    """Placeholders back to names, longest placeholder first."""
    return replaced(text, {v: k for k, v in names.items()})


def safe_filename(name: Column) -> Column:
    """The last part of a path with odd characters as underscores, never empty."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/\\\\]*$", 0)
    clean = F.left(F.regexp_replace(F.trim(last), r"[^\w.\-一-鿿]+", "_"), F.lit(120))
    return F.when(F.regexp_replace(clean, r"[._]", "") == "", F.lit("file")).otherwise(clean)


def iso_valid(value: Column) -> Column:
    """A date or a moment in ISO form, Z accepted."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$") & F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00")).isNotNull(), F.lit(False))


def field_hit(text: Column, value: Column) -> Column:
    """A field's value stands in a text, both normalised."""
    return norm(text).contains(norm(value))


def harvested(line: Column) -> Column:
    """Lines worth keeping: 2 to 40 characters, some of them letters, digits or Chinese."""
    t = F.trim(F.coalesce(line, F.lit("")))
    return F.length(t).between(2, 40) & t.rlike("[A-Za-z0-9一-鿿]")


def sparse(text: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < least


def redact_each(lines: Column) -> Column:
    """Each plain line of an array redacted by itself."""

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, "　", " ")
        for pattern, mark in REDACTIONS:
            x = F.regexp_replace(x, pattern, mark)
        return x

    return F.transform(nfkc_each(lines), clean)


def fetch_outcome(code: Column, size: Column, magic_ok: Column, most: int = 50_000_000) -> Column:
    """Why a fetched file does not count; ok if it does."""
    return F.when(code.isNull(), "unreachable").when(code != 200, F.concat(F.lit("http_"), code.cast("string"))).when(size == 0, "empty").when(size > most, "too_large").when(~magic_ok, "not_a_pdf").otherwise("ok")

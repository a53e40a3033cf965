"""Registered queries over evidence matching, key fields, candidate choice and review progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import rules
from docketry.plans.catalog import _QUOTE, _SCAN, BLOCKS, blocks, query

_FOUND = f"b AS ({BLOCKS}), s AS (SELECT *, {_QUOTE} AS quote, row_number() OVER (PARTITION BY doc_id ORDER BY line, rule, pos) AS seq FROM ({_SCAN})), r AS (SELECT doc_id, line, category, label, quote, min(seq)::INT AS seq FROM s GROUP BY ALL)"
_BARE = r"lower(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g'))"


@query(
    f"""WITH {_FOUND}, e AS (SELECT doc_id - 1 AS doc_id, line, {_BARE} AS c FROM b WHERE line % 7 <> 6),
    p AS (SELECT doc_id, list(c ORDER BY line) AS cs, list(line ORDER BY line) AS ls, string_agg(c, '' ORDER BY line) AS whole FROM e GROUP BY doc_id),
    q AS (SELECT doc_id, seq, list_distinct(list_transform(regexp_extract_all(quote, '[A-Za-z]{{3,}}'), lambda x: lower(x))) AS terms, cs, ls, whole FROM r LEFT JOIN p USING (doc_id)),
    f AS (SELECT doc_id, seq, len(list_filter(terms, lambda t: contains(coalesce(whole, ''), t)))::INT AS matched, ls[list_filter(range(1, coalesce(len(cs), 0) + 1), lambda i: len(list_filter(terms, lambda t: contains(cs[i], t))) > 0)[1]]::INT AS evidence_page FROM q)
    SELECT doc_id, seq, matched, evidence_page, CASE WHEN matched > 0 AND evidence_page IS NOT NULL THEN 'NEEDS_REVIEW' ELSE 'UNKNOWN' END AS status FROM f"""
)
def evidence_match(t):
    """Each document's requirements against the lines of the next document, each seventh line taken as failed."""
    found = rules.first_wins(rules.scan(blocks(t), "doc_id", "line", "text", rules.LATIN), "doc_id", "line")
    asked = found.select(F.col("doc_id").alias("doc"), F.col("seq").alias("requirement_id"), F.col("quote").alias("title"), "category")
    failed = F.when(F.col("line") % 7 == 6, "FAILED")
    given = blocks(t).select((F.col("doc_id") - 1).alias("doc"), F.col("line").alias("page"), "text", failed.alias("ocr_status"))
    got = rules.match_evidence(asked, given)
    return got.select(F.col("doc").alias("doc_id"), F.col("requirement_id").alias("seq"), F.size("matched_terms").alias("matched"), "evidence_page", "status")


_MAIL, _ADDRESS = r"([a-z0-9._]+@[a-z0-9.]+)", r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"
_PII = r"(^|[^0-9])(1[3-9][0-9]{9}|0[0-9]{2,3}-?[0-9]{7,8}|[0-9]{17}[0-9Xx])($|[^0-9])"


@query(f"SELECT doc_id, name, value FROM (SELECT doc_id, 'mail' AS name, regexp_extract(text, '{_MAIL}', 1) AS value FROM documents UNION ALL SELECT doc_id, 'address', regexp_extract(text, '{_ADDRESS}', 1) FROM documents) WHERE length(value) BETWEEN 2 AND 80 AND NOT regexp_matches(value, '{_PII}')")
def key_field_values(t):
    """Each document's first mail address and network address, by a lexicon that is a parameter."""
    fields = text.key_fields(F.col("text"), (("mail", _MAIL), ("address", _ADDRESS)))
    return t("documents").select("doc_id", F.inline(fields))


_STRONG = {"CREDENTIAL": ("permission", "copyright", "software"), "SIGNATURE": ("contact", "mail")}
_BONUS = {"BOND": (r"[0-9]{8}", 8), "CREDENTIAL": (r"MIT|Apache|GPL", 6)}
_SCORE = " + ".join(f"CASE WHEN category = '{c}' AND contains(quote, '{w}') THEN 4 ELSE 0 END" for c, ws in _STRONG.items() for w in ws) + "".join(f" + CASE WHEN category = '{c}' AND regexp_matches(quote, '{p}') THEN {n} ELSE 0 END" for c, (p, n) in _BONUS.items()) + " + CASE WHEN length(quote) - length(replace(quote, '.', '')) > 20 OR length(quote) - length(replace(quote, '…', '')) > 10 THEN -100 ELSE 0 END"


@query(f"WITH {_FOUND} SELECT doc_id, category, score, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY score DESC, seq) AS n FROM (SELECT doc_id, category, seq, ({_SCORE})::INT AS score FROM r)) WHERE n = 1")
def best_candidates(t):
    """The requirement with the highest score in each document and category; the first wins a tie."""
    found = rules.first_wins(rules.scan(blocks(t), "doc_id", "line", "text", rules.LATIN), "doc_id", "line")
    score = rules.candidate_score(F.col("category"), F.col("quote"), _STRONG, _BONUS)
    best = found.groupBy("doc_id", "category").agg(F.max(F.struct(score.alias("score"), (-F.col("seq")).alias("n"))).alias("b"))
    return best.select("doc_id", "category", "b.score", (-F.col("b.n")).alias("seq"))


@query("SELECT o_orderkey, total, reviewed, round(100.0 * reviewed / nullif(total, 0), 6)::DOUBLE AS progress FROM (SELECT o_orderkey, count(l_linenumber) AS total, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_linenumber END) AS reviewed FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)")
def review_progress(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    both = t("orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    done = both.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("total"), F.countDistinct(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))).alias("reviewed"))
    return done.withColumn("progress", F.round(F.try_divide(F.lit(100.0) * F.col("reviewed"), F.col("total")), 6))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS lo, l_quantity + l_tax * 100 AS hi FROM lineitem) SELECT a.l_orderkey, a.l_linenumber, count(b.l_orderkey) AS touching, round(coalesce(sum(CASE WHEN b.l_orderkey IS NOT NULL THEN least(a.hi, b.hi) - greatest(a.lo, b.lo) END), 0), 6)::DOUBLE AS overlap FROM x a LEFT JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND a.lo < b.hi AND b.lo < a.hi GROUP BY ALL")
def interval_overlap(t):
    """Intervals that overlap on one page: an order is the page, its lines are the boxes."""
    x = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("hi"))
    return rules.overlaps(x, x, "l_orderkey", "l_linenumber")

"""Registered queries over quality metrics, seeds, tables, limits and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import metrics, tables, text
from docketry.operators import cohorts, evaluate, rules, seeds, store, timewin
from docketry.plans.catalog import Table, query

_PAGES = "SELECT l_orderkey AS doc_id, l_linenumber AS page, (l_partkey % 40)::BIGINT AS edits, (l_partkey % 7 * 50)::BIGINT AS chars, l_returnflag AS mode, l_quantity AS latency_ms, CASE WHEN l_suppkey % 3 <> 0 THEN '<TABLE>' ELSE '' END AS table_html, l_discount * 10 AS teds, l_shipdate FROM lineitem"


def _pages(t: Table) -> DataFrame:
    c = F.col
    return t("lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("page"), (c("l_partkey") % 40).alias("edits"), (c("l_partkey") % 7 * 50).alias("chars"), c("l_returnflag").alias("mode"), c("l_quantity").alias("latency_ms"), F.when(c("l_suppkey") % 3 != 0, "<TABLE>").otherwise("").alias("table_html"), (c("l_discount") * 10).alias("teds"), "l_shipdate", "l_partkey", "l_suppkey")


@query(f"SELECT mode, count(*) AS pages, round(CASE WHEN sum(chars) > 0 THEN sum(edits) / sum(chars) ELSE 1 END, 6) AS rate FROM ({_PAGES}) GROUP BY ALL")
def micro_cer(t):
    return cohorts.micro_rate(_pages(t), "edits", "chars", "mode").withColumn("rate", F.round("rate", 6))


@query(f"SELECT mode, count(*) AS pages, round(avg(teds), 6) AS mean FROM ({_PAGES}) WHERE contains(lower(table_html), '<table') GROUP BY ALL")
def macro_teds(t):
    return cohorts.macro_mean(_pages(t), "teds", "table_html", "mode").withColumn("mean", F.round("mean", 6))


@query(f"SELECT mode, count(*) AS pages, round(avg(CASE WHEN chars > 0 THEN edits / chars END), 6) AS mean_cer, round(avg(edits / (chars + 1)), 6) AS mean_wer, round(avg(latency_ms), 6) AS mean_latency_ms, list_sort(list(latency_ms))[floor(0.95::DOUBLE * (count(*) - 1))::INT + 1] AS p95_latency_ms, round(sum(page) / nullif(sum(page + 1), 0), 6) AS field_accuracy, array_to_string(list_sort(list_distinct(list('p' || (doc_id % 3)::VARCHAR))), ',') AS providers FROM ({_PAGES}) GROUP BY ALL")
def ocr_by_mode(t):
    p = _pages(t).withColumns({"cer": F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")), "wer": F.col("edits") / (F.col("chars") + 1), "field_hits": F.col("page"), "field_total": F.col("page") + 1, "provider": F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"))})
    out = cohorts.by_mode(p, "mode").withColumn("providers", F.array_join("providers", ","))
    return out.withColumns({n: F.round(n, 6) for n in ("mean_cer", "mean_wer", "mean_latency_ms", "field_accuracy")})


@query(f"SELECT mode, count(*) AS pages, round(avg(cer), 6) AS mean, round(median(cer), 6) AS median, round(list_sort(list(cer) FILTER (cer IS NOT NULL))[greatest(1, floor(0.95::DOUBLE * count(cer))::INT)], 6) AS p95, count_if(cer > 0.5) AS hard FROM (SELECT mode, CASE WHEN chars > 0 THEN edits / chars END AS cer FROM ({_PAGES})) GROUP BY ALL")
def hard_page_summary(t):
    p = _pages(t).withColumn("cer", F.when(F.col("chars") > 0, F.col("edits") / F.col("chars")))
    return cohorts.hard_pages(p, 0.5, "mode").withColumns({n: F.round(n, 6) for n in ("mean", "median", "p95")})


_COHORT = f"SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'synthetic' WHEN doc_id % 5 < 3 THEN 'old' ELSE 'real' END AS cohort, doc_id % 4 AS tp, page % 2 AS fp, doc_id % 2 AS fn FROM ({_PAGES})"


@query(f"SELECT *, CASE WHEN line_cer <= 0.02 THEN 'GATE_PASS' ELSE 'GATE_FAIL' END AS line_cer_gate, CASE WHEN key_field_f1 >= 0.97 THEN 'GATE_PASS' ELSE 'GATE_FAIL' END AS key_field_f1_gate, CASE WHEN teds >= 0.9 THEN 'GATE_PASS' ELSE 'GATE_FAIL' END AS teds_gate FROM (SELECT cohort, count(*) AS pages, round(sum(edits) / sum(chars), 6) AS line_cer, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS key_field_f1, round(avg(CASE WHEN contains(lower(table_html), '<table') AND cohort <> 'old' THEN teds END), 6) AS teds FROM ({_COHORT}) GROUP BY ALL)")
def cohort_report(t):
    """Three cohorts; one of them has no table, so that its gate fails."""
    synthetic, doc = F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 5 < 3, "old-1").otherwise("x")
    p = _pages(t).withColumns({"cohort": cohorts.cohort_of(doc, synthetic), "tp": F.col("doc_id") % 4, "fp": F.col("page") % 2, "fn": F.col("doc_id") % 2})
    p = p.withColumn("table_html", F.when(F.col("cohort") != "old", F.col("table_html")))
    return cohorts.cohort_report(p).withColumns({n: F.round(n, 6) for n in ("line_cer", "key_field_f1", "teds")})


@query(f"SELECT doc_id, page, round(rate, 6) AS rate FROM (SELECT doc_id, page, edits / chars AS rate FROM ({_PAGES}) WHERE chars > 0 GROUP BY ALL) ORDER BY rate DESC, doc_id, page LIMIT 5")
def worst_pages(t):
    p = _pages(t).filter("chars > 0").select("doc_id", "page", (F.col("edits") / F.col("chars")).alias("rate")).distinct().withColumn("is_toc", F.lit(False))
    return cohorts.root_causes(p)[0].select("doc_id", "page", F.round("rate", 6).alias("rate"))


@query(f"SELECT page = 2 AS is_toc, count(*) AS pages, count_if(edits / chars > 0.10) AS bad FROM ({_PAGES}) WHERE chars > 0 GROUP BY ALL")
def root_causes(t):
    p = _pages(t).filter("chars > 0").withColumns({"rate": F.col("edits") / F.col("chars"), "is_toc": F.col("page") == 2})
    return cohorts.root_causes(p)[1]


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS documents, count(DISTINCT (l_orderkey, 'f' || (l_partkey % 9)::VARCHAR)) AS pairs, count(*) AS instances, array_to_string(list_sort(list_filter(list_distinct(list('f' || (l_partkey % 9)::VARCHAR)), lambda x: x IN ('f0', 'f1', 'f8', 'f9', 'g'))), ',') AS seen, 'f9,g' AS gaps FROM lineitem GROUP BY ALL")
def field_coverage(t):
    f = t("lineitem").select("l_returnflag", "l_orderkey", F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string")).alias("name"))
    out = cohorts.coverage(f, "l_orderkey", "name", ["f0", "f1", "f8", "f9", "g"], "l_returnflag")
    return out.withColumns({"seen": F.array_join("seen", ","), "gaps": F.array_join("gaps", ",")})


@query("SELECT c_nationkey, c, s, CASE WHEN c > 0 THEN 'CONFIRMED' WHEN s > 0 THEN 'SIGNAL_ONLY' ELSE 'NO_SIGNAL' END AS status FROM (SELECT c_nationkey, count_if(c_acctbal > 9900) AS c, count_if(c_mktsegment = 'BUILDING' AND c_acctbal < 0) AS s FROM customer GROUP BY ALL)")
def business_status(t):
    yes = F.when(F.col("c_acctbal") > 9900, " Yes ").otherwise("no")
    signal = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))
    by = t("customer").groupBy("c_nationkey").agg(F.count_if(cohorts.marked(yes, "yes", "true", "1")).alias("c"), F.count_if(cohorts.marked(signal, "building")).alias("s"))
    return by.withColumn("status", cohorts.business_status(F.col("c"), F.col("s")))


@query("SELECT 'hits{event_type=\"' || event_type || '\",code=\"' || (event_id % 3)::VARCHAR || '\"} ' || count(*)::VARCHAR AS line FROM events GROUP BY event_type, event_id % 3")
def metric_exposition(t):
    by = t("events").groupBy("event_type", (F.col("event_id") % 3).alias("code")).agg(F.count("*").alias("n"))
    return cohorts.metric_lines(by, "hits", ["event_type", "code"], "n")


@query("WITH l AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS p FROM lineitem), m AS (SELECT d, max(p) AS n FROM l GROUP BY ALL) SELECT d, p FROM l JOIN m USING (d) WHERE p = 1 OR p = n // 2 + 1 OR p = n")
def cover_middle_last(t):
    pages = t("lineitem").select(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("p")).distinct()
    return cohorts.chosen_pages(pages, "d", "p").select("d", "p")


@query()
def train_val_split(t):
    return cohorts.hash_split(t("documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, count(*) AS lines, count_if(length(trim(x)) BETWEEN 2 AND 40 AND regexp_matches(x, '[A-Za-z0-9]')) AS kept FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY ALL")
def line_harvest(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.harvested(F.col("x"))).alias("kept"))


@query("SELECT doc_id, list_sort(list(DISTINCT turn))::VARCHAR AS pages FROM (SELECT conv_id AS doc_id, turn FROM conversations) GROUP BY ALL")
def scored_pages(t):
    by = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_set("turn")).alias("p"))
    return by.select("doc_id", F.concat(F.lit("["), F.array_join(F.col("p").cast("array<string>"), ", "), F.lit("]")).alias("pages"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def leakage_free(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.join(d.filter("doc_id % 3 = 0").select("digest").distinct(), "digest", "left_anti").select("doc_id")


# --- seeds and manifest

_MAN = "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 10 = 1 THEN 'Excluded' ELSE 'done' END AS status, CASE WHEN doc_id % 17 <> 0 THEN 'http://x/' || (doc_id % 50)::VARCHAR ELSE '' END AS url, CASE WHEN doc_id % 7 = 0 THEN 'short' WHEN doc_id % 10 = 0 AND doc_id % 3 <> 0 THEN '' ELSE sha256(text) END AS sha, CASE WHEN doc_id % 20 = 0 THEN false END AS counts FROM documents"


def _manifest(t: Table) -> DataFrame:
    d = F.col("doc_id")
    return t("documents").select(d.cast("string").alias("document_id"), F.when(d % 10 == 0, "failed").when(d % 10 == 1, "Excluded").otherwise("done").alias("status"), F.when(d % 17 != 0, F.concat(F.lit("http://x/"), (d % 50).cast("string"))).otherwise("").alias("source_url"), F.when(d % 7 == 0, "short").when((d % 10 == 0) & (d % 3 != 0), "").otherwise(F.sha2("text", 256)).alias("sha256"), F.when(d % 20 == 0, F.lit(False)).alias("counts_as_completed"))


@query(
    f"""WITH m AS ({_MAN}), w AS (SELECT *, status = 'failed' AS off, row_number() OVER (PARTITION BY status <> 'failed' AND length(sha) = 64, sha ORDER BY id::VARCHAR) AS r FROM m)
    SELECT id::VARCHAR AS document_id, concat_ws(',', CASE WHEN (off AND url = '') OR (NOT off AND NOT starts_with(url, 'http')) THEN 'missing_source_url' END, CASE WHEN NOT off AND length(sha) <> 64 THEN 'missing_sha256' END,
    CASE WHEN NOT off AND length(sha) = 64 AND r > 1 THEN 'duplicate_sha256' END, CASE WHEN off AND counts IS DISTINCT FROM false THEN 'counts_as_completed' END, CASE WHEN off AND sha <> '' THEN 'failure_with_sha256' END) AS issues FROM w"""
)
def manifest_checks(t):
    return seeds.manifest_issues(_manifest(t)).select("document_id", F.array_join("issues", ",").alias("issues"))


@query(f"SELECT count_if(status <> 'failed') AS finished, count_if(status = 'done' AND length(sha) = 64) + count_if(status = 'Excluded' AND false) AS strict, count_if(status = 'failed') AS failed FROM ({_MAN})")
def manifest_counts(t):
    m = _manifest(t)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(seeds.completed(m), "finished").crossJoin(count(seeds.completed(m, strict=True), "strict")).crossJoin(count(seeds.failed(m), "failed"))


_BARE = r"lower(regexp_replace({}, '\s+', '', 'g'))"
_MANOK = f"(SELECT id, min(url) AS m_url, min(sha) AS m_sha FROM ({_MAN}) WHERE status = 'done' AND length(sha) = 64 GROUP BY ALL)"
_SEED = "SELECT turn, conv_id, text, (['public', 'synthetic', 'Public ', 'odd'])[(conv_id + turn) % 4 + 1] AS origin, CASE WHEN conv_id % 3 = 0 THEN 'synthetic-' || conv_id::VARCHAR ELSE conv_id::VARCHAR END AS doc_id, CASE WHEN conv_id % 5 <> 0 THEN 'http://x/' || (conv_id % 50)::VARCHAR END AS url FROM conversations"
_ORIGIN = f"""SELECT s.*, CASE WHEN origin = 'odd' THEN 'invalid_origin' WHEN origin <> 'synthetic' AND coalesce(url, '') = '' THEN 'missing_source_url' WHEN origin <> 'synthetic' AND length(coalesce(sha, '')) <> 64 THEN 'missing_sha256'
    WHEN origin <> 'synthetic' AND (id IS NULL OR url <> m_url OR sha <> m_sha) THEN 'manifest_mismatch' WHEN origin = 'synthetic' AND NOT starts_with(s.doc_id, 'synthetic-') THEN 'invalid_synthetic_id' WHEN origin = 'synthetic' AND id IS NOT NULL THEN 'synthetic_in_manifest' ELSE '' END AS origin_issue
    FROM (SELECT a.*, CASE WHEN conv_id % 8 <> 0 THEN sha256(d.text) END AS sha FROM ({_SEED}) a LEFT JOIN documents d ON d.doc_id = conv_id) s LEFT JOIN {_MANOK} ON id::VARCHAR = s.doc_id"""


def _seed(t: Table) -> DataFrame:
    c = F.col("conv_id")
    origins = F.array(*map(F.lit, ("public", "synthetic", "Public ", "odd")))
    digests = t("documents").select(F.col("doc_id").alias("conv_id"), F.sha2("text", 256).alias("digest"))
    s = t("conversations").join(digests, "conv_id", "left")
    return s.select(c, F.col("turn").alias("page"), F.col("text").alias("text_gt"), F.element_at(origins, ((c + F.col("turn")) % 4 + 1).cast("int")).alias("origin"), F.when(c % 3 == 0, F.concat(F.lit("synthetic-"), c.cast("string"))).otherwise(c.cast("string")).alias("doc_id"), F.when(c % 5 != 0, F.concat(F.lit("http://x/"), (c % 50).cast("string"))).alias("source_url"), F.when(c % 8 != 0, F.col("digest")).alias("sha256"), "role")


@query(f"SELECT conv_id, turn AS page, doc_id, origin_issue AS issues, text FROM ({_ORIGIN})".replace(", text FROM", ", sha256(text) AS digest FROM"))
def seed_origins(t):
    out = seeds.origin_issue(_seed(t), _manifest(t))
    return out.select("conv_id", "page", "doc_id", F.array_join("origin_issues", ",").alias("issues"), F.sha2("text_gt", 256).alias("digest"))


_F1 = "trim(string_split(text, ' ')[1])"
_PII = r"(^|[^0-9])(1[3-9][0-9]{9}|0[0-9]{2,3}-?[0-9]{7,8}|[0-9]{17}[0-9Xx])($|[^0-9])"


@query(
    f"""WITH o AS ({_ORIGIN}), u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, turn ORDER BY sha256(text)) AS k FROM o), q AS (SELECT * FROM u WHERE k = 1),
    f AS (SELECT doc_id, turn, text, unnest([{{'i': 0, 'name': CASE WHEN turn % 4 = 3 THEN 'odd' ELSE 'first' END, 'value': CASE WHEN conv_id % 9 = 0 THEN 'not in it' ELSE {_F1} END}}, {{'i': 1, 'name': 'second', 'value': CASE WHEN turn % 5 = 4 THEN ' ' ELSE left(text, 3) END}}]) AS x FROM q WHERE conv_id % 11 <> 0),
    g AS (SELECT *, {_BARE.format("x.value")} AS v, {_BARE.format("text")} AS tn, first_value(CASE WHEN x.name <> 'odd' AND trim(x.value) <> '' THEN {_BARE.format("x.value")} END IGNORE NULLS) OVER (PARTITION BY doc_id, x.name ORDER BY turn, x.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM f),
    h AS (SELECT *, CASE WHEN x.name = 'odd' THEN 'unknown_key_field_name' WHEN trim(x.value) = '' THEN 'invalid_fields' WHEN regexp_matches(regexp_replace(x.value, '\\s', '', 'g'), '{_PII}') THEN 'pii_value' WHEN regexp_matches(regexp_replace(text, '\\s', '', 'g'), '{_PII}') THEN 'pii_in_text_gt' WHEN NOT contains(tn, v) THEN 'value_not_in_text_gt' WHEN before <> v THEN 'conflicting_key_field' END AS issue FROM g),
    p AS (SELECT doc_id, turn, string_agg(issue, ',' ORDER BY x.i) AS issues FROM h GROUP BY ALL)
    SELECT q.doc_id, q.turn AS page, CASE WHEN origin_issue = 'invalid_origin' THEN origin_issue WHEN conv_id % 11 = 0 THEN 'empty_fields' ELSE coalesce(issues, origin_issue) END AS issues FROM q LEFT JOIN p USING (doc_id, turn)"""
)
def key_field_seed(t):
    c, turn, body = F.col("conv_id"), F.col("page"), F.col("text_gt")
    seed = store.first(_seed(t).withColumn("digest", F.sha2("text_gt", 256)), ["doc_id", "page"], ["digest"])
    first = F.struct(F.when(turn % 4 == 3, "odd").otherwise("first").alias("name"), F.when(c % 9 == 0, "not in it").otherwise(F.trim(F.get(F.split(body, " "), 0))).alias("value"))
    second = F.struct(F.lit("second").alias("name"), F.when(turn % 5 == 4, " ").otherwise(F.left(body, F.lit(3))).alias("value"))
    out = seeds.key_field_issues(seed.withColumn("fields", F.when(c % 11 != 0, F.array(first, second))), _manifest(t), ("first", "second"))
    return out.select("doc_id", "page", F.array_join("issues", ",").alias("issues"))


@query(
    f"""WITH o AS ({_ORIGIN}), q AS (SELECT *, (conv_id + turn) % 7 AS k FROM o)
    SELECT conv_id, turn AS page, sha256(text) AS digest, CASE WHEN origin_issue = 'invalid_origin' THEN origin_issue WHEN k = 0 THEN 'missing_table_html' WHEN k IN (1, 2) THEN 'invalid_table_html' WHEN k = 3 THEN 'cross_page_table'
    WHEN regexp_matches(regexp_replace(text, '\\s', '', 'g'), '{_PII}') THEN 'pii_in_text_gt' WHEN k = 4 THEN 'pii_value' WHEN k = 5 THEN 'cell_not_in_text_gt' ELSE origin_issue END AS issues FROM q"""
)
def table_seed(t):
    k = (F.col("conv_id") + F.col("page")) % 7
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    own = tables.escaped(F.col("text_gt"))
    whole = lambda *xs: F.concat(F.lit("<Table><tr>"), *map(cell, xs), F.lit("</tr></Table>"))
    html = F.when(k == 0, " ").when(k == 1, "no table").when(k == 2, whole(own)).when(k == 3, F.concat(whole(own, own), F.lit("续表"))).when(k == 4, whole(own, F.lit("13812345678"))).when(k == 5, whole(own, F.lit("zz not there zz"))).otherwise(whole(own, own))
    out = seeds.table_issues(_seed(t).withColumns({"table_html": html, "table_span": F.lit(None).cast("string")}), _manifest(t))
    return out.select("conv_id", "page", F.sha2("text_gt", 256).alias("digest"), F.array_join("issues", ",").alias("issues"))


@query(
    f"""WITH o AS ({_ORIGIN}), q AS (SELECT *, (['seal', 'handwriting', 'body'])[turn % 3 + 1] AS pt, conv_id % 2 = 0 AS s, conv_id % 3 = 0 AS h, trim(origin) AS og, CASE WHEN conv_id % 4 = 0 THEN 'odd' WHEN conv_id % 4 = 1 THEN 'mixed' ELSE '' END AS slot, row_number() OVER (PARTITION BY doc_id, turn ORDER BY sha256(text)) AS k FROM o),
    m AS (SELECT q.*, id, m_url, m_sha FROM q LEFT JOIN {_MANOK} ON id::VARCHAR = q.doc_id WHERE k = 1)
    SELECT doc_id, turn AS page, concat_ws(',', CASE WHEN pt = 'seal' AND NOT s THEN 'seal_slot_inconsistent' END, CASE WHEN pt = 'handwriting' AND NOT h THEN 'hw_slot_inconsistent' END, CASE WHEN NOT s AND NOT h THEN 'empty_slot' END, CASE WHEN og NOT IN ('public', 'synthetic') THEN 'invalid_origin' END,
    CASE WHEN slot = 'odd' THEN 'invalid_slot' END, CASE WHEN og = 'synthetic' AND NOT starts_with(doc_id, 'synthetic-') THEN 'synthetic_doc_id' END, CASE WHEN og = 'public' AND id IS NULL THEN 'unknown_public_doc' END, CASE WHEN og = 'public' AND coalesce(url, '') <> m_url THEN 'source_url_mismatch' END, CASE WHEN og = 'public' AND coalesce(sha, '') <> m_sha THEN 'sha256_mismatch' END) AS issues, s OR pt = 'seal' AS seal, h OR pt = 'handwriting' AS hand FROM m"""
)
def slot_seed(t):
    c = F.col("conv_id")
    seed = store.first(_seed(t).withColumn("digest", F.sha2("text_gt", 256)), ["doc_id", "page"], ["digest"])
    seed = seed.withColumns({"page_type": F.element_at(F.array(*map(F.lit, ("seal", "handwriting", "body"))), (F.col("page") % 3 + 1).cast("int")), "has_seal": c % 2 == 0, "has_hw": c % 3 == 0, "slot": F.when(c % 4 == 0, "odd").when(c % 4 == 1, "mixed").otherwise("")})
    out = seeds.slot_issues(seed, _manifest(t))
    return out.select("doc_id", "page", F.array_join("issues", ",").alias("issues"), seeds.has_seal(F.col("has_seal"), F.col("page_type")).alias("seal"), seeds.has_handwriting(F.col("has_hw"), F.col("page_type")).alias("hand"))


# --- tables

_CELLS = "list_transform(list_sort(list((l_linenumber, l_partkey, l_quantity))), lambda x: '<tr><td>' || x[2]::VARCHAR || '</td><td>' || x[3]::INT::VARCHAR || '</td></tr>')"


@query("SELECT l_orderkey, '<table><thead><tr><th>part &amp; no</th><th>n</th></tr></thead><tbody>' || array_to_string(list_transform(list_sort(list({'a': l_linenumber, 'b': l_partkey, 'c': l_quantity})), lambda x: '<tr><td>' || x.b::VARCHAR || '</td><td>' || CASE WHEN x.a % 2 = 0 THEN x.c::INT::VARCHAR ELSE '' END || '</td></tr>'), '') || '</tbody></table>' AS html FROM lineitem GROUP BY ALL")
def table_html(t):
    """An order's lines as a table with a header; every other row lacks its last cell and is filled up."""
    number = F.col("l_quantity").cast("int").cast("string")
    cells = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_partkey").cast("string"), number)).otherwise(F.array(F.col("l_partkey").cast("string")))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", cells.alias("cells")))).alias("r"))
    body = F.concat(F.array(F.array(F.lit("part & no"), F.lit("n"))), F.col("r.cells"))
    return rows.select("l_orderkey", tables.rows_to_html(body).alias("html"))


@query(r"SELECT doc_id, round(len(list_filter(c, lambda x: contains(n, x))) / len(c), 6) AS share FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ' ') || ['zz never there', 'a1fi'], lambda x: lower(regexp_replace(x, '\s+', '', 'g'))), lambda x: x <> '') AS c, lower(regexp_replace(text, '\s+', '', 'g')) || 'a1fi' AS n FROM documents)")
def table_support(t):
    """A document's words as cells, with one that is not in it and one that is there in full width and as a ligature."""
    cells = F.concat(F.split("text", " "), F.array(F.lit("zz never there"), F.lit("a1　FI")))
    d = t("documents").select("doc_id", text.norm_each(cells).alias("cells"), text.norm(F.concat("text", F.lit("　Ａ１ﬁ"))).alias("whole"))
    return d.select("doc_id", F.round(tables.support(F.col("cells"), F.col("whole")), 6).alias("share"))


@query("SELECT l_orderkey, min(s) AS seq FROM (SELECT l_orderkey, l_linenumber AS s, l_quantity > 20 AND l_partkey % 6 <> 0 AND l_suppkey % 5 <> 0 AS ok FROM lineitem) WHERE ok GROUP BY ALL")
def first_supported_table(t):
    """A line stands for a table of two rows; small ones lack a row, some hold a phone number, some are not in the text."""
    a, b = F.lit("alpha  1"), F.when(F.col("l_partkey") % 6 == 0, "13812345678").when(F.col("l_suppkey") % 5 == 0, "gone").otherwise("beta")
    second = F.array(F.when(F.col("l_quantity") > 20, "gamma"), F.when(F.col("l_suppkey") % 5 == 0, "lost"))
    rows = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.array(F.array(a, b), F.when(F.col("l_quantity") > 20, second).otherwise(F.array(F.lit(" "), F.lit(None)))).alias("rows"), F.lit("ALPHA 1 beta gamma 13812345678").alias("page_text"))
    return tables.first_supported(rows, "l_orderkey", "seq").select("l_orderkey", "seq")


@query()
def lines_over_cells(t):
    """Words of a conversation as recognised lines over a grid of three rows and two columns."""
    words = t("conversations").select("conv_id", F.posexplode(F.split("text", " ")).alias("line", "text"), "turn").withColumn("line", F.col("line") + F.col("turn") * 100_000)
    lines = words.withColumns({"x0": (F.col("line") % 4 * 20).cast("double"), "y0": (F.col("line") % 3 * 10).cast("double")})
    lines = lines.select("conv_id", "line", "text", "x0", (F.col("x0") + 30).alias("x1"), "y0", (F.col("y0") + 8).alias("y1"))
    cells = [(r, c, c * 45.0, c * 45.0 + 40, r * 10.0, r * 10.0 + 9) for r in range(3) for c in range(2)]
    grid = F.inline(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(x).alias("x0"), F.lit(y).alias("x1"), F.lit(u).alias("y0"), F.lit(v).alias("y1")) for r, c, x, y, u, v in cells)))
    return tables.lines_in_grid(lines, t("conversations").select("conv_id").distinct().select("conv_id", grid), "conv_id")


# --- chains, limits, alerts

_EV = "SELECT user_id, event_id, event_type, value, ts FROM events"


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    c AS (SELECT user_id, event_id, n, NULL::VARCHAR AS prev_hash, sha256('|' || event_id::VARCHAR || '|' || event_type) AS event_hash FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, c.event_hash, sha256(c.event_hash || '|' || e.event_id::VARCHAR || '|' || e.event_type) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
    SELECT user_id, event_id, prev_hash, event_hash FROM c"""
)
def chain_append(t):
    e = t("events").select("user_id", "event_id", "event_type")
    none = e.select("user_id", F.lit(None).cast("string").alias("event_hash")).distinct()
    return timewin.append_chain(none, e, "user_id", "event_id", ["event_id", "event_type"])


@query(
    """WITH h AS (SELECT user_id, event_id, CASE WHEN event_id % 997 = 5 THEN 'altered' ELSE event_type END AS event_type, sha256('|' || event_id::VARCHAR || '|' || event_type) AS own FROM events),
    p AS (SELECT *, lag(own) OVER w AS before FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, CASE WHEN event_id % 991 = 7 THEN 'broken' ELSE before END AS prev_hash FROM p),
    k AS (SELECT *, sha256(coalesce(prev_hash, '') || '|' || event_id::VARCHAR || '|' || event_type) AS expected, CASE WHEN event_id % 2 = 0 THEN sha256(coalesce(before, '') || '|' || event_id::VARCHAR || '|' || CASE WHEN event_type = 'altered' THEN 'x' ELSE event_type END) ELSE 'none' END AS event_hash FROM s)
    SELECT user_id, count(*) AS events, min(CASE WHEN coalesce(prev_hash, '') <> coalesce(l, '') OR event_hash <> expected THEN event_id END) AS first_break FROM (SELECT *, lag(event_hash) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM k) GROUP BY ALL"""
)
def chain_of_odd_hashes(t):
    """Chains with most links broken: the first break is found in every one."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    joined = lambda *parts: F.sha2(F.concat_ws("|", *parts), 256)
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    e = t("events").select("user_id", "event_id", F.when(F.col("event_id") % 997 == 5, "altered").otherwise(kind).alias("event_type"), joined(F.lit(""), n, kind).alias("own"))
    e = e.withColumn("before", F.lag("own").over(w)).withColumn("prev_hash", F.when(F.col("event_id") % 991 == 7, "broken").otherwise(F.col("before")))
    made = joined(F.coalesce("before", F.lit("")), n, F.when(kind == "altered", "x").otherwise(kind))
    e = e.withColumn("event_hash", F.when(F.col("event_id") % 2 == 0, made).otherwise("none"))
    return timewin.verify_chain(e, "user_id", "event_id", ["event_id", "event_type"])


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    c AS (SELECT user_id, event_id, n, event_type, NULL::VARCHAR AS prev_hash, sha256('|' || event_id::VARCHAR || '|' || event_type) AS event_hash FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, e.event_type, c.event_hash, sha256(c.event_hash || '|' || e.event_id::VARCHAR || '|' || e.event_type) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
    SELECT user_id, count(*) AS events, min(CASE WHEN event_id % 97 = 3 OR (prev_hash IS NOT NULL AND event_id % 89 = 5) THEN event_id END) AS first_break FROM c GROUP BY ALL"""
)
def chain_verified(t):
    """Whole chains, with some contents and some pointers altered after they were stored."""
    e = t("events").select("user_id", "event_id", "event_type")
    none = e.select("user_id", F.lit(None).cast("string").alias("event_hash")).distinct()
    stored = timewin.append_chain(none, e, "user_id", "event_id", ["event_id", "event_type"]).join(e, ["user_id", "event_id"])
    stored = stored.withColumn("event_type", F.when(F.col("event_id") % 97 == 3, "altered").otherwise(F.col("event_type")))
    stored = stored.withColumn("prev_hash", F.when(F.col("prev_hash").isNotNull() & (F.col("event_id") % 89 == 5), "broken").otherwise(F.col("prev_hash")))
    return timewin.verify_chain(stored, "user_id", "event_id", ["event_id", "event_type"])


_LIMITS = {"click": (2, 86_400), "view": (3, 172_800), "purchase": (1, 3_600)}


@query(
    " UNION ALL ".join(
        f"SELECT event_id, hits, hits >= {m} AS rejected, CASE WHEN hits >= {m} THEN greatest(1, floor({s} - (epoch_us(ts) - oldest) / 1000000))::INT END AS retry_after FROM (SELECT event_id, ts, count(*) OVER w AS hits, min(epoch_us(ts)) OVER w AS oldest FROM events WHERE event_type = '{n}' WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {s * 1_000_000 - 1} PRECEDING AND CURRENT ROW))"
        for n, (m, s) in _LIMITS.items()
    )
)
def named_limits(t):
    return timewin.limited(t("events"), "event_type", "user_id", "ts", _LIMITS).select("event_id", "hits", "rejected", "retry_after")


@query()
def resend_cooldown(t):
    return timewin.cooled(t("events"), "user_id", "ts", "event_id", 43_200).select("user_id", "event_id", "sent")


@query("SELECT event_id, CASE WHEN before > 0 THEN 'CONSUMED' WHEN n > 5 THEN 'EXHAUSTED' WHEN ok THEN 'ACCEPTED' ELSE 'WRONG' END AS result FROM (SELECT *, coalesce(sum(ok::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER w AS n FROM (SELECT event_id, user_id, event_type, event_id % 7 = 0 AS ok FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))")
def challenge_attempts(t):
    e = t("events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("challenge"), (F.col("event_id") % 7 == 0).alias("ok"))
    return timewin.attempts_left(e, "challenge", "event_id").select("event_id", "result")


@query("SELECT o_orderkey, CASE WHEN d < 0 THEN 'order ' || o_orderkey::VARCHAR || ' is overdue by ' || (-d)::VARCHAR || ' days' WHEN d = 0 THEN 'order ' || o_orderkey::VARCHAR || ' is due today' ELSE 'order ' || o_orderkey::VARCHAR || ' is due in ' || d::VARCHAR || ' days' END AS message FROM (SELECT o_orderkey, date_diff('day', DATE '1996-06-01', o_orderdate::DATE) AS d FROM orders WHERE o_orderdate::DATE <= DATE '1996-06-04')")
def due_messages(t):
    rows = timewin.due_alerts(t("orders"), "o_orderdate", F.lit("1996-06-01").cast("date"))
    title = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", timewin.due_message(F.col("days_left"), title).alias("message"))


@query("SELECT event_id, v, v LIKE '2024-%' AND event_id % 6 <> 2 AS valid FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN '2024-13-45' WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') WHEN 4 THEN 'soon' ELSE '' END AS v FROM events)")
def iso_dates(t):
    k, stamp = F.col("event_id") % 6, lambda f: F.date_format("ts", f)
    v = F.when(k == 0, stamp("yyyy-MM-dd")).when(k == 1, stamp("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, "2024-13-45").when(k == 3, stamp("yyyy-MM-dd'T'HH:mm:ss'+08:00'")).when(k == 4, "soon").otherwise("")
    return t("events").select("event_id", v.alias("v")).withColumn("valid", text.iso_valid(F.col("v")))


@query("SELECT page_id, CASE WHEN s = '' THEN 'file' ELSE s END AS name FROM (SELECT page_id, left(regexp_replace(trim(regexp_extract(url, '[^/]*$', 0)), '[^A-Za-z0-9_.-]+', '_', 'g'), 120) AS s FROM pages)")
def safe_filenames(t):
    return t("pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query(r"""SELECT doc_id, sha256(masked) AS masked, lines, (lines = 0 AND NOT contains(text, '<N1>') AND NOT contains(text, '<N2>')) AS restored
    FROM (SELECT doc_id, text, regexp_replace(replace(replace(text, 'the ', '<N2>'), 'the', '<N1>'), '(^|[^0-9])(0[0-9]{2,3}-?[0-9]{7,8})($|[^0-9])', '\1［已隐去电话］\3', 'g') AS masked,
    len(regexp_extract_all(text, '(^|[^0-9])0[0-9]{2,3}-?[0-9]{7,8}($|[^0-9])')) AS lines FROM documents)""")
def masked_round_trip(t):
    """Names to placeholders and back: a text comes back as it was unless a number was masked in it or it held a placeholder."""
    names = {"the ": "<N2>", "the": "<N1>"}
    d = t("documents").select("doc_id", "text", text.masked_names(F.col("text"), names).alias("masked"))
    lines = F.size(F.regexp_extract_all("text", F.lit(text.LANDLINE), F.lit(0))).cast("long")
    return d.select("doc_id", F.sha2("masked", 256).alias("masked"), lines.alias("lines"), (text.rehydrated(F.col("masked"), names) == F.col("text")).alias("restored"))


@query(r"SELECT item_id, contains(lower(regexp_replace(text, '\s+', '', 'g')), lower(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || CASE WHEN item_id % 3 = 0 THEN 'zzz' ELSE '' END, '\s+', '', 'g'))) AS hit FROM benchmark")
def field_hits(t):
    low = "abcdefghijklmnopqrstuvwxyz"
    value = F.concat(F.translate("text", low, low.upper()), F.when(F.col("item_id") % 3 == 0, "zzz").otherwise(""))
    return t("benchmark").select("item_id", text.field_hit(F.col("text"), value).alias("hit"))


@query("SELECT doc_id, length(trim(text)) < 50 AS sparse, length(regexp_replace(text, '[\\s]+', '', 'g'))::INT + 3 AS counted FROM documents")
def page_decisions(t):
    """What is counted is a text in normal form: a ligature and a letter in full width are three characters."""
    return t("documents").select("doc_id", text.sparse(F.col("text")).alias("sparse"), text.counted(F.concat("text", F.lit("　ﬁＡ"))).alias("counted"))


@query("SELECT category, tp, fp, fn, tn, detected_total, CASE WHEN detected_total > 0 THEN round((tp + fp) / detected_total, 6) END AS coverage, CASE WHEN detected_total > 0 AND tp + fp = detected_total AND tp + fp + fn + tn >= 20 AND complete THEN 'MEASURABLE' ELSE 'INSUFFICIENT' END AS status FROM (SELECT coalesce(f.category, d.category) AS category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, coalesce(detected_total, 0) AS detected_total, coalesce(complete, false) AS complete FROM (SELECT p_brand AS category, count_if(p AND a) AS tp, count_if(p AND NOT a) AS fp, count_if(NOT p AND a) AS fn, count_if(NOT p AND NOT a) AS tn, bool_and(NOT (p_brand LIKE '%1' AND l_orderkey % 9 = 0)) AS complete FROM (SELECT p_brand, l_orderkey, l_quantity > 10 AS p, l_tax > 0.02 AS a FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT LIKE '%5') GROUP BY ALL) f FULL JOIN (SELECT p_brand AS category, count_if(l_quantity > 10 OR p_brand LIKE '%2') AS detected_total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT LIKE '%4' GROUP BY ALL) d USING (category))")
def accuracy_by_brand(t):
    """Coverage and completeness vary: some brands have detections beyond those reviewed, some no feedback at all, some
    no detections, some an incomplete review."""
    both = t("lineitem").join(t("part").select("p_partkey", F.col("p_brand").alias("category")), F.col("l_partkey") == F.col("p_partkey"))
    ends = lambda d: F.col("category").endswith(d)
    feedback = both.filter(~ends("5")).select("category", (F.col("l_quantity") > 10).alias("predicted"), (F.col("l_tax") > 0.02).alias("actual"), (~(ends("1") & (F.col("l_orderkey") % 9 == 0))).alias("complete"))
    detected = both.filter(~ends("4")).groupBy("category").agg(F.count_if((F.col("l_quantity") > 10) | ends("2")).alias("detected_total"))
    a = evaluate.accuracy(feedback, detected)
    return a.select("category", "tp", "fp", "fn", "tn", "detected_total", F.round("coverage", 6).alias("coverage"), "status")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT user_id, event_type, max(event_id) FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 2 = 0) GROUP BY ALL) GROUP BY ALL")
def insert_missing_only(t):
    """New rows come in only where the key is not there; a stored row stays though the new one is older or younger."""
    e = t("events").select("user_id", "event_type", "event_id")
    old = e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    new = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return store.insert_missing(old, new, ["user_id", "event_type"])


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.06), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_tax > 0.06) (SELECT k, 'only_r' AS side FROM a EXCEPT SELECT k, 'only_r' FROM b) UNION ALL (SELECT k, 'only_a' FROM b EXCEPT SELECT k, 'only_a' FROM a)")
def key_difference_both(t):
    side = lambda f: t("lineitem").filter((F.col("l_returnflag") == f) & (F.col("l_tax") > 0.06)).select(F.col("l_partkey").alias("k"))
    out = store.same_ids(side("R"), side("A"), "k")
    return out.select("k", F.when(F.col("side") == "not_wanted", "only_r").otherwise("only_a").alias("side"))


@query("SELECT event_type, v[(floor(0.95 * (len(v) - 1)) + 1)::INT] AS p95_a, v[(greatest(0, floor(len(v) * 0.95) - 1) + 1)::INT] AS p95_b FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL)")
def p95_by_ranges(t):
    """Both p95 by counts of ranges: only the range that holds the rank is looked at value by value."""
    total = F.col("total")
    ranks = {"p95_a": F.floor(F.lit(0.95) * (total - 1)) + 1, "p95_b": F.greatest(F.lit(0), F.floor(total * F.lit(0.95)) - 1) + 1}
    return cohorts.nearest_ranks(t("events"), ["event_type"], "value", ranks, 1.0)


@query("SELECT doc_id, CASE WHEN regexp_matches(q, 'no|not') THEN 'NEGATIVE_OR_EXCLUSION' WHEN regexp_matches(q, 'must|shall') THEN 'OBLIGATION' ELSE 'NEUTRAL' END AS polarity FROM (SELECT doc_id, text AS q FROM documents)")
def polarity_of_quotes(t):
    """The Chinese wording stands in for the Latin one, word by word, before the rule is asked."""
    words = F.regexp_replace(F.regexp_replace("text", "no|not", "不得"), "must|shall", "必须")
    return t("documents").select("doc_id", rules.polarity(words).alias("polarity"))


@query("SELECT doc_id, array_to_string(list_distinct(list_transform(regexp_extract_all(left(text, 160), '[A-Za-z]{3,}'), lambda x: lower(x))) || CASE WHEN doc_id % 2 = 0 THEN ['保证金', '保函'] ELSE ['评分', '业绩'] END, ',') AS terms FROM documents".replace("list_distinct(list_transform(", "list_filter(list_transform(").replace("lambda x: lower(x)))", "lambda x: lower(x)), lambda x, i: list_position(list_transform(regexp_extract_all(left(text, 160), '[A-Za-z]{3,}'), lambda y: lower(y)), x) = i)"))
def category_terms(t):
    category = F.when(F.col("doc_id") % 2 == 0, "BOND").otherwise("SCORING")
    return t("documents").select("doc_id", F.array_join(rules.terms(F.left("text", F.lit(160)), category), ",").alias("terms"))


@query("SELECT conv_id, count(*) AS turns, round(sum(edits) / nullif(sum(chars), 0), 6) AS cer FROM (SELECT conv_id, levenshtein(a, b) AS edits, length(a) AS chars FROM (SELECT conv_id, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS a, lower(regexp_replace(replace(text, 'the', 'eth'), '[^a-zA-Z0-9]', '', 'g')) AS b FROM conversations)) GROUP BY ALL")
def page_cer(t):
    clean = lambda x: F.lower(F.regexp_replace(x, "[^a-zA-Z0-9]", ""))
    p = t("conversations").select("conv_id", clean(F.col("text")).alias("a"), clean(F.replace("text", F.lit("the"), F.lit("eth"))).alias("b"))
    p = p.withColumns({"edits": F.levenshtein("a", "b").cast("long"), "chars": F.length("a").cast("long"), "page_cer": metrics.cer(F.col("a"), F.col("b"))})
    return p.groupBy("conv_id").agg(F.count("*").alias("turns"), F.round(F.sum("edits") / F.nullif(F.sum("chars"), F.lit(0)), 6).alias("cer"))

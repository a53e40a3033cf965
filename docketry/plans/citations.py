"""Registered queries over citations, listings, queues, ledgers and manifest merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import metrics, text
from docketry.operators import evaluate, review, rules, seeds
from docketry.plans.catalog import _QUOTE, _SCAN, BLOCKS, blocks, query
from docketry.plans.evidence import _BARE, _FOUND
from docketry.plans.reviewing import _CITED, REQ, requirements

_SQUEEZE = r"trim(regexp_replace({}, '[\s\x0b\x1c-\x1f\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def _page_blocks(t):
    """Each line as a page of two blocks: its first half and the whole; every fifth page has a label of its own."""
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    named = lambda name: F.concat(F.lit(name), F.col("line").cast("string"))
    whole = F.struct(F.col("text"), F.when(F.col("line") % 3 != 0, named("b")).alias("label"))
    return blocks(t).withColumns({"label": F.when(F.col("line") % 5 == 0, named("L")), "blocks": F.array(F.struct(half.alias("text"), named("a").alias("label")), whole)})


@query(
    f"""WITH b AS ({BLOCKS}), s AS (SELECT *, {_QUOTE} AS quote, row_number() OVER (PARTITION BY doc_id ORDER BY line, rule, pos) AS seq FROM ({_SCAN}))
    SELECT doc_id, line::INT AS line, seq::INT AS seq, left(quote, 160) AS title, CASE WHEN contains(left(text, (length(text) // 2)::INT), hit) THEN 'a' || line::VARCHAR WHEN line % 3 <> 0 THEN 'b' || line::VARCHAR WHEN line % 5 = 0 THEN 'L' || line::VARCHAR ELSE '第 ' || line::VARCHAR || ' 页' END AS locator FROM s"""
)
def requirement_locators(t):
    """Every match with its title and the label of the first block that holds it."""
    found = rules.scan(blocks(t), "doc_id", "line", "text", rules.LATIN)
    return rules.located(found, _page_blocks(t), "doc_id", "line").select("doc_id", "line", "seq", "title", "locator")


@query(
    f"""WITH {_FOUND}, e AS (SELECT doc_id - 1 AS doc_id, line, text, {_BARE} AS c, {_BARE.replace("text", "left(text, (length(text) // 2)::INT)")} AS ch FROM b),
    p AS (SELECT doc_id, list(c ORDER BY line) AS cs, list(line ORDER BY line) AS ls, list(text ORDER BY line) AS ts, list(ch ORDER BY line) AS hs, string_agg(c, '' ORDER BY line) AS whole FROM e GROUP BY doc_id),
    q AS (SELECT doc_id, seq, category, list_distinct(list_transform(regexp_extract_all(quote, '[A-Za-z]{{3,}}'), lambda x: lower(x)) || CASE category WHEN 'CREDENTIAL' THEN ['iso13485'] ELSE [] END) AS terms, cs, ls, ts, hs, whole FROM r LEFT JOIN p USING (doc_id)),
    f AS (SELECT *, len(list_filter(terms, lambda t: contains(coalesce(whole, ''), t))) AS matched, list_filter(range(1, coalesce(len(cs), 0) + 1), lambda i: len(list_filter(terms, lambda t: contains(cs[i], t))) > 0)[1] AS k FROM q),
    g AS (SELECT *, ls[k] AS pg, ts[k] AS tx, len(list_filter(terms, lambda t: contains(hs[k], t))) > 0 AS in_half, matched > 0 AND k IS NOT NULL AS hit FROM f)
    SELECT doc_id, seq, CASE WHEN hit THEN CASE WHEN in_half THEN 'a' || pg::VARCHAR WHEN pg % 3 <> 0 THEN 'b' || pg::VARCHAR WHEN pg % 5 = 0 THEN 'L' || pg::VARCHAR ELSE '第 ' || pg::VARCHAR || ' 页' END END AS locator,
    CASE WHEN hit THEN left({_SQUEEZE.format("CASE WHEN in_half THEN left(tx, (length(tx) // 2)::INT) ELSE tx END")}, 240) END AS evidence_quote, CASE WHEN hit THEN matched END::INT AS rule_score, CASE WHEN hit THEN 'PENDING' END AS match_review_status FROM g"""
)
def evidence_citations(t):
    """Each document's requirements against the next document: the citation of the first page that holds a term."""
    found = rules.first_wins(rules.scan(blocks(t), "doc_id", "line", "text", rules.LATIN), "doc_id", "line")
    asked = found.select(F.col("doc_id").alias("doc"), F.col("seq").alias("requirement_id"), F.col("quote").alias("title"), "category")
    pages = _page_blocks(t).select((F.col("doc_id") - 1).alias("doc"), F.col("line").alias("page"), "text", F.lit(None).cast("string").alias("ocr_status"), "label", F.lit("f").alias("filename"), "blocks")
    got = rules.with_citation(rules.match_evidence(asked, pages), pages)
    return got.select(F.col("doc").alias("doc_id"), F.col("requirement_id").alias("seq"), "locator", "evidence_quote", "rule_score", "match_review_status")


@query(
    f"""WITH r AS (SELECT run_id, count(*) AS total, count_if(status IN ('UNKNOWN', 'NEEDS_REVIEW')) AS unresolved, count_if(category IN ('FATAL', 'QUALIFICATION') AND status IN ('FAIL', 'UNKNOWN', 'NEEDS_REVIEW')) AS blockers, count_if(category = 'FATAL') AS fatal FROM ({REQ}) WHERE l_suppkey % 3 > 0 GROUP BY ALL)
    SELECT o_orderkey AS run_id, o_orderstatus, coalesce(total, o_custkey % 9) AS total, coalesce(unresolved, 0) AS unresolved, coalesce(blockers, CASE WHEN o_custkey % 2 = 0 THEN 4 END, 0) AS blockers, coalesce(fatal, 1) AS fatal FROM orders LEFT JOIN r ON run_id = o_orderkey"""
)
def run_summaries(t):
    """Listing counters from the requirements; a run whose lines all come from each third supplier shows stored ones."""
    k = F.col("o_custkey")
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus", (k % 9).alias("requirement_count"), F.when(k % 2 == 0, 4).alias("blocker_count"), F.lit(1).alias("fatal_risk_count"))
    return review.run_summaries(runs, requirements(t).filter("l_suppkey % 3 > 0"))


@query("SELECT page_id AS run_id, 'PROCESSING' AS status, 1 AS revision, 'INGEST' AS phase, 0 AS events FROM pages")
def initial_runs(t):
    asked = t("pages").select(F.col("page_id").alias("run_id"), text.safe_filename(F.col("url")).alias("filename"))
    docs = review.initial_runs(asked, F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    return docs.select("run_id", "status", "revision", F.col("state.phase").alias("phase"), F.size("state.review_events").alias("events"))


@query(f"SELECT run_id, requirement_id, category, left(title, 160) AS title, CASE WHEN coalesce(s_label, '') <> '' THEN s_label ELSE '{review.NO_LOCATOR}' END AS locator, left(s_quote, 240) AS quote FROM ({REQ}) WHERE status IN ('UNKNOWN', 'NEEDS_REVIEW')")
def review_packet(t):
    return review.review_packet(requirements(t))


@query("SELECT conv_id, list_sort(list_distinct(list(turn)))::VARCHAR AS pages, array_to_string(list_sort(list_distinct(list(role))), ',') AS fields FROM conversations GROUP BY ALL")
def document_index(t):
    d = review.document_index(t("conversations"), "conv_id", "turn", "role")
    return d.select("conv_id", F.concat(F.lit("["), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit("]")).alias("pages"), F.array_join("fields", ",").alias("fields"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND toxic = 0")
def metric_eligible(t):
    d = t("documents").select("doc_id", "text").join(t("labels"), "doc_id", "left")
    d = d.withColumns({"review_status": F.when(F.col("quality") == 1, "CONFIRMED").otherwise("OPEN"), "origin": F.when(F.col("doc_id") % 3 != 0, "public").otherwise("synthetic"), "sha256": F.when(F.col("doc_id") % 7 != 0, F.sha2("text", 256)).otherwise("cut"), "independent": F.col("toxic") == 0})
    return review.metric_eligible(d).select("doc_id")


@query("SELECT page_id FROM pages WHERE page_id % 4 <> 0 AND NOT starts_with(url, 'http://') AND page_id % 5 <> 1")
def scored_rows(t):
    p = t("pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "synthetic-1").otherwise("doc").alias("doc_id"), F.col("url").alias("source_url"), F.when(F.col("page_id") % 5 != 1, 0.5).alias("score"))
    return review.scored(p, ["http://"]).select("page_id")


_LAST = "SELECT conv_id AS id, arg_max(CASE WHEN length(text) % 2 = 0 THEN 'CONFIRM' ELSE 'REJECT' END, turn * 1000000 + length(text)) AS decision FROM conversations GROUP BY ALL"


@query(f"SELECT doc_id AS requirement_id, coalesce(decision = 'CONFIRM', false) AS confirmed FROM documents LEFT JOIN ({_LAST}) ON id = doc_id")
def review_queue(t):
    """Both queues, side by side."""
    req = t("documents").select(F.col("doc_id").alias("requirement_id"))
    reviews = t("conversations").select(F.col("conv_id").alias("requirement_id"), F.when(F.length("text") % 2 == 0, "CONFIRM").otherwise("REJECT").alias("decision"), (F.col("turn") * 1_000_000 + F.length("text")).alias("seq"))
    queue = lambda done: review.review_queue(req, reviews, done).select("requirement_id", F.lit(done).alias("confirmed"))
    return queue(True).unionByName(queue(False))


@query("SELECT s_suppkey, coalesce(CASE WHEN c_acctbal > 0 THEN 'YES' WHEN c_acctbal <= 0 THEN 'NO' END, 'OPEN') AS verdict, coalesce(c_name, 'first') AS reviewer, c_custkey IS NOT NULL AS second_pass FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON s_suppkey = c_custkey")
def ledger_decisions(t):
    ledger = t("supplier").select("s_suppkey", F.lit("OPEN").alias("verdict"), F.lit("first").alias("reviewer"))
    decisions = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.when(F.col("c_acctbal") > 0, "YES").otherwise("NO").alias("verdict"), F.col("c_name").alias("reviewer"))
    return review.with_decisions(ledger, decisions, "s_suppkey")


@query(f"SELECT category, count(*) AS total, count(*) - count_if(status IN ('PASS', 'FAIL')) AS open, count_if(status IN ('PASS', 'FAIL')) AS decided, floor(100 * count_if(status IN ('PASS', 'FAIL')) / count(*))::BIGINT AS percent FROM ({REQ}) GROUP BY ALL")
def dashboard(t):
    return review.dashboard(requirements(t), "category")


@query()
def run_uuids(t):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    return t("orders").select("o_orderkey", review.name_uuid(space, F.concat(F.lit("job:"), F.col("o_orderkey").cast("string"))).alias("run_id"))


@query("SELECT event_id, CASE WHEN value > 50 THEN TIMESTAMP '2024-03-01' END AS delivered_at, CASE WHEN value <= 50 THEN TIMESTAMP '2024-03-01' END AS failed_at FROM events WHERE value IS NOT NULL")
def delivery_marks(t):
    none = F.lit(None).cast("timestamp_ntz")
    e = t("events").filter("value is not null").select("event_id", (F.col("value") > 50).alias("succeeded"), none.alias("delivered_at"), none.alias("failed_at"))
    return review.delivered(e, F.expr("timestamp_ntz'2024-03-01 00:00:00'")).drop("succeeded")


@query(
    """WITH a AS (SELECT doc_id, 'u' || (doc_id % 60)::VARCHAR AS url, sha256(text) AS sha, doc_id % 4 = 0 AS off FROM documents),
    m AS (SELECT * FROM a WHERE doc_id % 2 = 0), f AS (SELECT * FROM a WHERE doc_id % 2 = 1 OR doc_id % 12 = 0),
    f2 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN url ELSE 'n' || doc_id::VARCHAR END AS url, sha, CASE WHEN doc_id % 12 = 0 THEN false ELSE doc_id % 5 = 1 END AS off FROM f),
    d AS (SELECT * FROM m WHERE NOT off), n0 AS (SELECT * FROM f2 WHERE NOT off AND sha NOT IN (SELECT sha FROM d) AND url NOT IN (SELECT url FROM d)),
    n AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id::VARCHAR) = 1), o AS (SELECT * FROM m WHERE off AND url NOT IN (SELECT url FROM n)),
    k AS (SELECT url FROM d UNION SELECT url FROM n UNION SELECT url FROM m WHERE off), x AS (SELECT * FROM f2 WHERE off AND url NOT IN (SELECT url FROM k))
    SELECT doc_id::VARCHAR AS document_id, url AS source_url, off FROM (SELECT * FROM d UNION ALL SELECT * FROM n UNION ALL SELECT * FROM o UNION ALL SELECT * FROM x)"""
)
def manifest_merge(t):
    """A second fetch into a manifest: new finished rows, known digests and urls, failures mended and failures new."""
    d = F.col("doc_id")
    a = t("documents").select(d, d.cast("string").alias("document_id"), F.concat(F.lit("u"), (d % 60).cast("string")).alias("source_url"), F.sha2("text", 256).alias("sha256"), F.when(d % 4 == 0, "failed").otherwise("done").alias("status"))
    old = a.filter(d % 2 == 0)
    new = a.filter((d % 2 == 1) | (d % 12 == 0)).withColumns({"source_url": F.when(d % 3 == 0, F.col("source_url")).otherwise(F.concat(F.lit("n"), d.cast("string"))), "status": F.when((d % 12 != 0) & (d % 5 == 1), "failed").otherwise("done")})
    merged = seeds.merge_manifest(old.drop("doc_id"), new.drop("doc_id"))
    return merged.select("document_id", "source_url", (F.col("status") == "failed").alias("off"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN NULL ELSE date_trunc('day', ts) END AS at FROM events")
def text_to_timestamp(t):
    """A text column of mixed forms as timestamps; what is no moment becomes null."""
    k = F.col("event_id") % 4
    stored = F.when(k == 0, F.col("ts").cast("string")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t("events").select("event_id", stored.alias("s")).select("event_id", F.expr("try_cast(s as timestamp_ntz)").alias("at"))


@query("WITH x AS (SELECT conv_id, turn, text, unnest([{'i': 0, 'n': role, 'v': left(text, 12)}, {'i': 1, 'n': 'len', 'v': CASE WHEN turn % 2 = 0 THEN length(text)::VARCHAR ELSE ' ' END}]) AS f FROM conversations) SELECT conv_id AS doc_id, f.n AS name, f.v AS value FROM x WHERE trim(f.v) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, f.n ORDER BY turn DESC, f.i DESC, f.v DESC) = 1")
def last_fields(t):
    """Of a document's fields of one name the last line's stands; blank values don't count."""
    f = F.array(F.struct(F.col("role").alias("name"), F.left("text", F.lit(12)).alias("value")), F.struct(F.lit("len").alias("name"), F.when(F.col("turn") % 2 == 0, F.length("text").cast("string")).otherwise(" ").alias("value")))
    rows = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), "text", f.alias("fields"))
    each = rows.select("doc_id", F.struct("line", F.left("text", F.lit(12)).alias("tie")).alias("line"), "fields")
    return evaluate.last_fields(each)


@query(f"SELECT category, count(*) AS n, count_if({_CITED}) AS cited, count_if(status = 'PASS') AS passed, CASE WHEN count_if(status = 'PASS') = count(*) THEN 'GATE_PASS' ELSE 'GATE_FAIL' END AS gate FROM ({REQ}) GROUP BY ALL")
def category_gates(t):
    r = requirements(t).groupBy("category").agg(F.count("*").alias("n"), F.count_if(review.complete_citation(F.col("source"), F.col("evidence"))).alias("cited"), F.count_if(F.col("status") == "PASS").alias("passed"))
    rate = 1 - F.col("passed") / F.col("n")
    return r.withColumn("gate", metrics.gate(line_cer=rate, key_field_f1=1 - rate, teds=1 - rate))

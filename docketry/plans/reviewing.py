"""Registered queries over requirements under review: reports, citations, decisions, listings and store transitions.

An order stands for a run, its lines for the run's requirements; what the tables lack is made of their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import review, store, timewin
from docketry.plans.catalog import Table, query

CATEGORIES = ("QUALIFICATION", "FATAL", "SCORING", "DEADLINE", "SIGNATURE", "BOND", "CREDENTIAL")
_CATS = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_ENTRY = "{{'filename': 'file' || (l_suppkey + {k})::VARCHAR, 'label': CASE WHEN l_tax > 0.03 THEN 'e' || (l_linenumber + {k})::VARCHAR END, 'quote': CASE WHEN l_tax > 0.05 THEN 'q' ELSE '' END}}"
REQ = f"""SELECT l_orderkey AS run_id, l_linenumber AS requirement_id, ({_CATS})[l_linenumber % 7 + 1] AS category, 'L' || l_linenumber::VARCHAR AS label,
CASE WHEN l_quantity < 10 THEN 'UNKNOWN' WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS status,
CASE WHEN l_linenumber % 7 < 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, '  Part  ' || l_partkey::VARCHAR || ' OF ' AS title,
CASE WHEN l_partkey % 5 <> 0 THEN 'p' || l_suppkey::VARCHAR END AS s_label, CASE WHEN l_partkey % 7 <> 0 THEN 'quote' ELSE '' END AS s_quote,
CASE WHEN l_discount > 0.06 THEN [{_ENTRY.format(k=0)}] WHEN l_discount > 0.02 THEN [{_ENTRY.format(k=0)}, {_ENTRY.format(k=1)}] ELSE [] END AS ev, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem"""
_CITED = "(coalesce(s_label, '') <> '' AND s_quote <> '' AND len(list_filter(ev, lambda e: coalesce(e.label, '') <> '' AND e.quote <> '')) > 0)"


_ONE = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)"


def requirements(t: Table, once: bool = False) -> DataFrame:
    """With `once` the first line of each number in an order, as some repeat."""
    c, lines = F.col, t("lineitem")
    if once:
        lines = store.first(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    number = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    entry = lambda k: F.struct(number("file", c("l_suppkey") + k).alias("filename"), F.struct(F.when(c("l_tax") > 0.03, number("e", c("l_linenumber") + k)).alias("label")).alias("locator"), F.when(c("l_tax") > 0.05, "q").otherwise("").alias("quote"))
    evidence = F.when(c("l_discount") > 0.06, F.array(entry(0))).when(c("l_discount") > 0.02, F.array(entry(0), entry(1))).otherwise(F.array())
    status = F.when(c("l_quantity") < 10, "UNKNOWN").when(c("l_returnflag") == "R", "FAIL").when(c("l_returnflag") == "A", "PASS").otherwise("NEEDS_REVIEW")
    source = F.struct(F.struct(F.when(c("l_partkey") % 5 != 0, number("p", c("l_suppkey"))).alias("label")).alias("locator"), F.when(c("l_partkey") % 7 != 0, "quote").otherwise("").alias("quote"))
    return lines.select(c("l_orderkey").alias("run_id"), c("l_linenumber").alias("requirement_id"), F.element_at(F.array(*map(F.lit, CATEGORIES)), c("l_linenumber") % 7 + 1).alias("category"), number("L", c("l_linenumber")).alias("label"), status.alias("status"), F.when(c("l_linenumber") % 7 < 2, "HIGH").otherwise("MEDIUM").alias("severity"), F.concat(F.lit("  Part  "), c("l_partkey").cast("string"), F.lit(" OF ")).alias("title"), source.alias("source"), evidence.alias("evidence"), "l_partkey", "l_suppkey", "l_quantity", "l_tax")


_RISK = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.RISKS.items()) + f" ELSE '{review.OTHER_RISK}' END"
_NEEDS = ", ".join(f"'{c}'" for c in review.EVIDENCE_CATEGORIES)


@query(
    f"""SELECT run_id, requirement_id, category, label, status, severity, title, CASE WHEN coalesce(s_label, '') <> '' THEN s_label ELSE '{review.NO_LOCATOR}' END AS tender_locator,
    array_to_string(list_transform(ev, lambda e: e.filename || ' ' || CASE WHEN coalesce(e.label, '') <> '' THEN e.label ELSE '{review.NO_LOCATOR}' END), '; ') AS evidence_locators,
    CASE WHEN status = 'PASS' AND len(ev) > 0 THEN '{review.GAPS[0]}' WHEN category IN ({_NEEDS}) THEN '{review.GAPS[1]}' ELSE '{review.GAPS[2]}' END AS evidence_gap,
    {_RISK} AS risk_impact, CASE WHEN status IN ('UNKNOWN', 'NEEDS_REVIEW') THEN '{review.ACTIONS[0]}' WHEN status = 'FAIL' THEN '{review.ACTIONS[1]}' ELSE '{review.ACTIONS[2]}' END AS next_action FROM ({REQ})"""
)
def requirement_report(t):
    rows = requirements(t).withColumn("requirement_id", F.col("requirement_id").cast("string"))
    return review.report_rows(rows, "run_id").withColumn("requirement_id", F.col("requirement_id").cast("int"))


@query(f"SELECT category, count(*) AS n, count_if({_CITED}) AS cited FROM ({REQ}) GROUP BY ALL")
def complete_citations(t):
    return requirements(t).groupBy("category").agg(F.count("*").alias("n"), F.count_if(review.complete_citation(F.col("source"), F.col("evidence"))).alias("cited"))


_DECISION = "(['CONFIRM', 'REJECT', 'PASS', 'UNKNOWN', 'OTHER'])[l_partkey % 5 + 1]"
_WANTED = "CASE WHEN l_partkey % 3 = 0 THEN 'PASS' END"
_RESOLVED = f"CASE WHEN {_DECISION} IN ('PASS', 'UNKNOWN') THEN {_DECISION} WHEN {_DECISION} = 'CONFIRM' THEN coalesce({_WANTED}, CASE WHEN status IN ('PASS', 'FAIL') THEN status ELSE 'NEEDS_REVIEW' END) WHEN {_DECISION} = 'REJECT' THEN 'NEEDS_REVIEW' ELSE 'UNKNOWN' END"


@query(
    f"""WITH r AS ({REQ.replace("FROM lineitem", f"FROM {_ONE}")}), d AS (SELECT *, {_DECISION} AS decision, {_RESOLVED} AS resolved, {_CITED} AS cited FROM r),
    o AS (SELECT *, CASE WHEN l_quantity > 40 THEN 'UNKNOWN_REQUIREMENT' WHEN resolved = 'PASS' AND NOT cited THEN 'CITATION_MISSING' WHEN l_suppkey % 4 <> l_partkey % 4 THEN 'CONFLICT' ELSE 'APPLIED' END AS outcome FROM d)
    SELECT run_id, requirement_id, decision, CASE WHEN outcome <> 'UNKNOWN_REQUIREMENT' THEN status END AS old_status, CASE outcome WHEN 'APPLIED' THEN resolved WHEN 'UNKNOWN_REQUIREMENT' THEN NULL ELSE status END AS new_status, outcome FROM o"""
)
def review_transitions(t):
    """A decision on every line; lines of a high quantity are not in the store, and half of the revisions are stale."""
    rows = requirements(t, once=True)
    verbs = F.array(*map(F.lit, ("CONFIRM", "REJECT", "PASS", "UNKNOWN", "OTHER")))
    decisions = rows.select("run_id", "requirement_id", F.element_at(verbs, (F.col("l_partkey") % 5 + 1).cast("int")).alias("decision"), F.when(F.col("l_partkey") % 3 == 0, "PASS").alias("new_status"), (F.col("l_suppkey") % 4).alias("revision"))
    stored = rows.filter("l_quantity <= 40").withColumn("revision", F.col("l_partkey") % 4)
    return review.review(stored, decisions, ["run_id", "requirement_id"])


@query(f"SELECT run_id, requirement_id, category AS sig_category, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS sig_title FROM ({REQ})")
def requirement_signatures(t):
    sig = review.signature(F.col("category"), F.col("title"))
    return requirements(t).select("run_id", "requirement_id", sig["category"].alias("sig_category"), sig["title"].alias("sig_title"))


@query(f"WITH a AS (SELECT DISTINCT run_id, category, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title FROM ({REQ})), n AS (SELECT run_id - 1 AS run_id, category, title FROM a WHERE run_id > 1) SELECT run_id, CASE WHEN n.title IS NULL THEN 'added' ELSE 'removed' END AS change, count(*) AS n FROM a FULL JOIN n USING (run_id, category, title) WHERE a.title IS NULL OR n.title IS NULL GROUP BY ALL")
def signature_diff(t):
    """Each run's signatures against those of the next one."""
    sig = review.signature(F.col("category"), F.col("title"))
    own = requirements(t).select("run_id", sig["category"].alias("category"), sig["title"].alias("title")).distinct()
    other = own.filter("run_id > 1").withColumn("run_id", F.col("run_id") - 1)
    diff = store.diff(own.withColumn("v", F.lit(1)), other.withColumn("v", F.lit(1)), ["run_id", "category", "title"], "v")
    return diff.groupBy("run_id", "change").agg(F.count("*").alias("n"))


@query(f"SELECT run_id, seq::INT AS seq, e.filename AS filename, e.label AS label FROM (SELECT run_id, requirement_id, unnest(ev) AS e, unnest(range(len(ev))) AS seq FROM ({REQ}))")
def flat_evidence_assets(t):
    rows = requirements(t).select("run_id", F.col("evidence").alias("evidence_assets"))
    return review.flat_evidence(rows).select("run_id", "seq", "filename", F.col("locator.label").alias("label"))


@query("SELECT o_orderkey AS run_id, list_sort(list_filter(list_distinct([1, 2, 3, 4, 5, (o_custkey % 9)::INT]), lambda x: NOT list_contains(coalesce(k, []), x))) AS unknown FROM orders LEFT JOIN (SELECT l_orderkey, list(l_linenumber) AS k FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey")
def unknown_requirement_ids(t):
    """An order's lines are a bounded group."""
    known = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("known"))
    given = F.array(*(F.lit(i) for i in range(1, 6)), (F.col("o_custkey") % 9).cast("int"))
    rows = t("orders").join(known, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("run_id"), review.unknown_ids(given, F.coalesce("known", F.array().cast("array<int>"))).alias("unknown"))


@query("SELECT event_id, CASE WHEN p = 'DETECTED' AND r IS NULL THEN 'REQUIREMENT_MISSING' WHEN p = 'MISSED' AND (value > 80 OR event_id % 11 = 0) THEN 'QUOTE_MISSING' WHEN r IS NOT NULL AND c_custkey IS NULL THEN 'REQUIREMENT_UNKNOWN' END AS issue FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'DETECTED' ELSE 'MISSED' END AS p, CASE WHEN event_id % 5 <> 0 THEN user_id * 7 END AS r FROM events) LEFT JOIN customer ON r = c_custkey AND c_acctbal > 0")
def feedback_issues(t):
    e = t("events").withColumn("r", F.when(F.col("event_id") % 5 != 0, F.col("user_id") * 7))
    e = e.join(t("customer").filter("c_acctbal > 0").select("c_custkey"), F.col("r") == F.col("c_custkey"), "left")
    predicted = F.when(F.col("event_id") % 2 == 0, "DETECTED").otherwise("MISSED")
    actual = F.when(F.col("value") > 80, "NOT_RELEVANT").otherwise("RELEVANT")
    quote = F.when(F.col("event_id") % 11 == 0, "").otherwise("q")
    return e.select("event_id", review.feedback_issue(predicted, actual, F.col("r").cast("string"), F.lit("p 1"), quote, F.col("c_custkey").isNotNull()).alias("issue"))


_RUNS = "SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 3 = 0 THEN 'w0' ELSE 'w1' END AS workspace_id, o_orderdate AS updated_at FROM orders"


def _runs(t: Table) -> DataFrame:
    space = F.when(F.col("o_custkey") % 3 == 0, "w0").otherwise("w1")
    return t("orders").select(F.col("o_orderkey").alias("run_id"), space.alias("workspace_id"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("archived_at"))


@query(f"SELECT run_id, workspace_id, CASE WHEN a THEN TIMESTAMP '2024-06-01' END AS archived_at, CASE WHEN a THEN TIMESTAMP '2024-06-01' ELSE updated_at END AS updated_at FROM (SELECT *, workspace_id = 'w0' AND run_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS a FROM ({_RUNS}))")
def bulk_archive(t):
    asked = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    return review.bulk_manage(_runs(t), asked, "w0", "ARCHIVE", F.expr("timestamp_ntz'2024-06-01 00:00:00'"))


@query(f"SELECT workspace_id, count(*) AS n FROM ({_RUNS}) WHERE NOT (workspace_id = 'w1' AND run_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) GROUP BY ALL")
def bulk_delete(t):
    asked = t("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("run_id"))
    left = review.bulk_manage(_runs(t), asked, "w1", "DELETE", F.expr("timestamp_ntz'2024-06-01 00:00:00'"))
    return left.groupBy("workspace_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, line::INT AS page, '第 ' || line || ' 页' AS label, coalesce(CASE WHEN line % 3 = 0 THEN 7 END, length(text))::INT AS char_count, line % 4 = 0 AS ocr_required, CASE WHEN line % 5 = 0 THEN 'FAILED' ELSE 'NOT_REQUIRED' END AS ocr_status, (length(text) - length(replace(text, ' ', '')) + 1)::INT AS block_count FROM (SELECT doc_id, i - 1 AS line, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(s[i]) <> '')")
def page_index(t):
    from docketry.plans.catalog import blocks

    line = F.col("line")
    entry = review.page_index(line, F.col("text"), F.split("text", " "), char_count=F.when(line % 3 == 0, 7), ocr_required=line % 4 == 0, ocr_status=F.when(line % 5 == 0, "FAILED"))
    return blocks(t).select("doc_id", F.inline(F.array(entry)))


@query("SELECT doc_id, count(*) AS total_pages, count_if(length(trim(text)) > 0) AS text_pages, count_if(line % 4 = 0) AS ocr_required_pages, count_if(line % 5 = 0) AS ocr_failed_pages, count_if(length(text) < 50) AS low_text_confidence_pages FROM (SELECT doc_id, i AS line, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))) GROUP BY ALL")
def scan_quality_counters(t):
    pages = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    pages = pages.withColumns({"has_text": F.length(F.trim("text")) > 0, "ocr_required": F.col("line") % 4 == 0, "ocr_status": F.when(F.col("line") % 5 == 0, "FAILED"), "low_text_confidence": F.length("text") < 50})
    return review.scan_quality(pages, "doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE coalesce(n, 0) END::BIGINT AS total_pages, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE coalesce(n, 0) END::BIGINT AS text_pages, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS ocr_required_pages FROM orders LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey")
def quality_fallback(t):
    """Runs without stored counters count their documents' pages."""
    pages = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber"))
    documents = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(pages.alias("pages"))).alias("documents"))
    rows = t("orders").join(documents, "o_orderkey", "left")
    stored = lambda x: F.when(F.col("o_orderkey") % 3 == 0, x).cast("long")
    quality = F.struct(stored(F.col("o_custkey")).alias("total_pages"), stored(F.lit(1)).alias("text_pages"), stored(F.lit(2)).alias("ocr_required_pages"), F.lit(0).cast("long").alias("ocr_failed_pages"), F.lit(0).cast("long").alias("low_text_confidence_pages"))
    return rows.select("o_orderkey", review.quality_or_documents(quality, F.col("documents")).alias("q")).select("o_orderkey", "q.total_pages", "q.text_pages", "q.ocr_required_pages")


@query("SELECT o_orderkey + 10000000 AS run_id, o_orderkey AS parent_run_id, CASE WHEN o_custkey % 3 = 0 THEN 'w0' ELSE 'w1' END AS workspace_id, CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE o_custkey % 4 + 1 END::BIGINT AS version_number FROM orders WHERE o_orderstatus = 'F'")
def rescanned_runs(t):
    runs = _runs(t).join(t("orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 4).alias("version_number")), "run_id")
    asked = t("orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") + 10_000_000).alias("new_run_id"), F.col("o_orderkey").alias("run_id"))
    return review.rescans(runs, asked)


# --- listings, lookups and store transitions


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def tenant_listing(t):
    """Only the listed columns are read; the tenant's filter reaches the scan."""
    tenant = store.by_key(t("customer"), c_nationkey=7).select(F.col("c_custkey").alias("o_custkey"))
    return store.by_key(t("orders"), o_orderpriority="1-URGENT").join(tenant, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part)) OR list_contains([p_brand, 'tag' || (p_size % 5)::VARCHAR], 'tag3')")
def tag_filter(t):
    first = t("part").agg(F.min(F.get(F.split("p_name", " "), 0)).alias("wanted"))
    p = t("part").crossJoin(F.broadcast(first))  # one row
    tags = F.array("p_brand", F.concat(F.lit("tag"), (F.col("p_size") % 5).cast("string")))
    return p.filter(F.array_contains(F.split("p_name", " "), F.col("wanted")) | F.array_contains(tags, "tag3")).select("p_partkey")


@query(f"SELECT category, status, count(*) AS n FROM ({REQ}) WHERE category = upper('bond') AND severity = upper('medium') GROUP BY ALL")
def requirement_filter(t):
    rows = requirements(t).filter((F.col("category") == F.upper(F.lit("bond"))) & (F.col("severity") == F.upper(F.lit("medium"))))
    return rows.groupBy("category", "status").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, strftime(DATE '2024-01-01' + (s_suppkey % 400)::INT, '%Y-%m-%d') AS valid_until FROM supplier WHERE s_nationkey < 12 AND contains(lower(s_name), '1') AND strftime(DATE '2024-01-01' + (s_suppkey % 400)::INT, '%Y-%m-%d') <= '2024-07-01'")
def evidence_index(t):
    """Dates are compared as texts, as they are stored."""
    until = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 400).cast("int")), "yyyy-MM-dd")
    rows = t("supplier").withColumn("valid_until", until).filter("s_nationkey < 12 and valid_until <= '2024-07-01'")
    return store.search(rows, ["s_name"], "1").select("s_suppkey", "s_name", "valid_until")


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name) DESC, c_custkey LIMIT 40")
def casefolded_order(t):
    return t("customer").select("c_custkey", "c_name").orderBy(F.lower("c_name").desc(), "c_custkey").limit(40)


@query("SELECT event_id, user_id, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error' OR value > 50) WHERE r <= 50")
def notifications(t):
    """Fifty of them, and how many there are in all; the count is a join with one row."""
    e = t("events").filter("event_type = 'error' or value > 50")
    total = e.agg(F.count("*").alias("total"))
    top = e.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return top.crossJoin(F.broadcast(total)).select("event_id", "user_id", "total")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1")
def oldest_pending(t):
    return store.by_key(t("events"), event_type="click").orderBy("ts", "event_id").limit(1).select("event_id", "user_id")


@query("SELECT c_custkey, coalesce(n, 'default') AS name, n IS NULL AS created FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY ALL) ON c_custkey = o_custkey")
def get_or_create_projects(t):
    stored = t("orders").filter("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("name"))
    return store.get_or_create(t("customer").select("c_custkey"), stored, ["c_custkey"], name=F.lit("default"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS member FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def replaced_members(t):
    parents = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    old = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("member"))
    return store.replace_children(old, parents, parents.select("l_orderkey", F.col("o_custkey").alias("member")), "l_orderkey")


@query("SELECT c_custkey, round(c_acctbal + 100, 2) AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_acctbal, 'NEW' FROM customer WHERE c_nationkey = 4")
def returned_updates(t):
    old = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    new = old.withColumns({"c_acctbal": F.when(F.col("c_nationkey") == 3, F.round(F.col("c_acctbal") + 100, 2)).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_nationkey") == 4, "NEW").otherwise(F.col("c_mktsegment"))})
    return store.returned(old.drop("c_nationkey"), new.drop("c_nationkey"), ["c_custkey"])


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07 AND l_discount > 0.08), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) SELECT 'not_wanted' AS side, k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'not_given', k FROM b WHERE k NOT IN (SELECT k FROM a)")
def pending_equals_submitted(t):
    given = t("lineitem").filter("l_quantity > 49 and l_tax > 0.07 and l_discount > 0.08").select(F.col("l_suppkey").alias("k"))
    return store.same_ids(given, t("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07) OR s_suppkey IN (SELECT l_linenumber FROM lineitem WHERE l_tax > 0.07)")
def url_met_on_either(t):
    known = t("lineitem").filter("l_tax > 0.07").select(F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    return store.met_on_either(t("supplier").select("s_suppkey"), known, "s_suppkey", ["a", "b"])


@query("SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN (props::JSON ->> 'k')::BIGINT END AS k, event_id % 13 <> 0 AS valid FROM events")
def document_codec(t):
    """Each thirteenth document is an array or no JSON at all, which is refused."""
    broken = F.when(F.col("event_id") % 26 == 0, "[1]").when(F.col("event_id") % 13 == 0, "{not json").otherwise(F.col("props"))
    return store.from_documents(t("events").select("event_id", broken.alias("document")), "k long", ["event_id"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def document_round_trip(t):
    packed = store.to_documents(t("customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"])
    return store.from_documents(packed, "c_name string, c_acctbal double", ["c_custkey"]).filter("valid").drop("valid")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_totalprice > 100000 THEN 'DONE' ELSE o_orderstatus END AS status FROM (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders)")
def cancelled_stays(t):
    """A guard on an update: finished orders keep their state; the others become DONE if they are large."""
    state = F.when(F.col("o_orderstatus") == "F", "CANCELLED").otherwise(F.col("o_orderstatus"))
    new = F.when(F.col("o_totalprice") > 100000, "DONE").otherwise(F.col("o_orderstatus"))
    kept = timewin.job_guard(state, new)
    return t("orders").select("o_orderkey", F.when(kept == "CANCELLED", "F").otherwise(kept).alias("status"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1996-01-01' AND c_acctbal > 0 AND c_nationkey % 5 = o_custkey % 5")
def token_user_join(t):
    """Equality join with an expiry, an active flag and an equality residual."""
    tokens = t("orders").filter(F.col("o_orderdate") > F.expr("timestamp_ntz'1996-01-01 00:00:00'"))
    users = t("customer").filter("c_acctbal > 0")
    return tokens.join(users, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") % 5 == F.col("o_custkey") % 5)).select("o_orderkey", "o_custkey", "c_name")


@query("SELECT user_id, event_type, value > 50 AS predicted, event_id % 3 = 0 AS actual, event_id % 2 = 0 AS complete, count(*) AS n FROM events GROUP BY ALL")
def feedback_five_keys(t):
    e = t("events").select("user_id", "event_type", (F.col("value") > 50).alias("predicted"), (F.col("event_id") % 3 == 0).alias("actual"), (F.col("event_id") % 2 == 0).alias("complete"))
    return e.groupBy("user_id", "event_type", "predicted", "actual", "complete").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(ts) AS last_seen, count_if(event_type = 'error') AS errors, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3600000000, 2) AS age_hours FROM events GROUP BY ALL")
def health_status(t):
    h = t("events").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return h.withColumn("age_hours", timewin.age_hours(F.col("last_seen"), F.expr("timestamp_ntz'2024-02-01 00:00:00'")))

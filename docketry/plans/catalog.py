"""Registered queries over the star-schema and document tables, each with the same result in DuckDB SQL where
SQL can say it. `t(name)` reads a table; all queries run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions import metrics, text
from docketry.operators import cohorts, evaluate, rules, store, timewin, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Table = Callable[[str], DataFrame]


def query(sql: str | None = None) -> Callable[[Callable[[Table], DataFrame]], Callable[[Table], DataFrame]]:
    def add(f: Callable[[Table], DataFrame]) -> Callable[[Table], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def blocks(t: Table) -> DataFrame:
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.filter(F.trim("text") != "")


BLOCKS = "SELECT doc_id, i - 1 AS line, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(s[i]) <> ''"


@query(f"SELECT doc_id, line::INT AS line, length(text)::INT AS n_chars FROM ({BLOCKS})")
def document_blocks(t):
    return blocks(t).select("doc_id", "line", F.length("text").alias("n_chars"))


_SCAN = " UNION ALL ".join(f"SELECT doc_id, line, '{label}' AS label, '{cat}' AS category, {i} AS rule, p.pos, p.hit, text FROM (SELECT doc_id, line, text, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'pos': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0), 'hit': h[i]}})) AS p FROM (SELECT *, regexp_extract_all(text, '(?i){pat}') AS h, string_split_regex(text, '(?i){pat}') AS g FROM b))" for i, (label, cat, pat) in enumerate(rules.LATIN))
_QUOTE = r"trim(regexp_replace(substring(text, greatest(0, pos - 110)::INT + 1, (pos + length(hit) + 110 - greatest(0, pos - 110))::INT), '[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"


@query(f"WITH b AS ({BLOCKS}) SELECT label, category, count(*) AS matches, count(DISTINCT doc_id) AS documents FROM ({_SCAN}) GROUP BY ALL")
def pattern_scan_counts(t):
    found = rules.scan(blocks(t), "doc_id", "line", "text", rules.LATIN)
    return found.groupBy("label", "category").agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("documents"))


@query(f"WITH b AS ({BLOCKS}), s AS (SELECT *, {_QUOTE} AS quote, row_number() OVER (PARTITION BY doc_id ORDER BY line, rule, pos) AS seq FROM ({_SCAN})) SELECT doc_id, line::INT AS line, category, label, quote, min(seq)::INT AS seq FROM s GROUP BY ALL")
def requirement_dedup_first(t):
    found = rules.scan(blocks(t), "doc_id", "line", "text", rules.LATIN)
    return rules.first_wins(found, "doc_id", "line").select("doc_id", "line", "category", "label", "quote", "seq")


@query("SELECT l_orderkey, count(*) AS total, count_if(l_returnflag = 'N') AS unresolved, count_if(l_returnflag = 'R' AND l_linestatus = 'F') AS blockers, count_if(l_quantity > 45) AS fatal FROM lineitem GROUP BY ALL")
def requirement_counts(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "N").alias("unresolved"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("blockers"), F.count_if(F.col("l_quantity") > 45).alias("fatal"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_run_ids(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def status_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


_FEEDBACK = "SELECT lang AS category, quality = 1 AS p, toxic = 0 AS a FROM documents JOIN labels USING (doc_id)"
_CONFUSION = f"SELECT category, count_if(p AND a) AS tp, count_if(p AND NOT a) AS fp, count_if(NOT p AND a) AS fn, count_if(NOT p AND NOT a) AS tn, count_if(p) AS detected_total FROM ({_FEEDBACK}) GROUP BY ALL"


def _feedback(t: Table) -> DataFrame:
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").select(F.col("lang").alias("category"), (F.col("quality") == 1).alias("predicted"), (F.col("toxic") == 0).alias("actual"), F.lit(True).alias("complete"))


@query(f"SELECT category, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS prec, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS rec, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) END AS fpr, CASE WHEN detected_total > 0 AND tp + fp = detected_total AND tp + fp + fn + tn >= 20 THEN 'MEASURABLE' ELSE 'INSUFFICIENT' END AS status FROM ({_CONFUSION})")
def accuracy_by_category(t):
    a = evaluate.accuracy(_feedback(t))
    return a.select("category", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"), F.round("false_positive", 6).alias("fpr"), "status")


@query(f"SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS prec, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS rec FROM ({_CONFUSION})")
def accuracy_overall_rollup(t):
    return evaluate.overall(evaluate.accuracy(_feedback(t))).select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"))


@query("WITH b AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS s FROM benchmark) SELECT x.item_id, levenshtein(x.s, y.s)::INT AS edits, round(CASE WHEN x.s = '' THEN (CASE WHEN y.s = '' THEN 0 ELSE 1 END) ELSE levenshtein(x.s, y.s) / length(x.s) END, 6)::DOUBLE AS cer FROM b x JOIN b y ON y.item_id = x.item_id + 1")
def edit_distance_pairs(t):
    b = t("benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("s"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("h"))
    return b.join(n, "item_id").select("item_id", F.levenshtein("s", "h").alias("edits"), F.round(metrics.cer(F.col("s"), F.col("h")), 6).alias("cer"))


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', chr(10), 'g')) AS digest FROM pages")
def html_strip_tags(t):
    return t("pages").select("page_id", F.sha2(F.regexp_replace("html", "<[^>]+>", "\n"), 256).alias("digest"))


@query()
def html_text(t):
    return t("pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS hits FROM events")
def sliding_window_hits(t):
    return timewin.sliding_hits(t("events"), ["user_id", "event_type"], "ts", 86_400).select("event_id", "hits")


_CHAIN = "sha256(concat_ws('|', coalesce(p, ''), event_id::VARCHAR, event_type))"


@query(f"WITH a AS (SELECT user_id, event_id, event_type, sha256(lag(event_id::VARCHAR) OVER (PARTITION BY user_id ORDER BY event_id)) AS p FROM events), h AS (SELECT *, CASE WHEN event_id % 997 = 0 THEN 'broken' ELSE p END AS stored FROM a) SELECT user_id, count(*) AS events, min(CASE WHEN coalesce(stored, '') <> coalesce(p, '') THEN event_id END) AS first_break FROM h GROUP BY ALL")
def hash_chain(t):
    """Each event's hash is of its id; some stored predecessors are broken on purpose and must be found."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t("events").select("user_id", "event_id", "event_type", F.sha2(F.col("event_id").cast("string"), 256).alias("own"))
    e = e.withColumn("p", F.lag("own").over(w)).withColumn("stored", F.when(F.col("event_id") % 997 == 0, "broken").otherwise(F.col("p")))
    bad = F.coalesce("stored", F.lit("")) != F.coalesce("p", F.lit(""))
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.min(F.when(bad, F.col("event_id"))).alias("first_break"))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT event_type, v[(floor(0.95 * (len(v) - 1)) + 1)::INT] AS p95_a, v[(greatest(0, floor(len(v) * 0.95) - 1) + 1)::INT] AS p95_b FROM s")
def latency_p95_nearest(t):
    """Ranges of values are counted first; only the one that holds a rank is looked at value by value, so no type's
    values meet in one task."""
    total = F.col("total")
    ranks = {"p95_a": F.floor(F.lit(0.95) * (total - 1)) + 1, "p95_b": F.greatest(F.lit(0), F.floor(total * F.lit(0.95)) - 1) + 1}
    return cohorts.nearest_ranks(t("events"), ["event_type"], "value", ranks, 0.5)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def keyset_page(t):
    last = [F.expr("timestamp_ntz'1996-01-01 00:00:00'"), 5000]
    o = t("orders").select("o_orderdate", "o_orderkey")
    return store.page_after(o, ["o_orderdate", "o_orderkey"], last, 25)


_HALF = "SELECT user_id, event_type, count(*) AS n FROM events WHERE ts {} TIMESTAMP '2024-01-15' GROUP BY ALL"


@query(f"SELECT user_id, event_type, a.n AS new_value, b.n AS old_value, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_HALF.format('>=')}) a FULL JOIN ({_HALF.format('<')}) b USING (user_id, event_type) WHERE a.n IS DISTINCT FROM b.n")
def snapshot_diff(t):
    e, cut = t("events"), F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    half = lambda c: e.filter(c).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return store.diff(half(F.col("ts") >= cut), half(F.col("ts") < cut), ["user_id", "event_type"], "n")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest_wins(t):
    e, cut = t("events").select("user_id", "event_type", "event_id", "value", "ts"), F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return store.upsert(e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut), ["user_id", "event_type"], "event_id").drop("ts")


@query("SELECT user_id, event_type, coalesce(min(event_id) FILTER (event_id % 8 = 0), min(event_id)) AS event_id FROM events GROUP BY ALL")
def insert_do_nothing(t):
    """A stored row stays although the new one has a smaller id; keys that are not stored come in."""
    e = t("events").select("user_id", "event_type", "event_id")
    old = store.first(e.filter("event_id % 8 = 0"), ["user_id", "event_type"], ["event_id"])
    return store.insert_missing(old, store.first(e, ["user_id", "event_type"], ["event_id"]), ["user_id", "event_type"])


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 3 DAY")
def ttl_retained(t):
    return store.keep_live(t("events"), "ts", F.expr("timestamp_ntz'2024-01-25 00:00:00'"), "interval 3 days").select("event_id", "user_id")


@query("SELECT o_orderkey, date_diff('day', DATE '1996-06-01', o_orderdate::DATE)::INT AS days_left, CASE WHEN o_orderdate::DATE < DATE '1996-06-01' THEN 'REMEDIATION_OVERDUE' ELSE 'REMEDIATION_DUE' END AS type FROM orders WHERE o_orderstatus = 'O' AND o_orderdate::DATE <= DATE '1996-06-04'")
def due_alerts(t):
    return timewin.due_alerts(t("orders").filter("o_orderstatus = 'O'"), "o_orderdate", F.lit("1996-06-01").cast("date")).select("o_orderkey", "days_left", "type")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r = 1")
def latest_review(t):
    return store.latest(t("conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def argmax_first(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("n"))).alias("b")).select("l_orderkey", (-F.col("b.n")).alias("l_linenumber"), "b.l_extendedprice")


@query(f"SELECT doc_id, count(*) AS lines, count_if(regexp_matches(text, '1[3-9][0-9]{{9}}|0[0-9]{{2,3}}-?[0-9]{{7,8}}|[0-9]{{17}}[0-9Xx]|E-?mail\\s*[:：]|(?i:https?://|www\\.)')) AS masked FROM ({BLOCKS}) GROUP BY ALL")
def pii_line_mask(t):
    return blocks(t).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.needs_mask(F.col("text"))).alias("masked"))


@query("SELECT doc_id, sha256(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r\\f\\x0b]+', '', 'g')) AS digest FROM documents")
def normalised_text(t):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return t("documents").select("doc_id", F.sha2(F.regexp_replace(F.translate("text", upper, upper.lower()), r"[ \t\n\r\f\x0b]+", ""), 256).alias("digest"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def feedback_semi_join(t):
    return t("orders").join(t("customer").filter("c_mktsegment = 'BUILDING' and c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def project_visibility(t):
    projects = t("customer").select(F.col("c_custkey").alias("project_id"), "c_name")
    members = t("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("user_id"))
    return store.visible(projects, members, "1-URGENT").withColumnRenamed("project_id", "c_custkey")


@query("SELECT 'ADMIN' AS role, c_custkey FROM customer UNION ALL SELECT 'REVIEWER', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def project_visibility_by_role(t):
    """The same user as admin and as reviewer."""
    projects = t("customer").select(F.col("c_custkey").alias("project_id"))
    members = t("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("user_id"))
    seen = lambda role: store.visible(projects, members, "5-LOW", role).select(F.lit(role).alias("role"), F.col("project_id").alias("c_custkey"))
    return seen("ADMIN").unionByName(seen("REVIEWER"))


@query("SELECT count(*) AS rows, count_if(lower(trim(c_mktsegment)) = 'building') AS confirmed_tasks, count_if(c_acctbal > 0) AS payment_signals, count_if(c_nationkey > 4) AS touched_contacts, count_if(c_custkey % 3 = 0) AS linked_pilot_tasks FROM customer")
def ledger_summaries(t):
    """Counts of a pilot and of a contact ledger."""
    k = F.col("c_nationkey")
    c = t("customer").select(F.when(F.col("c_mktsegment") == "BUILDING", " Confirmed ").otherwise("open").alias("human_confirmation"), F.when(F.col("c_acctbal") > 0, "paid").otherwise("  ").alias("payment_signal"), F.when(k > 4, "Answered").when(k > 2, " PENDING ").when(k > 1, " ").alias("response_status"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).alias("linked_pilot_task_id"))
    return cohorts.ledger_summary(c).join(cohorts.contact_summary(c), "rows")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND c_acctbal > 0")
def session_user_join(t):
    return t("orders").filter("o_orderstatus = 'F'").join(t("customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def worst_five(t):
    return t("orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def usage_counts(t):
    return store.table_counts({n: t(n) for n in ("orders", "lineitem", "events", "documents")})


@query("SELECT lang, source, count(*) AS documents, count(DISTINCT n_chars) AS lengths, avg(n_chars) AS mean_chars FROM documents GROUP BY ALL")
def inventory(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.countDistinct("n_chars").alias("lengths"), F.avg("n_chars").alias("mean_chars"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'an') GROUP BY ALL")
def search_filter(t):
    return store.search(t("part"), ["p_name", "p_brand", "p_type"], "an").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') (SELECT k, 'only_r' AS side FROM a EXCEPT SELECT k, 'only_r' FROM b) UNION ALL (SELECT k, 'only_a' FROM b EXCEPT SELECT k, 'only_a' FROM a)")
def key_difference(t):
    side = lambda f: t("lineitem").filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct()
    r, a = side("R"), side("A")
    return r.join(a, "k", "left_anti").withColumn("side", F.lit("only_r")).unionByName(a.join(r, "k", "left_anti").withColumn("side", F.lit("only_a")))


@query("SELECT user_id, event_id, CASE WHEN event_type = 'click' AND value > 50 THEN CASE WHEN event_id % 7 >= 5 THEN 'DEAD' ELSE 'PENDING' END ELSE 'RUNNING' END AS status FROM events")
def stale_jobs(t):
    e = t("events").select("user_id", "event_id", F.lit("RUNNING").alias("status"), (F.col("event_type") != "click").alias("cancel_requested"), (F.col("event_id") % 7).alias("attempts"), F.when(F.col("value") > 50, F.expr("timestamp_ntz'2024-01-01 00:00:00'")).otherwise(F.expr("timestamp_ntz'2024-02-01 00:00:00'")).alias("updated_at"))
    return timewin.requeue_stale(e, F.expr("timestamp_ntz'2024-02-01 00:00:00'"), "interval 1 hour").select("user_id", "event_id", "status")


@query("WITH f AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations) SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN n > 1 THEN 'duplicate' END) AS issues FROM f")
def row_issues(t):
    out = validate.with_issues(t("conversations"), {"role": F.col("role").isin("user", "assistant"), "short": F.length("text") >= 100}, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.array_join("issues", ",").alias("issues"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v FROM lineitem WHERE l_quantity < 40), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.05 THEN 'X' ELSE l_returnflag END AS v FROM lineitem WHERE l_quantity > 5), s AS (SELECT count_if(a.v = b.v) AS tp, count_if(b.v IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS fp, count_if(a.v IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS fn FROM a FULL JOIN b USING (l_orderkey, l_linenumber)) SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s")
def field_f1(t):
    line = t("lineitem").withColumns({"doc_id": F.col("l_orderkey"), "name": F.col("l_linenumber")})
    truth = line.filter("l_quantity < 40").select("doc_id", "name", F.col("l_returnflag").alias("value"))
    guess = line.filter("l_quantity > 5").select("doc_id", "name", F.when(F.col("l_tax") > 0.05, "X").otherwise(F.col("l_returnflag")).alias("value"))
    return evaluate.field_scores(truth, guess).withColumn("f1", F.round("f1", 6))


@query()
def fixed_window_fold(t):
    return timewin.fixed_windows(t("events"), "user_id", "ts", "event_id", 86_400, 3)


@query()
def wer_pairs(t):
    b = t("benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("h"))
    return b.join(n, "item_id").select("item_id", metrics.wer("text", "h").alias("wer"))


@query()
def line_cer(t):
    """Conversations against themselves with each second line's first word gone."""
    c = t("conversations").select("conv_id", "turn", "text", F.regexp_replace("text", r"(\n[^\n]*\n)\S+ ", "$1").alias("h"))
    return c.select("conv_id", "turn", metrics.line_edit_counts("text", "h").alias("e")).select("conv_id", "turn", "e.edits", "e.chars")


@query()
def table_teds(t):
    """Each order's lines as a table, against the same table with some quantities altered."""
    cell = lambda q: F.concat(F.lit("<tr><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), q.cast("string"), F.lit("</td></tr>"))
    other = F.when(F.col("l_tax") > 0.06, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    both = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cell(F.col("l_quantity")).alias("a"), cell(other).alias("b")))).alias("r"))
    table = lambda f: F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x[f]), ""), F.lit("</table>"))
    return both.select("l_orderkey", metrics.teds(table("b"), table("a")).alias("teds"))


@query()
def redacted_text(t):
    return t("documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query()
def page_classes(t):
    return t("documents").select("doc_id", text.page_types(F.col("text")).alias("types"), text.is_toc(F.col("text")).alias("is_toc"), text.escalation(F.col("text"), F.lit(0.9), F.lit(842.0)).alias("outcome"))

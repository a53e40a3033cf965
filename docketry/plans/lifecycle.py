"""Registered queries over joins, store transitions, reports and time that the first catalogue leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators import store, timewin
from docketry.plans.catalog import query


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def newest_sessions(t):
    """The rank filter limits each task's rows of a key before the shuffle, so a hot user costs ten rows a task."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t("events").select("user_id", "event_id", "ts").withColumn("r", rank).filter("r <= 10").select("user_id", "event_id")


@query("SELECT l_orderkey, string_agg(l_returnflag || ':' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_returnflag || ':' || l_partkey) AS evidence FROM lineitem GROUP BY ALL")
def evidence_string(t):
    """A group is one order's lines."""
    hit = F.struct("l_linenumber", "l_partkey", F.concat_ws(":", "l_returnflag", F.col("l_partkey").cast("string")).alias("s"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(hit)).alias("h"))
    return rows.select("l_orderkey", F.array_join("h.s", "; ").alias("evidence"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'BLOCKER' WHEN l_quantity > 45 THEN 'HIGH' ELSE 'NORMAL' END AS risk_impact, CASE WHEN l_returnflag = 'N' THEN 'REVIEW' WHEN l_tax = 0 THEN 'ADD_EVIDENCE' ELSE 'NONE' END AS next_action FROM lineitem")
def report_rows(t):
    risk = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "BLOCKER").when(F.col("l_quantity") > 45, "HIGH").otherwise("NORMAL")
    action = F.when(F.col("l_returnflag") == "N", "REVIEW").when(F.col("l_tax") == 0, "ADD_EVIDENCE").otherwise("NONE")
    return t("lineitem").select("l_orderkey", "l_linenumber", risk.alias("risk_impact"), action.alias("next_action"))


@query("SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_returnflag = 'R') WHERE r = 1) ON o_orderkey = l_orderkey")
def last_duplicate_join(t):
    hyp = store.latest(t("lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], ["l_linenumber"])
    return t("orders").join(hyp, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("WITH m AS (SELECT sha256(text) AS digest, min(item_id) AS by_digest FROM benchmark GROUP BY ALL) SELECT doc_id, coalesce(by_digest, item_id) AS item_id, CASE WHEN by_digest IS NOT NULL THEN 'sha256' WHEN item_id IS NOT NULL THEN 'name' ELSE 'none' END AS matched FROM documents LEFT JOIN m ON sha256(documents.text) = digest LEFT JOIN (SELECT item_id FROM benchmark) ON doc_id = item_id")
def match_digest_or_name(t):
    """An OR join as two equality joins, the digest preferred."""
    b = t("benchmark")
    digests = b.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("item_id").alias("by_digest"))
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("digest")).join(digests, "digest", "left")
    d = d.join(b.select("item_id"), F.col("doc_id") == F.col("item_id"), "left")
    how = F.when(F.col("by_digest").isNotNull(), "sha256").when(F.col("item_id").isNotNull(), "name").otherwise("none")
    return d.select("doc_id", F.coalesce("by_digest", "item_id").alias("item_id"), how.alias("matched"))


@query("SELECT c_custkey, CASE WHEN seen = c_nationkey THEN c_nationkey + 1 ELSE c_nationkey END AS revision, CASE WHEN seen = c_nationkey THEN 'APPLIED' ELSE 'CONFLICT' END AS outcome FROM customer JOIN (SELECT o_custkey, max(o_orderkey) % 25 AS seen FROM orders GROUP BY ALL) ON c_custkey = o_custkey")
def revision_conflicts(t):
    changes = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_orderkey") % 25).alias("revision"))
    return store.compare_and_set(t("customer").select("c_custkey", F.col("c_nationkey").alias("revision")), changes, "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(t):
    gone = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.delete_cascade({"lineitem": t("lineitem").select("l_orderkey", "l_linenumber")}, "l_orderkey", gone)["lineitem"]


@query("SELECT c_custkey, coalesce(p, c_mktsegment) AS segment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) ON c_custkey = o_custkey")
def patch_non_null(t):
    patch = t("orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("segment"))
    return store.merge_non_null(t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), patch, "c_custkey")


@query("SELECT event_id, user_id FROM events JOIN (SELECT user_id, arg_max(event_type, event_id) AS held FROM events GROUP BY ALL) USING (user_id) WHERE event_type = held")
def fenced_results(t):
    e = t("events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("lease_token"))
    return timewin.fence(e, store.latest(e, ["job_id"], ["event_id"])).select("event_id", F.col("job_id").alias("user_id"))


@query("SELECT o_orderkey, o_custkey FROM orders LEFT JOIN (SELECT c_custkey, (c_custkey % 1000)::INT AS d FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1998-01-01' - to_days(coalesce(d, 365))")
def retention_candidates(t):
    runs = t("orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("workspace_id"), F.col("o_orderdate").alias("created_at"))
    settings = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("workspace_id"), (F.col("c_custkey") % 1000).cast("int").alias("retention_days"))
    return timewin.expired_runs(runs, settings, F.expr("timestamp_ntz'1998-01-01 00:00:00'")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderpriority AS name, count(*) AS misses FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL ORDER BY misses DESC, name")
def miss_histogram(t):
    return t("orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("misses")).orderBy(F.desc("misses"), "name")


@query("SELECT l_returnflag, count(*) AS instances, count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_partkey) AS names FROM lineitem GROUP BY ALL")
def coverage(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("instances"), F.countDistinct("l_orderkey").alias("documents"), F.countDistinct("l_partkey").alias("names"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS due FROM orders ORDER BY o_orderstatus, due NULLS FIRST, o_orderkey LIMIT 25")
def remediation_order(t):
    """A page of 25 rows, nulls first."""
    o = t("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("due"))
    return o.orderBy("o_orderstatus", F.asc_nulls_first("due"), "o_orderkey").limit(25)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_quantity > 45 THEN 1 ELSE 2 END AS risk FROM lineitem ORDER BY risk, l_orderkey, l_linenumber LIMIT 25 OFFSET 25")
def risk_page(t):
    """The second page of 25, by risk."""
    risk = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_quantity") > 45, 1).otherwise(2)
    return t("lineitem").select("l_orderkey", "l_linenumber", risk.alias("risk")).orderBy("risk", "l_orderkey", "l_linenumber").offset(25).limit(25)


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL")
def eligible_entries(t):
    return t("events").filter(F.col("event_type").isin("click", "purchase") & F.col("value").isNotNull()).select("event_id", "event_type", "value")


@query("SELECT event_id, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 3.6e9::DOUBLE AS age_hours FROM events")
def age_hours(t):
    now = timewin.micros(F.expr("timestamp_ntz'2024-03-01 00:00:00'"))
    return t("events").select("event_id", ((now - timewin.micros(F.col("ts"))) / F.lit(3.6e9)).alias("age_hours"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'detected:' || doc_id ELSE 'missed:' || sha256(coalesce(trim(lang), '') || '|' || coalesce(trim(source), '') || '|' || n_chars) END AS feedback_key FROM documents")
def feedback_keys(t):
    part = lambda c: F.coalesce(F.trim(c), F.lit(""))
    missed = F.sha2(F.concat_ws("|", part("lang"), part("source"), F.col("n_chars").cast("string")), 256)
    key = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("detected:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("missed:"), missed))
    return t("documents").select("doc_id", key.alias("feedback_key"))


@query("SELECT event_id, min(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) + 86400000000 - epoch_us(ts) AS wait_us FROM events")
def retry_after(t):
    """Microseconds until the oldest hit of the window leaves it."""
    at = timewin.micros(F.col("ts"))
    w = Window.partitionBy("user_id", "event_type").orderBy(at).rangeBetween(-(86_400_000_000 - 1), 0)
    return t("events").select("event_id", (F.min(at).over(w) + 86_400_000_000 - at).alias("wait_us"))

"""Registered queries over recognised lines, page evaluation, candidate ledgers and fetches."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import metrics, tables, text
from docketry.operators import evaluate, review
from docketry.plans.catalog import query


@query("SELECT vec_id, 0 AS line, 'v' || label::VARCHAR AS text, round(least(embedding[1], embedding[3], embedding[5], embedding[7])::DOUBLE, 5) AS x0, round(greatest(embedding[2], embedding[4], embedding[6], embedding[8])::DOUBLE, 5) AS y1 FROM embeddings")
def recognised_lines(t):
    """The first eight numbers of a vector are a line's corners; a second line has no text and is left out."""
    point = lambda k: F.array(F.get("embedding", k).cast("double"), F.get("embedding", k + 1).cast("double"))
    box = F.array(*(point(k) for k in (0, 2, 4, 6)))
    line = lambda s: F.struct(s.alias("text"), F.lit(0.9).alias("confidence"), box.alias("box"))
    rows = t("embeddings").select("vec_id", F.array(line(F.concat(F.lit(" v"), F.col("label").cast("string"))), line(F.lit(" "))).alias("lines"))
    return tables.line_boxes(rows, "vec_id").select("vec_id", "line", "text", F.round("x0", 5).alias("x0"), F.round("y1", 5).alias("y1"))


@query("SELECT l_orderkey, arg_min(s, (-share, s)) AS seq, round(max(share), 6)::DOUBLE AS share FROM (SELECT l_orderkey, l_linenumber AS s, CASE WHEN l_partkey % 4 = 0 THEN 0.25 WHEN l_partkey % 4 = 1 THEN 0.5 WHEN l_partkey % 4 = 2 THEN 0.75 ELSE 1 END AS share FROM lineitem) WHERE share >= 0.5 GROUP BY ALL")
def best_table(t):
    """A line stands for a table of four cells, one to four of which are in the page's text."""
    cells = F.array(*(F.when(F.col("l_partkey") % 4 >= k, w).otherwise("absent") for k, w in enumerate(("alpha", "beta", "gamma", "delta"))))
    rows = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.array(F.slice(cells, 1, 2), F.slice(cells, 3, 2)).alias("rows"), F.lit("Alpha beta GAMMA delta").alias("page_text"))
    return tables.best_overlap(rows, "l_orderkey", "seq").withColumn("share", F.round("share", 6))


@query()
def prepared_pages(t):
    """Every third document's text counts as a contents page."""
    d = t("documents").withColumn("truth", F.when(F.col("doc_id") % 3 == 0, "目录").otherwise("body"))
    return d.select("doc_id", metrics.prepared(F.col("truth"), F.split("text", "\n")).alias("lines"))


_CLEAN = "lower(regexp_replace({}, '[^a-zA-Z0-9]', '', 'g'))"


@query(
    f"""WITH g AS (SELECT conv_id, turn, {_CLEAN.format("text")} AS a, ['an', 'zzzz'] AS f FROM conversations), h AS (SELECT conv_id, turn, {_CLEAN.format("replace(text, 'the', 'eth')")} AS b, 1 AS line FROM conversations WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, turn, {_CLEAN.format("replace(text, 'an', '')")}, 2 FROM conversations WHERE turn % 4 = 1),
    l AS (SELECT conv_id, turn, arg_max(b, line::VARCHAR || b) AS b FROM h GROUP BY ALL)
    SELECT conv_id AS doc_id, turn AS page, 'local' AS mode, round(CASE WHEN a = '' THEN (CASE WHEN coalesce(b, '') = '' THEN 0 ELSE 1 END) ELSE levenshtein(a, coalesce(b, '')) / length(a) END, 6)::DOUBLE AS cer, len(list_filter(f, lambda x: contains(coalesce(b, ''), x)))::INT AS field_hits, 2 AS field_total FROM g LEFT JOIN l USING (conv_id, turn)"""
)
def page_evaluation(t):
    """Pages against guesses with letters exchanged or lost, of which some are missing and some come twice."""
    clean = lambda x: F.lower(F.regexp_replace(x, "[^a-zA-Z0-9]", ""))
    c = t("conversations").withColumns({"doc_id": F.col("conv_id"), "page": F.col("turn")})
    truth = c.select("doc_id", "page", clean(F.col("text")).alias("text_n"), F.array(F.lit("an"), F.lit("zzzz")).alias("fields_n"))
    swapped, lost = clean(F.replace("text", F.lit("the"), F.lit("eth"))), clean(F.replace("text", F.lit("an"), F.lit("")))
    guess = c.filter("turn % 3 <> 0").select("doc_id", "page", swapped.alias("text_n"), F.lit(1).alias("line")).unionByName(c.filter("turn % 4 = 1").select("doc_id", "page", lost.alias("text_n"), F.lit(2).alias("line")))
    return evaluate.page_rows(truth, guess, "local").withColumn("cer", F.round("cer", 6))


@query("SELECT o_orderkey AS fixture_id, seq, category, page, CASE WHEN o_orderkey % 5 = 0 THEN 'MISSING' WHEN o_orderkey % 7 = 0 THEN 'CHANGED' ELSE 'VERIFIED' END AS source_status, CASE WHEN category = 'R' AND o_orderkey % 2 = 0 THEN 'not a clause' END AS reason FROM orders JOIN (SELECT l_orderkey, l_returnflag AS category, l_suppkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) - 1 AS seq FROM lineitem) ON o_orderkey = l_orderkey")
def candidate_ledger(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("fixture_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").alias("page"), F.col("l_returnflag").alias("category")))).alias("candidates"))
    fixtures = t("orders").select(F.col("o_orderkey").alias("fixture_id"), F.lit("a").alias("sha256")).join(lines, "fixture_id")
    key = F.col("fixture_id")
    digests = fixtures.filter(key % 5 != 0).select("fixture_id", F.when(key % 7 == 0, "b").otherwise("a").alias("sha256"))
    rejections = fixtures.filter(key % 2 == 0).select("fixture_id", F.lit("R").alias("category"), F.lit("not a clause").alias("reason"))
    return review.candidate_ledger(fixtures, digests, rejections).select("fixture_id", F.col("seq").cast("long").alias("seq"), "category", "page", "source_status", "reason")


@query("SELECT lang, count(*) AS fetched, count_if(o = 'ok') AS ok, count_if(o = 'unreachable') AS unreachable, count_if(o NOT IN ('ok', 'unreachable')) AS bad FROM (SELECT lang, CASE WHEN doc_id % 10 = 0 THEN 'unreachable' WHEN doc_id % 10 = 1 THEN 'http_404' WHEN n_chars > 20000 THEN 'too_large' WHEN text LIKE 'T%' THEN 'not_a_pdf' ELSE 'ok' END AS o FROM documents) GROUP BY ALL")
def fetch_summary(t):
    d = t("documents")
    code = F.when(F.col("doc_id") % 10 == 1, 404).when(F.col("doc_id") % 10 != 0, 200)
    outcome = text.fetch_outcome(code, F.col("n_chars"), ~F.col("text").startswith("T"), 20_000)
    return evaluate.fetch_summary(d.select("lang", outcome.alias("outcome")), "lang")


@query("SELECT l_orderkey, min(l_partkey) AS part FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL")
def source_file_lookup(t):
    """The document with id 2 of each run; runs without one are left out."""
    docs = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("source_id"), F.col("l_partkey").alias("part")))).alias("documents"))
    return docs.select("l_orderkey", review.source_file(F.col("documents"), F.lit(2))["part"].alias("part")).filter("part is not null")

"""Operator 7, URL filter: rules first, then empirical-Bayes host reputation.

A page's outcome is bad where its label's quality is 0 (labels.doc_id is taken as the page's id). Bad rates are
shrunk down a hierarchy of beta-binomial posteriors: all pages -> public suffix -> registered domain -> host.
Each level's prior has the level above's posterior mean, and a strength (pseudo-count) estimated by the method
of moments from the spread of that level's rates around their priors. A host is blocked if the lower bound of its bad rate, mean
less Z standard deviations of its beta posterior, exceeds TOLERANCE.

Everything is grouping and joining by host; only three strengths and one mean pass through the driver. A host with
more pages than HOT_ROWS (common.py) meets its pages by a broadcast of such hosts, of which there are few by count.

Names are registered one label below a public suffix: the longest of `suffixes` that a host ends in, else its last
label. The table is a parameter; `read_suffixes` reads a file in the public suffix list's format (plain rules and
`*.` rules), and SECOND_LEVEL stands in where none is given.

Defined results: a null url or one without `://` has empty host and path and is judged by all pages' rate; a
host without labels has its domain's rate, and so on up; rows of repeated page_ids are judged each; pages and
labels of null id are unlabelled; a page with conflicting labels counts each; without any label nothing is
blocked by the method; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, join_counted, materialise

TOLERANCE = 0.2
Z = 1.0
STRENGTHS = (1.0, 10_000.0)

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Second-level suffixes under which names are registered.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "co.nz", "co.za", "com.mx", "com.tr")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, labels) of a public suffix file; a rule `*.x` stands for one label more than x."""
    line = F.lower(F.trim(F.regexp_extract("value", r"^[^\s]*", 0)))
    rules = spark.read.text(path).select(line.alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("//") & ~F.col("rule").startswith("!"))
    bare = F.regexp_replace("rule", r"^\*\.", "")
    extra = F.col("rule").startswith("*.").cast("int")
    return rules.select(bare.alias("suffix"), (F.size(F.split(bare, r"\.")) + extra).alias("labels")).groupBy("suffix").agg(F.max("labels").alias("labels"))


def with_domain(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Add domain and suffix to a table of distinct hosts. A suffix table is some ten thousand rows: broadcast."""
    parts = F.split("host", r"\.")
    tail = lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")
    each = hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).withColumn("suffix", tail(F.col("k")))
    best = each.join(F.broadcast(suffixes), "suffix").groupBy("host").agg(F.max("labels").alias("labels"))
    found = hosts.join(best, "host", "left").withColumn("labels", F.least(F.coalesce("labels", F.lit(1)) + 1, F.size(parts)))
    found = found.withColumn("domain", tail(F.col("labels"))).drop("labels")
    return found.withColumn("suffix", F.when(F.col("domain").contains("."), F.regexp_replace("domain", r"(?s)^[^.]*\.", "")).otherwise(F.lit("")))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def strength(groups: DataFrame) -> float:
    """The prior's pseudo-count from (n, bad, prior), by moments: the less the rates of groups spread around
    their priors, beyond what binomial draws do, the larger."""
    n, prior = F.col("n"), F.col("prior")
    v = prior * (1 - prior)
    off = F.col("bad") / n - prior
    s, alone, pairs = groups.filter(n > 0).agg(F.sum(n * off * off), F.sum(v), F.sum(v * (n - 1))).first()
    if not pairs:
        return STRENGTHS[1]
    rho = (s - alone) / pairs
    return STRENGTHS[1] if rho <= 1 / (1 + STRENGTHS[1]) else max(STRENGTHS[0], min(STRENGTHS[1], 1 / rho - 1))


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """pages (page_id, host) and outcomes (page_id, bad 0/1) -> one row per host: host, pages, rate, bound."""
    labelled = pages.join(outcomes, "page_id").groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages")).join(labelled, "host", "left").na.fill(0, ["n", "bad"])
    hosts = materialise(with_domain(hosts, suffixes), "url-hosts")  # one row a host
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    mean = ((bad or 0) + 0.5) / ((n or 0) + 1.0) if n else 0.0
    suffix = suffix.withColumn("prior", F.lit(mean))
    suffix = suffix.select("suffix", _posterior(strength(suffix)).alias("prior"))
    domains = domains.join(suffix, "suffix")
    domains = domains.select("domain", _posterior(strength(domains)).alias("prior"))
    rated = hosts.join(domains, "domain")
    m = strength(rated)
    rated = rated.select("host", "pages", "n", _posterior(m).alias("rate"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.lit(m) + F.col("n") + 1))
    return rated.select("host", "pages", "rate", (F.col("rate") - F.lit(Z) * sd).alias("bound"))


def _posterior(m: float) -> Column:
    return (F.col("prior") * F.lit(m) + F.col("bad")) / (F.lit(m) + F.col("n"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound: one row per row."""
    if suffixes is None:
        suffixes = pages.sparkSession.createDataFrame([(x, x.count(".") + 1) for x in SECOND_LEVEL], "suffix string, labels int")
    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = materialise(reputation(cut.drop("path"), outcomes.select("page_id", "bad"), suffixes), "url-known")
    name, verdict = rule_of(F.col("host"), F.col("path"))
    out = join_counted(cut, known, "host", "pages")
    method = F.when(F.col("bound") > TOLERANCE, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "rate", "bound")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.filter("quality is not null").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return judge(pages, outcomes).drop("rate", "bound")


_TLD2 = ", ".join(f"'{x}'" for x in SECOND_LEVEL)


def _rho(table: str) -> str:
    return f"""SELECT CASE WHEN pairs IS NULL OR pairs = 0 OR (s - alone) / pairs <= 1 / (1 + {STRENGTHS[1]}) THEN {STRENGTHS[1]}
    ELSE greatest({STRENGTHS[0]}, least({STRENGTHS[1]}, 1 / ((s - alone) / pairs) - 1)) END AS m
    FROM (SELECT sum(n * (bad / n - p) * (bad / n - p)) AS s, sum(p * (1 - p)) AS alone, sum(p * (1 - p) * (n - 1)) AS pairs FROM {table} WHERE n > 0)"""


def _cases(pick: int) -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[pick]}'" for v, h, p in rules) + " END"


ORACLE = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT *, string_split(host, '.') AS a FROM u),
d AS (SELECT page_id, host, path, CASE WHEN len(a) > 2 AND array_to_string(a[-2:], '.') IN ({_TLD2}) THEN array_to_string(a[-3:], '.') ELSE array_to_string(a[-2:], '.') END AS domain FROM l),
c AS (SELECT *, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '(?s)^[^.]*\\.', '') ELSE '' END AS suffix FROM d),
h AS (SELECT host, domain, suffix, count(quality) AS n, coalesce(sum((quality = 0)::INT), 0) AS bad FROM c LEFT JOIN labels ON doc_id = page_id GROUP BY ALL),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
sx AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dm GROUP BY ALL),
m0 AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1.0) ELSE 0 END::DOUBLE AS p FROM h),
sp AS (SELECT sx.*, p FROM sx, m0), m1 AS ({_rho("sp")}),
ps AS (SELECT suffix, (p * m + bad) / (m + n) AS p FROM sp, m1),
dp AS (SELECT dm.*, p FROM dm JOIN ps USING (suffix)), m2 AS ({_rho("dp")}),
pd AS (SELECT domain, (p * m + bad) / (m + n) AS p FROM dp, m2),
hp AS (SELECT h.*, p FROM h JOIN pd USING (domain)), m3 AS ({_rho("hp")}),
ph AS (SELECT host, m, n, (p * m + bad) / (m + n) AS p FROM hp, m3)
SELECT page_id, host, path, {_cases(0)} AS rule, coalesce({_cases(1)}, CASE WHEN p - {Z} * sqrt(p * (1 - p) / (m + n + 1)) > {TOLERANCE} THEN 'block' ELSE 'allow' END) AS verdict
FROM c JOIN ph USING (host)
"""

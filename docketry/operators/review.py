"""Requirements under review: report rows, citations, decisions and the checks before an insert.

A requirement is a row: run_id, requirement_id, category, label, status, severity, title, source (a struct with
locator and quote) and evidence (an array of structs with filename, locator and quote)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import squeezed

#: Categories that need evidence of one's own, and the wording of a report.
EVIDENCE_CATEGORIES = ("QUALIFICATION", "CREDENTIAL", "BOND", "SIGNATURE")
NO_LOCATOR = "定位缺失"
GAPS = ("已定位企业证据，仍需人工确认原件有效性", "未定位到可核验的企业证据", "该项主要依赖招标原文，需人工确认适用条件")
RISKS = {"FATAL": "可能导致废标或资格失效", "QUALIFICATION": "可能导致资格审查不通过", "DEADLINE": "错过节点可能导致文件不被接收"}
OTHER_RISK = "可能影响合规性、评分或材料完整性"
ACTIONS = ("补充证据并由人工复核", "核对原文并制定风险处置方案", "保留原文定位并确认原件有效")
REPORT_COLUMNS = ("requirement_id", "category", "label", "status", "severity", "title", "tender_locator", "evidence_locators", "evidence_gap", "risk_impact", "next_action")


def present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def locator_label(item: Column) -> Column:
    label = item["locator"]["label"]
    return F.when(present(label), label).otherwise(F.lit(NO_LOCATOR))


def signature(category: Column, title: Column) -> Column:
    """What makes two requirements of different runs the same one."""
    return F.struct(F.coalesce(category, F.lit("")).alias("category"), F.lower(squeezed(F.coalesce(title, F.lit("")))).alias("title"))


def has_evidence(evidence: Column) -> Column:
    return F.coalesce(F.size(evidence), F.lit(0)) > 0


def complete_citation(source: Column, evidence: Column) -> Column:
    """A place and a quote on both sides: the source, and one of the evidence entries."""
    cited = F.exists(F.coalesce(evidence, F.array()), lambda e: present(e["locator"]["label"]) & present(e["quote"]))
    return present(source["locator"]["label"]) & present(source["quote"]) & cited


def evidence_gap(status: Column, category: Column, evidence: Column) -> Column:
    found = F.coalesce((status == "PASS") & has_evidence(evidence), F.lit(False))
    return F.when(found, GAPS[0]).when(category.isin(*EVIDENCE_CATEGORIES), GAPS[1]).otherwise(GAPS[2])


def risk_impact(category: Column) -> Column:
    out = F
    for name, risk in RISKS.items():
        out = out.when(category == name, risk)
    return out.otherwise(OTHER_RISK)


def next_action(status: Column) -> Column:
    return F.when(status.isin("UNKNOWN", "NEEDS_REVIEW"), ACTIONS[0]).when(status == "FAIL", ACTIONS[1]).otherwise(ACTIONS[2])


def report_rows(requirements: DataFrame, *more: str) -> DataFrame:
    """The report's columns, after the columns named in `more`."""
    c = F.col
    locators = F.array_join(F.transform(F.coalesce("evidence", F.array()), lambda e: F.concat(F.coalesce(e["filename"], F.lit("")), F.lit(" "), locator_label(e))), "; ")
    made = {"tender_locator": locator_label(c("source")), "evidence_locators": locators, "evidence_gap": evidence_gap(c("status"), c("category"), c("evidence")), "risk_impact": risk_impact(c("category")), "next_action": next_action(c("status"))}
    return requirements.select(*more, *((made[n] if n in made else F.coalesce(n, F.lit(""))).alias(n) for n in REPORT_COLUMNS))


def resolved_status(decision: Column, wanted: Column, old: Column) -> Column:
    """The status after a reviewer's decision."""
    confirmed = F.when(present(wanted), wanted).when(old.isin("PASS", "FAIL"), old).otherwise("NEEDS_REVIEW")
    return F.when(decision.isin("PASS", "FAIL", "UNKNOWN", "NEEDS_REVIEW"), decision).when(decision == "CONFIRM", confirmed).when(decision == "REJECT", "NEEDS_REVIEW").otherwise("UNKNOWN")


def review(requirements: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per decision (keys, decision, new_status, revision): old_status, new_status and the outcome. A PASS
    without a citation on both sides, an unknown requirement and a stale revision change nothing."""
    wanted = decisions.withColumnsRenamed({"new_status": "wanted", "revision": "seen"})
    both = wanted.join(requirements, list(keys), "left")
    status = resolved_status(F.col("decision"), F.col("wanted"), F.col("status"))
    outcome = F.when(F.col("status").isNull(), "UNKNOWN_REQUIREMENT").when((status == "PASS") & ~complete_citation(F.col("source"), F.col("evidence")), "CITATION_MISSING").when(F.col("seen") != F.col("revision"), "CONFLICT").otherwise("APPLIED")
    both = both.withColumn("outcome", outcome)
    return both.select(*keys, "decision", F.col("status").alias("old_status"), F.when(F.col("outcome") == "APPLIED", status).otherwise(F.col("status")).alias("new_status"), "outcome")


def unknown_ids(given: Column, known: Column) -> Column:
    """Ids given that are not known, sorted."""
    return F.array_sort(F.array_except(given, known))


def feedback_issue(predicted: Column, actual: Column, requirement_id: Column, locator: Column, quote: Column, known: Column) -> Column:
    """Why a feedback row can't be stored; null if it can. `known`: its requirement belongs to the run."""
    lacks = (actual != "RELEVANT") | ~present(locator) | ~present(quote)
    return F.when((predicted == "DETECTED") & ~present(requirement_id), "REQUIREMENT_MISSING").when((predicted == "MISSED") & lacks, "QUOTE_MISSING").when(present(requirement_id) & ~known, "REQUIREMENT_UNKNOWN")


def bulk_manage(runs: DataFrame, run_ids: DataFrame, workspace: str, action: str, now: Column) -> DataFrame:
    """The runs after ARCHIVE, RESTORE or DELETE of those asked for (run_id) that are the workspace's own."""
    asked = run_ids.select("run_id").distinct().withColumn("asked", F.lit(True))
    both = runs.join(asked, "run_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)) & (F.col("workspace_id") == workspace))
    if action == "DELETE":
        return both.filter("not asked").drop("asked")
    at = now if action == "ARCHIVE" else F.lit(None).cast("timestamp_ntz")
    return both.withColumn("archived_at", F.when(F.col("asked"), at).otherwise(F.col("archived_at"))).withColumn("updated_at", F.when(F.col("asked"), now).otherwise(F.col("updated_at"))).drop("asked")


def page_index(page: Column, text: Column, blocks: Column, **known: Column) -> Column:
    """A page's listing entry: what isn't known has its default."""
    get = lambda name, default: F.coalesce(known[name], default) if name in known else default
    label = F.concat(F.lit("第 "), F.coalesce(page.cast("string"), F.lit("?")), F.lit(" 页"))
    return F.struct(page.alias("page"), label.alias("label"), get("char_count", F.length(F.coalesce(text, F.lit("")))).alias("char_count"), get("ocr_required", F.lit(False)).alias("ocr_required"), get("ocr_status", F.lit("NOT_REQUIRED")).alias("ocr_status"), F.coalesce(F.size(blocks), F.lit(0)).alias("block_count"))


def scan_quality(pages: DataFrame, *keys: str) -> DataFrame:
    """Counters over pages (has_text, ocr_required, ocr_status, low_text_confidence) of each key."""
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return pages.groupBy(*keys).agg(F.count("*").alias("total_pages"), flag(F.col("has_text")).alias("text_pages"), flag(F.col("ocr_required")).alias("ocr_required_pages"), flag(F.col("ocr_status") == "FAILED").alias("ocr_failed_pages"), flag(F.col("low_text_confidence")).alias("low_text_confidence_pages"))


def quality_or_documents(quality: Column, documents: Column) -> Column:
    """The stored counters of a run, or for old runs the sum of its documents' pages, all taken for text."""
    total = F.aggregate(F.coalesce(documents, F.array()), F.lit(0).cast("long"), lambda n, d: n + F.coalesce(d["pages"], F.lit(0)))
    zero = F.lit(0).cast("long")
    old = F.struct(total.alias("total_pages"), total.alias("text_pages"), zero.alias("ocr_required_pages"), zero.alias("ocr_failed_pages"), zero.alias("low_text_confidence_pages"))
    return F.when(quality["total_pages"].isNotNull(), quality).otherwise(old)


def flat_evidence(runs: DataFrame) -> DataFrame:
    """One row per evidence asset of each run's array, with the run's id."""
    return runs.select("run_id", F.posexplode("evidence_assets").alias("seq", "asset")).select("run_id", "seq", "asset.*")


def rescans(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """The new runs (new_run_id, run_id of the parent): one version up, linked to their parents."""
    return asked.join(runs.select("run_id", "workspace_id", "version_number"), "run_id").select(F.col("new_run_id").alias("run_id"), F.col("run_id").alias("parent_run_id"), "workspace_id", (F.coalesce("version_number", F.lit(1)) + 1).alias("version_number"))


def run_summaries(runs: DataFrame, requirements: DataFrame) -> DataFrame:
    """runs (run_id, ...) with what a listing shows of their requirements. A run without any shows its stored counters
    (requirement_count, unresolved_count, blocker_count, fatal_risk_count; zero where a column or value is missing)."""
    open_ = F.col("status").isin("UNKNOWN", "NEEDS_REVIEW")
    blocks = F.col("category").isin("FATAL", "QUALIFICATION") & (open_ | (F.col("status") == "FAIL"))
    counts = requirements.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(open_).alias("unresolved"), F.count_if(blocks).alias("blockers"), F.count_if(F.col("category") == "FATAL").alias("fatal"))
    stored = {"total": "requirement_count", "unresolved": "unresolved_count", "blockers": "blocker_count", "fatal": "fatal_risk_count"}
    kept = {n: F.col(c).cast("long") if c in runs.columns else F.lit(None).cast("long") for n, c in stored.items()}
    both = runs.join(counts, "run_id", "left").withColumns({n: F.coalesce(F.col(n), kept[n], F.lit(0)) for n in stored})
    return both.drop(*stored.values())


def initial_runs(asked: DataFrame, now: Column) -> DataFrame:
    """A new run's document for each row asked for (run_id, filename)."""
    empty = F.array().cast("array<string>")
    state = F.struct(F.lit("INGEST").alias("phase"), F.lit("PROCESSING").alias("status"), empty.alias("review_events"), empty.alias("action_plan"))
    return asked.select("run_id", "filename", F.lit("PROCESSING").alias("status"), F.lit(1).alias("revision"), F.lit(1).alias("version_number"), F.lit(False).alias("favorite"), empty.alias("tags"), state.alias("state"), now.alias("created_at"), now.alias("updated_at"))


def review_packet(requirements: DataFrame) -> DataFrame:
    """What an independent reviewer is given: open requirements with their source, without any verdict."""
    return requirements.filter(F.col("status").isin("UNKNOWN", "NEEDS_REVIEW")).select("run_id", "requirement_id", "category", F.left("title", F.lit(160)).alias("title"), locator_label(F.col("source")).alias("locator"), F.left("source.quote", F.lit(240)).alias("quote"))


def document_index(fields: DataFrame, doc: str, page: str, name: str) -> DataFrame:
    """Each document's pages and field names, sorted."""
    return fields.groupBy(doc).agg(F.sort_array(F.collect_set(page)).alias("pages"), F.sort_array(F.collect_set(name)).alias("fields"))


def metric_eligible(entries: DataFrame) -> DataFrame:
    """Confirmed entries of public sources with a whole digest that were reviewed independently."""
    return entries.filter((F.col("review_status") == "CONFIRMED") & (F.col("origin") == "public") & (F.length("sha256") == 64) & F.coalesce(F.col("independent"), F.lit(False)))


def scored(rows: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Rows that count: no synthetic ids, no forbidden sources, and a score."""
    bad = F.coalesce("doc_id", F.lit("")).startswith("synthetic-")
    for prefix in forbidden:
        bad = bad | F.coalesce("source_url", F.lit("")).startswith(prefix)
    return rows.filter(~bad & F.col("score").isNotNull())


def review_queue(requirements: DataFrame, reviews: DataFrame, confirmed: bool) -> DataFrame:
    """Requirements whose latest review (by seq) confirms them, or all the others."""
    last = reviews.groupBy("requirement_id").agg(F.max_by("decision", "seq").alias("decision"))
    both = requirements.join(last, "requirement_id", "left")
    done = F.coalesce(F.col("decision").isin("PASS", "CONFIRM"), F.lit(False))
    return both.filter(done if confirmed else ~done)


def with_decisions(ledger: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """A first-pass ledger after independent decisions: a decided row takes the verdict and says by whom."""
    both = ledger.join(decisions.select(key, F.col("verdict").alias("decided"), F.col("reviewer").alias("by")), key, "left")
    return both.withColumns({"verdict": F.coalesce("decided", "verdict"), "reviewer": F.coalesce("by", "reviewer"), "second_pass": F.col("decided").isNotNull()}).drop("decided", "by")


def dashboard(requirements: DataFrame, *keys: str) -> DataFrame:
    """Totals, open and decided rows, and the decided share in whole percent."""
    decided = F.count_if(F.col("status").isin("PASS", "FAIL"))
    return requirements.groupBy(*keys).agg(F.count("*").alias("total"), (F.count("*") - decided).alias("open"), decided.alias("decided"), F.floor(100 * decided / F.count("*")).alias("percent"))


def name_uuid(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name: the same for the same name, whoever makes it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.element_at(F.split(F.lit("8 9 a b"), " "), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def delivered(rows: DataFrame, at: Column) -> DataFrame:
    """Mark a delivery: one of two columns takes the time, by how it went."""
    ok = F.col("succeeded")
    return rows.withColumns({"delivered_at": F.when(ok, at).otherwise(F.col("delivered_at")), "failed_at": F.when(~ok, at).otherwise(F.col("failed_at"))})


def candidate_ledger(fixtures: DataFrame, digests: DataFrame, rejections: DataFrame) -> DataFrame:
    """fixtures (fixture_id, sha256, candidates array<struct<category, page, quote>>) flattened, one row a candidate, with
    whether the file at hand is the one that was read (digests: fixture_id, sha256) and why a category was rejected."""
    each = fixtures.select("fixture_id", "sha256", F.posexplode("candidates").alias("seq", "c")).select("fixture_id", "sha256", "seq", "c.*")
    both = each.join(digests.select("fixture_id", F.col("sha256").alias("at_hand")), "fixture_id", "left").join(rejections, ["fixture_id", "category"], "left")
    source = F.when(F.col("at_hand").isNull(), "MISSING").when(F.col("at_hand") != F.col("sha256"), "CHANGED").otherwise("VERIFIED")
    return both.withColumn("source_status", source).drop("at_hand", "sha256")


def source_file(documents: Column, source_id: Column) -> Column:
    """The entry of a run's documents with an id; null if it has none."""
    return F.get(F.filter(documents, lambda d: d["source_id"] == source_id), 0)

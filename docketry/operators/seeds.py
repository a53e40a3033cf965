"""Checks of labelled seeds (key fields, tables, seals and handwriting) and of the manifest that they cite.

Each check gives a column `issues`; a seed is taken only if no row has any (validate.fail_closed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions import tables, text

ORIGINS = ("public", "synthetic")
SLOTS = ("seal", "handwriting", "mixed")
CROSS_PAGE = r"跨页|续表|续上表|cross-page"
FAILED = ("failed", "dead")
EXCLUDED = ("failed", "excluded")


def given(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) != ""


def coded(**checks: Column) -> Column:
    """The names of the checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items())))


def first_of(**checks: Column) -> Column:
    """The first check that holds, as an array of at most one name."""
    return F.slice(coded(**checks), 1, 1)


def completed(manifest: DataFrame, strict: bool = False) -> DataFrame:
    """The manifest's finished rows; strict ones have a whole digest too."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    rows = manifest.filter(~status.isin(*(EXCLUDED if strict else FAILED)))
    return rows.filter(F.length(F.trim(F.coalesce("sha256", F.lit("")))) == 64) if strict else rows


def failed(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*FAILED))


def manifest_issues(manifest: DataFrame) -> DataFrame:
    """Finished rows need an http source and a whole digest of their own; failures a source, no digest, and must say
    that they don't count."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    off = status.isin(*FAILED)
    sha = F.trim(F.coalesce("sha256", F.lit("")))
    whole = ~off & (F.length(sha) == 64)
    again = F.row_number().over(Window.partitionBy(whole, sha).orderBy("document_id")) > 1
    rows = manifest.withColumn("again", whole & again)
    issues = coded(
        missing_source_url=F.when(off, ~given(F.col("source_url"))).otherwise(~F.coalesce(F.trim("source_url"), F.lit("")).startswith("http")),
        missing_sha256=~off & (F.length(sha) != 64),
        duplicate_sha256=F.col("again"),
        counts_as_completed=off & F.coalesce(F.col("counts_as_completed"), F.lit(True)),
        failure_with_sha256=off & (sha != ""),
    )
    return rows.withColumn("issues", issues).drop("again")


def origin_issue(seed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add `origin_issues`: a public row must match its finished manifest row; a synthetic one says so in its id and
    is in no manifest."""
    known = completed(manifest, strict=True).groupBy("document_id").agg(F.first(F.trim("source_url")).alias("m_url"), F.first(F.lower(F.trim("sha256"))).alias("m_sha"))
    rows = seed.join(known, seed["doc_id"] == known["document_id"], "left")
    origin = F.lower(F.trim(F.coalesce("origin", F.lit(""))))
    sha = F.lower(F.trim(F.coalesce("sha256", F.lit(""))))
    public, lost = origin == "public", F.col("document_id").isNull()
    issue = first_of(
        invalid_origin=~origin.isin(*ORIGINS),
        missing_source_url=public & ~given(F.col("source_url")),
        missing_sha256=public & (F.length(sha) != 64),
        manifest_mismatch=public & (lost | (F.trim("source_url") != F.col("m_url")) | (sha != F.col("m_sha"))),
        invalid_synthetic_id=~public & ~F.coalesce("doc_id", F.lit("")).startswith("synthetic-"),
        synthetic_in_manifest=~public & ~lost,
    )
    return rows.withColumn("origin_issues", issue).drop("document_id", "m_url", "m_sha")


def key_field_issues(seed: DataFrame, manifest: DataFrame, names: Sequence[str]) -> DataFrame:
    """seed (doc_id, page, origin, source_url, sha256, text_gt, fields). A field's name must be known, its value
    there, impersonal and in the text; a document's values of one name must agree with the first."""
    rows = origin_issue(seed, manifest).withColumns({"text_n": text.norm(F.col("text_gt")), "text_pii": text.is_pii(F.coalesce("text_gt", F.lit("")))})
    each = rows.select("doc_id", "page", "text_n", "text_pii", F.posexplode("fields").alias("seq", "f")).withColumns({"name": F.trim(F.coalesce("f.name", F.lit(""))), "value_n": text.norm(F.col("f.value"))})
    kept = F.when(F.col("name").isin(*names) & given(F.col("f.value")), F.col("value_n"))
    earlier = F.first(kept, ignorenulls=True).over(Window.partitionBy("doc_id", "name").orderBy("page", "seq"))
    issue = first_of(
        unknown_key_field_name=~F.col("name").isin(*names),
        invalid_fields=~given(F.col("f.value")),
        pii_value=text.is_pii(F.coalesce("f.value", F.lit(""))),
        pii_in_text_gt=F.col("text_pii"),
        value_not_in_text_gt=~F.col("text_n").contains(F.col("value_n")),
        conflicting_key_field=earlier != F.col("value_n"),
    )
    of_page = each.withColumn("issue", issue).groupBy("doc_id", "page").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "issue"))), lambda x: x["issue"])).alias("field_issues"))
    rows = rows.drop("text_n", "text_pii").join(of_page, ["doc_id", "page"], "left")
    empty = F.when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, F.array(F.lit("empty_fields"))).otherwise(F.coalesce("field_issues", F.array().cast("array<string>")))
    bad_origin = F.array_contains("origin_issues", "invalid_origin")
    issues = F.when(bad_origin, F.col("origin_issues")).when(F.size(empty) > 0, empty).otherwise(F.col("origin_issues"))
    return rows.withColumn("issues", issues).drop("field_issues", "origin_issues")


def table_issues(seed: DataFrame, manifest: DataFrame) -> DataFrame:
    """seed (doc_id, page, origin, source_url, sha256, text_gt, table_html, table_span). A table on one page, of a row
    and two cells at least, impersonal, each cell in the text."""
    rows = origin_issue(seed, manifest).withColumn("cells", tables.cells(F.col("table_html")))
    html, body = F.coalesce("table_html", F.lit("")), F.coalesce("text_gt", F.lit(""))
    norms = text.norm_each(F.col("cells.text"))
    rows = rows.withColumns({"cells_n": norms, "text_n": text.norm(F.col("text_gt"))})
    span = F.lower(F.trim(F.coalesce(F.when(given(F.col("table_span")), F.col("table_span")), F.lit("single_page"))))
    issue = first_of(
        missing_table_html=~given(F.col("table_html")),
        invalid_table_html=~F.lower(html).contains("<table") | (F.col("cells.rows") < 1) | (F.size("cells_n") < 2),
        cross_page_table=(span != "single_page") | body.rlike(CROSS_PAGE) | html.rlike(CROSS_PAGE),
        pii_in_text_gt=text.is_pii(body),
        pii_value=F.exists("cells.text", text.is_pii),
        cell_not_in_text_gt=F.exists("cells_n", lambda c: ~F.col("text_n").contains(c)),
    )
    bad_origin = F.array_contains("origin_issues", "invalid_origin")
    return rows.withColumn("issues", F.when(bad_origin | (F.size(issue) == 0), F.col("origin_issues")).otherwise(issue)).drop("origin_issues", "cells", "cells_n", "text_n")


def has_seal(flag: Column, page_type: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(page_type == "seal", F.lit(False))


def has_handwriting(flag: Column, page_type: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(page_type == "handwriting", F.lit(False))


def slot_issues(seed: DataFrame, manifest: DataFrame) -> DataFrame:
    """seed (doc_id, page, page_type, has_seal, has_hw, origin, slot, source_url, sha256): every issue of a row."""
    known = completed(manifest, strict=True).groupBy("document_id").agg(F.first(F.trim("source_url")).alias("m_url"), F.first(F.lower(F.trim("sha256"))).alias("m_sha"))
    again = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("page_type")) > 1
    rows = seed.withColumn("again", again).join(known, seed["doc_id"] == known["document_id"], "left")
    seal, hand = F.coalesce("has_seal", F.lit(False)), F.coalesce("has_hw", F.lit(False))
    origin, slot = F.trim(F.coalesce("origin", F.lit(""))), F.trim(F.coalesce("slot", F.lit("")))
    public, lost = origin == "public", F.col("document_id").isNull()
    issues = coded(
        seal_slot_inconsistent=(F.col("page_type") == "seal") & ~seal,
        hw_slot_inconsistent=(F.col("page_type") == "handwriting") & ~hand,
        empty_slot=~seal & ~hand,
        invalid_origin=~origin.isin(*ORIGINS),
        invalid_slot=(slot != "") & ~slot.isin(*SLOTS),
        synthetic_doc_id=(origin == "synthetic") & ~F.coalesce("doc_id", F.lit("")).startswith("synthetic-"),
        unknown_public_doc=public & lost,
        source_url_mismatch=public & ~lost & (F.trim(F.coalesce("source_url", F.lit(""))) != F.col("m_url")),
        sha256_mismatch=public & ~lost & (F.lower(F.trim(F.coalesce("sha256", F.lit("")))) != F.col("m_sha")),
    )
    return rows.withColumn("issues", F.when(F.col("again"), F.array(F.lit("duplicate_page"))).otherwise(issues)).drop("again", "document_id", "m_url", "m_sha")


def merge_manifest(manifest: DataFrame, fetched: DataFrame) -> DataFrame:
    """The manifest after a fetch (same columns): a finished row takes the place of the failures of its url; one whose
    digest or url is finished already is left out; of new rows with one digest the first id stays; failures come in
    for urls that have no row yet."""
    old_done, old_off = completed(manifest), failed(manifest)
    new = completed(fetched)
    new = new.join(old_done.select("sha256"), "sha256", "left_anti").join(old_done.select("source_url"), "source_url", "left_anti")
    rest = [c for c in new.columns if c not in ("sha256", "document_id")]
    new = new.groupBy("sha256").agg(F.min(F.struct("document_id", *rest)).alias("row")).select("sha256", "row.*").select(*manifest.columns)
    kept_off = old_off.join(new.select("source_url"), "source_url", "left_anti").select(*manifest.columns)
    known = old_done.select("source_url").unionByName(new.select("source_url")).unionByName(old_off.select("source_url"))
    new_off = failed(fetched).join(known, "source_url", "left_anti").select(*manifest.columns)
    return old_done.select(*manifest.columns).unionByName(new).unionByName(kept_off).unionByName(new_off)

"""Row validators: coded issues per row, and a fail-closed assertion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_TYPES = ("cover", "toc", "body", "table", "seal", "handwriting")


def with_issues(df: DataFrame, rules: dict[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """issues: the codes of the rules that a row breaks (a rule that gives null counts as broken)."""
    if unique:
        many = df.groupBy(*unique).count().filter("count > 1").select(*(F.col(c).alias(f"__{c}") for c in unique), F.lit(True).alias("__many"))
        cond = [df[c].eqNullSafe(F.col(f"__{c}")) for c in unique]
        df = df.join(many, cond, "left").drop(*(f"__{c}" for c in unique))
        rules = rules | {"duplicate": F.col("__many").isNull()}
    out = df.withColumn("issues", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()))))
    return out.drop("__many")


def annotations(df: DataFrame) -> DataFrame:
    rules = {"doc_id": F.trim("doc_id") != "", "page": F.col("page") >= 1, "page_type": F.col("page_type").isin(*PAGE_TYPES), "text_gt": F.col("text_gt").isNotNull(), "fields": F.coalesce(F.forall("fields", lambda f: (F.trim(f["name"]) != "") & f["value"].isNotNull()), F.lit(True))}
    return with_issues(df, rules, ["doc_id", "page"])


def fail_closed(df: DataFrame) -> DataFrame:
    """The rows, unless any has an issue: then the action fails."""
    bad = F.size("issues") > 0
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit("rejected: "), F.array_join("issues", ",")))).otherwise(F.lit(True)).cast("boolean"))

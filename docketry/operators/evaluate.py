"""Confusion metrics, rollups and field scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.metrics import cer

MEASURABLE_FROM = 20


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_discovery": ratio(fp, tp + fp), "miss": ratio(fn, tp + fn), "false_positive": ratio(fp, fp + tn)})


def accuracy(feedback: DataFrame, detected: DataFrame | None = None) -> DataFrame:
    """feedback (category, predicted, actual, complete) [and detected (category, detected_total)] -> metrics by
    category. A category is MEASURABLE if all its detections were reviewed, in MEASURABLE_FROM rows or more,
    and no review is incomplete."""
    p, a = F.col("predicted"), F.col("actual")
    by = feedback.groupBy("category").agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"), F.bool_and("complete").alias("complete"))
    if detected is None:
        detected = feedback.filter(p).groupBy("category").agg(F.count("*").alias("detected_total"))
    out = by.join(detected, "category", "full_outer").na.fill(0, ["tp", "fp", "fn", "tn", "detected_total"])
    out = rates(out).withColumn("sample_size", F.expr("tp + fp + fn + tn")).withColumn("coverage", ratio(F.expr("tp + fp"), F.col("detected_total")))
    ready = (F.col("coverage") == 1) & (F.col("sample_size") >= MEASURABLE_FROM) & F.coalesce(F.col("complete"), F.lit(False))
    return out.withColumn("status", F.when(F.coalesce(ready, F.lit(False)), "MEASURABLE").otherwise("INSUFFICIENT"))


def overall(by_category: DataFrame) -> DataFrame:
    sums = by_category.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")), F.bool_and(F.col("status") == "MEASURABLE").alias("measurable"))
    return rates(sums)


def field_scores(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """(doc_id, name, value) twice, values normalised -> tp, fp, fn, f1. A wrong value is a miss and a false find."""
    j = truth.withColumnRenamed("value", "t").join(guess.withColumnRenamed("value", "g"), ["doc_id", "name"], "full_outer")
    hit = F.coalesce(F.col("t") == F.col("g"), F.lit(False))
    s = j.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("g").isNotNull() & ~hit).alias("fp"), F.count_if(F.col("t").isNotNull() & ~hit).alias("fn"))
    return s.withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), F.expr("2 * tp + fp + fn")), F.lit(0.0)))


def last_fields(rows: DataFrame, line: str = "line") -> DataFrame:
    """Explode (doc_id, line, fields array<struct<name, value>>); the last line's value wins."""
    each = rows.select("doc_id", line, F.posexplode("fields").alias("n", "f")).filter(F.trim("f.value") != "")
    return each.groupBy("doc_id", F.col("f.name").alias("name")).agg(F.max_by("f.value", F.struct(line, "n")).alias("value"))


def page_rows(truth: DataFrame, guess: DataFrame, mode: str) -> DataFrame:
    """truth (doc_id, page, text_n, fields_n array) and guess (doc_id, page, text_n, line), texts normalised: each page
    of the truth against the last guess of its key: cer, and how many of its fields' values the guess holds."""
    last = guess.groupBy("doc_id", "page").agg(F.max_by("text_n", F.struct("line", "text_n")).alias("guess_n"))
    both = truth.join(last, ["doc_id", "page"], "left").withColumn("guess_n", F.coalesce("guess_n", F.lit("")))
    hits = F.size(F.filter("fields_n", lambda f: F.contains(F.col("guess_n"), f)))
    return both.select("doc_id", "page", F.lit(mode).alias("mode"), cer(F.col("text_n"), F.col("guess_n")).alias("cer"), hits.alias("field_hits"), F.size("fields_n").alias("field_total"))


def fetch_summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    """How many fetches there were, how many went well, and how many failed by no answer and by a bad one."""
    o = F.col("outcome")
    return outcomes.groupBy(*keys).agg(F.count("*").alias("fetched"), F.count_if(o == "ok").alias("ok"), F.count_if(o == "unreachable").alias("unreachable"), F.count_if((o != "ok") & (o != "unreachable")).alias("bad"))

"""Rollups of page and field metrics: micro and macro means, summaries by mode, cohorts, root causes, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.metrics import GATES


def micro_rate(pages: DataFrame, edits: str, chars: str, *keys: str) -> DataFrame:
    """Sum of edits over sum of characters; 1 where there are none."""
    total = F.coalesce(F.sum(chars), F.lit(0))
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.when(total > 0, F.sum(edits) / total).otherwise(1.0).alias("rate"))


def has_table(html: Column) -> Column:
    return F.coalesce(F.lower(html).contains("<table"), F.lit(False))


def macro_mean(pages: DataFrame, score: str, html: str, *keys: str) -> DataFrame:
    """Mean score of the pages whose truth has a table; pages without one do not count."""
    return pages.filter(has_table(F.col(html))).groupBy(*keys).agg(F.count("*").alias("pages"), F.avg(score).alias("mean"))


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], width: float) -> DataFrame:
    """The values at the given ranks (from 1, of the sorted values of each group; `total` is their number).

    Values are counted by range of `width` first; only the range that holds a rank is counted value by value, so
    no group's values meet in one task."""
    ranges = df.filter(F.col(value).isNotNull()).withColumn("range", F.floor(F.col(value) / F.lit(width)))
    counts = ranges.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("range")
    whole = Window.partitionBy(*keys)
    upto = counts.withColumns({"last": F.sum("n").over(order), "total": F.sum("n").over(whole)})
    upto = upto.withColumn("wanted", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("rank")) for name, at in ranks.items()))))
    holds = upto.filter((F.col("wanted.rank") <= F.col("last")) & (F.col("wanted.rank") > F.col("last") - F.col("n")))
    holds = holds.select(*keys, "range", "wanted.name", (F.col("wanted.rank") - F.col("last") + F.col("n")).alias("rank"))
    inside = ranges.join(holds.select(*keys, "range").distinct(), [*keys, "range"], "left_semi").groupBy(*keys, "range", value).agg(F.count("*").alias("n"))
    inside = inside.withColumn("last", F.sum("n").over(Window.partitionBy(*keys, "range").orderBy(value)))
    met = inside.join(holds, [*keys, "range"]).filter(F.col("last") >= F.col("rank"))
    return met.groupBy(*keys).agg(*(F.min(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks))


def with_ranks(summary: DataFrame, df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], width: float) -> DataFrame:
    """Add the values of `nearest_ranks` to a summary of one row a group; null where a group has no values."""
    found = nearest_ranks(df, keys, value, ranks, width)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return summary.join(found.withColumnsRenamed({k: f"__{k}" for k in keys}), same, "left").drop(*(f"__{k}" for k in keys))


def by_mode(pages: DataFrame, mode: str, width: float = 50.0) -> DataFrame:
    """pages, mean cer and wer, mean and 95th-percentile latency, field accuracy and providers of each mode. The percentile
    is the value at place floor(0.95 * (n - 1)) from 0 of the sorted ones, found by ranges of `width`."""
    hits, total = F.sum("field_hits"), F.sum("field_total")
    out = pages.groupBy(mode).agg(F.count("*").alias("pages"), F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.avg("latency_ms").alias("mean_latency_ms"), F.when(total > 0, hits / total).alias("field_accuracy"), F.array_sort(F.collect_set("provider")).alias("providers"))
    return with_ranks(out, pages, [mode], "latency_ms", {"p95_latency_ms": F.floor(F.lit(0.95) * (F.col("total") - 1)) + 1}, width)


def hard_pages(pages: DataFrame, above: float, *keys: str, width: float = 0.01) -> DataFrame:
    """Mean, median and 95th percentile of cer, and how many pages are above a bound. The percentile is the value at place
    floor(0.95 * n) from 1, the first at least; ranks are found by ranges of `width`, so no task gets a group's values."""
    out = pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.avg("cer").alias("mean"), F.count_if(F.col("cer") > above).alias("hard"))
    n = F.col("total")
    ranks = {"__low": F.floor((n + 1) / 2), "__high": F.floor(n / 2) + 1, "p95": F.greatest(F.lit(1), F.floor(n * F.lit(0.95)))}
    return with_ranks(out, pages, keys, "cer", ranks, width).withColumn("median", (F.col("__low") + F.col("__high")) / 2).drop("__low", "__high")


def cohort_of(doc_id: Column, synthetic: Column) -> Column:
    return F.when(synthetic, "synthetic").when(doc_id.startswith("old-"), "old").otherwise("real")


def cohort_report(pages: DataFrame) -> DataFrame:
    """pages (cohort, edits, chars, tp, fp, fn, teds, table_html) -> one row a cohort with its metrics and its gate;
    a metric that is not there fails the gate."""
    tp2 = 2 * F.sum("tp")
    all_fields = tp2 + F.sum("fp") + F.sum("fn")
    table = has_table(F.col("table_html"))
    out = pages.groupBy("cohort").agg(F.count("*").alias("pages"), F.when(F.sum("chars") > 0, F.sum("edits") / F.sum("chars")).alias("line_cer"), F.when(all_fields > 0, tp2 / all_fields).alias("key_field_f1"), F.avg(F.when(table, F.col("teds"))).alias("teds"))
    for name, kind, bound in GATES:
        out = out.withColumn(f"{name}_gate", metric_gate(F.col(name), kind, bound))
    return out


def metric_gate(value: Column, kind: str, bound: float) -> Column:
    ok = value <= bound if kind == "max" else value >= bound
    return F.when(F.coalesce(ok, F.lit(False)), "GATE_PASS").otherwise("GATE_FAIL")


def root_causes(pages: DataFrame, worst: int = 5, bad: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """The worst pages by rate, and of contents pages and others how many there are and how many are bad."""
    top = pages.orderBy(F.desc("rate"), "doc_id", "page").limit(worst)
    return top, pages.groupBy("is_toc").agg(F.count("*").alias("pages"), F.count_if(F.col("rate") > bad).alias("bad"))


def coverage(fields: DataFrame, doc: str, name: str, wanted: Sequence[str], *keys: str) -> DataFrame:
    """Documents, distinct (document, name) pairs, instances, and the wanted names that were seen and not seen."""
    seen = F.collect_set(F.when(F.col(name).isin(*wanted), F.col(name)))
    gaps = F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), seen))
    return fields.groupBy(*keys).agg(F.countDistinct(doc).alias("documents"), F.countDistinct(doc, name).alias("pairs"), F.count("*").alias("instances"), F.array_sort(seen).alias("seen"), gaps.alias("gaps"))


def marked(value: Column, *words: str) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*words), F.lit(False))


def ledger_summary(rows: DataFrame) -> DataFrame:
    """One row of a pilot ledger's counts: rows, confirmed tasks, payment signals."""
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return rows.agg(F.count("*").alias("rows"), F.count_if(marked(F.col("human_confirmation"), "confirmed")).alias("confirmed_tasks"), F.count_if(some("payment_signal")).alias("payment_signals"))


def contact_summary(rows: DataFrame) -> DataFrame:
    """One row of a contact ledger's counts: rows, contacts that answered or were followed up, rows with a pilot task."""
    touched = ~F.coalesce(F.lower(F.trim("response_status")), F.lit("")).isin("", "pending")
    return rows.agg(F.count("*").alias("rows"), F.count_if(touched).alias("touched_contacts"), F.count_if(F.coalesce(F.trim("linked_pilot_task_id") != "", F.lit(False))).alias("linked_pilot_tasks"))


def business_status(confirmed: Column, signals: Column) -> Column:
    return F.when(confirmed > 0, "CONFIRMED").when(signals > 0, "SIGNAL_ONLY").otherwise("NO_SIGNAL")


def metric_lines(counts: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """Counters as exposition lines: name{label="value",...} number."""
    pairs = F.concat_ws(",", *(F.format_string(f'{x}="%s"', F.col(x).cast("string")) for x in labels))
    return counts.select(F.format_string(f"{name}{{%s}} %d", pairs, F.col(value)).alias("line"))


def chosen_pages(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Cover, middle and last page of each document; pages count from 1."""
    last = pages.groupBy(doc).agg(F.max(page).alias("last_page"))
    at = F.col(page)
    return pages.join(last, doc).filter((at == 1) | (at == F.floor(F.col("last_page") / 2) + 1) | (at == F.col("last_page")))


def hash_split(df: DataFrame, key: str, tenths: int = 9, seed: int = 42) -> DataFrame:
    """train or val by a hash of the key: the same at any partitioning and size."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10)) < tenths, "train").otherwise("val"))

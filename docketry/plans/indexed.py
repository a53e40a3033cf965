"""Registered queries over indexes, digests, bitmaps and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import boxes, indexes
from docketry.plans.catalog import _HALF, query
from docketry.sources.shared import scratch


@query("SELECT p_brand, p_type, count(*) AS n FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') GROUP BY ALL")
def search_indexed(t):
    """Search by trigram postings that are written first."""
    part = t("part")
    path = scratch(part.sparkSession, "trigrams")
    indexes.write_trigrams(part, "p_partkey", ["p_name", "p_brand", "p_type"], path, parts=16)
    return indexes.search_trigrams(part, "p_partkey", ["p_name", "p_brand", "p_type"], "Brand#1", path, parts=16).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query(f"SELECT user_id, event_type, a.n AS new_value, b.n AS old_value, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_HALF.format('>=')}) a FULL JOIN ({_HALF.format('<')}) b USING (user_id, event_type) WHERE a.n IS DISTINCT FROM b.n")
def snapshot_diff_by_digest(t):
    """Two stored snapshots, compared by their digests first."""
    e, cut = t("events"), F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    paths = [scratch(e.sparkSession, name) for name in ("new", "old")]
    for path, side in zip(paths, (F.col("ts") >= cut, F.col("ts") < cut), strict=True):
        indexes.write_snapshot(e.filter(side).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"], path, leaves=16)
    return indexes.diff_snapshots(e.sparkSession, *paths, ["user_id", "event_type"], "n")


@query(
    """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' WHEN grouping(l_linestatus) = 1 THEN 'flag' ELSE 'both' END AS level, l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS documents, count(*) AS instances
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"""
)
def coverage_rollups(t):
    """Distinct documents at three levels, all from one table of bitmaps."""
    table = indexes.bitmaps(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")
    path = scratch(table.sparkSession, "bitmaps")
    table.write.parquet(path)
    table, out = table.sparkSession.read.parquet(path), None
    for level, keys in (("both", ["l_returnflag", "l_linestatus"]), ("flag", ["l_returnflag"]), ("all", [])):
        rows = indexes.distinct_counts(table, *keys).withColumnsRenamed({"n": "documents"}).withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


_BOX = "SELECT l_suppkey % 20 AS page, l_orderkey * 10 + l_linenumber AS item, l_partkey % 500 AS x0, l_partkey % 500 + 1 + l_quantity / 10 AS x1, l_extendedprice % 400 AS y0, l_extendedprice % 400 + 2 + l_discount * 50 AS y1 FROM lineitem"


@query(f"WITH b AS ({_BOX}) SELECT a.page, count(*) AS pairs, count(DISTINCT a.item) AS items, round(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))), 3)::DOUBLE AS area FROM b a JOIN b ON a.page = b.page AND a.item < b.item AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY ALL")
def box_pairs(t):
    """Boxes that overlap on both axes, on twenty large pages."""
    c = F.col
    b = t("lineitem").select((c("l_suppkey") % 20).alias("page"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("item"), (c("l_partkey") % 500).alias("x0"), (c("l_partkey") % 500 + 1 + c("l_quantity") / 10).alias("x1"), (c("l_extendedprice") % 400).alias("y0"), (c("l_extendedprice") % 400 + 2 + c("l_discount") * 50).alias("y1"))
    sums = boxes.totals(b, "page", "item", [("x0", "x1"), ("y0", "y1")])
    return sums.select("page", "pairs", "items", F.round("area", 3).alias("area"))

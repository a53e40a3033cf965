"""Operator 8, sharding by a hypergeometric communication matrix, DataFrame functions only.

A uniform shuffle of N rows sends to each shard a hypergeometric share of each partition. The matrix of those
counts, with the input partitions' sizes as row sums and the exact shard sizes as column sums, is drawn on the driver
(it has at most PARTITIONS rows, whatever the input). Each partition is permuted where it is (sorted by seeded hashes
in its task, its rows numbered) and cut by its row of the matrix, rows are exchanged, and each shard is permuted
again: in blocks of about BLOCK rows, whose order is that of other hashes, so that no task holds a shard.

The permuted rows are written once with their numbers, so that lost tasks come out the same when repeated.

Defined results: null text has size 8 and the crc32 of no bytes; null and repeated doc_ids and repeated rows
are rows like any other; extra columns are carried by `shuffle`, an input column named shard or slot under that name
with _input after it; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise, unused

SHARDS = 24
BLOCK = 20_000
PARTITIONS = 1 << 14


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; by inversion, for numbers of any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    share = good / (good + bad)
    mean = n * share
    sd = (mean * (1 - share) * (good + bad - n) / max(1, good + bad - 1)) ** 0.5
    a, b = max(low, int(mean - 12 * sd - 12)), min(high, int(mean + 12 * sd + 12))  # beyond lies less than a double holds
    k = np.arange(a, b, dtype=np.float64)
    log = np.concatenate(([0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))))
    cdf = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right").clip(0, len(cdf) - 1))


def matrix(partition_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts (partition, shard) of a uniform shuffle."""
    rng, left = np.random.default_rng(seed), list(shard_sizes)
    out = np.zeros((len(partition_sizes), len(shard_sizes)), np.int64)
    for p, n in enumerate(partition_sizes):
        rest = sum(left)
        for s in range(len(left)):
            rest -= left[s]
            x = hypergeometric(rng, left[s], rest, n)
            out[p, s] = x
            n -= x
            left[s] -= x
    return out


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """All columns, and shard and slot: a uniform shuffle in which shard sizes differ by one at most."""
    spark = df.sparkSession
    for name in ("shard", "slot"):
        df = df.withColumnsRenamed({c: unused(df, f"{c}_input")[0] for c in df.columns if c.lower() == name})
    row, place, part, rank, cuts, order, block, before, number = unused(df, "row", "place", "part", "rank", "cuts", "order", "block", "before", "number")
    rows = df.coalesce(PARTITIONS).withColumn(row, F.monotonically_increasing_id())
    rows = rows.sortWithinPartitions(F.xxhash64(row, F.lit(seed)), row).withColumn(place, F.monotonically_increasing_id())
    rows = materialise(rows, "shard-rows")  # place: the partition above 33 bits of the rank in it
    rows = rows.withColumn(part, F.shiftright(place, 33).cast("int")).withColumn(rank, F.col(place).bitwiseAND((1 << 33) - 1))
    sizes = dict(rows.groupBy(part).count().collect())  # at most PARTITIONS numbers
    names, total = sorted(sizes), sum(sizes.values())
    cut = matrix([sizes[p] for p in names], [total // shards + (s < total % shards) for s in range(shards)], seed).cumsum(axis=1)
    bounds = F.broadcast(spark.createDataFrame([(p, c) for p, c in zip(names, cut.tolist(), strict=True)], f"`{part}` int, `{cuts}` array<long>"))
    shard = F.size(F.filter(cuts, lambda b: b <= F.col(rank)))
    blocks = max(4, -(-total // (shards * BLOCK)))
    dealt = rows.join(bounds, part).withColumn("shard", shard).withColumn(order, F.shiftrightunsigned(F.xxhash64(row, F.lit(seed + 2)), 1))
    dealt = dealt.withColumn(block, F.shiftright(F.shiftright(order, 39) * F.lit(blocks).cast("long"), 24).cast("int"))
    dealt = materialise(dealt.drop(cuts, part, rank, place), "shard-dealt")
    upto = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", block).count()
    starts = starts.select("shard", block, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias(before))
    again = Window.partitionBy("shard", block).orderBy(order, row)
    placed = dealt.withColumn(number, F.row_number().over(again) - 1).join(starts, ["shard", block])
    return placed.withColumn("slot", F.col(before) + F.col(number)).select(*df.columns, "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

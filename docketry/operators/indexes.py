"""Tables that are written once so that later questions read little: trigrams for search, digests for differences of
snapshots, bitmaps for distinct counts at any level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import store

GRAM = 3
PARTS = 64
LEAVES, FAN = 256, 16


def _folded(columns: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def write_trigrams(df: DataFrame, key: str, columns: Sequence[str], path: str, parts: int = PARTS) -> None:
    """Postings (gram, key) of the lower-cased columns, by parts of the grams; a common gram's are spread over files by
    key."""
    text = _folded(columns)
    grams = F.transform(F.sequence(F.lit(1), F.length("text") - GRAM + 1), lambda i: F.substring("text", i, F.lit(GRAM)))
    rows = df.select(F.col(key).alias("key"), text.alias("text")).filter(F.length("text") >= GRAM).select("key", F.explode(F.array_distinct(grams)).alias("gram"))
    dealt = rows.withColumn("part", _part(F.col("gram"), parts)).repartitionByRange("part", "gram", "key").sortWithinPartitions("part", "gram", "key")
    dealt.write.mode("overwrite").partitionBy("part").parquet(path)


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.hash(gram), F.lit(parts))


def search_trigrams(df: DataFrame, key: str, columns: Sequence[str], needle: str, path: str, parts: int = PARTS) -> DataFrame:
    """The rows of `store.search`. Candidates have all of the needle's grams in the postings, of which only the grams' parts
    are read; each is then tested by the text itself. A needle of fewer than three characters is searched by the scan."""
    folded = needle.lower()
    grams = sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
    if not grams:
        return store.search(df, columns, needle)
    postings = df.sparkSession.read.parquet(path)
    wanted = postings.filter(F.col("part").isin([_part(F.lit(g), parts) for g in grams]) & F.col("gram").isin(grams))
    keys = wanted.groupBy("key").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select(F.col("key").alias(key))
    return store.search(df.join(keys, key, "left_semi"), columns, needle)


def write_snapshot(df: DataFrame, keys: Sequence[str], path: str, leaves: int = LEAVES) -> None:
    """A snapshot by leaves (ranges of the keys' hash), and a digest of each leaf and of each FAN nodes above them. A digest
    counts rows and holds an exclusive or and a sum of two hashes of each row's JSON, so it knows no order."""
    rows = df.withColumn("leaf", F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int"))
    rows.repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/rows")
    spark = df.sparkSession
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    each = spark.read.parquet(f"{path}/rows").select("leaf", body.alias("body"))
    digest = each.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("body")).alias("x"), F.sum(F.xxhash64("body", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    nodes = digest.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), F.sha2(F.concat_ws("|", "n", "x", "s"), 256).alias("digest"))
    level, top, tree = nodes, leaves, nodes
    while top > 1:
        top = -(-top // FAN)
        level = level.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda d: F.concat_ws(":", d["node"], d["digest"])), "|"), 256).alias("digest"))
        tree = tree.unionByName(level)
    tree.coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def changed_leaves(spark: SparkSession, new: str, old: str) -> list[int]:
    """The leaves in which two snapshots differ, found from the root down; at most as many as there are leaves."""
    a, b = (spark.read.parquet(f"{p}/digests").select("level", "node", F.col("digest").alias(n)) for p, n in ((new, "a"), (old, "b")))
    unlike = a.join(b, ["level", "node"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")
    level = unlike.agg(F.max("level")).first()[0]
    found: list[int] | None = None
    while level is not None and level >= 0:
        here = unlike.filter(F.col("level") == level)
        if found is not None:
            here = here.filter(F.floor(F.col("node") / FAN).isin(found))
        found = [r.node for r in here.collect()]
        level -= 1
    return sorted(found or [])


def diff_snapshots(spark: SparkSession, new: str, old: str, keys: Sequence[str], value: str) -> DataFrame:
    """The rows of `store.diff`; only the leaves whose digests differ are read and joined."""
    leaves = changed_leaves(spark, new, old)
    part = lambda path: spark.read.parquet(f"{path}/rows").filter(F.col("leaf").isin(leaves)).drop("leaf")
    return store.diff(part(new), part(old), keys, value)


def bitmaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, bucket, bits, instances): which numbers the rows of each key have, as bitmaps of 32,768 numbers. Combined
    before the shuffle; the distinct counts of any coarser grouping come from this table alone."""
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number)))
    return df.groupBy(*keys, F.bitmap_bucket_number(F.col(number)).alias("bucket")).agg(bits.alias("bits"), F.count("*").alias("instances"))


def distinct_counts(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, instances) of a table of `bitmaps`, exactly, for some of its keys or none. Rows without a number count as
    instances only."""
    merged = table.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("instances").alias("instances"))
    count = F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    return merged.groupBy(*keys).agg(F.sum(count).alias("n"), F.sum("instances").alias("instances"))

"""Operator 4, exact dedup: two-pass Bloom filtering, DataFrame functions only.

The filter is blocked: a row's hash names one word of 64 bits and two bits in it, so a row is one (word, mask) pair.
Pass one counts equal pairs, in tasks first (16 bytes a row cross the network, whatever the text), and sets in each
word the bits of the pairs that two rows or more have. Pass two looks up every row's word: a row that lacks one of
its bits there is certainly unique and passes straight through; only the others shuffle, by the SHA-256 of their
normalised text, so false positives cost a shuffle and never a wrong result.

The filter has a word for each ROWS_A_WORD rows, so the share of false positives stays the same at any size. Only
words with a bit set are kept: where they are counted to be at most BROADCAST_WORDS they are broadcast (20 MB), else
the probe is a join that shuffles word and row.

Of the rows that shuffle, each group is dealt over SALTS, or more with the input: a group's rows meet their result
salt by salt, so a group that holds a third of all rows is spread over many tasks.

Defined results: null text counts as empty; texts differing only in A-Z case are equal; of equal texts the row
with the largest doc_id stays (null is smallest), and of repeated rows with that doc_id exactly one; an empty
table gives an empty result; other columns, of any type and name, are carried by `drop_exact_duplicates` and ignored
by `decide`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, materialise, unused

ROWS_A_WORD = 4
BROADCAST_WORDS = 1 << 20
SALTS = 64
ROWS_A_SALT = 1_000_000  # so that a salt of the largest possible group has about so many rows


def _slot(sha: Column, words: int) -> tuple[Column, Column]:
    """The word of the filter and the mask of two bits (or one, if they fall together) of a hash."""
    h = F.xxhash64(sha, F.lit(2))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64(sha, F.lit(1)), F.lit(words)), bit(0).bitwiseOR(bit(6))


def repeated_bits(keys: DataFrame, sha: str, words: int) -> DataFrame:
    """(word, bits): of each word of the filter the bits of the (word, mask) pairs that two rows or more have."""
    word, mask = _slot(F.col(sha), words)
    twice = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word", "mask").count().filter("count > 1")
    return twice.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def split_by_filter(rows: DataFrame, bits: DataFrame, sha: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows that no other row equals, rows that may have equals)."""
    word, mask, bit = unused(rows, "word", "mask", "bits")
    w, m = _slot(F.col(sha), words)
    filled = bits.select(F.col("word").alias(word), F.col("bits").alias(bit))
    if filled.count() <= BROADCAST_WORDS:
        filled = F.broadcast(filled)
    probed = rows.withColumn(word, w).withColumn(mask, m).join(filled, word, "left")
    maybe = F.coalesce(F.col(bit).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))
    return probed.filter(~maybe).drop(word, mask, bit), probed.filter(maybe).drop(word, mask, bit)


def winners(maybe: DataFrame, sha: str, doc_id: str, row: str, total: int) -> DataFrame:
    """(sha, salt, best, group_size): for each group the largest (doc_id, row) and the size, on each of its salts."""
    salts = max(SALTS, -(-total // ROWS_A_SALT))
    salted = maybe.select(F.col(sha).alias("sha"), F.struct(F.col(doc_id).alias("id"), F.col(row).alias("row")).alias("me"), salt_of(F.col(row), salts).alias("salt"))
    some = salted.groupBy("sha", "salt").agg(F.max("me").alias("best"), F.count("*").alias("n"))
    best = some.groupBy("sha").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    return best.select("sha", F.explode("salts").alias("salt"), "best", "group_size")


def salt_of(row: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(doc_id, text_sha256, row) of every row; the filter; its words; the number of rows."""
    sha = F.sha2(ascii_lower(F.col(text_col)), 256)
    keys = docs.select(F.col(id_col).alias("doc_id"), sha.alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    keys = materialise(keys, "exact-keys")  # some 80 bytes a document
    total = keys.count()
    words = max(1, total // ROWS_A_WORD)
    return keys, materialise(repeated_bits(keys, "text_sha256", words), "exact-bits"), words, total


def decide_hashed(keys: DataFrame, bits: DataFrame, words: int, total: int) -> DataFrame:
    one, maybe = split_by_filter(keys, bits, "text_sha256", words)
    one = one.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    best = winners(maybe, "text_sha256", "doc_id", "row", total)
    maybe = maybe.withColumn("salt", salt_of(F.col("row"), max(SALTS, -(-total // ROWS_A_SALT))))
    more = maybe.join(best.withColumnRenamed("sha", "text_sha256"), ["text_sha256", "salt"])
    return one.unionByName(more.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return decide_hashed(*hashed(docs, id_col, text_col))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. A unique row passes straight through; one that may have equals
    meets the (doc_id, hash) pairs that go."""
    keys, bits, words, total = hashed(docs, id_col, text_col)
    gone = materialise(decide_hashed(keys, bits, words, total).filter("not kept"), "exact-gone")
    digest, lost_id, lost_digest, again, row = unused(docs, "digest", "lost_id", "lost_digest", "again", "row")
    one, maybe = split_by_filter(docs.withColumn(digest, F.sha2(ascii_lower(F.col(text_col)), 256)), bits, digest, words)
    lost = gone.groupBy("doc_id", "text_sha256").agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias(again))
    lost = lost.select(F.col("doc_id").alias(lost_id), F.col("text_sha256").alias(lost_digest), again)
    met = maybe.join(lost, F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.col(digest) == F.col(lost_digest)), "left")
    stays = one.select(*docs.columns).unionByName(met.filter(F.col(again).isNull()).select(*docs.columns))
    if not gone.filter("doc_id <=> keep_id").limit(1).count():
        return stays
    # rows that repeat the doc_id that stays: any one of them
    same = materialise(met.filter(again).withColumn(row, F.monotonically_increasing_id()), "exact-same")
    pick = same.groupBy(digest).agg(F.min(row).alias(row)).select(row)
    return stays.unionByName(same.join(pick, row, "left_semi").select(*docs.columns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir))


ORACLE = """
WITH k AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256)
"""

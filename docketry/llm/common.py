"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    All of an application's tables lie under its id there. Only where that setting is absent and the driver is the
    whole cluster (tests on one machine) a temporary folder is made."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docketry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    pure = F.octet_length(t) == F.char_length(t)  # lower() touches only A-Z there, and is faster
    return F.when(pure, F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores after it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


HOT_ROWS = 1_000_000  # of a key with more rows than this, the rows stay where they are and the key's row travels


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with a table of one row per key that says how many of the rows have the key. Of the keys
    with more than HOT_ROWS rows there are at most all rows / HOT_ROWS: those are broadcast, so no task gets them all."""
    hot = F.broadcast(table.filter(F.col(count) > HOT_ROWS).drop(count))
    cold = table.filter(F.col(count) <= HOT_ROWS).drop(count)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


FILTER_WORDS = 1 << 20  # of 64 bits, that a broadcast filter has at most


def _probed(rows: DataFrame, keys: DataFrame, digest: Column, key_digest: str) -> tuple[DataFrame, Column]:
    """The rows, with further columns, and whether a row's digest may be that of a key. The keys are a stored table; a
    blocked Bloom filter of them, a word for four, is broadcast. More keys than FILTER_WORDS can hold apart let more rows
    through."""
    words = min(FILTER_WORDS, max(1, keys.count() // 4))
    word, mask, bits = unused(rows, "word", "mask", "bits")
    bit = lambda h, at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    slot = lambda h: (F.pmod(h, F.lit(words)).alias(word), bit(h, 40).bitwiseOR(bit(h, 50)).alias(mask))
    h = lambda d: F.xxhash64(d, F.lit(3))
    filled = F.broadcast(keys.select(*slot(h(F.col(key_digest)))).groupBy(word).agg(F.bit_or(mask).alias(bits)))
    at, own = slot(h(digest))
    probed = rows.withColumn(word, at).join(filled, word, "left").withColumn(mask, own)
    return probed, F.coalesce(F.col(bits).bitwiseAND(F.col(mask)) == F.col(mask), F.lit(False))


def maybe_among(rows: DataFrame, keys: DataFrame, digest: Column, key_digest: str) -> DataFrame:
    """The rows whose digest is that of a key of the stored table, and a few others: what a join with it has to shuffle."""
    probed, maybe = _probed(rows, keys, digest, key_digest)
    return probed.filter(maybe).select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, ids: dict[str, str], digest: Column, gone_digest: str) -> DataFrame:
    """The rows that are not in the stored table of keys (an id, null equal to null, and a digest). Rows that miss the
    broadcast filter of the keys pass straight through, and only the others meet the keys in a join."""
    probed, maybe = _probed(rows, gone, digest, gone_digest)
    same = digest == F.col(gone_digest)
    for mine, theirs in ids.items():
        same = same & F.col(mine).eqNullSafe(F.col(theirs))
    return probed.filter(~maybe).select(*rows.columns).unionByName(probed.filter(maybe).select(*rows.columns).join(gone, same, "left_anti"))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the column's bytes pass `most`; a longer text is a slice of its own."""
    size = np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(column).offset :][: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words between ASCII white space of all texts, one after the other, and where each text's begin; null has none."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    values, offsets = cut.flatten(), np.asarray(cut.offsets).astype(np.int64)
    real = np.asarray(pc.not_equal(values, ""))  # white space at a text's ends leaves empty ones
    return values.filter(pa.array(real)).dictionary_encode(), np.concatenate(([0], np.cumsum(real)))[offsets - offsets[0]]


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, free memory goes back to the system, as idle Python workers stay beside the JVM."""
    libc = ctypes.CDLL(None)
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

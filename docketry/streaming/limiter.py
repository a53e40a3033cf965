"""Structured Streaming: file ingestion and stateful limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """New text files of a folder, as (filename, value) rows."""
    return spark.readStream.text(path).select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("filename"), "value")


def fixed_window(events: DataFrame, seconds: int, most: int, late: str | None = None) -> DataFrame:
    """Stream of (key string, ts timestamp) -> (key, opened, hits, allowed) per batch and key: the open window
    starts at the first hit and is reset by the first hit after its end. State: two numbers a key; with `late`, the
    watermark's delay, a key's state goes once its window has passed, else it stays."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, hits = state.get if state.exists else (None, 0)
        stamps = sorted(t for f in frames for t in f["t"].tolist())
        for t in stamps:
            if opened is None or t - opened >= seconds * 1_000_000:
                opened, hits = t, 1
            else:
                hits = min(hits + 1, most + 1)
        state.update((opened, hits))
        if late:
            state.setTimeoutTimestamp(max(opened // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "opened": [opened], "hits": [hits], "allowed": [hits <= most]})

    typed = events.select("key", F.col("ts").cast("timestamp").alias("ts"))
    typed = (typed.withWatermark("ts", late) if late else typed).withColumn("t", F.unix_micros("ts"))
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return typed.groupBy("key").applyInPandasWithState(step, "key string, opened long, hits int, allowed boolean", "opened long, hits int", "update", timeout)


def sliding_counts(events: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """Hits per key and window, finalised once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy("key", F.window("ts", length, slide)).count()


def upsert_batches(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str):
    """Each batch's latest row per key, appended as its own snapshot folder; readers take the latest over all."""
    from docketry.operators.store import latest

    def write(batch: DataFrame, n: int) -> None:
        latest(batch, keys, [version]).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

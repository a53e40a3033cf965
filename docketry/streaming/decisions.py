"""Stateful streams with one answer per event: named limits with a sliding window, and leases of jobs.

Both keep their state in Spark's keyed state (transformWithState), which needs the RocksDB store:
`spark.sql.streaming.stateStore.providerClass`; `use_rocksdb` sets it for a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.operators.timewin import LIMITS, micros

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class _Limiter(StatefulProcessor):
    """Hits that are decided and may still count, and hits that wait for the watermark, both as microseconds.

    An event is decided once the watermark has passed it: then no earlier one can come. A timer stands at the next
    waiting hit or, where none waits, at the end of the last hit's window, when the key's state is cleared."""

    def __init__(self, limits: dict[str, tuple[int, int]]) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "t long")
        self.waiting = handle.getListState("waiting", "t long, id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [(int(t), i) for f in rows for t, i in zip(f["t"].tolist(), f["id"].tolist(), strict=True)]
        if waiting:
            self.waiting.appendList(waiting)
            self._wake(min(t for t, _ in waiting), list(self.handle.listTimers()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        most, seconds = self.limits[key[0]]
        width, now = seconds * 1_000_000, timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        hits = sorted(t for (t,) in self.hits.get()) if self.hits.exists() else []
        due, rest = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        out, first, k = [], 0, 0
        while k < len(due):  # events of one moment count each other
            t, peers = due[k][0], k
            while peers < len(due) and due[peers][0] == t:
                hits.append(t)
                peers += 1
            while hits[first] <= t - width:
                first += 1
            n = len(hits) - first
            wait = max(1, int(seconds - (t - hits[first]) / 1_000_000)) if n >= most else None
            out += [(key[0], key[1], i, t, n, n >= most, wait) for _, i in due[k:peers]]
            k = peers
        hits = [t for t in hits if t > now - width]
        self._store(self.waiting, rest)
        self._store(self.hits, [(t,) for t in hits])
        for x in list(self.handle.listTimers()):  # the one that expires is among them
            self.handle.deleteTimer(x)
        if rest or hits:
            self._wake(rest[0][0] if rest else hits[-1] + width, [])
        frame = pd.DataFrame(out, columns=["scope", "bucket", "id", "t", "hits", "rejected", "retry_after"])
        yield frame.astype({"retry_after": "Int32"})

    def _wake(self, t: int, standing: list[int]) -> None:
        """At the first millisecond at or after t; a key has one timer, the earliest."""
        at = -(-t // 1000)
        if not standing or at < min(standing):
            for x in standing:
                self.handle.deleteTimer(x)
            self.handle.registerTimer(at)

    @staticmethod
    def _store(state, values: list) -> None:
        if values:
            state.put(values)
        else:
            state.clear()

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, scope: str, bucket: str, ts: str, event_id: str, late: str, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """A stream's events of named limits, each with hits, rejected and retry_after as in `timewin.limited`, whatever the
    order in which they come. An event is answered when the watermark, `late` behind the newest, has passed it; those
    that come later than that are left out, as Spark does. State: a key's hits of one window and those that wait."""
    rows = events.filter(F.col(scope).isin(*limits)).withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    rows = rows.select(F.col(scope).alias("scope"), F.col(bucket).cast("string").alias("bucket"), F.col(event_id).cast("string").alias("id"), micros(F.col("__ts")).alias("t"), "__ts")
    out = rows.groupBy("scope", "bucket").transformWithStateInPandas(_Limiter(limits), "scope string, bucket string, id string, t long, hits long, rejected boolean, retry_after int", "append", "eventTime")
    return out.withColumn("t", F.timestamp_micros("t"))


#: Fixed value: after so many attempts a silent job is given up.
ATTEMPTS = 5


class _Leases(StatefulProcessor):
    """One job: status, attempts, the lease's token and when it was last heard of (microseconds)."""

    def __init__(self, silence: int, attempts: int, by_watermark: bool) -> None:
        self.silence, self.attempts, self.by_watermark = silence, attempts, by_watermark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, token string, heard long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = list(self.job.get()) if self.job.exists() else [None, 0, None, 0]
        events = sorted((x for f in rows for x in zip(f["t"].tolist(), f["seq"].tolist(), f["kind"].tolist(), f["token"].tolist(), strict=True)), key=lambda x: x[:2])
        now = self._now(timerValues)
        out = self._silent(key, job, now)  # a job whose time is up is lost before the batch's events
        for t, seq, kind, token in events:
            outcome, job = step(job, kind, token, t if self.by_watermark else now, self.attempts)
            out.append((key[0], seq, kind, outcome, job[0], job[1]))
        self._keep(job)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = list(self.job.get())
        out = self._silent(key, job, self._now(timerValues))
        self._keep(job)
        yield self._frame(out)

    def _now(self, timerValues) -> int:
        return 1000 * (timerValues.getCurrentWatermarkInMs() if self.by_watermark else timerValues.getCurrentProcessingTimeInMs())

    def _silent(self, key: tuple, job: list, now: int) -> list[tuple]:
        if job[0] != "RUNNING" or job[3] + self.silence > now:
            return []
        job[0], job[2] = "DEAD" if job[1] >= self.attempts else "PENDING", None
        return [(key[0], None, "SILENCE", "REQUEUED" if job[0] == "PENDING" else "GIVEN_UP", job[0], job[1])]

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "seq", "kind", "outcome", "status", "attempts"]).astype({"seq": "Int64"})

    def _keep(self, job: list) -> None:
        self.job.update(tuple(job))
        for x in list(self.handle.listTimers()):
            self.handle.deleteTimer(x)
        if job[0] == "RUNNING":
            self.handle.registerTimer(-(-(job[3] + self.silence) // 1000))

    def close(self) -> None:
        pass


def step(job: list, kind: str, token: str | None, t: int, attempts: int = ATTEMPTS) -> tuple[str, list]:
    """What an event does to a job [status, attempts, token, heard], and the job after it."""
    status, tries, lease, heard = job
    if kind == "SUBMIT":
        return ("ACCEPTED", ["PENDING", 0, None, t]) if status is None else ("KNOWN", job)
    if kind == "CLAIM":
        free = status == "PENDING" and tries < attempts
        return ("CLAIMED", ["RUNNING", tries + 1, token, t]) if free else ("REFUSED", job)
    if kind == "CANCEL":
        return ("CANCELLED", ["CANCELLED", tries, None, t]) if status in ("PENDING", "RUNNING") else ("REFUSED", job)
    if kind == "RETRY":
        again = status in ("FAILED", "PENDING") and tries < attempts
        return ("QUEUED", ["PENDING", tries, None, t]) if again else ("REFUSED", job)
    if status != "RUNNING" or token is None or token != lease:
        return "LEASE_LOST", job  # a late result, or a heartbeat of a worker whose job went to another
    if kind == "HEARTBEAT":
        return "HEARD", [status, tries, lease, max(heard, t)]
    if kind in ("COMPLETED", "FAILED"):
        return "PUBLISHED", [kind, tries, None, t]
    return "UNKNOWN_KIND", job


def job_stream(events: DataFrame, silence_seconds: int, late: str = "0 seconds", attempts: int = ATTEMPTS, by_watermark: bool = True) -> DataFrame:
    """A stream of (job_id, seq, kind, token, ts), kind SUBMIT, CLAIM, HEARTBEAT, COMPLETED, FAILED, CANCEL or RETRY ->
    (job_id, seq, kind, outcome, status, attempts): what each did. A batch's events of a job go by (ts, seq), batches as
    they come. A running job that is not heard of for so long goes back to PENDING, or to DEAD at the last attempt (kind
    SILENCE), before the events of the batch that finds it so; the clock is the watermark, or the processing time. A result or heartbeat under another lease than the
    job's present one is LEASE_LOST and changes nothing. State: four values a job."""
    rows = events.withColumn("__ts", F.col("ts").cast("timestamp"))
    if by_watermark:
        rows = rows.withWatermark("__ts", late)
    rows = rows.select(F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), "kind", "token", micros(F.col("__ts")).alias("t"), "__ts")
    return rows.groupBy("job_id").transformWithStateInPandas(_Leases(silence_seconds * 1_000_000, attempts, by_watermark), "job_id string, seq long, kind string, outcome string, status string, attempts int", "append", "eventTime" if by_watermark else "processingTime")

"""Stateful streams against their batch forms: several batches, out of order, with restarts from the checkpoint."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import timewin
from docketry.streaming import decisions

LIMITS = {"click": (2, 86_400), "view": (3, 172_800), "purchase": (1, 3_600)}
EVENTS = "event_id long, user_id long, event_type string, ts timestamp"
JOBS = "job_id string, seq long, kind string, token string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    decisions.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


class Feed:
    """A folder of JSON files, each a batch, and a stream over it that is started anew for each run."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.path, self.schema, self.make = spark, tmp_path, schema, make
        self.n = itertools.count()
        (tmp_path / "in").mkdir()

    def put(self, rows):
        text = "\n".join(self.spark.createDataFrame(rows, self.schema).select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})).toPandas().iloc[:, 0])
        (self.path / "in" / f"{next(self.n):04}.json").write_text(text)

    def run(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.path / "in"))
        query = self.make(source).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return self.spark.read.parquet(str(self.path / "out")).collect()


def test_limits_answer_every_event(rocks, sf, tmp_path):
    spark = rocks
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "ts").filter(F.col("event_type").isin(*LIMITS)).orderBy("ts").limit(400)
    rows = [tuple(r) for r in events.collect()]
    rows += [(10_000 + i, r[1], r[2], r[3]) for i, r in enumerate(rows[::7])]  # events of one moment
    table = spark.createDataFrame(rows, EVENTS)
    want = {r.event_id: (r.hits, r.rejected, r.retry_after) for r in timewin.limited(table, "event_type", "user_id", "ts", LIMITS).collect()}
    rnd = random.Random(8)
    rows.sort(key=lambda r: r[3].timestamp() + rnd.random() * 2.9 * 86_400)  # up to three days late
    feed = Feed(spark, tmp_path, EVENTS, lambda s: decisions.limited_stream(s, "event_type", "user_id", "ts", "event_id", "3 days", LIMITS))
    cut = len(rows) // 3
    feed.put(rows[:cut])
    feed.put(rows[cut : 2 * cut])
    first = feed.run()
    assert 0 < len(first) < len(rows)
    feed.put(rows[2 * cut :])
    feed.put([(-1, -1, "click", max(r[3] for r in rows) + datetime.timedelta(days=40))])
    got = feed.run()  # from the checkpoint
    assert len(got) == len({r.id for r in got}) == len(rows)
    assert {int(r.id): (r.hits, r.rejected, r.retry_after) for r in got} == want
    assert any(w[1] for w in want.values()) and not all(w[1] for w in want.values())


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_leases(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, JOBS, lambda s: decisions.job_stream(s, 60, "0 seconds", attempts=2))
    tick = lambda t: ("clock", t, "HEARTBEAT", None, at(t))  # noqa: E731  moves the watermark
    feed.put([("a", 1, "SUBMIT", None, at(0)), ("a", 2, "CLAIM", "t1", at(1)), ("b", 1, "SUBMIT", None, at(0)), ("b", 2, "CLAIM", "u1", at(1)), ("c", 1, "CLAIM", "v", at(1)), tick(2)])
    feed.put([("b", 3, "HEARTBEAT", "u1", at(50)), tick(70)])  # a falls silent, b doesn't
    first = {(r.job_id, r.seq, r.kind): (r.outcome, r.status, r.attempts) for r in feed.run()}
    assert first[("a", None, "SILENCE")] == ("REQUEUED", "PENDING", 1) and ("b", None, "SILENCE") not in first
    assert first[("c", 1, "CLAIM")] == ("REFUSED", None, 0)
    feed.put([("a", 3, "COMPLETED", "t1", at(75)), ("a", 4, "CLAIM", "t2", at(76)), ("a", 5, "COMPLETED", "t1", at(77)), ("b", 4, "COMPLETED", "u1", at(78)), ("b", 5, "COMPLETED", "u1", at(79)), tick(80)])
    feed.put([tick(300)])
    feed.put([("a", 6, "COMPLETED", "t2", at(301)), ("a", 7, "CLAIM", "t3", at(302)), ("a", 8, "RETRY", None, at(303)), tick(400)])
    got = [(r.job_id, r.seq, r.kind, r.outcome, r.status, r.attempts) for r in feed.run() if r.job_id != "clock"]
    assert sorted(x[1:] for x in got if x[0] == "a" and x[2] != "SILENCE" and x[1] > 2) == [
        (3, "COMPLETED", "LEASE_LOST", "PENDING", 1), (4, "CLAIM", "CLAIMED", "RUNNING", 2), (5, "COMPLETED", "LEASE_LOST", "RUNNING", 2),
        (6, "COMPLETED", "LEASE_LOST", "DEAD", 2), (7, "CLAIM", "REFUSED", "DEAD", 2), (8, "RETRY", "REFUSED", "DEAD", 2),
    ]
    assert sorted(x[3:] for x in got if x[0] == "a" and x[2] == "SILENCE") == [("GIVEN_UP", "DEAD", 2), ("REQUEUED", "PENDING", 1)]
    assert [x[2:] for x in sorted(got, key=str) if x[0] == "b" and x[1] > 3] == [("COMPLETED", "PUBLISHED", "COMPLETED", 1), ("COMPLETED", "LEASE_LOST", "COMPLETED", 1)]


def test_steps_of_a_job():
    job, seen = [None, 0, None, 0], []
    for kind, token in [("HEARTBEAT", "x"), ("SUBMIT", None), ("SUBMIT", None), ("CLAIM", "x"), ("CLAIM", "y"), ("HEARTBEAT", "x"), ("FAILED", "x"), ("CLAIM", "y"), ("RETRY", None), ("CLAIM", "y"), ("CANCEL", None), ("COMPLETED", "y"), ("RETRY", None), ("NAP", None)]:
        outcome, job = decisions.step(job, kind, token, 5)
        seen.append((kind, outcome, job[0]))
    assert [x[1:] for x in seen] == [("LEASE_LOST", None), ("ACCEPTED", "PENDING"), ("KNOWN", "PENDING"), ("CLAIMED", "RUNNING"), ("REFUSED", "RUNNING"), ("HEARD", "RUNNING"), ("PUBLISHED", "FAILED"), ("REFUSED", "FAILED"), ("QUEUED", "PENDING"), ("CLAIMED", "RUNNING"), ("CANCELLED", "CANCELLED"), ("LEASE_LOST", "CANCELLED"), ("REFUSED", "CANCELLED"), ("LEASE_LOST", "CANCELLED")]

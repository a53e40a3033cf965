"""Windows, chains and attempts of hot keys against plain Python."""

import datetime
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docketry.operators import timewin

START = datetime.datetime(2024, 1, 1)


def stamps(rnd, n, span):
    """Half of the rows have one key; many stamps are equal, or just a window apart."""
    rows = []
    for i in range(n):
        t = rnd.choice([rnd.randrange(span), 1_000_000 * rnd.randrange(span // 1_000_000 + 1)])
        rows.append((i, "hot" if rnd.random() < 0.5 else rnd.choice([None, "a", "b"]), rnd.choice(["x", "y"]), t))
    return rows


@pytest.mark.parametrize(("seconds", "span"), [(1, 5_000_000), (3, 900_000_000), (640, 3_000_000_000)])
def test_windows_of_a_hot_key(spark, seconds, span):
    rows = stamps(random.Random(seconds), 700, span)
    frame = spark.createDataFrame([(i, k, s, START + datetime.timedelta(microseconds=t)) for i, k, s, t in rows] + [(-1, "hot", "x", None)], "hits_ long, k string, s string, ts timestamp_ntz").withColumnRenamed("hits_", "id")
    got = {r.id: (r.hits, r.oldest) for r in timewin.windowed(frame, ["k", "s"], "ts", F.lit(seconds), oldest=True).collect()}
    base = (START - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    times = defaultdict(list)
    for _, k, s, t in rows:
        times[k, s].append(t)
    want = {}
    for i, k, s, t in rows:
        inside = [x for x in times[k, s] if t - seconds * 1_000_000 < x <= t]
        want[i] = (len(inside), base + min(inside))
    assert got.pop(-1) == (None, None) and got == want


def test_named_limits_have_their_own_windows(spark):
    rnd = random.Random(1)
    limits = {"x": (2, 1), "y": (3, 50)}
    rows = stamps(rnd, 500, 60_000_000)
    frame = spark.createDataFrame([(i, k, s, START + datetime.timedelta(microseconds=t)) for i, k, s, t in rows] + [(9999, "hot", "other", START)], "id long, k string, s string, ts timestamp_ntz")
    got = {r.id: (r.hits, r.rejected, r.retry_after) for r in timewin.limited(frame, "s", "k", "ts", limits).collect()}
    want = {}
    for i, k, s, t in rows:
        most, seconds = limits[s]
        inside = [x for _, k2, s2, x in rows if (k2, s2) == (k, s) and t - seconds * 1_000_000 < x <= t]
        full = len(inside) >= most
        want[i] = (len(inside), full, max(1, int(seconds - (t - min(inside)) / 1_000_000)) if full else None)
    assert got == want


def test_a_hot_key_is_spread(spark):
    """Half of the events are one key's; no group of the window's shuffle has a twentieth of the rows."""
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 2 else f"k{i}", START + datetime.timedelta(seconds=rnd.randrange(40_000))) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    plan = timewin.sliding_hits(frame, ["k"], "ts", 6400)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert all("chunk" in line or "partial" in plan for line in dealt) and any("chunk" in line for line in dealt)
    cells = frame.select("k", F.floor(timewin.micros(F.col("ts")) / (6400 * 1_000_000 / timewin.CHUNKS)).alias("chunk")).groupBy("k", "chunk").count()
    assert cells.agg(F.max("count")).first()[0] < 200


def sha(prev, *parts):
    return hashlib.sha256("|".join([prev or "", *map(str, parts)]).encode()).hexdigest()


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_chain_of_a_hot_scope(spark, ranges):
    rnd = random.Random(ranges)
    rows, want, last = [], {}, {}
    for i in range(1, 601):
        scope = rnd.choice(["hot", "hot", "hot", "a", "b", f"one{i}"])
        prev = last.get(scope)
        own = sha(prev, i, "x")
        last[scope] = own
        body, first = "x", want.setdefault(scope, [0, None])
        first[0] += 1
        fault = rnd.random()
        if fault < 0.01:
            body, bad = "altered", True
        elif fault < 0.02:
            prev, bad = "broken", True
        elif fault < 0.03:
            own, bad = None, True
        else:
            bad = False
        if len(rows) and rows[-1][0] == scope and rows[-1][4] is None:
            bad = True  # the stored predecessor has no hash
        if bad and first[1] is None:
            first[1] = i
        rows.append((scope, i, body, prev, own))
    # a row is also broken where its stored predecessor, of any distance, lost its hash
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for scope, rs in by.items():
        breaks = [r[1] for n, r in enumerate(rs) if r[4] != sha(r[3], r[1], r[2]) or (r[3] or "") != ((rs[n - 1][4] or "") if n else "")]
        assert min(breaks, default=None) is None or want[scope][1] is not None
        want[scope][1] = min(breaks, default=None)
    frame = spark.createDataFrame(rows, "scope string, i long, body string, prev_hash string, event_hash string").repartition(5)
    got = {r.scope: [r.events, r.first_break] for r in timewin.verify_chain(frame, "scope", "i", ["i", "body"], ranges).collect()}
    assert got == want and any(v[1] for v in want.values()) and got["hot"][0] > 200
    assert timewin.verify_chain(frame.limit(0), "scope", "i", ["i", "body"], ranges).count() == 0


def test_attempts_of_a_hot_challenge(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", None, *"abcdefgh"]), i, rnd.random() < 0.15) for i in range(500)]
    want, seen = {}, defaultdict(list)
    for k, i, ok in rows:
        tries = seen[k]
        want[i] = "CONSUMED" if any(tries) else "EXHAUSTED" if len(tries) >= 5 else "ACCEPTED" if ok else "WRONG"
        tries.append(ok)
    frame = spark.createDataFrame(rows, "k string, i long, ok boolean").repartition(4)
    assert {r.i: r.result for r in timewin.attempts_left(frame, "k", "i").collect()} == want


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned as sorted ones and turn into broadcasts at run time, in as many tasks, as with large tables."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10MB", "adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    yield
    for k in conf:
        spark.conf.unset(f"spark.sql.{k}")


def test_chains_stay_whole_under_a_late_broadcast(spark, late_broadcast):
    rnd = random.Random(5)
    rows = [(f"u{rnd.randrange(30)}", i, rnd.choice("xy")) for i in range(900)]
    rnd.shuffle(rows)
    known = spark.createDataFrame([("u0", "abc")] + [(f"u{i}", None) for i in range(1, 29)], "k string, event_hash string")
    got = timewin.append_chain(known, spark.createDataFrame(rows, "k string, id int, body string"), "k", "id", ["id", "body"]).collect()
    want, last = [], {"u0": "abc"}
    for k, i, body in sorted(rows, key=lambda r: r[1]):
        own = hashlib.sha256(f"{last.get(k) or ''}|{i}|{body}".encode()).hexdigest()
        want.append((k, i, last.get(k), own))
        last[k] = own
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_stored_chains_verify_under_a_late_broadcast(spark, late_broadcast, tmp_path):
    """The registered query: its chains are made and verified in one plan."""
    from docketry.plans import catalog

    spark.range(4000).selectExpr("id AS event_id", "id * 7 % 40 AS user_id", "if(id % 3 = 0, 'view', 'click') AS event_type").write.parquet(f"file://{tmp_path}/events.parquet")
    got = {r.user_id: (r.events, r.first_break) for r in catalog.QUERIES["chain_verified"](spark, f"file://{tmp_path}").collect()}
    ids = defaultdict(list)
    for i in range(4000):
        ids[i * 7 % 40].append(i)
    assert got == {u: (100, min((i for i in x if i % 97 == 3 or (i > x[0] and i % 89 == 5)), default=None)) for u, x in ids.items()}

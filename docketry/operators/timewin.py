"""Time and order: windows over microseconds, ordered folds, hash chains, alerts, stale jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


CHUNKS = 64  # of a window's length


def windowed(events: DataFrame, keys: Sequence[str], ts: str, seconds: Column, oldest: bool = False) -> DataFrame:
    """Add `hits`, the key's events in the window that ends at each event and is open at its start, and if asked for
    `oldest`, the microsecond of the first of them. seconds may depend on the keys.

    A key's timeline is cut into chunks of a 64th of the window, so that no task holds a key. The window of an event in
    chunk c is what chunk c has up to it, all of the chunks between, and of chunk c - 64 what comes after the window's
    start. An event therefore goes to two chunks: to its own and, moved on by a window's length, to the one whose windows
    start around it; there a running sum over both counts it in or out. Counts of whole chunks are aggregated before the
    shuffle and summed over at most 64. An event without a time has no hits."""
    rows = events.withColumns({"__t": micros(F.col(ts)), "__w": seconds.cast("long") * 1_000_000})
    chunk = lambda at: F.expr(f"({at} - pmod({at}, __w div {CHUNKS})) div (__w div {CHUNKS})")
    row = F.struct(*events.columns)
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("__t").alias("at"), row.alias("row")), F.struct(F.lit(-1).alias("side"), (F.col("__t") + F.col("__w")).alias("at"), F.lit(None).alias("row")))
    known = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    sent = rows.filter("__t is not null").select(*known, "__w", F.explode(sides).alias("s")).select(*names, "__w", "s.*").withColumn("chunk", chunk("at"))
    cell = Window.partitionBy(*names, "chunk")
    seen = sent.withColumn("running", F.sum("side").over(cell.orderBy("at")))
    if oldest:
        own, moved = F.when(F.col("side") == 1, F.col("at")), F.when(F.col("side") == -1, F.col("at") - F.col("__w"))
        seen = seen.withColumns({"own_first": F.min(own).over(cell.orderBy("at")), "start_first": F.min(moved).over(cell.orderBy(-F.col("at")).rangeBetween(Window.unboundedPreceding, -1))})
    each = rows.filter("__t is not null").select(*known, chunk("__t").alias("chunk"), "__t").groupBy(*names, "chunk").agg(F.count("*").alias("n"), F.min("__t").alias("first"))
    past = Window.partitionBy(*names).orderBy("chunk")
    whole = each.select(*(F.col(x).alias(f"{x}_") for x in names), F.col("chunk").alias("chunk_"), F.sum("n").over(past.rangeBetween(-CHUNKS, -1)).alias("before"), F.min("first").over(past.rangeBetween(1 - CHUNKS, -1)).alias("between_first"))
    same = F.col("chunk") == F.col("chunk_")
    for x in names:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}_"))
    found = seen.filter("side = 1").join(whole, same)
    out = {"hits": F.coalesce("before", F.lit(0)) + F.col("running")}
    if oldest:
        out["oldest"] = F.coalesce("start_first", "between_first", "own_first")
    done = found.select("row.*", *(v.alias(k) for k, v in out.items()))
    return done.unionByName(rows.filter("__t is null").select(*events.columns, *(F.lit(None).cast("long").alias(k) for k in out)))


def sliding_hits(events: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Hits of the key in the window that ends at each event and is open at its start."""
    return windowed(events, keys, ts, F.lit(seconds))


def fixed_windows(events: DataFrame, key: str, ts: str, order: str, seconds: int, most: int) -> DataFrame:
    """A window opens at a key's first hit and again at the first hit after it has expired; hits are capped at
    most + 1. One pass over each sorted partition with the open window as the only state, so a key of any size
    takes constant memory."""
    width = seconds * 1_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, opened, hits = object(), 0, 0
        for f in frames:
            starts, counts = [], []
            for k, t in zip(f["k"].tolist(), f["t"].tolist(), strict=True):
                if k != at or t - opened >= width:
                    at, opened, hits = k, t, 1
                else:
                    hits = min(hits + 1, most + 1)
                starts.append(opened)
                counts.append(hits)
            yield pd.DataFrame({"k": f["k"], "o": f["o"], "opened": starts, "hits": counts, "allowed": [h <= most for h in counts]})

    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), micros(F.col(ts)).alias("t"))
    rows = rows.repartition("k").sortWithinPartitions("k", "t", "o")
    types = dict(rows.dtypes)
    out = rows.mapInPandas(run, f"k {types['k']}, o {types['o']}, opened long, hits int, allowed boolean")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.timestamp_micros("opened").alias("opened"), "hits", "allowed")


def chain_hash(prev: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(prev, F.lit("")), *(p.cast("string") for p in parts)), 256)


RANGES = 64


def verify_chain(rows: DataFrame, scope: str, order: str, parts: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """The first broken row per scope. Each row is checked against its stored predecessor, so rows verify in parallel.

    The order is cut into ranges of about as many rows (by approximate percentiles, one aggregate), which all scopes share:
    a scope of any size is spread over them, and only one of few rows has them to itself. Inside its range a row has its
    predecessor by a window; a range hands its last hash on to the scope's next range by the ranges' numbers."""
    cuts = rows.agg(F.percentile_approx(F.col(order), [i / ranges for i in range(1, ranges)], 100 * ranges).alias("__cuts"))
    placed = rows.join(F.broadcast(cuts)).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order))), F.lit(0))).drop("__cuts")
    w = Window.partitionBy(scope, "__range").orderBy(order)
    before, prev = F.coalesce("__before", F.lit("")), F.coalesce("prev_hash", F.lit(""))
    wrong = ~F.col("event_hash").eqNullSafe(chain_hash(F.col("prev_hash"), *map(F.col, parts)))
    seen = placed.withColumns({"__before": F.lag("event_hash").over(w), "__first": F.row_number().over(w) == 1})
    bad = wrong | (~F.col("__first") & (prev != before))
    cells = seen.groupBy(scope, "__range").agg(
        F.count("*").alias("n"),
        F.min(F.when(bad, F.col(order))).alias("bad"),
        F.min(F.when(F.col("__first"), F.struct(F.col(order).alias("order"), prev.alias("prev")))).alias("head"),
        F.max(F.struct(F.col(order).alias("order"), F.coalesce("event_hash", F.lit("")).alias("hash"))).alias("tail"),
    )
    handed = F.coalesce(F.lag("tail.hash").over(Window.partitionBy(scope).orderBy("__range")), F.lit(""))
    joint = cells.withColumn("bad", F.least("bad", F.when(handed != F.col("head.prev"), F.col("head.order"))))
    return joint.groupBy(scope).agg(F.sum("n").alias("events"), F.min("bad").alias("first_break"))


def due_alerts(items: DataFrame, due: str, today: Column, days: int = 3) -> DataFrame:
    """Open items overdue or due within some days; dates that don't parse are skipped."""
    d = F.datediff(F.to_date(F.try_to_timestamp(F.col(due).cast("string"))), today)
    out = items.withColumn("days_left", d).filter(F.col("days_left") <= days)
    return out.withColumn("type", F.when(F.col("days_left") < 0, "REMEDIATION_OVERDUE").otherwise("REMEDIATION_DUE")).withColumn("severity", F.when(F.col("days_left") < 0, "danger").otherwise("warning"))


def requeue_stale(jobs: DataFrame, now: Column, max_age: str, attempts: int = 5) -> DataFrame:
    stale = (F.col("status") == "RUNNING") & ~F.col("cancel_requested") & (F.col("updated_at") < now - F.expr(max_age))
    return jobs.withColumn("status", F.when(stale, F.when(F.col("attempts") >= attempts, "DEAD").otherwise("PENDING")).otherwise(F.col("status")))


def fence(results: DataFrame, leases: DataFrame) -> DataFrame:
    """Only results under the job's present lease count."""
    return results.join(leases.select("job_id", "lease_token"), ["job_id", "lease_token"], "left_semi")


def expired_runs(runs: DataFrame, settings: DataFrame, now: Column) -> DataFrame:
    """Runs past their workspace's retention (365 days where none is set)."""
    days = F.coalesce(F.col("retention_days"), F.lit(365))
    return runs.join(settings, "workspace_id", "left").filter(F.col("created_at") < now - F.make_dt_interval(days))


def append_chain(last: DataFrame, rows: DataFrame, scope: str, order: str, parts: Sequence[str]) -> DataFrame:
    """New rows with prev_hash and event_hash, after each scope's last hash (scope, event_hash). A hash needs the one
    before it, so a scope's rows are folded in order, one task a scope, with one hash as the only state.

    They are dealt by a hash of the scope: a deal by the scope itself is left out where the join before has dealt the rows
    so, and when that join turns into a broadcast at run time, its rows are read as they lay, a scope in many tasks."""
    types = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, prev = object(), None
        for f in frames:
            before, own = [], []
            for k, start, body in zip(f["k"].tolist(), f["start"].tolist(), f["body"].tolist(), strict=True):
                if k != at:
                    at, prev = k, start
                before.append(prev)
                prev = hashlib.sha256(f"{prev or ''}|{body}".encode()).hexdigest()
                own.append(prev)
            yield pd.DataFrame({"k": f["k"], "o": f["o"], "prev_hash": before, "event_hash": own})

    body = F.concat_ws("|", *(F.col(p).cast("string") for p in parts))
    known = last.select(scope, F.col("event_hash").alias("start"))
    each = rows.join(known, scope, "left").select(F.col(scope).alias("k"), F.col(order).alias("o"), "start", body.alias("body"))
    done = each.repartition(F.xxhash64("k")).sortWithinPartitions("k", "o").mapInPandas(run, f"k {types[scope]}, o {types[order]}, prev_hash string, event_hash string")
    return done.withColumnsRenamed({"k": scope, "o": order})


#: What a caller may do how often in how many seconds.
LIMITS = {"login": (5, 900), "mfa": (8, 300), "token-auth": (20, 300), "write": (240, 60), "export": (30, 300)}


def limited(events: DataFrame, scope: str, bucket: str, ts: str, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Each event of a named limit with the hits in its window, whether it is rejected (the window is full with it),
    and then after how many seconds the oldest hit leaves. All limits share one shuffle, see `windowed`."""
    by_scope = lambda i: F.coalesce(*(F.when(F.col(scope) == name, F.lit(limit[i])) for name, limit in limits.items()))
    rows = windowed(events.filter(F.col(scope).isin(*limits)), [scope, bucket], ts, by_scope(1), oldest=True)
    rejected = F.col("hits") >= by_scope(0)
    wait = F.greatest(F.lit(1), F.floor(by_scope(1) - (micros(F.col(ts)) - F.col("oldest")) / 1_000_000).cast("int"))
    return rows.withColumns({"rejected": rejected, "retry_after": F.when(rejected, wait)}).drop("oldest")


def cooled(events: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """Sends that are let through: the first, and each that comes `seconds` or more after the last one let through.
    It is the opening hit of a fixed window."""
    rows = fixed_windows(events, key, ts, order, seconds, 1)
    return rows.withColumn("sent", F.col("hits") == 1)


def attempts_left(tries: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """tries (key, order, ok) of a challenge: what each gives. The first success within `most` tries consumes it.

    A challenge is two values: the order of its first success and that of its last try that counts. Both come from
    aggregates that combine before the shuffle, so a challenge of any size is spread over the tasks."""
    first = tries.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col(order))).alias("__ok"))
    w = Window.partitionBy(key).orderBy(order)
    last = tries.select(key, order).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).groupBy(key).agg(F.max(order).alias("__last"))
    ends = first.withColumnRenamed(key, "__key").unionByName(last.withColumnRenamed(key, "__key"), allowMissingColumns=True).groupBy("__key").agg(F.min("__ok").alias("__ok"), F.max("__last").alias("__last"))
    seen = tries.join(ends, F.col(key).eqNullSafe(F.col("__key")))
    result = F.when(F.col("__ok") < F.col(order), "CONSUMED").when(F.col(order) > F.col("__last"), "EXHAUSTED").when(F.col("ok"), "ACCEPTED").otherwise("WRONG")
    return seen.withColumn("result", result).drop("__key", "__ok", "__last")


def due_message(days_left: Column, title: Column) -> Column:
    late = F.format_string("%s is overdue by %d days", title, -days_left)
    return F.when(days_left < 0, late).when(days_left == 0, F.format_string("%s is due today", title)).otherwise(F.format_string("%s is due in %d days", title, days_left))


def age_hours(at: Column, now: Column) -> Column:
    return F.round((micros(now) - micros(at)) / 3_600_000_000, 2)


def job_guard(old: Column, new: Column) -> Column:
    """A cancelled job stays cancelled."""
    return F.when((old != "CANCELLED") | (new == "CANCELLED"), new).otherwise(old)

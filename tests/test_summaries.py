"""Percentiles, ledgers and the fixed window's state against plain Python."""

import datetime
import json
import os
import random
import statistics

import pytest

from docketry.operators import cohorts
from docketry.sources import files
from docketry.streaming import limiter


@pytest.mark.parametrize("width", [0.01, 7.0])
def test_percentiles_by_ranges(spark, width):
    rnd = random.Random(3)
    rows = [(rnd.choice("abcdef"), rnd.choice([None, rnd.random(), rnd.randrange(5) / 4]), rnd.choice([None, float(rnd.randrange(400))])) for _ in range(150)]
    rows += [("one", 0.25, 3.0), ("none", None, None), ("two", 0.1, 1.0), ("two", 0.3, 2.0)]
    frame = spark.createDataFrame([(m, c, lat, 0.1, 1, 2, "p") for m, c, lat in rows], "mode string, cer double, latency_ms double, wer double, field_hits int, field_total int, provider string")
    hard = {r["mode"]: (r["median"], r["p95"], r["hard"], r["pages"]) for r in cohorts.hard_pages(frame, 0.5, "mode", width=width).collect()}
    late = {r["mode"]: r["p95_latency_ms"] for r in cohorts.by_mode(frame, "mode", width * 100).collect()}
    for m in {r[0] for r in rows}:
        cers, lats = sorted(c for k, c, _ in rows if k == m and c is not None), sorted(x for k, _, x in rows if k == m and x is not None)
        want = (statistics.median(cers), cers[max(0, int(len(cers) * 0.95) - 1)]) if cers else (None, None)
        assert hard[m] == (*want, sum(c > 0.5 for c in cers), sum(k == m for k, _, _ in rows))
        assert late[m] == (lats[int(0.95 * (len(lats) - 1))] if lats else None)


def test_ledger_append_is_all_or_nothing(spark, tmp_path):
    columns = ["task_id", "received_at", "due", "human_confirmation", "payment_signal"]
    path = f"file://{tmp_path}/ledger"
    make = lambda *rows: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    good = make(("t1", "2024-05-01T10:00:00Z", "", " Confirmed", "yes"), ("t2", "2024-05-01T10:00:00+08:00", "2024-06-01", None, " "))
    put = lambda df: files.append_ledger(df, path, columns, "task_id", ["received_at"], ["due"])
    assert tuple(cohorts.ledger_summary(put(good)).first()) == (2, 1, 1)
    for bad in (("", "2024-05-01", "", "", ""), (None, "2024-05-01", "", "", ""), ("t3", "soon", "", "", ""), ("t3", None, "", "", ""), ("t3", "2024-05-01", "tomorrow", "", "")):
        with pytest.raises(ValueError, match="lacks"):
            put(make(("ok", "2024-05-01", None, "", ""), bad))
    assert files.read_ledger(spark, path, columns).count() == 2
    assert tuple(cohorts.ledger_summary(put(make(("t4", "2024-05-02", None, "confirmed", None)))).first()) == (3, 2, 1)


def test_fixed_window_forgets_keys(spark, tmp_path):
    """With a watermark a key's state goes when its window has passed; what it gives stays the same."""
    start = datetime.datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    batches = [[("a", 0), ("a", 3), ("b", 1)], [("a", 9), ("c", 40)], [("c", 41), ("a", 42)], [("z", 500)]]
    for n, rows in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"key": k, "ts": (start + datetime.timedelta(seconds=s)).isoformat() + "Z"}) for k, s in rows))
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # the order in which they are read
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    out = limiter.fixed_window(stream, 10, 2, late="5 seconds")
    query = out.writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(200)
    base = int(start.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)
    got = sorted((r.key, (r.opened - base) // 1_000_000, r.hits, r.allowed) for r in spark.table("windows").collect())
    assert got == [("a", 0, 2, True), ("a", 0, 3, False), ("a", 42, 1, True), ("b", 1, 1, True), ("c", 40, 1, True), ("c", 40, 2, True), ("z", 500, 1, True)]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1

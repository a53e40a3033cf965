"""Box join, trigram search, digests of snapshots and bitmap rollups against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.operators import boxes, indexes, rules, store

BOX = "page int, item int, x0 double, y0 double, x1 double, y1 double"


def random_boxes(rnd, n, pages):
    out = []
    for i in range(n):
        x, y = rnd.uniform(-50, 50), rnd.choice([rnd.uniform(-50, 50), rnd.randrange(-5, 5)])
        w, h = (rnd.choice([0, 0.001, 1, 4, 16, rnd.uniform(0, 3), rnd.uniform(0, 90)]) for _ in range(2))
        out.append((rnd.choice(pages), i, x, float(y), rnd.choice([x + w, x + w, x - w]), float(y + h)))
    return out


def overlap(a, b):
    return a[0] is not None and a[0] == b[0] and all(None not in (a[k], b[k], a[k + 2], b[k + 2]) and a[k] < b[k + 2] and b[k] < a[k + 2] for k in (2, 3))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boxes_that_meet(spark, seed):
    rnd = random.Random(seed)
    a, b = random_boxes(rnd, 160, [1, 1, 1, 2, None]), random_boxes(rnd, 150, [1, 2, 3])
    b += [(1, 900, None, 0.0, 1.0, 1.0), (1, 901, 0.0, 0.0, 1e9, 1e9), (2, 902, -1e7, -1e7, 1e7, 1e7), (1, 903, float("nan"), 0.0, 1.0, 1.0)]
    got = sorted((r.a.item, r.b.item) for r in boxes.met(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), "page", [("x0", "x1"), ("y0", "y1")]).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if overlap(x, y)) and got
    line = boxes.met(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), "page", [("y0", "y1")])
    assert line.count() == sum(x[0] == y[0] and x[3] < y[5] and y[3] < x[5] for x in a for y in b)
    assert boxes.met(spark.createDataFrame(a, BOX).limit(0), spark.createDataFrame(b, BOX), "page", [("x0", "x1")]).count() == 0


def test_a_page_of_many_boxes(spark):
    """100,000 boxes on one page: the join makes rows by the boxes that share a bin, not by all pairs."""
    cells = spark.range(100_000).selectExpr("1 AS page", "cast(id AS int) AS item", "double(id % 400) * 10 AS x0", "double(id div 400) * 10 AS y0")
    cells = cells.selectExpr("*", "x0 + 11 AS x1", "y0 + 9 AS y1")  # each touches its right neighbour alone
    assert boxes.met(cells, cells, "page", [("x0", "x1"), ("y0", "y1")]).filter("a.item < b.item").count() == 250 * 399
    spans = cells.selectExpr("page", "item", "item * 1.0 AS lo", "item + 1.5 AS hi")
    assert rules.overlaps(spans, spans, "page", "item").agg(F.sum("touching"), F.sum("overlap")).first()[:] == (2 * 99_999, 99_999.0)


@pytest.mark.parametrize("needle", ["abc", "ABCA", "b", "", "ab", "zzz", "é日本", "a b", "İ", "aaaaaa", "c\nb"])
def test_search(spark, tmp_path_factory, needle):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, "", "".join(rnd.choice("abcABC é日本\n") for _ in range(rnd.randint(0, 40)))]), rnd.choice(["x", None, "abc", "İb"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    path = f"file://{tmp_path_factory.getbasetemp()}/grams"
    if not (tmp_path_factory.getbasetemp() / "grams").exists():
        indexes.write_trigrams(df, "id", ["a", "b"], path)
    got = indexes.search_trigrams(df, "id", ["a", "b"], needle, path)
    assert sorted(got.collect(), key=str) == sorted(store.search(df, ["a", "b"], needle).collect(), key=str)
    if len(needle) >= 3:
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        assert re.search(r"PartitionFilters: \[.*part#", plan) and re.search(r"PushedFilters: \[.*gram", plan)


def test_search_skips_files(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "concat('row ', sha2(string(id), 256)) AS a")
    needle = hashlib.sha256(b"17").hexdigest()[10:14]
    path = f"file://{tmp_path}/grams"
    indexes.write_trigrams(df, "id", ["a"], path)
    every = len(list((tmp_path / "grams").glob("part=*/*.parquet")))
    read = indexes.search_trigrams(df, "id", ["a"], needle, path)
    postings = spark.read.parquet(path).filter(F.col("part").isin([indexes._part(F.lit(g), indexes.PARTS) for g in (needle[:3], needle[1:])]))
    assert len(postings.inputFiles()) == every  # as Spark lists them; what is scanned is less
    assert postings.select(F.input_file_name()).distinct().count() <= every / 8
    assert read.count() == store.search(df, ["a"], needle).count() > 0


def test_snapshots(spark, tmp_path):
    rnd = random.Random(9)
    old = {(i, rnd.choice("ab")): rnd.choice([None, "x", "y"]) for i in range(600)}
    new = dict(old)
    for k in rnd.sample(sorted(old), 5):
        new[k] = "changed"
    for k in rnd.sample(sorted(old), 4):
        del new[k]
    new[9999, "z"] = None
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "a long, b string, v string")
    paths = [f"file://{tmp_path}/{n}" for n in ("new", "old", "again", "one")]
    for p, d in zip(paths, (new, old, dict(reversed(old.items())), old | {(5, next(b for a, b in old if a == 5)): "only"}), strict=True):
        indexes.write_snapshot(frame(d).repartition(3), ["a", "b"], p)
    got = indexes.diff_snapshots(spark, paths[0], paths[1], ["a", "b"], "v")
    want = store.diff(frame(new), frame(old), ["a", "b"], "v")
    assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 0
    assert indexes.changed_leaves(spark, paths[2], paths[1]) == [] and indexes.diff_snapshots(spark, paths[2], paths[1], ["a", "b"], "v").count() == 0
    assert len(indexes.changed_leaves(spark, paths[3], paths[1])) == 1  # a row's change reads one leaf
    assert indexes.diff_snapshots(spark, paths[3], paths[1], ["a", "b"], "v").count() == 1


def test_rollups(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), rnd.choice([None, 0, 1, 32767, 32768, 32769, 10**12, -5, rnd.randrange(200)])) for _ in range(900)]
    table = indexes.bitmaps(spark.createDataFrame(rows, "k string, m string, n long").repartition(4), ["k", "m"], "n")
    for keys in ((), ("k",), ("m",), ("k", "m")):
        want = {}
        for r in rows:
            numbers, count = want.setdefault(tuple(r["km".index(c)] for c in keys), (set(), [0]))
            count[0] += 1
            if r[2] is not None:
                numbers.add(r[2])
        got = {tuple(r[c] for c in keys): (r.n, r.instances) for r in indexes.distinct_counts(table, *keys).collect()}
        assert got == {k: (len(s), c[0]) for k, (s, c) in want.items()}


def brute_totals(rows):
    out = {}
    for x in rows:
        for y in rows:
            if None not in (x[1], y[1]) and x[1] < y[1] and overlap(x, y):
                pairs, items, area = out.setdefault(x[0], [0, set(), 0.0])
                out[x[0]] = [pairs + 1, items | {x[1]}, area + max(0, min(x[4], y[4]) - max(x[2], y[2])) * max(0, min(x[5], y[5]) - max(x[3], y[3]))]
    return {p: (n, len(items), round(area, 6)) for p, (n, items, area) in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_totals_of_pairs(spark, seed, monkeypatch):
    """Items and whole boxes that stand several times, flat and inverted boxes, boxes of all sizes and without a bound."""
    monkeypatch.setattr(boxes, "BLOCK", 64)
    rnd = random.Random(seed)
    rows = random_boxes(rnd, 150, [1, 1, 1, 2, 3, None])
    rows = [(p, rnd.choice([i, i, i % 40, None]), *ends) for p, i, *ends in rows + rows[:60]] + [r for r in rows[:30] for _ in range(2)]
    rows += [(1, 900, None, 0.0, 1.0, 1.0), (1, 901, 0.0, 0.0, 1e9, 1e9), (2, 902, -1e7, -1e7, 1e7, 1e7), (1, 903, float("nan"), 0.0, 1.0, 1.0), (4, 1, 0.0, 0.0, 1.0, 1.0), (4, 1, 0.5, 0.0, 1.0, 1.0), (5, 1, 0.0, 0.0, 1.0, 1.0), (5, 2, 1.0, 0.0, 2.0, 1.0)]
    got = {r.page: (r.pairs, r["items"], round(r.area, 6)) for r in boxes.totals(spark.createDataFrame(rows, BOX), "page", "item", [("x0", "x1"), ("y0", "y1")]).collect()}
    want = brute_totals(rows)
    assert {p: x[:2] for p, x in got.items()} == {p: x[:2] for p, x in want.items()} and all(got[p][2] == pytest.approx(x[2]) for p, x in want.items()) and 4 not in got


def test_totals_of_a_crowded_page(spark):
    """200,000 boxes that nearly all overlap: the pairs, ten billion and more, are no rows."""
    rows = spark.range(200_000).selectExpr("1 AS page", "id AS item", "double(id % 100) / 1000 AS x0", "0.0 AS y0", "1.0 AS x1", "double(id % 7 + 1) AS y1")
    (r,) = boxes.totals(rows, "page", "item", [("x0", "x1"), ("y0", "y1")]).collect()
    assert (r.pairs, r["items"]) == (200_000 * 199_999 // 2, 199_999)

"""Operator 13 against DuckDB and brute force."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from docketry.llm import phrases

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, support=30, most=4, top=2000, contained=80):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        best = {}
        for p, a in found.items():
            best[p] = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
        longer = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        left = [(-best[p][0], -a, " ".join(p).encode(), p) for p, a in found.items() if not 100 * longer[p] >= contained * a]
        out += [(lang, k, " ".join(p), -a, *best[p][2:], totals[lang], -s) for k, (s, a, _, p) in enumerate(sorted(left)[:top], 1)]
    return sorted(out)


def test_query_and_oracle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()
    got = sorted(map(tuple, phrases.op13_phrases(spark, sf).collect()))
    assert got == expected(docs) and got
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert sorted(con.execute(phrases.ORACLE).fetchall()) == got


def rows_of(seed, n=300):
    rnd = random.Random(seed)
    words = ["the", "of", "Und", "é", "ß", "a b", "x\x1cy", "İ", *"abcdefgh"]
    return [(rnd.choice(["en", "en", "en", None, "und", "fr"]), rnd.choice([None, "", *[None] * (i % 2)]) if rnd.random() < 0.05 else "".join(rnd.choice(words) + rnd.choice([" "] * 9 + ["\t", "  ", ". ", "\n", ",", "\x0b", "!?"]) for _ in range(rnd.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize(("parts", "places", "bits"), [(1, 1 << 21, 1 << 27), (7, 200, 1 << 27), (24, 1, 1 << 12)])
def test_brute_force(spark, monkeypatch, parts, places, bits):
    """One shard at the whole support, many shards at a support of one and ranges, and a filter that is full."""
    monkeypatch.setattr(phrases, "RANGE", 1 << 21 if parts == 1 else 300)
    monkeypatch.setattr(phrases, "PLACES", places)
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    rows = rows_of(parts)
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "lang string, text string, n int, phrase string").repartition(parts)
    for support, most, top in ((5, 4, 2000), (3, 3, 7), (40, 2, 50)):
        assert sorted(map(tuple, phrases.collocations(docs, support, most, top).collect())) == expected(rows, support, most, top)


def test_packed_lists():
    rng = np.random.default_rng(1)
    slots = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    gains = rng.integers(1, 1 << 40, len(slots))
    for n in (0, 1, len(slots)):
        got = phrases.unpacked(phrases.packed(slots[:n], gains[:n]))
        assert (got[0] == slots[:n]).all() and (got[1] == gains[:n]).all() and len(got[0]) == n
    assert len(phrases.packed(np.arange(0, 300_000, 3, dtype=np.uint64), np.ones(100_000, np.int64))) < 2_000


def test_local_support_is_lowered_in_proportion(spark):
    """A phrase that stands in one shard only, and one that is spread thinly over all."""
    rows = [("en", "rare pair. ")] * 30 + [("en", "thin line. " + "x. " * 50)] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").repartitionByRange(12, "text")
    assert [r.phrase for r in phrases.collocations(docs).orderBy("rank").collect()] == ["rare pair", "thin line"]
    assert phrases.collocations(spark.createDataFrame(rows[1:], "lang string, text string")).count() == 1


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = [(r[2], r[1]) for r in odd_rows]
    assert sorted(map(tuple, phrases.collocations(odd, 2).collect())) == expected(rows, 2)
    assert phrases.collocations(empty).count() == 0
    with pytest.raises(ValueError, match="two words"):
        phrases.collocations(odd, max_words=1)


def test_numbers_past_64_bits(spark):
    df = spark.sql("SELECT 6000000000000000000L AS a, 9000000000000000000L AS l, 9000000000000000000L AS r")
    assert df.selectExpr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r) AS s").first()[0] == 666666

"""Operator 11 against a brute-force search of runs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(w, min_length=6, exponent=4):
    """(start, length, period), each period's stretches one by one."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, exponent * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    w = planted(doc_id, WORD.findall(text or ""))
    found = runs_of(w)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    s, n, q = best or (None,) * 3
    return doc_id, len(found), s, n, q, best and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("octet_length(text) < 6000").collect()  # the brute force takes the square of a text's words
    want = {r[0]: expected(*r) for r in docs}
    got = {r[0]: tuple(r) for r in periodic_runs.op11_periodic_runs(spark, sf).collect()}
    assert {k: got[k] for k in want} == want and any(r[1] for r in want.values())
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize(("min_length", "exponent"), [(6, 4), (2, 2), (5, 3)])
def test_random_texts(min_length, exponent):
    rnd = random.Random(min_length)
    for _ in range(60):
        docs = []
        for _ in range(rnd.randint(0, 6)):
            n, kinds = rnd.randint(0, 150), rnd.choice([1, 2, 3, 20])
            w = [rnd.choice("abcdefghijklmnopqrst"[:kinds]) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 3))
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(w)
        got = periodic_runs._slice(pa.array(range(len(docs)), pa.int64()), pa.array([" ".join(w) for w in docs], pa.string()), None, min_length, exponent)
        for w, found, text in zip(docs, got[2].to_pylist(), got[3].to_pylist(), strict=True):
            assert [(r["start"], r["length"], r["period"]) for r in found] == runs_of(w, min_length, exponent)
            assert text == collapsed(w, runs_of(w, min_length, exponent))


def test_extensions():
    rnd = np.random.default_rng(2)
    words = np.concatenate((rnd.integers(0, 2, 300), [9], np.tile(rnd.integers(0, 3, 70), 6), [10], np.zeros(200, int), [11]))
    alike = periodic_runs.Extensions(words)
    i, j = rnd.integers(0, len(words), (2, 4000))
    i, j = i[i != j], j[i != j]
    want = [next(t for t in range(len(words)) if max(a, b) + t >= len(words) or words[a + t] != words[b + t]) for a, b in zip(i, j, strict=True)]
    assert alike(i, j).tolist() == want


def test_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in periodic_runs.periodic_runs(odd).collect()), key=str)
    words = [(r[0], WORD.findall(r[1] or "")) for r in odd_rows]
    short = [(i, w) for i, w in words if len(w) < 1000]
    want = sorted(((i, len(w), runs_of(w), collapsed(w, runs_of(w))) for i, w in short), key=str)
    assert [g for g in got if g[1] < 1000] == want and len(got) == len(odd_rows)
    assert periodic_runs.periodic_runs(empty).count() == 0
    once = spark.createDataFrame([(1, "ab " * 50_000 + "end", 1), (None, "x\ty\n" * 8, 2)], "doc_id long, text string, runs int")
    assert {(r[0], str(r[2])) for r in periodic_runs.periodic_runs(once).collect()} == {(1, "[Row(start=0, length=50000, period=1)]"), (None, "[Row(start=0, length=16, period=2)]")}
    with pytest.raises(ValueError, match="twice"):
        periodic_runs.periodic_runs(once, exponent=1)

"""Operator 11, periodic run detection by a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(min_length, exponent * q) that no neighbouring word extends. The texts of a slice lie one after the other, as one
array of word numbers, each text ended by a number of its own.

Grid: a run of period q holds two neighbouring points of the grid 0, q, 2q, ... of its text, so the words after each
such pair of points are compared, for every q: n + n/2 + n/3 + ... pairs. Most differ within a few words. For the texts
that hold a pair left over, the longest common extension of two places is taken from a difference cover: only suffixes at
places whose remainder by 31 is in the cover are sorted (blocks of 31 words are named in their order, the names' suffixes
by doubling), neighbours in that order get the length of their common prefix, and a sparse table gives the least of any
range of it. Two places compare at most 30 words until both are sampled. How far a run reaches to the left of its first
grid point is found by halving, with the same extensions.

The slices of a batch bound the memory by bytes; a longer text is a slice of its own and needs some 40 times its bytes.

Defined results: null and empty texts and texts of white space have no words and no runs, and collapse to an empty text;
repeated rows give repeated results, a null id is kept; extra columns are ignored. Words are compared as they stand.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, slices, words_of

#: Fixed value: a perfect difference set. Each difference by 31 occurs once.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
MIN_LENGTH, EXPONENT = 6, 4
SLICE = 1 << 20
PAIRS = 1 << 20  # grid pairs that are compared at once
Rewrite = Callable[[list, np.ndarray], np.ndarray]


def _shifts() -> np.ndarray:
    """For two remainders, how many words on both are in the cover."""
    at = np.zeros(MODULUS, bool)
    at[list(COVER)] = True
    both = np.array([[[at[(a + d) % MODULUS] and at[(b + d) % MODULUS] for d in range(MODULUS)] for b in range(MODULUS)] for a in range(MODULUS)])
    if not both.any(2).all():
        raise ValueError("not a difference cover")
    return both.argmax(2)


SHIFT = _shifts()


class Extensions:
    """Longest common extensions of an array of numbers of 0 or more, in which each text ends with a number of its own."""

    def __init__(self, codes: np.ndarray) -> None:
        n, v = len(codes), MODULUS
        self.codes = codes
        self.first = np.full(v, -1, np.int64)  # of each remainder's samples
        places = []
        for r in COVER:
            self.first[r] = sum(map(len, places))
            places.append(np.arange(r, n, v))
        sample = np.concatenate(places)
        padded = np.concatenate((codes + 1, np.zeros(v, codes.dtype))).astype(">u4")
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, v)[sample])
        _, rank = np.unique(blocks.view(np.dtype((np.void, 4 * v))).ravel(), return_inverse=True)
        m, levels = len(sample), [rank.astype(np.int64)]
        while m and levels[-1].max() < m - 1:  # names of twice as many blocks
            step = 1 << (len(levels) - 1)
            after = np.zeros(m, np.int64)
            after[: m - step] = levels[-1][step:] + 1
            levels.append(np.unique(levels[-1] * (m + 1) + after, return_inverse=True)[1])
        self.rank = levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b, blocks_alike = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            some = np.flatnonzero(np.maximum(a, b) < m)
            same = some[levels[k][a[some]] == levels[k][b[some]]]
            for x in (a, b, blocks_alike):
                x[same] += 1 << k
        differ = blocks[a] != blocks[b]  # a last block has its text's end, so both are inside
        table = [np.concatenate(([0], blocks_alike * v + differ.argmax(1)))]
        while 2 << (len(table) - 1) <= m:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = (self.rank[self.first[x % MODULUS] + x // MODULUS] for x in (i, j))
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k)) + 1])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on; the two places differ."""
        out, shift, left, t = np.zeros(len(i), np.int64), SHIFT[i % MODULUS, j % MODULUS], np.arange(len(i)), 0
        while len(left):
            if len(now := left[shift[left] == t]):
                out[now] = t + self.sampled(i[now] + t, j[now] + t)
            left = left[shift[left] > t]
            same = self.codes[i[left] + t] == self.codes[j[left] + t]
            out[left[~same]] = t
            left, t = left[same], t + 1
        return out


def grid_pairs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, ...]:
    """(text, period, place): grid points whose next words agree with those a period on, as far as a short look shows."""
    periods = np.where(sizes >= min_length, sizes // exponent, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    need = np.maximum(min_length, exponent * q) - 2 * q + 1
    count = np.maximum((sizes[text] - q - need) // q + 1, 0)
    look = int(need.min(initial=1))
    ends, found, at = np.cumsum(count), [], 0
    while at < len(count):
        before = ends[at] - count[at]
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        k = np.repeat(np.arange(at, to), count[at:to])
        i = starts[text[k]] + (np.arange(before, ends[to - 1]) - (ends - count)[k]) * q[k]
        for t in range(look):
            same = codes[i + t] == codes[i + q[k] + t]
            k, i = k[same], i[same]
        found.append((k, i))
        at = to
    k, i = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in (0, 1))
    return text[k], q[k], i


def find_runs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period. Each text is followed by a number that
    occurs nowhere else; start counts from the text's first word."""
    text, q, i = grid_pairs(codes, starts, sizes, min_length, exponent)
    none = np.zeros(0, np.int64)
    if not len(text):
        return none, none, none, none
    own = np.unique(text)  # only their words are sorted
    moved = np.full(len(sizes), -1, np.int64)
    moved[own] = np.cumsum(sizes[own] + 1) - sizes[own] - 1
    place = np.repeat(starts[own] - moved[own], sizes[own] + 1) + np.arange((sizes[own] + 1).sum())
    alike = Extensions(codes[place])
    i = i - starts[text] + moved[text]
    ahead = alike(i, i + q)
    fit = ahead >= np.maximum(min_length, exponent * q) - 2 * q + 1
    text, q, i, ahead = text[fit], q[fit], i[fit], ahead[fit]
    again = np.zeros(len(i), bool)  # the run already has an earlier grid point
    again[1:] = (text[1:] == text[:-1]) & (q[1:] == q[:-1]) & (i[1:] == i[:-1] + q[:-1]) & (ahead[:-1] >= q[:-1])
    text, q, i, ahead = text[~again], q[~again], i[~again], ahead[~again]
    low, high = np.zeros(len(i), np.int64), np.minimum(q - 1, i - moved[text])
    while len(open_ := np.flatnonzero(low < high)):
        t = (low[open_] + high[open_] + 1) // 2
        reach = alike(i[open_] - t, i[open_] - t + q[open_]) >= t
        low[open_] = np.where(reach, t, low[open_])
        high[open_] = np.where(reach, high[open_], t - 1)
    start, length = i - low - moved[text], low + q + ahead
    fit = length >= np.maximum(min_length, exponent * q)
    text, start, length, q = text[fit], start[fit], length[fit], q[fit]
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    own = np.ones(len(text), bool)  # of one stretch, the smallest period
    own[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = text[own], start[own], length[own], q[own]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def _slice(ids: pa.Array, texts: pa.Array, rewrite: Rewrite | None, min_length: int, exponent: int) -> list[pa.Array]:
    words, offsets = words_of(texts)
    sizes, where = np.diff(offsets), np.asarray(words.indices).astype(np.int64)
    if rewrite:
        where = where[rewrite(ids.to_pylist(), offsets)]
    starts = offsets[:-1] + np.arange(len(sizes))
    codes = np.empty(len(where) + len(sizes), np.int64)
    codes[np.arange(len(where)) + np.repeat(np.arange(len(sizes)), sizes)] = where
    codes[starts + sizes] = len(words.dictionary) + np.arange(len(sizes))
    text, start, length, q = find_runs(codes, starts, sizes, min_length, exponent)
    edge = np.zeros(len(where) + 1, np.int64)  # +1 where words are dropped from, -1 where they stop
    np.add.at(edge, offsets[text] + start + q, 1)
    np.add.at(edge, offsets[text] + start + length, -1)
    keep = np.cumsum(edge)[:-1] == 0
    left = np.concatenate(([0], np.cumsum(keep)))[offsets]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.dictionary.take(pa.array(where[keep])))
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, q)], ["start", "length", "period"])
    cuts = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
    return [ids, pa.array(sizes), pa.ListArray.from_arrays(cuts, runs), pc.binary_join(kept, " ")]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words that no run holds after its first period.

    rewrite(ids, offsets), if given, says which word of the slice stands at each place, before runs are searched."""
    if exponent < 2 or min_length < 2:
        raise ValueError("a run holds its period twice at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in lean(batches):
            for b in slices(whole, 1, SLICE):
                yield pa.RecordBatch.from_arrays(_slice(b.column(0), b.column(1), rewrite, min_length, exponent), ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def planted(ids: list, offsets: np.ndarray) -> np.ndarray:
    """The query's own rewriting: in a tenth of the documents, by the id's crc32, the words from a on repeat the p from a on."""
    out = np.arange(offsets[-1])
    for doc, first, end in zip(ids, offsets.tolist(), offsets[1:].tolist(), strict=False):
        h, n = zlib.crc32(str(doc).encode()), end - first
        if doc is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        out[first + a : end] = first + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return out


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), rewrite=planted)
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])  # noqa: E731  by start: of equal ones the first stays
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(greater(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

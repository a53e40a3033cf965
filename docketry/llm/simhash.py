"""Operator 2, SimHash near-dedup with bit-sliced comparison.

1. Fingerprints: XXH64 (seed 42) of the 3-word shingles, a bit is 1 if it is set in over half of them.
2. Equal fingerprints become one node. Each node goes to ten buckets, one for each pair of five bit blocks: two
   fingerprints that differ in at most 3 bits agree on two of five blocks at least, so no link is lost.
3. A bucket of more than BUCKET nodes is dealt again by each three of six blocks of its free bits (three
   differing bits leave three of six blocks equal), and so on; with ten free bits, after two rounds, a bucket
   can't exceed BUCKET. So no task ever holds an unbounded bucket, and nothing is dropped.
4. In a task the sorted nodes are lanes of vertical bit planes. For each lag k, all lanes are compared with the
   lanes k further on at once: XOR of planes, carry-save counters of two bits with an overflow bit, and blocks
   whose lanes are all past the radius or at a bucket's end are abandoned. A bucket yields a spanning forest,
   not its pairs.
5. Components by alternating large-star and small-star rounds, each written to the shared folder.

The pipeline's stage (drop_near_duplicates) asks for more than op2's contract: texts whose sets of 5-word
shingles have a Jaccard similarity of LIKE at least. Its SimHash has 256 bits; pairs that agree on all bits of one of
the samples of the bits (Bands: 64 of 16 bits, wider and more of them beyond 262,144 texts), and differ in at most NEAR of the first 128 (the same bit-sliced
comparison), are candidates, and a join confirms each candidate by the two sets themselves. First each bucket lists
a forest of its candidates, the closest first (RADII), not its pairs, so a large group of copies costs joined rows in
proportion to its size. Then, of the texts in these, all candidates between groups that are still apart are listed,
but for those that a SimHash of FINE bits shows to be less alike than LIKE (more than FINE_NEAR bits apart; three
standard deviations above the mean of texts just alike).

Defined results: null and wordless texts have fingerprint 0 and are linked like any other; fewer than three
words make one shingle; rows with a null doc_id get the component of their group's smallest known doc_id, or
null; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result. In
the stage, rows that repeat the doc_id and text that stay are that one document and stay with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_counted, lean, materialise, maybe_among, unused, without

RADIUS = 3
SHINGLE = 3
BUCKET = 1024
CHUNK = 1 << 16
STAGE_SHINGLE = 5
LIKE = 0.8
BAND = 16  # bits of a band at least
MISSED = 1e-4  # of pairs that are NEAR bits apart, how many may share no band
NEAR = 30
RADII = (10, 16, 22, NEAR)
FINE = 1024
FINE_NEAR = 190
WORDS = ["w0", "w1", "w2", "w3"]  # the 256 bits
WIDE = np.random.default_rng(64).integers(0, 1 << 63, FINE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # odd multipliers
ALL = (1 << 64) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The whole text's fingerprint, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(norm[a:b], 42) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row per row; text_hash tells rows with one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_bits(mask: int, parts: int) -> list[int]:
    """Masks of `parts` blocks, nearly equal, of the bits that are set in `mask`."""
    bits = [i for i in range(64) if mask >> i & 1]
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def first_masks() -> list[int]:
    return [a | b for a, b in combinations(split_bits(ALL, RADIUS + 2), 2)]


def _hook(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each a and b; lab leads to the smallest index."""
    while True:
        x, y = lab[a], lab[b]
        open_ = x != y
        if not open_.any():
            return lab
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(lab, nxt := lab[lab]):
            lab = nxt


def near_lanes(fp: np.ndarray, rank: np.ndarray, size: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lanes sorted by bucket, with each lane's rank in its bucket and that bucket's size: the pairs of
    lanes at most `radius` bits apart, lag by lag. A lane whose size is set to 0 meanwhile starts no more pairs."""
    n = len(fp)
    words = (n + 63) // 64
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((words * 64 - n, bits.shape[1]), np.uint8)])
    planes = np.zeros((bits.shape[1], words + 1), np.uint64)
    planes[:, :words] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    del bits
    width = radius.bit_length()
    bias = (1 << width) - 1 - radius  # counters start here, so that they overflow past the radius
    for k in range(1, int(size.max(initial=1))):
        ok = np.zeros(words * 64, np.uint8)
        ok[:n] = rank + k < size
        valid = np.packbits(ok, bitorder="little").view(np.uint64)
        at = np.flatnonzero(valid)
        if not len(at):
            break
        valid, q, r = valid[at], *divmod(k, 64)
        low, high = np.minimum(at + q, words), np.minimum(at + q + 1, words)
        over = np.zeros(len(at), np.uint64)
        count = [np.full(len(at), ALL if bias >> j & 1 else 0, np.uint64) for j in range(width)]
        for p in range(len(planes)):
            if r:
                other = planes[p, low] >> np.uint64(r) | planes[p, high] << np.uint64(64 - r)
            else:
                other = planes[p, low]
            carry = planes[p, at] ^ other
            for j in range(width):
                count[j], carry = count[j] ^ carry, count[j] & carry
            over |= carry
            if p % 6 == 5:
                live = (valid & ~over) != 0
                if not live.all():
                    at, valid, low, high, over, count = at[live], valid[live], low[live], high[live], over[live], [c[live] for c in count]
                    if not len(at):
                        break
        if len(at):
            near = np.unpackbits((valid & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            block, lane = np.nonzero(near)
            i = at[block] * 64 + lane
            yield i, i + k


def bit_sliced_links(fp: np.ndarray, rank: np.ndarray, size: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The smallest lane that each is linked with through pairs at most `radius` bits apart."""
    lab = np.arange(len(fp))
    for i, j in near_lanes(fp, rank, size, radius):
        lab = _hook(lab, i, j)
    return lab


def _whole_buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of numbers, sorted by their first `keys` columns, whole buckets in one partition -> (rows, rank in
    the bucket, size of the bucket) of the buckets with two rows at least, many at a time."""

    def flush(rows: np.ndarray, last: bool) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        new = np.flatnonzero(np.concatenate(([True], (rows[1:, :keys] != rows[:-1, :keys]).any(1))))
        keep = rows[:0]
        if not last:  # the last bucket may go on
            keep, rows, new = rows[new[-1] :], rows[: new[-1]], new[:-1]
        size = np.diff(np.append(new, len(rows)))
        start, size = np.repeat(new, size), np.repeat(size, size)
        many = size > 1
        return (rows[many], (np.arange(len(rows)) - start)[many], size[many]), keep

    rows, held, waiting = None, [], 0
    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
        waiting += b.num_rows
        if waiting >= CHUNK:
            out, rows = flush(np.concatenate([*([] if rows is None else [rows]), *held]), False)
            held, waiting = [], 0
            if len(out[0]):
                yield out
    rows = [*([] if rows is None else [rows]), *held]
    if sum(map(len, rows)):
        out, _ = flush(np.concatenate(rows), True)
        if len(out[0]):
            yield out


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp), sorted, whole buckets in one partition -> edges of a spanning forest."""
    for rows, rank, size in _whole_buckets(batches, 2):
        fp = rows[:, 2]
        lab = bit_sliced_links(fp.view(np.uint64), rank, size)
        linked = np.flatnonzero(lab != np.arange(len(lab)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[lab[linked]])], ["a", "b"])


def link(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints `fp` -> edges (a, b) whose components are those of all pairs within the radius."""
    spark = nodes.sparkSession
    masks = first_masks()
    rows = nodes.select(F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"), "fp")
    free = 64
    edges = None
    while True:
        rows = rows.withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
        free = max(64 - m.bit_count() for m in masks)
        cold, hot = rows, None
        if 1 << free > BUCKET:
            hot = materialise(rows.groupBy("mask", "key").count().filter(F.col("count") > BUCKET).select("mask", "key"), "simhash-hot")
            here = {r[0] & ALL for r in hot.select("mask").distinct().collect()}  # at most 10 x 20 ** level masks, of two levels
            if here:
                cold = rows.join(hot, ["mask", "key"], "left_anti")
                children = [(_signed(m), _signed(m | a | b | c)) for m in here for a, b, c in combinations(split_bits(ALL ^ m, RADIUS + 3), 3)]
                masks = [c & ALL for _, c in children]
                finer = F.broadcast(spark.createDataFrame(children, "mask long, finer long"))
                rows = materialise(rows.join(hot, ["mask", "key"], "left_semi").join(finer, "mask").select(F.col("finer").alias("mask"), "fp"), "simhash-finer")
            else:
                hot = None
        dealt = cold.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = dealt.mapInArrow(_link_buckets, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if hot is None:
            return edges


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the smallest node of the component. Each round is written out."""
    cur = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    while True:
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id), one row per row."""
    fps = materialise(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-nodes")
    comp = connected_components(link(nodes.select("fp")))
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root"))
    by_fp = with_component(materialise(rooted, "simhash-rooted"), "first_id").select("fp", "n", "component_id")
    return join_counted(fps, by_fp, "fp", "n").select("doc_id", "text_hash", "fp", "component_id")


def with_component(rooted: DataFrame, id_col: str) -> DataFrame:
    """Add component_id, the smallest id of all rows with the same root."""
    least = rooted.groupBy("root").agg(F.min(id_col).alias("component_id"), F.count("*").alias("of_root"))
    return join_counted(rooted, least, "root", "of_root")


def shingles(text: bytes | None, shingle: int = STAGE_SHINGLE) -> tuple[int, np.ndarray]:
    """A key of the text in normal form (lower case, single spaces), and the sorted hashes of its set of shingles."""
    words = (text or b"").lower().split()
    norm = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if not words:
        return digest(norm), np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return digest(norm), np.unique(np.array([digest(norm[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64))


def wide_bits(h: np.ndarray, bits: int = 256) -> np.ndarray:
    """The bits of the SimHash of a set of shingle hashes: the first 256, or more."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(h), CHUNK // 4):
        x = h[at : at + CHUNK // 4, None] * WIDE[: bits // 64]
        x ^= x >> np.uint64(29)
        x *= WIDE[1]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), bits // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (2 * ones > len(h)).astype(np.uint8)


class Bands:
    """Samples of the 256 bits, as wide as the number of texts asks for: a bucket of unlike texts holds some four of them at
    any size. The wider a band, the more of them, so that as many pairs are met."""

    def __init__(self, texts: int) -> None:
        self.width = max(BAND, (max(texts, 1) - 1).bit_length() - 2)
        agree = (1 - NEAR / 256) ** self.width  # of pairs just alike, some NEAR of the 256 bits differ
        self.count = max(64, int(np.ceil(np.log(MISSED) / np.log1p(-agree))))
        self.samples = np.stack([np.random.default_rng(i).choice(256, self.width, replace=False) for i in range(self.count)])
        self.bits = np.zeros((self.count, 4), np.uint64)  # the bits of each band among the first 256
        np.bitwise_or.at(self.bits, (np.arange(self.count)[:, None], self.samples // 64), np.uint64(1) << (self.samples % 64).astype(np.uint64))

    def buckets(self, bits: np.ndarray) -> np.ndarray:
        """(n, 256) bits -> (n, count) bucket numbers; each band has its own."""
        powers = np.int64(1) << np.arange(self.width, dtype=np.int64)
        return np.stack([bits[:, x] @ powers for x in self.samples], 1) + (np.arange(self.count, dtype=np.int64) << self.width)

    def first(self, apart: np.ndarray) -> np.ndarray:
        """For pairs, (n, 4) words of the bits in which they differ: the first band on all of whose bits they agree."""
        first = np.full(len(apart), self.count)
        for b in reversed(range(self.count)):
            first[~(apart & self.bits[b]).any(1)] = b
        return first


def near_pairs(fp: np.ndarray, rank: np.ndarray, size: np.ndarray, group: np.ndarray, fine: np.ndarray | None, band: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lanes of different groups at most NEAR bits apart: those of a forest of a bucket's groups, by growing
    radius; or, with the bits of `fine`, every pair at most FINE_NEAR of these apart, in the first band that it shares."""
    first = np.arange(len(fp)) - rank
    order = np.lexsort((group, first))
    new = np.concatenate(([True], (first[order][1:] != first[order][:-1]) | (group[order][1:] != group[order][:-1])))
    lab = np.empty(len(fp), np.int64)  # the first lane of the same bucket and group
    lab[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    for radius in RADII if fine is None else (NEAR,):
        left = size.copy()
        for step, (i, j) in enumerate(near_lanes(fp, rank, left, radius)):
            apart = lab[i] != lab[j]
            i, j = i[apart], j[apart]
            if fine is not None and len(i):
                differ = fine[i] ^ fine[j]
                close = np.flatnonzero(np.bitwise_count(differ).sum(1) <= FINE_NEAR)
                close = close[bands.first(differ[close, :4]) == band[i[close]]]
                i, j = i[close], j[close]
            if not len(i):
                continue
            yield i, j
            if fine is None:
                lab = _hook(lab, i, j)
                if step % 8 == 7:  # buckets of one group are done
                    split = np.zeros(len(fp), bool)
                    np.logical_or.at(split, first, lab != lab[first])
                    left[~split[first]] = 0


def _pair_buckets(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, w0, w1, node), sorted, whole buckets in one partition -> candidate pairs, forests of each bucket;
    with the group and the FINE bits in further columns every pair."""
    for rows, rank, size in _whole_buckets(batches, 1):
        node, group, fine = rows[:, 3], rows[:, min(4, rows.shape[1] - 1)], np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
        for i, j in near_pairs(np.ascontiguousarray(rows[:, 1:3]).view(np.uint64), rank, size, group, fine if fine.shape[1] else None, rows[:, 0] >> bands.width, bands):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])


def _wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lean(batches):
        nodes, bits = np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, 256), np.uint8)
        for i, t in enumerate(b.column(2)):
            nodes[i], h = shingles(t.as_py())
            bits[i] = wide_bits(h)
        w = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes.view(np.int64)), *(pa.array(w[:, k].copy()) for k in range(4))], ["doc_id", "text_hash", "node", *WORDS])


def _dealt(rows: DataFrame, bands: Bands) -> DataFrame:
    """Rows (w0, w1, w2, w3, further longs) -> (bucket, w0, w1, further longs), one for each band. Buckets are made where
    they are dealt: a text's list of them is longer than all its bits, and grows with the number of bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:4]], axis=1)
            bits = np.unpackbits(w.view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")
            keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands.count), pa.array(bands.buckets(bits).ravel()))
            yield pa.RecordBatch.from_arrays([keys, *b.columns[:2], *b.columns[4:]], ["buckets", *kept])

    kept = [c for c in rows.columns if c not in WORDS[2:]]
    listed = rows.mapInArrow(run, "buckets array<long>, " + ", ".join(f"{c} long" for c in kept))
    return listed.select(F.explode("buckets").alias("bucket"), *kept)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for b in lean(batches):
        for node, t in zip(b.column(0), b.column(1), strict=True):
            h = shingles(t.as_py())[1]
            fine = np.packbits(wide_bits(h, FINE), bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([h.view(np.int64)], longs), pa.array([fine], longs)], ["node", "shingles", "fine"])


def near_links(docs: DataFrame, wide: DataFrame, text_col: str, bands: Bands) -> DataFrame:
    """Edges (a, b) of nodes whose sets of shingles are alike by LIKE."""
    nodes = wide.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *(F.first(w).alias(w) for w in WORDS))
    nodes = materialise(nodes, "near-nodes")
    forest = _candidates(nodes.select(*WORDS, "node"), bands)
    # a text that is in no pair of the forests is in no pair at all
    met = forest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    met = materialise(met.join(nodes.select("node", "text_hash"), "node"), "near-met")
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    texts = maybe_among(texts, met, F.col("text_hash"), "text_hash").join(met, "text_hash")
    # rows of one node lie in one partition by their text_hash already
    sets = texts.groupBy("node", "text_hash").agg(F.first("text").alias("text")).select("node", "text")
    sets = sets.mapInArrow(_sets, "node long, shingles array<long>, fine array<long>")
    sets = materialise(sets, "near-sets")
    edges = materialise(_confirmed(forest, sets), "near-edges")
    group = met.select("node").join(connected_components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    rest = nodes.join(group, "node").join(sets.select("node", "fine"), "node")
    rest = rest.select(*WORDS, "node", "group", *(F.col("fine")[k].alias(f"f{k}") for k in range(FINE // 64)))
    return edges.unionByName(_confirmed(_candidates(rest, bands), sets))


def _candidates(rows: DataFrame, bands: Bands) -> DataFrame:
    dealt = _dealt(rows, bands).repartition("bucket").sortWithinPartitions("bucket", "w0", "w1")
    return materialise(dealt.mapInArrow(lambda batches: _pair_buckets(batches, bands), "a long, b long").distinct(), "near-pairs")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are alike by LIKE."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("n") >= LIKE * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component_id), one row per row, of the stage's own similarity."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    bands = Bands(docs.count())
    wide = materialise(cols.mapInArrow(_wide_rows, "doc_id long, text_hash long, node long, w0 long, w1 long, w2 long, w3 long"), "near-wide")
    comp = connected_components(near_links(docs, wide, text_col, bands))
    nodes = wide.groupBy("node").agg(F.count("*").alias("n")).join(comp, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialise(join_counted(wide.select("doc_id", "text_hash", "node"), materialise(nodes, "near-roots"), "node", "n"), "near-rooted")
    return with_component(rooted, "doc_id").select("doc_id", "text_hash", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of texts alike by LIKE, the document with the smallest doc_id stays, with all its
    columns; rows without a doc_id always stay."""
    gone, digest = unused(docs, "gone", "digest")
    out = near_classes(docs, id_col, text_col).filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone), F.col("text_hash").alias(digest)).distinct()
    out = materialise(out, "simhash-gone")
    return without(docs, out, {id_col: gone}, F.xxhash64(text_col), digest)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(documents(spark, sf_dir))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

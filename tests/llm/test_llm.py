"""The corpus operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docketry.llm import bpe, common, decontaminate, exact_dedup, license_scan, lm_score, sharding, simhash, sstable, toxicity, url_filter

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- 1: sorted string tables


def stored(texts):
    """What op1 must return for (doc_id, text) rows in key order."""
    lib, start, out = Tokenizer.from_file(BYTE), 0, []
    for doc_id, text in texts:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_sstable_query(spark, sf):
    got = sorted(rows(sstable.op1_sstable(spark, sf).drop("shard")))
    assert got == stored(sorted(rows(documents(spark, sf).select("doc_id", "text"))))


def test_sstable_pieces_of_random_texts():
    """Cut pieces give the ids of the whole text, whatever stands side by side."""
    import random

    rnd = random.Random(3)
    parts = ["a", "Bc", "the", " ", "  ", "\n", "\t", "'s", "'S", "'", "'re", "'x", ",", ".", "...", "!?", "é", "漢", " ", "\r\n", "1", "23", "<|endoftext|>", "_", "-", "\x0b", "“", "ß", "x'y", "don't", "''s", "a,b", "$5", "\x7f", "\x01", "\0", "\x1c", "　"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    lib, e = Tokenizer.from_file(BYTE), sstable.Encoder(open(BYTE, encoding="utf-8").read())
    for text, ids in zip(texts, e.batch(pa.array(texts, pa.string())).to_pylist(), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_sstable_odd_rows(spark, odd, odd_rows, tmp_path):
    path = f"file://{tmp_path}/t"
    sstable.write(odd, path, BYTE)
    got = sorted(rows(sstable.read_back(spark, path).drop("shard")), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert Counter((r[0], *r[2:]) for r in got) == Counter((r[0], *r[2:]) for r in stored([x[:2] for x in odd_rows]))


def test_sstable_lookup(spark, sf, tmp_path):
    path = f"file://{tmp_path}/t"
    docs = documents(spark, sf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several shards
    sstable.write(docs, path, BYTE)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lib = Tokenizer.from_file(BYTE)
    want = {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect() if r.doc_id in (0, 7, 77, 199)}
    assert dict(rows(sstable.lookup(spark, path, [0, 7, 77, 199, 10**9, -5, None]))) == want
    ranges = sstable.key_ranges(spark, path)
    assert dict(rows(sstable.lookup(spark, path, [0, 7, 77, 199, 10**9, -5, None], ranges))) == want
    assert rows(sstable.lookup(spark, path, [10**9, -5, None], ranges)) == []
    first = sorted(rows(ranges.select("first_key", "last_key")))
    assert all(a[1] < b[0] for a, b in zip(first, first[1:], strict=False)) and ranges.count() > 1
    assert len(sstable.lookup(spark, path, [7], ranges).inputFiles()) == 1


def test_sstable_empty(spark, empty, tmp_path):
    path = f"file://{tmp_path}/t"
    sstable.write(empty, path, BYTE)
    assert rows(sstable.read_back(spark, path)) == []


def test_shard_blocks_and_bloom():
    w = sstable.Writer(4)
    keys = [sstable.key_of(i) for i in (None, -(2**63), -3, -3, 0, *range(5, 40_000, 3))]
    assert keys == sorted(keys)
    values = [np.arange(i % 5, dtype="<u4").tobytes() for i in range(len(keys))]
    out = [s for k, v in zip(keys, values, strict=True) if (s := w.add(k, v)) is not None]
    s = sstable.Shard(b"".join(x + b"\n" for x in [*out, *w.finish()]))
    assert len(s.blocks) == 3 and s.n_docs == len(keys)
    assert [e for b in s.blocks for e in s.entries(b)] == list(zip(keys, values, strict=True))
    assert s.get(sstable.key_of(-3)) == values[2:4] and s.get(sstable.key_of(6)) == []
    assert sum(bool(s.bloom[p >> 3] >> (p & 7) & 1) for i in range(1000) for p in sstable.probes(sstable.key_of(-9 - i), s.bits)[:1]) < 700


# --- 2: SimHash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(pairs):
    """(doc_id, fingerprint) -> smallest doc_id reachable through links of at most 3 bits, by brute force."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in pairs:
        if d is not None:
            least[find(f)].append(d)
    return [(d, f"{f:016x}", min(least[find(f)], default=None)) for d, f in pairs]


def test_simhash_query(spark, sf):
    pairs = [(r.doc_id, fingerprint(r.text)) for r in documents(spark, sf).collect()]
    assert sorted(rows(simhash.op2_simhash(spark, sf))) == sorted(components(pairs))


def test_simhash_odd_rows(spark, odd, odd_rows, empty):
    got = [(r[0], f"{r[2] & simhash.ALL:016x}", r[3]) for r in rows(simhash.classes(odd))]
    assert sorted(got, key=key) == sorted(components([(r[0], fingerprint(r[1])) for r in odd_rows]), key=key)
    assert rows(simhash.classes(empty)) == []
    assert simhash.drop_near_duplicates(odd).columns == odd.columns


@pytest.mark.parametrize("bucket", [1024, 16])
def test_links_match_brute_force(spark, bucket, monkeypatch):
    """Chains and random fingerprints, and a dense ball; with a small bucket the hot path deals them again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(25):
            b ^= sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(b)
    ball = base[9]
    if bucket == 1024:
        fps |= {ball ^ sum(1 << i for i in range(5) if m >> i & 1) ^ (1 << 40 if m > 40 else 0) for m in range(64)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    comp = {r[0] & simhash.ALL: r[1] for r in rows(simhash.connected_components(simhash.link(nodes)))}
    want = {f"{b:016x}": c for (_, b, c) in ((d, int(h, 16), c) for d, h, c in components([(i, f) for i, f in enumerate(fps)]))}
    groups = defaultdict(set)
    for f in fps:
        groups[comp.get(f, simhash._signed(f))].add(want[f"{f:016x}"])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_bit_sliced_radii():
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (70, 4), dtype=np.uint64), axis=1) for c in center])
    size, rank = np.full(350, 70), np.tile(np.arange(70), 5)
    for radius in (1, 2, 3, 5):
        lab = simhash.bit_sliced_links(fp, rank, size, radius)
        near = np.array([[i // 70 == j // 70 and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius for j in range(350)] for i in range(350)])
        want = np.arange(350)
        while not np.array_equal(want, new := np.where(near, want, 10**6).min(1)):
            want = new
        assert np.array_equal(lab, want)


def five_grams(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_copies(rng, words, changed, pairs):
    """(text, copy with some words changed, their 5-word Jaccard)."""
    out = []
    for _ in range(pairs):
        a = [f"w{x}" for x in rng.integers(0, 5000, words)]
        b = list(a)
        for i in rng.choice(words, changed, replace=False):
            b[i] = f"v{rng.integers(0, 5000)}"
        x, y = " ".join(a), " ".join(b)
        g, h = five_grams(x), five_grams(y)
        out.append((x, y, len(g & h) / len(g | h)))
    return out


def test_stage_finds_texts_alike_by_jaccard(spark):
    """The pairs of the review: all alike by 0.8, and some just under it."""
    rng = np.random.default_rng(2)
    cases = [x for words, changed, n in ((100, 1, 40), (300, 3, 40), (1000, 10, 20), (1000, 20, 20), (200, 12, 20)) for x in near_copies(rng, words, changed, n)]
    docs = spark.createDataFrame([(2 * i + k, c[k]) for i, c in enumerate(cases) for k in (0, 1)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept >= {2 * i for i in range(len(cases))}
    assert all(2 * i + 1 in kept for i, c in enumerate(cases) if c[2] < 0.8)
    alike = [2 * i + 1 not in kept for i, c in enumerate(cases) if c[2] >= 0.8]
    assert len(alike) > 90 and sum(alike) / len(alike) > 0.95


def test_stage_shuffles_the_texts_of_candidates_alone(spark):
    """Texts that are like no other stay where they are, and no table on disk holds a text's list of buckets."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 60, 2500)) for _ in range(300)]
    rows = list(enumerate([*texts, texts[7] + " x", texts[9] + " y"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    written = lambda: sum(s.shuffleWriteBytes() for s in jvm.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)))
    names, real, before = {}, simhash.materialise, written()
    simhash.materialise = lambda df, name: (names.setdefault(name, df.columns), real(df, name))[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the candidates are many
    try:
        kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    finally:
        simhash.materialise = real
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept == set(range(300))
    assert written() - before < 0.2 * sum(len(t) for t in texts), written() - before
    assert "buckets" not in names["near-wide"] + names["near-nodes"]


def test_stage_on_a_large_group_of_copies(spark):
    """Copies of one text with a word or more changed each, some of them alike only through others: one stays, and
    the candidates confirmed stay in proportion to the group."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
    texts = []
    for n in range(1500):
        t = list(base)
        for at in rng.choice(120, 1 + n % 3, replace=False):
            t[at] = f"v{rng.integers(0, 10**6)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(base), *texts])], "doc_id long, text string").repartition(5)
    grams = [five_grams(t) for t in texts]
    whole = five_grams(" ".join(base))
    near = {i + 1 for i, g in enumerate(grams) if len(g & whole) >= 0.8 * len(g | whole)}
    listed = []
    real = simhash.materialise
    simhash.materialise = lambda df, name: (lambda out: (listed.append(out.count()) if name == "near-pairs" else None, out)[1])(real(df, name))
    try:
        kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    finally:
        simhash.materialise = real
    assert 0 in kept and not kept & near and len(near) > 900
    assert sum(listed) < 0.2 * 1501 * 1500 / 2, listed  # a third of the group is barely not alike


def test_first_band_of_a_pair():
    """The band in which a pair is listed is the first in which its bucket numbers agree."""
    rng = np.random.default_rng(3)
    h = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(6)]
    h += [np.concatenate([x[:170], rng.integers(0, 1 << 63, 30, dtype=np.uint64)]) for x in h]
    fine = np.stack([np.packbits(simhash.wide_bits(x, simhash.FINE), bitorder="little").view(np.uint64) for x in h])
    for texts in (100, 1 << 22):
        bands = simhash.Bands(texts)
        keys = bands.buckets(np.stack([simhash.wide_bits(x) for x in h]))
        for i in range(12):
            for j in range(12):
                same = np.flatnonzero(keys[i] == keys[j])
                assert bands.first((fine[i] ^ fine[j])[None, :4])[0] == (same[0] if len(same) else bands.count)
        assert any(0 < (keys[i] == keys[i + 6]).sum() < bands.count for i in range(6))


def test_bands_grow_with_the_texts():
    """Four texts a bucket at any size, and as many pairs that are NEAR bits apart share a band."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2, (2000, 256)).astype(np.uint8)
    b = a.copy()
    for row in b:
        row[rng.choice(256, simhash.NEAR, replace=False)] ^= 1
    for texts in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 22, 1 << 28):
        bands = simhash.Bands(texts)
        assert texts / 2**bands.width <= 4 and (bands.width, bands.count) >= (16, 64)
        assert (bands.buckets(a) == bands.buckets(b)).any(1).mean() > 0.998


@pytest.mark.parametrize("words", [2000, 40])
def test_without(spark, monkeypatch, words):
    """A filter that holds the keys apart, and one that is full."""
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    table = spark.range(3000).selectExpr("if(id % 50 = 0, null, id) AS id", "concat('t', id % 700) AS text", "1L AS gone", "'w' AS word")
    gone = table.filter("gone = 1 and text >= 't3'").select(F.col("id").alias("g"), F.xxhash64("text").alias("d")).distinct()
    got = common.without(table, common.materialise(gone, "gone"), {"id": "g"}, F.xxhash64("text"), "d")
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r) for r in table.collect() if r.text < "t3") and got.columns == table.columns
    other = common.materialise(gone.withColumn("g", F.lit(-1).cast("long")), "gone")  # the same text of another id stays
    assert common.without(table, other, {"id": "g"}, F.xxhash64("text"), "d").count() == 3000
    assert common.without(table, common.materialise(gone.limit(0), "gone"), {"id": "g"}, F.xxhash64("text"), "d").count() == 3000


def test_rows_meet_their_component_by_key_counts(spark, odd, odd_rows, monkeypatch):
    """Keys of many rows are broadcast, the others shuffle; the result is the same."""
    from docketry.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    got = [(r[0], f"{r[2] & simhash.ALL:016x}", r[3]) for r in rows(simhash.classes(odd))]
    assert sorted(got, key=key) == sorted(components([(r[0], fingerprint(r[1])) for r in odd_rows]), key=key)


def test_stage_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", True, 1), (2, "A b c d e f", False, 2), (None, "a b c d e f", False, 3)], "doc_id long, text string, gone boolean, digest int")
    assert Counter(rows(simhash.drop_near_duplicates(docs))) == Counter(r for r in rows(docs) if r[0] != 2)


# --- 3: decontamination


def contamination(texts, items):
    """op3's rows by brute force."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    table = defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            table[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in texts:
        w = cut(text)
        hit, found = set(), set()
        for n in {len(t) for t in table}:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in table:
                    hit |= set(range(i, i + n))
                    found |= table[t]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate_query(spark, sf):
    bench = rows(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))
    want = contamination(rows(documents(spark, sf).select("doc_id", "text")), bench)
    assert sorted(rows(decontaminate.op3_decontaminate(spark, sf))) == sorted(want)


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_decontaminate_odd_rows(spark, odd, odd_rows, empty, limit, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    items = [(1, "jumps over the lazy dog while seven small cats watch from a warm"), (2, "one two"), (3, "ONE"), (4, None), (5, "..."), (6, "over the lazy dog while seven small cats watch from a x"), (6, "one"), (7, "other text of id three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(odd, bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
    want = contamination([r[:2] for r in odd_rows], items)
    assert sorted(rows(got), key=key) == sorted(want, key=key)
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not w[-1] for w in want)
    none = bench.limit(0)
    assert all(r[2] == 0 for r in rows(decontaminate.contamination(odd, none))) and decontaminate.drop_contaminated(odd, none).count() == len(odd_rows)
    assert rows(decontaminate.contamination(empty, bench)) == []


def test_fingerprints_are_winnowed(spark, sf):
    """Far fewer fingerprints than windows, on either side, and one in every window of ten words."""
    from pyspark.sql import functions as F

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    table, _, lengths = decontaminate.windows(bench)
    long = table.filter(f"length = {decontaminate.WINDOW}")
    assert long.select("key").distinct().count() < 0.5 * long.count()
    base = documents(spark, sf).select("doc_id", F.lit(0).alias("row_key"), decontaminate.words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    at = defaultdict(set)
    for r in decontaminate.fingerprints(base, [10]).select("doc_id", "p").collect():
        at[r.doc_id].add(r.p)
    n = dict(rows(base.select("doc_id", "n_words")))
    assert sum(map(len, at.values())) - len(n) < 0.35 * sum(n.values())
    for d, k in n.items():
        assert all(any(p in at[d] for p in range(i, i + decontaminate.GRAMS)) for i in range(k - 9))


def test_decontaminate_repeats_and_names(spark):
    """Texts of one repeated word, spans longer than a window, and columns that clash with the operator's own."""
    items = [(1, "a " * 14), (2, " ".join(f"w{i}" for i in range(40))), (3, "x y")]
    texts = [(1, "a " * 50), (2, "z " + " ".join(f"w{i}" for i in range(7, 33)) + " z"), (3, "q x y x y"), (4, "a " * 9), (5, None)]
    docs = spark.createDataFrame([(d, t, True, "g") for d, t in texts], "doc_id long, text string, gone boolean, row_key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench)
    assert sorted(rows(got.select("doc_id", "n_words", "n_hit", "n_items"))) == sorted(w[:4] for w in contamination(texts, items))
    assert [tuple(x) for x in got.filter("doc_id = 2").first().spans] == [(1, 27)]
    assert sorted(rows(decontaminate.drop_contaminated(docs, bench))) == [(4, "a " * 9, True, "g"), (5, None, True, "g")]


# --- 4: exact dedup


def duplicates(texts):
    groups = defaultdict(list)
    for d, t in texts:
        groups[(t or "").translate(UP)].append(d)
    biggest = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((d, biggest(groups[n]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for d, t in texts for n in [(t or "").translate(UP)]), key=key)


@pytest.mark.parametrize(("rows_a_word", "broadcast"), [(4, 1 << 20), (1000, 0)])
def test_exact_dedup(spark, sf, odd, odd_rows, empty, rows_a_word, broadcast, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_A_WORD", rows_a_word)  # a full filter changes nothing but speed
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", broadcast)
    for df, data in ((documents(spark, sf), rows(documents(spark, sf).select("doc_id", "text"))), (odd, [r[:2] for r in odd_rows])):
        got = rows(exact_dedup.decide(df))
        assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=key) == duplicates(data)
        assert Counter(r[4] for r in got if r[3]) == Counter({r[4]: 1 for r in got}) and all(r[0] == r[1] for r in got if r[3])
        kept = exact_dedup.drop_exact_duplicates(df)
        assert kept.columns == df.columns
        assert sorted(rows(kept.select("doc_id")), key=key) == sorted(((r[0],) for r in got if r[3]), key=key)
    assert rows(exact_dedup.decide(empty)) == [] == rows(exact_dedup.drop_exact_duplicates(empty))


def test_exact_dedup_names_and_types(spark):
    """Columns of any name, maps among them, come through whole; of repeated rows one stays."""
    data = [(1, "x", "u", 1, {"k": 1}), (2, "X", "v", 2, {"k": 2}), (2, "x", "w", 3, {"k": 3}), (None, "x", "n", 4, None), (5, "only", "o", 5, {}), (None, "no id", "p", 6, None), (None, "no id", "q", 7, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, text_sha256 string, row int, gone map<string,int>")
    docs = docs.withColumnsRenamed({"text_sha256": "digest"}).selectExpr("*", "row as word", "row as bits", "row as again")
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert [sum(r.doc_id == x and (r.text or "").lower() == t for r in got) for x, t in ((1, "x"), (2, "x"), (5, "only"), (None, "no id"), (None, "x"))] == [0, 1, 1, 1, 0] and len(got) == 3
    assert all(r.digest == {3: "w", 2: "v", 5: "o", 6: "p", 7: "q"}[r.row] and r.word == r.row for r in got)


def test_exact_dedup_filter_keeps_its_share(spark):
    """At ten times the rows the share of unique rows that take the exact path is as small."""
    shares = []
    for n in (4_000, 40_000):
        keys = spark.range(n).selectExpr("sha2(cast(if(id % 10 = 0, id div 20, id) as string), 256) as sha")
        words = n // exact_dedup.ROWS_A_WORD
        one, maybe = exact_dedup.split_by_filter(keys, exact_dedup.repeated_bits(keys, "sha", words), "sha", words)
        repeated = keys.groupBy("sha").count().filter("count > 1")
        assert one.join(repeated, "sha", "left_semi").count() == 0 and one.count() + maybe.count() == n
        shares.append(maybe.join(repeated, "sha", "left_anti").count() / n)
    assert max(shares) < 0.02, shares


# --- 5: BPE


def encoded(texts):
    lib = Tokenizer.from_file(WORD)
    out = []
    for d, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((d, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=key)


def test_bpe(spark, sf, odd, odd_rows, empty):
    assert sorted(rows(bpe.op5_bpe(spark, sf))) == encoded(rows(documents(spark, sf).select("doc_id", "text")))
    full = bpe.encode(odd, WORD)
    assert sorted(rows(full.drop("ids", "decoded")), key=key) == encoded([r[:2] for r in odd_rows])
    assert all(len(r.ids) == r.n_tokens for r in full.collect()) and rows(bpe.encode(empty, WORD)) == []
    assert Counter(rows(bpe.decode(full, WORD))) == Counter(rows(full.select("doc_id", "decoded")))


def test_bpe_decodes_ids(spark):
    lib = Tokenizer.from_file(WORD)
    data = [(1, [320, 5, 49406, 49407, 0]), (2, []), (3, None), (4, [10**6, -1, None, 320]), (1, [320])]
    got = rows(bpe.decode(spark.createDataFrame(data, "doc_id long, ids array<int>"), WORD))
    want = [(d, lib.decode([i for i in ids or [] if i is not None and 0 <= i < lib.get_vocab_size()], skip_special_tokens=False)) for d, ids in data]
    assert sorted(got) == sorted(want)


def test_memo_generations_change_nothing(monkeypatch):
    """A memo far too small for its texts gives the same ids."""
    monkeypatch.setattr(bpe, "MEMO", 20)
    monkeypatch.setattr(sstable, "MEMO", 20)
    rng = np.random.default_rng(2)
    text = [" ".join("".join(rng.choice(list("abcdeé.,1"), rng.integers(1, 5))) for _ in range(30)) for _ in range(50)]
    with open(WORD, encoding="utf-8") as f:
        c = bpe.Codec(f.read())
    with open(BYTE, encoding="utf-8") as f:
        e = sstable.Encoder(f.read())
    for at in range(0, 50, 5):
        some = text[at : at + 5]
        assert c.batch(pa.array(some))[1].to_pylist() == [" ".join(map(str, c.lib.encode(t, add_special_tokens=False).ids)) for t in some]
        assert e.batch(pa.array(some)).to_pylist() == [e.whole(t) for t in some]


def test_pair_index_on_random_words():
    with open(WORD, encoding="utf-8") as f:
        c = bpe.Codec(f.read())
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeinorst'12.,!éß日"), rng.integers(1, 14))) for _ in range(3000)]
    text = [" ".join(words[i : i + 7]) for i in range(0, 3000, 7)] + ["a" * 50, "ss" * 31, "<|endoftext|><|endoftext|>x", "<|ENDOFTEXT|>", "é" * 9]
    lib = Tokenizer.from_file(WORD)
    n, all_ids, texts = c.batch(pa.array(text))
    for t, k, ids, decoded in zip(text, n, all_ids.to_pylist(), texts.to_pylist(), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and k == len(want), t
        assert decoded == lib.decode(want, skip_special_tokens=False)


def test_byte_pieces_on_odd_space():
    with open(BYTE, encoding="utf-8") as f:
        e = sstable.Encoder(f.read())
    rng = np.random.default_rng(0)
    text = ["".join(rng.choice(["a", "B", "the", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "!", "'s", "12", "é", "\u00a0", "日", "\0", "<|endoftext|>", "\x1c"], rng.integers(0, 30), p=[0.1, 0.05, 0.15, 0.2, 0.1, 0.03, 0.06, 0.02, 0.02, 0.02, 0.08, 0.04, 0.05, 0.03, 0.01, 0.02, 0.005, 0.005, 0.01])) for _ in range(3000)]
    got = [np.frombuffer(b, e.dtype).tolist() for b in e.batch(pa.array(text)).to_pylist()]
    assert got == [e.lib.encode(t, add_special_tokens=False).ids for t in text]


# --- 6: licenses


def test_license_scan(spark, sf, odd, empty):
    s = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES:
        found = list(s.scan(f"Some prose.\n{text}\nMore prose."))
        assert [(f[3], f[5]) for f in found] == [(name, 0)], (name, found)
    cut = license_scan.TEMPLATES[2][1].replace("binary", "object").replace("contributors", "authors")
    assert [(f[3], f[5] > 0) for f in s.scan(cut)] == [("BSD-3-Clause", True)]
    assert [f[3] for f in s.scan("You need a driving licence to copy this chair.")] == [None]
    assert list(s.scan(None)) == list(s.scan("")) == []
    want = sorted((r.doc_id, *f) for r in documents(spark, sf).collect() for f in s.scan(r.text))
    assert sorted(rows(license_scan.op6_license_scan(spark, sf)), key=key) == sorted(want, key=key)
    assert rows(license_scan.scan(odd)) == [] == rows(license_scan.scan(empty))


def test_license_ranking_by_saving():
    s = license_scan.Scanner()
    saving, best = s.rank("This work is licensed under the GNU General Public License, version 3.")[0]
    assert s.names[best] == "GPL-3.0" and saving > 20


def test_license_scan_of_whole_tables_by_containment(spark, sf):
    """Not by the scanner's own code: every template whose words stand in a document one after the other is found,
    once for each time it stands there, and nothing is found without the words that it claims to have."""
    flat = lambda t: re.findall(r"[^\W_]+(?:[.][^\W_]+)*", t.lower())
    wanted, texts = Counter(), {}
    for r in documents(spark, sf).collect():
        words = " " + " ".join(flat(r.text)) + " "
        texts[r.doc_id] = words
        taken = []
        for name, t in sorted(license_scan.TEMPLATES, key=lambda x: -len(x[1])):
            notice = " " + " ".join(flat(t)) + " "
            at = words.find(notice)
            while at >= 0:
                if not any(a < at + len(notice) - 1 and at < b for a, b in taken):
                    taken.append((at, at + len(notice) - 1))
                    wanted[r.doc_id, name] += 1
                at = words.find(notice, at + 1)
    got = [r for r in license_scan.op6_license_scan(spark, sf).collect() if r.license]
    found = Counter((r.doc_id, r.license) for r in got)
    assert sum(wanted.values()) > 0 and not wanted - found
    shortest = {n: min(len(set(flat(t))) for m, t in license_scan.TEMPLATES if m == n) for n, _ in license_scan.TEMPLATES}
    for r in got:
        best = max(sum(f" {w} " in texts[r.doc_id] for w in set(flat(t))) / len(set(flat(t))) for n, t in license_scan.TEMPLATES if n == r.license)
        assert best >= 0.8 and shortest[r.license] >= 2
    assert all(r.missing == 0 for r in got if (r.doc_id, r.license) in wanted and found[r.doc_id, r.license] == wanted[r.doc_id, r.license])


def test_license_recall_on_wrapped_and_edited_notices(spark, sf):
    """Notices planted in real documents, wrapped, some with a word or two changed: recall of 0.9 at least."""
    import textwrap

    rng = np.random.default_rng(11)
    s = license_scan.Scanner()
    docs = [r.text for r in documents(spark, sf).collect() if not any(c in r.text.lower() for c in license_scan.CUES)]
    hit = total = 0
    for i in range(150):
        name, t = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        w = t.split()
        for at in rng.choice(len(w), len(w) // 25, replace=False):
            w[at] = "altered"
        lines = docs[int(rng.integers(len(docs)))].split("\n")
        at = int(rng.integers(len(lines) + 1))
        notice = "\n".join(rng.choice(["", "# ", " * ", "// "]) + x for x in textwrap.wrap(" ".join(w), int(rng.integers(40, 90))))
        found = [f[3] for f in s.scan("\n".join([*lines[:at], notice, *lines[at:]]))]
        hit += name in found
        total += 1
    print("recall", hit / total)
    assert hit / total >= 0.9


LGPL21 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
NEAR_MISSES = [  # notices and what they are; None: a license of which no template speaks
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 1.", None),
    ("This work is licensed under the GNU Affero General Public License, version 3.", None),
    (LGPL21, "LGPL-2.1"),
    (LGPL21.replace("2.1", "2"), None),
    (LGPL21.replace("Lesser", "Library"), None),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", None),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", None),
    ("Licensed under CC BY-ND 4.0.", None),
    ("Licensed under CC BY 3.0.", None),
    ("Licensed under CC BY-NC-SA 4.0.", None),
    ("Released under the BSD 4-Clause License.", None),
    ("Released under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("MIT License", "MIT"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"),
    ("SPDX-License-Identifier: LGPL-2.0", None),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", None),
    ("Released under the GNU AGPL.", None),
]


def test_license_near_misses(spark, sf):
    """Each notice alone, and wrapped within a document: the right license or none, never another."""
    import textwrap

    docs = [r.text for r in documents(spark, sf).collect() if not any(c in r.text.lower() for c in license_scan.CUES)][:20]
    s = license_scan.Scanner()
    for k, (notice, want) in enumerate(NEAR_MISSES):
        for text in (notice, notice.upper(), "\n".join([docs[k % 20], *(f" * {x}" for x in textwrap.wrap(notice, 50)), docs[(k + 1) % 20]])):
            assert [f[3] for f in s.scan(text)] == [want], (notice, want, list(s.scan(text)))
    table = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(NEAR_MISSES)], "doc_id long, text string")
    assert dict(rows(license_scan.scan(table).select("doc_id", "license"))) == {k: w for k, (_, w) in enumerate(NEAR_MISSES)}


def test_license_precision_on_altered_versions(spark, sf):
    """Templates whose telling words are changed, left out or have another before them: none is reported under its name,
    unless a whole notice of that name is left."""
    s = license_scan.Scanner()
    wrong = total = 0
    for name, t in license_scan.TEMPLATES:
        w, own = t.split(), license_scan.words(t)
        telling = {own[j] for j in range(len(own)) if license_scan.telling(own, j)}
        for k in range(1, len(w)):
            if not telling & set(license_scan.words(w[k])):
                continue
            for new in ([], ["9.9"], ["NonCommercial-NoDerivatives", w[k]]):
                text = " ".join([*w[:k], *new, *w[k + 1 :]])
                flat = f" {' '.join(license_scan.words(text))} "
                if not any(f" {' '.join(license_scan.words(x))} " in flat for n, x in license_scan.TEMPLATES if n == name):
                    total += 1
                    wrong += name in [f[3] for f in s.scan(text)]
    assert total > 40 and wrong == 0


def test_license_texts_passed_over_have_no_place(spark, sf):
    """Whatever words a notice lacks, as long as it is confirmed it holds a word that is asked for."""
    rng = np.random.default_rng(4)
    every = license_scan.with_identifiers(license_scan.TEMPLATES)
    asked = [*license_scan.CUES, *license_scan.sure_words(every)]
    s = license_scan.Scanner()
    for _ in range(20):
        for name, t in every:
            w = license_scan.words(t)
            gone = [k for k in np.argsort([-len(x) + rng.random() for x in w]) if not license_scan.telling(w, k)][: int(license_scan.MISSING * len(w))]
            text = " ".join(x for k, x in enumerate(w) if k not in set(gone))
            assert any(a in text for a in asked), (name, text)


def test_license_templates_are_a_parameter(spark):
    table = spark.createDataFrame([("Own-1.0", "Use of this file is granted under the Own Terms, version 1.0."), (None, "x"), ("y", None)], "name string, text string")
    own = license_scan.read_templates(table)
    docs = spark.createDataFrame([(1, "use of this file is GRANTED under the own terms, version 1.0"), (2, "use of this file is granted under the own terms, version 2.0"), (3, "Released under the MIT License.")], "doc_id long, text string")
    assert {tuple(r) for r in rows(license_scan.scan(docs, templates=own).select("doc_id", "license"))} == {(1, "Own-1.0"), (3, None)}


@pytest.mark.parametrize("width", [60, 70, 80])
def test_license_notices_wrapped(width):
    import textwrap

    s = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES:
        for prefix in ("", "# ", " * "):
            body = "\n".join(prefix + line for line in textwrap.wrap(text, width))
            found = list(s.scan(f"Some prose.\n\n{body}\n\nMore prose."))
            assert [(f[3], f[5]) for f in found] == [(name, 0)], (name, found)


def test_license_every_notice_of_a_long_line():
    """Short notices in long prose of legal wording without line ends: each is found, beside the others."""
    s = license_scan.Scanner()
    rng = np.random.default_rng(5)
    legal = "the license of this work and any copyright notice shall be included in all copies under these conditions without warranties or permission to use software for any purpose by law".split()
    short = [(n, t) for n, t in license_scan.TEMPLATES if len(t.split()) < 20]
    for words in (100, 1000, 5000):
        for (a, x), (b, y) in zip(short, short[1:], strict=False):
            prose = [" ".join(rng.choice(legal, words)) for _ in range(3)]
            got = [f[3] for f in s.scan(f"{prose[0]}. {x} {prose[1]}. {y} {prose[2]}") if f[3]]
            assert got == [a, b], (words, x, y, got)


# --- 7: URLs


def test_url_cases(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.ORG/es/a?b#c", "https://example.org/en/12", "https://notexample.org/es/x", "http://org/", "http://org", "x://a.com/fr/", "x://a.com/de/?q", "http://h.co.uk?x/y", "http://h/#/://z", "a://b://c/d\ne", "://"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(2, urls[2], "x"), (None, "http://q.net/", None)], "page_id long, url string, rate string")
    outcomes = spark.createDataFrame([(i, 1) for i in (0, 4)], "page_id long, bad int")
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_filter.judge(pages, outcomes).collect()}
    want = {(0, "", "", None), (1, "", "", None), (2, "www.example.org", "/es/a", "example.org/es/"), (3, "example.org", "/en/12", "example.org/en/1"), (4, "notexample.org", "/es/x", "org/"), (5, "org", "/", "org/"), (6, "org", "", None), (7, "a.com", "/fr/", "com/fr/"), (8, "a.com", "/de/", "com/de/"), (9, "h.co.uk", "", None), (10, "h", "/", None), (11, "b:", "//c/d\ne", None), (12, "", "", None), (None, "q.net", "/", None)}
    assert got == want
    assert url_filter.judge(pages, outcomes).count() == len(urls) + 2
    assert {r.verdict for r in url_filter.judge(pages, outcomes.limit(0)).filter("rule is null").collect()} == {"allow"}
    assert rows(url_filter.judge(pages.limit(0), outcomes)) == []


def test_url_shrinkage(spark):
    """Bad hosts with evidence are blocked; one bad page of a good domain's host is not."""
    data = [(i, f"http://h{i % 40}.good.net/{i}", 0) for i in range(4000)] + [(5000 + i, f"http://s{i % 4}.spam.info/{i}", int(i % 10 > 0)) for i in range(400)] + [(9000, "http://new.good.net/", 1), (9001, "http://fresh.spam.info/", None), (9002, "http://unseen.xyz/", None)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in data], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, _, b in data if b is not None], "page_id long, bad int")
    verdict = {r.page_id: r.verdict for r in url_filter.judge(pages, outcomes).collect()}
    assert verdict[0] == verdict[9000] == "allow" and verdict[5001] == verdict[9001] == "block"


def test_url_suffixes_and_hot_hosts(spark, tmp_path, monkeypatch):
    """A suffix file decides where names are registered; hosts of many pages are broadcast, with the same result."""
    from docketry.llm import common

    (tmp_path / "psl.txt").write_text("// comment\n\ncom\nuk\nco.uk\nblog.example.com  // private\n*.ck\n!www.ck\n")
    suffixes = url_filter.read_suffixes(spark, f"file://{tmp_path}/psl.txt")
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.blog.example.com",), ("z.example.com",), ("p.q.r.ck",), ("one",), ("",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.with_domain(hosts, suffixes).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.y.blog.example.com": ("y.blog.example.com", "blog.example.com"), "z.example.com": ("example.com", "com"), "p.q.r.ck": ("q.r.ck", "r.ck"), "one": ("one", ""), "": ("", "")}
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.x.co.uk/{i}") for i in range(60)] + [(None, None)] * 5, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(50)], "page_id long, bad int")
    want = sorted(rows(url_filter.judge(pages, outcomes, suffixes=suffixes)), key=key)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(rows(url_filter.judge(pages, outcomes, suffixes=suffixes)), key=key) == want and len(want) == 65


# --- 8: sharding


def check_shards(got, total, shards):
    by = defaultdict(list)
    for shard, slot in got:
        by[shard].append(slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, sf, odd, odd_rows, empty):
    got = sharding.op8_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text.encode() for r in documents(spark, sf).collect()}
    assert all(r["size"] == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
    check_shards([(r.shard, r.slot) for r in got], len(texts), 24)
    clash = odd.selectExpr("*", "shard as Slot", "shard as row", "shard as place", "shard as `part`", "shard as `order`", "shard as shard_input")
    out = sharding.shuffle(clash, 5)
    check_shards(rows(out.select("shard", "slot")), len(odd_rows), 5)
    kept = [{"shard": "shard_input_", "Slot": "Slot_input"}.get(c, c) for c in clash.columns]
    assert out.columns == [*kept, "shard", "slot"]
    assert Counter(rows(out.select(*kept))) == Counter(rows(clash))
    assert rows(sharding.shuffle(empty, 5)) == []


def test_sharding_is_uniform(spark):
    """Over many seeds each row lands in each shard, and each pair of neighbours together, as often as it should."""
    times, together, first = 60, 0, Counter()
    df = spark.range(0, 40, 1, 3)
    for seed in range(times):
        at = dict(rows(sharding.shuffle(df, 4, seed).select("id", "shard")))
        together += sum(at[i] == at[i + 1] for i in range(39))
        first.update(at[i] for i in range(10))
    assert abs(together / times - 39 * 9 / 39) < 1.2  # 9 of the 39 others share a row's shard
    assert all(abs(first[s] / times - 2.5) < 0.7 for s in range(4)), first


def test_hypergeometric_is_exact():
    from math import comb

    rng = np.random.default_rng(0)
    good, bad, n, times = 7, 9, 6, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(times))
    for k in range(n + 1):
        p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
        assert abs(seen[k] / times - p) < 5 * (p * (1 - p) / times) ** 0.5 + 1e-4
    m = sharding.matrix([50, 3, 0, 47], [34, 33, 33], 1)
    assert m.sum(1).tolist() == [50, 3, 0, 47] and m.sum(0).tolist() == [34, 33, 33]
    assert abs(sharding.hypergeometric(rng, 10**12, 9 * 10**12, 10**6) - 10**5) < 3000


# --- 9: toxicity


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = label.sum()
    return (order[label == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(label) - pos))


def test_toxicity_held_out(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.1"
    out = toxicity.op9_toxicity(spark, sf).toPandas()
    assert len(out) == documents(spark, sf).count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.3)).all()
    both = out.merge(pd.read_parquet(f"{sf}/labels.parquet")).query("held_out")
    tp = ((both.predicted == 1) & (both.toxic == 1)).sum()
    f1 = 2 * tp / (both.predicted.sum() + both.toxic.sum())
    print("held-out", len(both), "f1", f1, "auc", auc(both.score.values, both.toxic.values))
    assert f1 > 0.75


def test_toxicity_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 1), (5, 1, 0), (6, 1, 0), (7, 1, None), (None, 1, 1), (8, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.train(odd, labels)
    assert toxicity.score(odd, m).count() == len(odd_rows)
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    clash = odd.withColumnsRenamed({"rate": "score", "fp": "threshold"})
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns
    none = toxicity.train(odd, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == len(odd_rows)
    assert rows(toxicity.score(empty, m)) == []


def test_toxicity_forward_pass_word_by_word():
    """The score of a text, place by place and filter by filter, without the model's own vector code."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "idiot", "tree", "sea", "Straße"], rng.integers(0, 12))) for _ in range(40)]
    m = toxicity.fit(texts, np.array([int("idiot tree" in t) for t in texts]))
    for t in [*texts, None, ""]:
        words = re.findall(r"\w+", (t or "").lower())
        rows = [[h % (toxicity.BUCKETS - 1) + 1, (h >> 32) % (toxicity.BUCKETS - 1) + 1] for h in map(xxhash.xxh64_intdigest, words)] or [[0, 0]]
        vectors = [[*m.tables[0][a], *m.tables[1][b]] for a, b in rows] + [[0.0] * 2 * toxicity.DIM] * (max(toxicity.WIDTHS) - 1)
        pooled = []
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                places = [m.bias[k][f] + sum(float(vectors[i + j][d]) * float(m.weights[k][j][d][f]) for j in range(width) for d in range(2 * toxicity.DIM)) for i in range(len(rows))]
                pooled.append(max(0.0, max(places)))
        z = sum(p * float(o) for p, o in zip(pooled, m.out, strict=True)) + m.out_bias
        assert abs(m.scores([t])[0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_pieces_score_as_whole_texts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "idiot", "tree", "sea"], rng.integers(1, 90))) for _ in range(60)]
    m = toxicity.fit(texts, np.array([int("idiot tree" in t) for t in texts]))
    one = np.array([m.scores([t])[0] for t in texts])
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.allclose(m.scores(texts), one, atol=1e-6)


def test_thresholds_by_all_labelled_rows(spark, monkeypatch):
    """A capped sample is half toxic; thresholds must follow the labels' own rate."""
    monkeypatch.setattr(toxicity, "TRAIN_PER_CLASS", 60)
    rng = np.random.default_rng(4)
    toxic = rng.random(4000) < 0.06
    plain = ["tree", "sea", "good", "fine", "road", "house"]
    texts = [" ".join([*rng.choice(plain, 12), *["idiot"] * (rng.random() < (0.9 if y else 0.15)), *["moron"] * (rng.random() < (0.5 if y else 0.01))]) for y in toxic]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, labels)
    s = np.array([m.scores([t])[0] for t in texts])
    f1 = lambda x: 2 * (toxic & (s >= x)).sum() / ((s >= x).sum() + toxic.sum())
    assert f1(m.thresholds[None]) > max(f1(x) for x in np.unique(s)) - 0.03
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert len(kept ^ {i for i in range(4000) if s[i] < m.thresholds[None]}) < 4


# --- 10: LM scores


def naive(net, ids):
    total = 0.0
    for t in range(len(ids)):
        h = np.zeros(lm_score.DIM)
        for k, o in enumerate(x for x in range(-lm_score.SIDE, lm_score.SIDE + 1) if x):
            w = ids[t + o] if 0 <= t + o < len(ids) else lm_score.EDGE
            h += net[k * lm_score.TABLE + w]
        h = np.tanh(h)
        c, m = divmod(int(ids[t]), lm_score.MEMBERS)
        a = net[lm_score.OUT_AT : lm_score.MEMBER_AT] @ h
        b = net[lm_score.MEMBER_AT + c * lm_score.MEMBERS : lm_score.MEMBER_AT + (c + 1) * lm_score.MEMBERS] @ h
        total += a[c] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())
    return total


def test_lm_scores(spark, sf, odd, odd_rows, empty, monkeypatch):
    docs = documents(spark, sf)
    counts = lm_score.count_words(docs)
    assert dict(rows(counts)) == Counter(lm_score.word_hash(w) for r in docs.collect() for w in lm_score.tokens(r.text))
    vocab = lm_score.vocabulary(counts)
    assert len(vocab.own) + len(set(vocab.buckets)) <= lm_score.VOCAB and not set(vocab.own) & set(vocab.buckets)
    net = lm_score.train(docs, vocab)
    got = {r.doc_id: r for r in lm_score.score(docs, net, vocab).collect()}
    for r in docs.limit(4).collect():
        ids = vocab.of(r.text)
        assert got[r.doc_id].n_tokens == len(ids) and abs(got[r.doc_id].log_prob - naive(net.astype(float), ids)) < 1e-3 * len(ids) + 1e-3
    fresh = sum(r.log_prob for r in lm_score.score(docs, lm_score.fresh(), vocab).collect())
    assert sum(r.log_prob for r in got.values()) > 0.8 * fresh  # log-probabilities are negative: nearer to 0 is better
    odd_scores = lm_score.score_words(odd, net, vocab, counts).collect()
    assert len(odd_scores) == len(odd_rows) and all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in odd_scores)
    monkeypatch.setattr(lm_score, "STEP", 5)
    ids = vocab.of("a b c d e f g h i j k l m")
    assert abs(lm_score.score_text(net, ids) - naive(net.astype(float), ids)) < 1e-3
    assert rows(lm_score.score(empty, net, vocab)) == []
    assert lm_score.score_words(empty, *(lambda c: (lm_score.fresh(), lm_score.vocabulary(c), c))(lm_score.count_words(empty))).count() == 0
    lm_score.train(empty, lm_score.vocabulary(lm_score.count_words(empty)))


def test_lm_cut_matches_whole_texts(odd_rows):
    texts = [r[1] for r in odd_rows] + ["Ab\tc-d,e\n\n f\x85g\u3000h  ", "\n", None]
    cut = lm_score.Cut(pa.array(texts, pa.string()))
    got = np.split(cut.words[cut.at], cut.ends[:-1])
    assert [x.tolist() for x in got] == [[lm_score.word_hash(w) for w in lm_score.tokens(t)] for t in texts]


def test_lm_gradient_step():
    """A step moves each parameter by the numeric gradient, for windows that share words."""
    ids = np.repeat(np.random.default_rng(1).integers(0, lm_score.VOCAB, 3), 2)
    net = lm_score.fresh().astype(np.float64) * 3
    near = lm_score.neighbours(ids)
    moved = net.copy()
    lm_score.train_step(moved, ids, near, 1e-6)
    step = (moved - net) / 1e-6
    for r in np.flatnonzero(step.any(1))[::7]:
        e = np.zeros_like(net)
        e[r, r % lm_score.DIM] = 1e-5
        slope = (lm_score.log_probs(net + e, ids, near).sum() - lm_score.log_probs(net - e, ids, near).sum()) / 2e-5
        assert step[r, r % lm_score.DIM] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_lm_trains_on_every_window():
    docs = [np.arange(n) for n in (1, 2, 3, 50, 0, 9)]
    sizes = np.array([len(x) for x in docs])
    assert lm_score.train_on(lm_score.fresh(), iter([(np.concatenate(docs), sizes)]), 0.1) == 65
    together, apart = lm_score.neighbours(np.concatenate(docs), sizes), [lm_score.neighbours(x) for x in docs if len(x)]
    assert np.array_equal(together, np.concatenate(apart, axis=1))


@pytest.mark.parametrize("most", [1_000_000, 300, 0])
def test_lm_gives_each_word_its_own_share(spark, sf, most, monkeypatch):
    """A row's score has the shares of all its words in buckets, wherever their counts are kept."""
    monkeypatch.setattr(lm_score, "TABLE_WORDS", most)
    docs = documents(spark, sf)
    counts = lm_score.count_words(docs)
    vocab = lm_score.vocabulary(counts)
    table, rarer = lm_score.shares(counts, vocab)
    n = {w: k for w, k in rows(counts) if w not in set(vocab.hashes.tolist())}
    whole = Counter()
    for w, k in n.items():
        whole[w & (lm_score.BUCKETS - 1)] += k
    assert len(n) > 1000 and table.whole.tolist() == [whole[b] + 1 for b in range(lm_score.BUCKETS)]
    assert len(table.hashes) <= most and len(table.hashes) + rarer.count() == sum(k > 1 for k in n.values()) and (most < 1000 or not rarer.count())
    net = lm_score.fresh()
    some = spark.createDataFrame([(1, docs.first().text), (2, "zzqx"), (3, None), (1, docs.first().text)], "doc_id long, text string")
    got = sorted(rows(lm_score.score_words(some, net, vocab, counts)), key=key)
    plain = sorted(rows(lm_score.score(some, net, vocab)), key=key)
    assert len(got) == 4 and got[0] == got[1]
    for g, p, text in zip(got, plain, (docs.first().text, docs.first().text, "zzqx", None), strict=True):
        h = [lm_score.word_hash(w) for w in lm_score.tokens(text)]
        inside = sum(np.log(n.get(w, 1) / (whole[w & (lm_score.BUCKETS - 1)] + 1)) for w in h if w in n or w not in vocab.hashes)
        assert g[:2] == p[:2] and abs(g[2] - p[2] - inside) < 1e-6 * max(1, abs(inside)), (g, p, inside)


def test_lm_prefers_its_own_language(spark):
    rng = np.random.default_rng(0)
    text = lambda n: " ".join(["red apple", "blue sky", "green leaf"][i] for i in rng.integers(0, 3, n))
    docs = spark.createDataFrame([(i, text(40)) for i in range(200)], "doc_id long, text string")
    vocab = lm_score.vocabulary(lm_score.count_words(docs))
    net = lm_score.train(docs, vocab)
    assert lm_score.score_text(net, vocab.of("red apple blue sky green leaf")) > lm_score.score_text(net, vocab.of("apple sky red leaf blue green"))


def test_lm_texts_are_cut_once(spark, odd, empty, tmp_path, monkeypatch):
    """Stored hashes count as the texts do and score as they do; the query cuts a text into words once."""
    cut = lm_score.cut_texts(odd)
    counts = lm_score.count_words(odd)
    assert Counter(rows(lm_score.count_words(cut))) == Counter(rows(counts))
    vocab, net = lm_score.vocabulary(counts), lm_score.fresh()
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    got, want = (sorted(rows(lm_score.score_words(x, net, vocab, counts)), key=key) for x in (cut, odd))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert lm_score.cut_texts(empty).count() == 0
    texts = [None, "", "a b a", "b, c", " "]
    stored = pa.array([np.array([lm_score.word_hash(w) for w in lm_score.tokens(t)], np.int64).tobytes() for t in texts], pa.binary())
    for some in (slice(0, 5), slice(3, 5), slice(0, 2), slice(0, 0)):
        a, b = lm_score.Cut(stored[some]), lm_score.Cut(pa.array(texts[some], pa.string()))
        assert a.words[a.at].tolist() == b.words[b.at].tolist() and a.sizes.tolist() == b.sizes.tolist() and a.ends.tolist() == b.ends.tolist()
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    seen, train = [], lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda docs, vocab: (seen.append(docs.schema["text"].dataType.typeName()), train(docs, vocab))[1])
    assert lm_score.op10_lm_score(spark, f"file://{tmp_path}").count() == odd.count() and seen == ["binary"]


def test_lm_scores_texts_that_occur_twice_apart(spark, sf):
    """Texts of made-up words, half of them in two documents: a model of the whole corpus finds the second kind likelier."""
    rng = np.random.default_rng(6)
    made = [" ".join("".join(rng.choice(list("aeioulnrstdkm"), rng.integers(4, 9))) for _ in range(60)) for _ in range(120)]
    plain = documents(spark, sf).select("doc_id", "text")
    twice = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made + made[:60])], "doc_id long, text string")
    docs = plain.unionByName(twice).repartition(4)
    counts = lm_score.count_words(docs)
    vocab = lm_score.vocabulary(counts)
    got = {r.doc_id: r.log_prob for r in lm_score.score_words(docs, lm_score.train(docs, vocab), vocab, counts).collect()}
    two, one = np.array([got[10_000 + i] for i in range(60)]), np.array([got[10_060 + i] for i in range(60)])
    caught = (two > np.quantile(one, 0.9)).mean()
    print("caught at 0.9 of the others left alone:", caught)
    assert caught > 0.9


# --- the pipeline


def alike_representatives(docs):
    """The smallest doc_id of each component of texts whose 5-word sets have a Jaccard of 0.8 or more."""
    data = sorted((r.doc_id, five_grams(r.text)) for r in docs.collect())
    root = {d: d for d, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, g) in enumerate(data):
        for e, h in data[i + 1 :]:
            if len(g & h) >= 0.8 * len(g | h):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {find(d) for d, _ in data}


def test_pipeline_by_stages(spark, sf):
    """Each stage against brute force on its own input."""
    docs = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    model = toxicity.train(docs, labels)
    limit = lambda lang: model.thresholds.get(lang, model.thresholds.get(None, toxicity.THRESHOLD))
    assert set(rows(first)) == {tuple(r) for r in docs.collect() if model.scores([r.text])[0] < limit(r.lang)}
    second = corpus_pipeline.STAGES[1][1](spark, first, sf)
    data = rows(first.select("doc_id", "text"))
    stay = {r[1] for r in duplicates(data)}
    assert sorted(rows(second)) == sorted(r for r in rows(first) if r[0] in stay)
    third = corpus_pipeline.STAGES[2][1](spark, second, sf)
    assert sorted(rows(third)) == sorted(r for r in rows(second) if r[0] in alike_representatives(second))
    fourth = corpus_pipeline.STAGES[3][1](spark, third, sf)
    bench = rows(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))
    clean = {r[0] for r in contamination(rows(third.select("doc_id", "text")), bench) if not r[-1]}
    assert sorted(rows(fourth)) == sorted(r for r in rows(third) if r[0] in clean)
    assert all(x.columns == docs.columns for x in (first, second, third, fourth))
    last = rows(corpus_pipeline.run(spark, sf))
    assert sorted(last) == encoded(rows(fourth.select("doc_id", "text")))


def test_pipeline_by_jaccard(spark, sf):
    """The near-duplicate stage on all documents, exact copies too, against 5-word Jaccard by brute force."""
    docs = documents(spark, sf)
    third = corpus_pipeline.STAGES[2][1](spark, docs, sf)
    assert sorted(r.doc_id for r in third.collect()) == sorted(alike_representatives(docs))


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_and_empty_tables(spark, sf, odd, empty, at):
    name, stage = corpus_pipeline.STAGES[at]
    assert stage(spark, empty, sf).count() == 0
    assert 0 < stage(spark, odd, sf).count() <= odd.count()

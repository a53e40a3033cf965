"""Operator 13, phrase collocation mining by partitions (SON).

Texts are lower-cased (A-Z), cut into pieces at marks and line ends and those into words. A phrase is two to max_words
words of one piece; all counts are per language. A phrase that occurs `support` times in all, over shards of w words of W,
occurs ceil(support * w / W) times in one shard at least. So:

1. all words are counted (pass one);
2. each shard (some two million places of a task, memory is bounded by that) is mined completely at that lowered support,
   pairs first and longer phrases where all their pairs are left over; it sends the slot of a hash and a count for each
   locally frequent phrase, as compressed lists by ranges of slots, about one byte and a half a phrase. The union is the
   candidates. A phrase that a shard doesn't send occurs there less often than the local support, so a slot stays only if
   its sent counts and those gaps can reach the support: two phrases of one slot only add up, none is lost;
3. every candidate's words are counted over all texts, exactly, by the words themselves.

With many shards the local support is 1 and a shard sends each of its phrases once; what bounds the rows then are the
words, and after them the pairs, that are frequent in all. Those sets and the candidates reach the tasks as a Bloom filter
of FILTER_BITS bits at most (16 MB): where it fills up, more rows are counted, with the same result.

Defined results: a null text has no words, a null language is `und`, together with that name's rows; an empty table gives
no rows; repeated rows count each; ties go by count, then by the phrase's bytes; extra columns are ignored. A long text is
a slice of its own and needs some 40 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lean, materialise, slices, words_of

SUPPORT, MAX_WORDS, TOP, CONTAINED = 30, 4, 2000, 80
SLICE, PLACES = 1 << 22, 1 << 21
RANGE = 1 << 21  # places in all texts for each range of slots
FILTER_BITS = 1 << 27
MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\v\f\r", np.uint8))
BLANKS = MARKS | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))


class Words:
    """A slice of texts as word numbers: each word's language and piece, and the words' hashes."""

    def __init__(self, b: pa.RecordBatch) -> None:
        texts = pc.ascii_lower(pc.fill_null(b.column(1).cast(pa.string()), ""))
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[texts.offset :][: len(texts) + 1]
        raw = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = BLANKS[raw]
        solid = ~blank
        clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.where(blank, np.uint8(32), raw)))
        words, cuts = words_of(clean)
        starts = solid.copy()
        starts[1:] &= blank[:-1]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        starts[firsts] = solid[firsts]
        doc = np.repeat(np.arange(len(texts)), np.diff(cuts))
        self.piece = np.cumsum(MARKS[raw])[starts] + doc
        self.words, self.code = words.dictionary, np.asarray(words.indices).astype(np.int64)
        langs = b.column(0).dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), np.asarray(langs.indices)[doc]

    def hashes(self, most: int) -> list[np.ndarray]:
        """Of each place the word's own hash, as Spark's xxhash64, and those of the phrases of 1, 2, ... words that begin
        there, with the language; no phrase of more words than are left."""
        of_word = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in self.words.cast(pa.binary()).to_pylist()), np.uint64, len(self.words))[self.code]
        h = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs), np.uint64, len(self.langs))[self.lang]
        out = [of_word]
        for k in range(min(most, len(of_word))):
            h = mixed(h[: len(h) - (k > 0)] ^ of_word[k:])
            out.append(h)
        return out

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each place on are of one piece."""
        return self.piece[: len(self.piece) - k + 1] == self.piece[k - 1 :]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Slots(NamedTuple):
    """How hashes fall into slots, some 16 for each place in all texts, and slots into ranges."""

    bits: int
    range_bits: int

    @classmethod
    def of(cls, places: int) -> Slots:
        return cls(min(63, max(20, (16 * places).bit_length())), min(20, (places // RANGE).bit_length()))

    def slot(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def key(self, h: np.ndarray) -> np.ndarray:
        """What a filter of slots holds."""
        return mixed(self.slot(h))


class Filter:
    """A Bloom filter of hashes, two bits each."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray) -> None:
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits >> 6, np.uint64)
        self.words[at] = words.view(np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        a, b = h & self.mask, (h >> np.uint64(32)) & self.mask
        one = np.uint64(1)
        return ((self.words[a >> np.uint64(6)] >> (a & np.uint64(63))) & (self.words[b >> np.uint64(6)] >> (b & np.uint64(63))) & one).astype(bool)


def filter_of(hashes: DataFrame):
    """The broadcast filter of a table (h); Spark sets the bits, the driver gets FILTER_BITS of them at most."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (32 * hashes.count()).bit_length()))
    slot = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1)))
    words = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    columns = [words[c].to_numpy().astype(np.int64) for c in ("at", "bits")]
    return hashes.sparkSession.sparkContext.broadcast(Filter(bits, *columns))


def packed(slots: np.ndarray, gains: np.ndarray) -> bytes:
    """Ascending numbers and their gains: differences, byte by byte, compressed."""
    both = np.stack((np.diff(slots, prepend=np.uint64(0)), gains.astype(np.uint64)))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)).tobytes())


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, 8, -1)
    steps, gains = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(np.uint64).reshape(2, -1)
    return np.cumsum(steps, dtype=np.uint64), gains.astype(np.int64)


class Shard:
    """The places of a shard: slots with their language's number, and how many words each language has in it."""

    def __init__(self, support: int, plan: Slots) -> None:
        self.support, self.plan, self.langs, self.totals = support, plan, {}, []
        self.clear()

    def clear(self) -> None:
        self.parts, self.size, self.words = [], 0, np.zeros(len(self.totals), np.int64)

    def add(self, w: Words, totals: dict[str, int], hashes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for x in w.langs:
            if x not in self.langs:
                self.langs[x] = len(self.totals)
                self.totals.append(totals[x])
        own = np.array([self.langs[x] for x in w.langs], np.int32)
        self.words = np.concatenate((self.words, np.zeros(len(self.totals) - len(self.words), np.int64)))
        np.add.at(self.words, own, np.bincount(w.lang, minlength=len(own)))
        for h, at in hashes:
            self.parts.append((self.plan.slot(h[at]), own[w.lang[at]]))
            self.size += len(at)

    def mined(self) -> pa.RecordBatch:
        """(range, slots, slack): by ranges the locally frequent slots, with count less local support plus one. One more
        row has the largest local support less one, by which any language's unsent phrases may fall short."""
        some = np.flatnonzero(self.words)
        least = np.ones(len(self.words), np.int64)
        least[some] = [-(-self.support * int(self.words[i]) // max(self.totals[i], 1)) for i in some]
        ranges, blobs = [None], [None]
        if self.size:
            slot, lang = (np.concatenate([p[x] for p in self.parts]) for x in (0, 1))
            order = np.argsort(slot)
            slot = slot[order]
            first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            gain = np.diff(np.append(first, len(slot))) - np.minimum.reduceat(least[lang[order]], first) + 1
            slot, gain = slot[first][gain > 0], gain[gain > 0]
            rest = np.uint64(self.plan.bits - self.plan.range_bits)
            own, cuts = np.unique(slot >> rest, return_index=True)
            slot &= (np.uint64(1) << rest) - np.uint64(1)
            for r, a, b in zip(own.tolist(), cuts.tolist(), [*cuts.tolist(), len(slot)][1:], strict=True):
                ranges.append(r)
                blobs.append(packed(slot[a:b], gain[a:b]))
        slack = [int(least[some].max(initial=1)) - 1, *[0] * (len(ranges) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(blobs, pa.binary()), pa.array(slack, pa.int64())], ["range", "slots", "slack"])


def _reached(batches: Iterator[pa.RecordBatch], plan: Slots, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (range, slots), whole ranges one after the other -> (h): the filter's keys of slots whose gains reach it."""
    at, parts = None, []

    def close() -> pa.RecordBatch:
        slot, gain = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
        order = np.argsort(slot)
        slot = slot[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        enough = np.add.reduceat(gain[order], first) >= least
        slot = slot[first][enough] | np.uint64(at << (plan.bits - plan.range_bits))
        return pa.RecordBatch.from_arrays([pa.array(mixed(slot).view(np.int64))], ["h"])

    for b in batches:
        for r, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if r != at:
                if parts:
                    yield close()
                at, parts = r, []
            parts.append(unpacked(blob.as_py()))
    if parts:
        yield close()


def lang_texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in lean(batches):
        yield from slices(whole, 1, SLICE)


def _counted(w: Words, values: pa.Array, lang: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of a slice's values."""
    for k in np.unique(lang).tolist():
        counts = pc.value_counts(values.filter(pa.array(lang == k)) if len(w.langs) > 1 else values)
        yield pa.RecordBatch.from_arrays([pa.array([w.langs[k]] * len(counts), pa.string()), counts.field(0), counts.field(1)], ["lang", "phrase", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of single words, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            w = Words(b)
            if not len(w.code):
                continue
            key = w.lang.astype(np.int64) * len(w.words) + w.code
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.string()).take(pa.array(w.lang[first])), w.words.take(pa.array(w.code[first])), pa.array(n)], ["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def candidates(texts: DataFrame, totals: DataFrame, sizes: range, parts, support: int, plan: Slots, name: str) -> DataFrame:
    """(h): keys of the slots of phrases of these sizes that may reach the support. parts: the filter of what they are made
    of, words for pairs, and pairs for longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fits, many = Shard(support, plan), parts.value, 1 if sizes[0] == 2 else 2
        for b in _sliced(batches):
            w = Words(b)
            h = w.hashes(max(sizes))
            if len(h) <= many:
                continue
            good = (fits(h[0]) if many == 1 else fits(plan.key(h[many]))) & w.inside(many)
            hashes = []
            for k in sizes:
                if len(h) > k:
                    n, ok = len(h[k]), w.inside(k)
                    for j in range(k - many + 1):
                        ok &= good[j : j + n]
                    hashes.append((h[k], np.flatnonzero(ok)))
            shard.add(w, dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)), hashes)
            if shard.size >= PLACES:
                yield shard.mined()
                shard.clear()
        yield shard.mined()

    sent = materialise(texts.join(totals, "lang").select("lang", "text", "total").mapInArrow(run, "range long, slots binary, slack long"), name)
    slack = sent.agg(F.coalesce(F.sum("slack"), F.lit(0))).first()[0]
    dealt = sent.filter("range is not null").select("range", "slots").repartition("range").sortWithinPartitions("range")
    return materialise(dealt.mapInArrow(lambda batches: _reached(batches, plan, support - slack), "h long"), f"{name}-left")


def count_phrases(texts: DataFrame, wanted, most: int, plan: Slots) -> DataFrame:
    """(lang, phrase, n) of the phrases of 2 to most words whose slot is in the filter, counted by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = wanted.value
        for b in _sliced(batches):
            w = Words(b)
            for k, h in list(enumerate(w.hashes(most)))[2:]:
                at = np.flatnonzero(fits(plan.key(h)) & w.inside(k))
                if len(at):
                    words = [w.words.take(pa.array(w.code[at + j])) for j in range(k)]
                    yield from _counted(w, pc.binary_join_element_wise(*words, " "), w.lang[at])

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, total), (lang, phrase, n) of all words, and (lang, phrase, n) of all phrases with the support."""
    if support < 1 or max_words < 2:
        raise ValueError("a phrase has two words and occurs once at least")
    texts = lang_texts(docs, lang_col, text_col)
    words = materialise(count_words(texts), "words")
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    plan = Slots.of(totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0])
    pairs = candidates(texts, totals, range(2, 3), filter_of(words.filter(F.col("n") >= support).select(F.xxhash64("phrase").alias("h"))), support, plan, "pairs")
    found = [pairs]
    if max_words > 2:
        found.append(candidates(texts, totals, range(3, max_words + 1), filter_of(pairs), support, plan, "longer"))
    counted = count_phrases(texts, filter_of(reduce(DataFrame.unionByName, found)), max_words, plan)
    return totals, words, materialise(counted.filter(F.col("n") >= support), "phrases")


def joined(words: str, start: str, size: str) -> F.Column:
    return F.expr(f"array_join(slice({words}, {start}, {size}), ' ')")


def collocations(docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, top: int = TOP, contained: int = CONTAINED, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases. A phrase cut after its first k words has
    l and r occurrences of its two parts and the score floor(2000000 * a / (l + r)); its lowest cut counts. Phrases that
    lie inside a longer one with `contained` percent of their occurrences are left out."""
    totals, words, phrases = mine(docs, support, max_words, lang_col, text_col)
    own = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    sizes = F.size("words")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), sizes - 1))).select("lang", "phrase", "a", "k", joined("words", "1", "k").alias("head"), joined("words", "k + 1", "size(words) - k").alias("tail"))
    parts = words.filter(F.col("n") >= support).unionByName(phrases.filter(F.size(F.split("phrase", " ")) < max_words))
    heads, tails = parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r)")  # may pass 64 bits
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = own.filter(sizes > 2).withColumn("size", F.explode(F.sequence(F.lit(2), sizes - 1))).withColumn("start", F.explode(F.sequence(F.lit(1), sizes - F.col("size") + 1)))
    longer = inner.select("lang", joined("words", "start", "size").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < contained * F.col("a").cast("decimal(20,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spread AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spread, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS j FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1:len(w)], ' ')),
best AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, a FROM (SELECT lang, w, k, a, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM c))),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY ALL),
left_ AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 80 * best.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_) JOIN totals USING (lang) WHERE rank <= 2000
"""

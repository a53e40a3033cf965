"""Operator 10, LM scoring: masked pseudo-likelihood of a bidirectional window network in numpy.

Each token is predicted from SIDE tokens on either side. Position-wise embeddings of the neighbours are summed
and squashed; a softmax over classes and one over the members of the token's class give its probability, so a
token costs about 2 * sqrt(vocabulary) outputs. The summed conditional log-probabilities score a document.

The vocabulary is the most frequent words of all documents (counted by Spark over every text), and hash
buckets for the other words, in order of frequency. A word of a bucket has the bucket's probability by the network
times the word's own share of the bucket, from the counts of all words (a count of one is kept in each bucket for
all words that were never counted), so every counted word has its own probability. The counts of the TABLE_WORDS
most frequent words are broadcast; the rarer words of a document meet theirs in a join.

Words are known by their XXH64. Texts are cut once, at ASCII white space by Arrow, and each distinct piece of a slice of
texts into words once; what is counted, trained on and scored is the stored table of each text's hashes. Training is data-parallel: in each of ROUNDS rounds, a
share of the documents, every one in exactly one round, trains a copy of the network per partition on all
its windows; Spark sums the copies, weighted by their windows, parameter row by parameter row. What crosses
the network grows with the number of partitions; what reaches the driver is one network (ROWS_OF_16 rows).

Defined results: null and wordless texts have no tokens and log_prob 0, mean null; texts of any length are
scored whole, in steps of STEP words; repeated rows score alike; extra columns are
ignored; an empty table trains on nothing and gives an empty result. Without randomness beyond a seed, results
vary only with how the input is split, as any sum over partitions of a trained network does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialise, slices

SIDE = 2
DIM = 16
CLASSES = 32
MEMBERS = 48
BUCKETS = 256
VOCAB = CLASSES * MEMBERS  # BUCKETS of them for the words that are not among the most frequent
EDGE = VOCAB  # before the first and after the last token
ROUNDS = 2
BATCH = 1024
RATE = 0.15
STEP = 1 << 12
SLICE = 1 << 22
FLUSH = 400_000
TABLE_WORDS = 1_000_000  # 16 bytes each
WORD = re.compile(r"\w+|[^\w\s]")
WORD_OR_END = re.compile(r"\w+|[^\w\s]|\n")
TABLE = VOCAB + 1
OUT_AT = 2 * SIDE * TABLE
MEMBER_AT = OUT_AT + CLASSES
ROWS_OF_16 = MEMBER_AT + VOCAB


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hash(word: str) -> int:
    """The XXH64 of a word, signed."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class Cut:
    """The words of a slice of texts: `words` are the distinct hashes, `at` the index in it of each word of the
    texts, one text after the other; `ends` is where each text ends. Texts that are binary are hashes already (see cut_texts)."""

    def __init__(self, texts: pa.Array) -> None:
        if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
            whole = texts.cast(pa.large_binary())
            offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset :][: len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
            data = whole.buffers()[2] if offsets[-1] > offsets[0] else b""
            coded = pa.array(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(np.int64)).dictionary_encode()
            self.words, self.at = coded.dictionary.to_numpy(), np.asarray(coded.indices)
            self.ends = (offsets[1:] - offsets[0]) // 8
            self.sizes = np.diff(offsets) // 8
            return
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        offsets = np.asarray(cut.offsets).astype(np.int64)
        pieces = cut.flatten().dictionary_encode()
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary), "\n")
        coded = pa.array(WORD_OR_END.findall(lines[0].as_py().lower()), pa.string()).dictionary_encode()
        code = np.asarray(coded.indices)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        end = names.index("\n") if "\n" in names else -1
        inside = code != end
        sizes = np.diff(np.concatenate(([0], np.cumsum(inside)[~inside], [int(inside.sum())])))  # words of each piece
        if not len(pieces.dictionary):
            sizes = sizes[:0]
        flat, starts = code[inside], np.cumsum(sizes) - sizes
        where = np.asarray(pieces.indices)
        each = sizes[where]
        upto = np.cumsum(each)
        take = np.repeat(starts[where] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)
        self.words = np.array(list(map(xxhash.xxh64_intdigest, names)), np.uint64).view(np.int64)
        self.at = flat[take]
        self.ends = np.concatenate(([0], upto))[offsets[1:] - offsets[0]]
        self.sizes = np.diff(np.concatenate(([0], self.ends)))


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns, with each text's words in place of it: their hashes, of 8 bytes each, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                cut = Cut(b.column(1))
                data = pa.py_buffer(cut.words[cut.at].tobytes())
                ends = pa.py_buffer(np.concatenate(([0], cut.ends * 8)).astype(np.int64).tobytes())
                words = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, ends, data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), words], [id_col, text_col])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, `{text_col}` binary")


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, each word by its hash; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            w, at = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(w)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], ["word", "n"])

        for whole in batches:
            for b in slices(whole, 0, SLICE):
                cut = Cut(b.column(0))
                n = np.bincount(cut.at, minlength=len(cut.words))
                words.append(cut.words[n > 0])
                counts.append(n[n > 0])
                held += len(words[-1])
                if held > FLUSH:
                    some = out()
                    words, counts, held = [some.column(0).to_numpy()], [some.column(1).to_numpy()], some.num_rows
                    if held > FLUSH // 2:
                        yield some
                        words, counts, held = [], [], 0
        if words:
            yield out()

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Ids:
    """Word hash -> id: the most frequent words have their own, the others their bucket's."""

    def __init__(self, words: np.ndarray, buckets: np.ndarray) -> None:
        self.order = np.argsort(words[:, 0]) if len(words) else np.zeros(0, np.int64)
        self.hashes, self.own = words[self.order, 0], words[self.order, 1]
        self.buckets = buckets

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & (BUCKETS - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.buckets[self.bucket(hashes)]
        known = self.known(hashes)
        out[known] = self.own[np.searchsorted(self.hashes, hashes[known])]
        return out

    def of(self, text: str | None) -> np.ndarray:
        return self(np.array([word_hash(w) for w in tokens(text)], np.int64))


def vocabulary(counts: DataFrame) -> Ids:
    """Ids of the most frequent words and of the hash buckets: VOCAB ids, ordered by frequency."""
    top = counts.orderBy(F.desc("n"), "word").limit(VOCAB - BUCKETS).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    each = max(0, total - sum(r.n for r in top)) / BUCKETS
    names = sorted([(-r.n, 0, r.word) for r in top] + [(-each, 1, i) for i in range(BUCKETS)])
    words = np.array([(w, i) for i, (_, kind, w) in enumerate(names) if not kind], np.int64).reshape(-1, 2)
    return Ids(words, np.array([i for i, (_, kind, _) in sorted(enumerate(names), key=lambda x: x[1][2]) if kind], np.int64))


def fresh(seed: int = 5) -> np.ndarray:
    """The network: one row of DIM numbers per neighbour position and token, per class, and per token."""
    return np.random.default_rng(seed).normal(0, 0.1, (ROWS_OF_16, DIM)).astype(np.float32)


def neighbours(ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """(2 * SIDE, n) parameter rows of the neighbours of each token; of texts of these sizes, one after the other."""
    sizes = np.array([len(ids)]) if sizes is None else sizes
    padded = np.full(len(ids) + SIDE * (len(sizes) + 1), EDGE, np.int64)
    at = np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[at] = ids
    offsets = [o for o in range(-SIDE, SIDE + 1) if o]
    return np.stack([padded[at + o] + k * TABLE for k, o in enumerate(offsets)])


def hidden(net: np.ndarray, near: np.ndarray) -> np.ndarray:
    h = net.take(near[0], axis=0)
    for k in range(1, len(near)):
        h += net.take(near[k], axis=0)
    return np.tanh(h, out=h)


def by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The order of the tokens by class, and for each class in it: from, to, and the rows of its members."""
    cls = (ids // MEMBERS).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(CLASSES + 1, dtype=np.int16)).tolist()
    spans = [(ends[c], ends[c + 1], MEMBER_AT + c * MEMBERS, MEMBER_AT + (c + 1) * MEMBERS) for c in range(CLASSES)]
    return order, [x for x in spans if x[0] < x[1]]


def logits(net: np.ndarray, h: np.ndarray, spans: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For tokens in the order of by_class: (n, CLASSES), and (n, MEMBERS) for the members of the token's class."""
    inner = np.empty((len(h), MEMBERS), h.dtype)
    for a, b, lo, hi in spans:
        np.matmul(h[a:b], net[lo:hi].T, out=inner[a:b])
    return h @ net[OUT_AT:MEMBER_AT].T, inner


def log_probs(net: np.ndarray, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The conditional log-probability of each token, given its neighbours' rows; in steps that fit a cache."""
    out = np.empty(len(ids), net.dtype)
    for at in range(0, len(ids), STEP):
        some = ids[at : at + STEP]
        order, spans = by_class(some)
        own = some[order]
        cls, member = np.divmod(own, MEMBERS)
        place = np.arange(len(own))
        p = np.zeros(len(own), net.dtype)
        for z, label in zip(logits(net, hidden(net, near[:, at : at + STEP][:, order]), spans), (cls, member), strict=True):
            p += z[place, label]
            p -= np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))
        out[at + order] = p
    return out


def errors(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The gradient of the log-probability of the labels by the logits z, in place of them."""
    np.exp(z, out=z)
    z *= (-1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z[np.arange(len(z)), label] += 1
    return z


def train_step(net: np.ndarray, ids: np.ndarray, near: np.ndarray, rate: float) -> None:
    """One step of gradient ascent on the mean conditional log-probability, in place."""
    order, spans = by_class(ids)
    ids, near = ids[order], near.take(order, axis=1)
    h = hidden(net, near)
    cls, member = np.divmod(ids, MEMBERS)
    outer, inner = logits(net, h, spans)
    outer, inner = errors(outer, cls), errors(inner, member)
    back, inside = outer @ net[OUT_AT:MEMBER_AT], np.empty_like(h)
    step = np.zeros((ROWS_OF_16 - OUT_AT, DIM), net.dtype)
    step[:CLASSES] = outer.T @ h
    for a, b, lo, hi in spans:
        np.matmul(inner[a:b], net[lo:hi], out=inside[a:b])
        np.matmul(inner[a:b].T, h[a:b], out=step[lo - OUT_AT : hi - OUT_AT])
    net[OUT_AT:] += rate * np.clip(step, -5, 5, out=step)
    back += inside
    back *= 1 - h * h
    np.clip(back, -1, 1, out=back)
    back *= np.float32(rate)
    flat, columns = net.reshape(-1), np.arange(DIM)
    for rows in near:
        np.add.at(flat, (rows[:, None] * DIM + columns).ravel(), back.ravel())


def train_on(net: np.ndarray, texts: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> int:
    """Train in place on every window of (ids, sizes of the texts); the number of windows."""
    seen = 0
    for ids, sizes in texts:
        near = neighbours(ids, sizes)
        order = np.random.default_rng(len(ids)).permutation(len(ids))
        for at in range(0, len(ids), BATCH):
            some = order[at : at + BATCH]
            train_step(net, ids[some], near.take(some, axis=1), rate / 8)
        seen += len(ids)
    return seen


def train(docs: DataFrame, vocab: Ids, text_col: str = "text") -> np.ndarray:
    """The network after ROUNDS rounds over all documents."""
    spark = docs.sparkSession
    net = fresh()
    schema = "part_row int, weight double, " + ", ".join(f"d{i} float" for i in range(DIM))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((net, vocab))
        rate = RATE / (1 + r)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            start, table = shared.value
            own = start.copy()

            def texts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for whole in batches:
                    for b in slices(whole, 0, SLICE):
                        cut = Cut(b.column(0))
                        yield table(cut.words)[cut.at], cut.sizes

            n = train_on(own, texts(), rate)
            if n:
                moved = np.flatnonzero((own != start).any(1))
                change = (own - start)[moved]
                names = ["part_row", "weight", *(f"d{i}" for i in range(DIM))]
                yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), pa.array(np.full(len(moved), float(n))), *(pa.array(change[:, i]) for i in range(DIM))], names)

        share = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)) == r).select(text_col)
        mean = [(F.sum(F.col(f"d{i}") * F.col("weight")) / F.sum("weight")).alias(f"d{i}") for i in range(DIM)]
        rows = share.mapInArrow(run, schema).groupBy("part_row").agg(*mean).collect()  # at most ROWS_OF_16
        net = net.copy()
        if rows:
            net[[x[0] for x in rows]] += np.array([x[1:] for x in rows], np.float32)
    return net


def score_text(net: np.ndarray, ids: np.ndarray) -> float:
    return float(log_probs(net, ids, neighbours(ids)).sum(dtype=np.float64))


class Shares:
    """The counts of the most frequent words that are in buckets, and each bucket's count of all its words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts, self.whole = hashes[order], counts[order], whole

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log of each word's count where the table has it, else 0; and which it lacks."""
        if not len(self.hashes):
            return np.zeros(len(hashes)), np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        met = self.hashes[at] == hashes
        return np.where(met, np.log(self.counts[at]), 0.0), ~met


def shares(counts: DataFrame, vocab: Ids) -> tuple[Shares, DataFrame]:
    """The table that is broadcast, and (word, n) of the words that it lacks and that were counted twice or more:
    the log of a count of one is 0."""
    spark = counts.sparkSession
    names = F.broadcast(spark.createDataFrame([(int(w),) for w in vocab.hashes], "word long"))  # at most VOCAB
    rare = counts.join(names, "word", "left_anti")
    whole = np.ones(BUCKETS, np.int64)
    for b, n in rare.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.sum("n")).collect():
        whole[b] += n
    sizes = rare.filter("n > 1").groupBy("n").count()  # a row a distinct count
    upto = sizes.withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("n"))))
    least = upto.filter(F.col("upto") <= TABLE_WORDS).agg(F.min("n")).first()[0] or 1 << 62
    top = rare.filter(F.col("n") >= least).toArrow()  # TABLE_WORDS rows at most
    table = Shares(top.column("word").to_numpy(), top.column("n").to_numpy(), whole)
    return table, rare.filter((F.col("n") > 1) & (F.col("n") < least))


def score(docs: DataFrame, net: np.ndarray, vocab: Ids, table: Shares | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob: one row per row, by the network alone; with a table also the share in its bucket
    of each word that is in one, but for the logs of the counts of `words`, which the table lacks: (hash, times)."""
    shared = docs.sparkSession.sparkContext.broadcast((net, vocab, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids_of, own = shared.value
        for whole in batches:
            for b in slices(whole, 1, SLICE):
                cut = Cut(b.column(1))
                ids = ids_of(cut.words)[cut.at]
                p = log_probs(model, ids, neighbours(ids, cut.sizes)).astype(np.float64)
                text = np.repeat(np.arange(b.num_rows), cut.sizes)
                lists: list[np.ndarray] = [np.zeros(b.num_rows, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
                if own is not None:
                    log_n, lacks = own.of(cut.words)
                    inside = ~ids_of.known(cut.words)
                    p += np.where(inside, log_n - np.log(own.whole[ids_of.bucket(cut.words)]), 0.0)[cut.at]
                    rare = (lacks & inside)[cut.at]
                    pairs, times = np.unique(text[rare] * len(cut.words) + cut.at[rare], return_counts=True)
                    lists = [np.bincount(pairs // len(cut.words), minlength=b.num_rows) if len(pairs) else lists[0], cut.words[pairs % max(1, len(cut.words))], times]
                total = np.bincount(text, p, b.num_rows).astype(np.float64)
                words = pa.StructArray.from_arrays([pa.array(lists[1]), pa.array(lists[2])], ["word", "times"])
                words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lists[0]))), pa.int32()), words)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut.sizes), pa.array(total), words], ["doc_id", "n_tokens", "log_prob", "words"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_tokens long, log_prob double, words array<struct<word:long,times:long>>")
    return out if table is not None else out.drop("words")


def score_words(docs: DataFrame, net: np.ndarray, vocab: Ids, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob: one row per row, each word by its own probability."""
    table, rarer = shares(counts, vocab)
    rows = score(docs, net, vocab, table, id_col, text_col).withColumn("__row", F.monotonically_increasing_id())
    rows = materialise(rows, "lm-scores")  # so the row numbers stay
    inside = rows.select("__row", F.inline("words")).join(rarer, "word").groupBy("__row").agg(F.sum(F.col("times") * F.log("n")).alias("inside"))
    total = F.col("log_prob") + F.coalesce("inside", F.lit(0.0))
    out = rows.drop("words").join(inside, "__row", "left").withColumn("log_prob", total)
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialise(cut_texts(documents(spark, sf_dir)), "lm-words")
    counts = materialise(count_words(docs), "lm-counts")
    vocab = vocabulary(counts)
    return score_words(docs, train(docs, vocab), vocab, counts)

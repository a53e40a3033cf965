"""Operator 9, toxicity: a convolutional text classifier trained in numpy.

Words are hashed twice into two embedding tables (a word that shares one bucket with another hardly shares
both); filters of widths 1 to 3 slide over the whole text, ReLU and max pooling keep each filter's strongest
place, and a logistic layer scores. Training fits a bounded sample of labelled rows on the driver (at most
TRAIN_PER_CLASS rows per class, texts of at most TRAIN_CHARS characters); scoring runs over whole texts in
Arrow batches, in pieces of PIECE words, so a text of any length takes bounded memory.

The score sees the text alone. Thresholds are calibrated by language on all labelled rows that were not fitted,
as many as there are, from counts by BIN of the score's log-odds: the threshold with the best F1 where a language
has CALIBRATE_POSITIVES toxic rows there, else all languages' one.
Labels are read only from rows whose crc32(doc_id as text) mod 4 is not 2.

Defined results: null and wordless texts get the score of an empty text; an unknown or null language gets the
common threshold; without usable labels of both classes every score is 0 and nothing is rejected; repeated
rows score alike; extra columns are carried by `drop_toxic`; conflicting labels of one doc_id count as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, materialise, slices, unused

BUCKETS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
TRAIN_PER_CLASS = 4000
TRAIN_CHARS = 20_000
EPOCHS = 6
BATCH = 32
PIECE = 1 << 16
SLICE = 1 << 22
CALIBRATE_POSITIVES = 30
THRESHOLD = 0.3
BIN = 0.01
WORD = re.compile(r"\w+")


def hashed(text: str | None) -> np.ndarray:
    """Two bucket numbers a word, (n, 2); an empty text is one empty place. Bucket 0 is kept empty."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in WORD.findall((text or "").lower())], np.uint64)
    if not len(h):
        return np.zeros((1, 2), np.int32)
    return np.stack([h % np.uint64(BUCKETS - 1) + np.uint64(1), (h >> np.uint64(32)) % np.uint64(BUCKETS - 1) + np.uint64(1)], axis=1).astype(np.int32)


@dataclass
class Model:
    tables: np.ndarray  # (2, BUCKETS, DIM); row 0 is zero
    weights: list[np.ndarray]  # per width (width, 2 * DIM, FILTERS)
    bias: np.ndarray  # (len(WIDTHS), FILTERS)
    out: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    fitted: bool = True

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[0][ids[:, 0]], self.tables[1][ids[:, 1]]], axis=1)

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """(places, widths * filters): each filter at each place, before ReLU; places after the end are empty."""
        x = self.embed(np.concatenate([ids, np.zeros((max(WIDTHS) - 1, 2), np.int32)]))
        n = len(ids)
        stacked = np.concatenate([w[j] for w in self.weights for j in range(len(w))], axis=1)
        y = x @ stacked
        out, at = np.empty((n, len(WIDTHS) * FILTERS), np.float32), 0
        for k, width in enumerate(WIDTHS):
            r = out[:, k * FILTERS : (k + 1) * FILTERS]
            r[:] = self.bias[k]
            for j in range(width):
                r += y[j : j + n, at : at + FILTERS]
                at += FILTERS
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        features = np.zeros((len(texts), len(self.out)), np.float32)
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            gap = np.zeros((max(WIDTHS) - 1, 2), np.int32)
            ids = np.concatenate([p for _, _, x in held for p in (x, gap)])
            ends = np.cumsum([len(x) + len(gap) for _, _, x in held])
            starts = np.concatenate(([0], ends[:-1]))
            edges = np.stack([starts, starts + [n for _, n, _ in held]], axis=1).ravel()
            top = np.maximum.reduceat(self.responses(ids), edges, axis=0)[::2]
            np.maximum.at(features, [i for i, _, _ in held], top)  # ReLU: features start at 0

        over = max(WIDTHS) - 1
        for i, t in enumerate(texts):
            ids = hashed(t)
            for a in range(0, len(ids), PIECE):  # pieces overlap, so that each place sees all its words
                held.append((i, min(PIECE, len(ids) - a), ids[a : a + PIECE + over]))
                size += len(held[-1][2])
                if size >= PIECE:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        z = features.astype(np.float64) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the dense layers, Adagrad on the embeddings; gradients pass through the pooled places only."""
    rng = np.random.default_rng(seed)
    d2, f = 2 * DIM, len(WIDTHS) * FILTERS
    tables = rng.normal(0, 0.1, (2, BUCKETS, DIM)).astype(np.float32)
    model = Model(tables, [rng.normal(0, 0.3, (w, d2, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.3, f).astype(np.float32), 0.0)
    if len(set(labels.tolist())) < 2:
        tables[:] = 0
        model.fitted = False
        return model
    ids = [hashed(t) for t in texts]
    for side in (0, 1):  # the first dimension starts as the smoothed log-odds of the word's documents
        seen = np.zeros((2, BUCKETS))
        for x, y in zip(ids, labels, strict=True):
            seen[y, np.unique(x[:, side])] += 1
        rate = labels.mean()
        tables[side][:, 0] += np.clip(np.log((seen[1] + 20 * rate) / (seen[0] + 20 * (1 - rate))) - np.log(rate / (1 - rate)), -1, 4) / 2
        tables[side][0] = 0
    model.out_bias = float(np.log(labels.mean() / (1 - labels.mean())))
    dense = [*model.weights, model.bias, model.out]
    m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    heat = np.full((2, BUCKETS), 1e-2, np.float32)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ids))
        rate = 0.01 * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in dense]
            bias_grad, touched = 0.0, []
            some = order[at : at + BATCH]
            for i in some:
                r = model.responses(ids[i])
                best = r.argmax(0)
                top = np.maximum(r[best, np.arange(f)], 0)
                delta = 1 / (1 + np.exp(-np.clip(top @ model.out + model.out_bias, -30, 30))) - labels[i]
                grads[-1] += delta * top
                bias_grad += delta
                back = np.where(top > 0, delta * model.out, 0).astype(np.float32)
                for k, width in enumerate(WIDTHS):
                    g = back[k * FILTERS : (k + 1) * FILTERS]
                    grads[-2][k] += g
                    for j in range(width):
                        place = best[k * FILTERS : (k + 1) * FILTERS] + j
                        inside = (place < len(ids[i])) & (g != 0)
                        if inside.any():
                            rows = ids[i][place[inside]]
                            grads[k][j][:, inside] += model.embed(rows).T * g[inside]
                            touched.append((rows, (model.weights[k][j][:, inside] * g[inside]).T))
            step += 1
            for n, (p, g) in enumerate(zip(dense, grads, strict=True)):
                g /= len(some)
                m[n] += 0.1 * (g - m[n])
                v[n] += 0.01 * (g * g - v[n])
                p -= rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-6)
            model.out_bias -= 0.05 * bias_grad / len(some)
            if touched:
                rows, g = np.concatenate([a for a, _ in touched]), np.concatenate([b for _, b in touched]) / len(some)
                for side in (0, 1):
                    part = g[:, side * DIM : (side + 1) * DIM]
                    np.add.at(heat[side], rows[:, side], (part * part).sum(1))
                    np.add.at(tables[side], rows[:, side], -0.05 * part / np.sqrt(heat[side][rows[:, side], None]))
                    tables[side][0] = 0
    return model


def best_threshold(bins: list[tuple[float, float, int, int]]) -> float:
    """Of (lowest score, highest score, rows, toxic rows) the lowest score of the bin down to which rejecting has
    the best F1; halfway to the next lower score."""
    low, high, n, toxic = map(np.array, zip(*sorted(bins, reverse=True), strict=True))
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    k = int(f1.argmax())
    return float((low[k] + high[k + 1]) / 2) if k + 1 < len(low) else float(low[k]) / 2


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, list[int]]:
    """The model without thresholds, and the ids it was fitted on. Collects at most 2 * TRAIN_PER_CLASS labelled
    rows; their ids, so bounded, are broadcast to find them."""
    usable = usable_labels(labels)
    pick = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_PER_CLASS) for y in (0, 1)]
    pick = F.broadcast(pick[0].unionByName(pick[1]).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")))
    found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    found = found.filter((F.char_length("__text") <= TRAIN_CHARS) & (F.pmod(F.xxhash64("__doc"), F.lit(5)) != 0))
    found = found.join(pick, F.col("__doc") == F.col("__id")).orderBy("__doc", F.xxhash64("__text"))
    rows = found.select("__text", "__doc", "__toxic").limit(2 * TRAIN_PER_CLASS).collect()
    # the two classes were sampled apart: weigh the score back to the labels' own rates
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    y = np.array([r[2] for r in rows], np.int64)
    model = fit([r[0] for r in rows], y)
    if model.fitted and counts.get(0) and counts.get(1):
        model.out_bias += float(np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean())))
    return model, sorted({r[1] for r in rows})


def calibrate(model: Model, scored: DataFrame, labels: DataFrame, fitted: list[int]) -> Model:
    """Sets the thresholds by all rows (doc_id, lang, score) with usable labels that were not fitted."""
    spark = scored.sparkSession
    used = F.broadcast(spark.createDataFrame([(i,) for i in fitted], "doc_id long"))
    rows = scored.join(usable_labels(labels), "doc_id").join(used, "doc_id", "left_anti")
    odds = F.floor(F.log(F.col("score") / (1 - F.col("score"))) / BIN)
    bins = rows.groupBy("lang", odds.alias("bin")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    bins = materialise(bins, "toxicity-bins")  # at most 60 / BIN rows a language
    both = bins.groupBy("bin").agg(F.min("low"), F.max("high"), F.sum("n"), F.sum("toxic").alias("toxic")).collect()
    if sum(r.toxic for r in both):
        model.thresholds[None] = best_threshold([tuple(r)[1:] for r in both])
    enough = bins.filter("lang is not null").groupBy("lang").agg(F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= CALIBRATE_POSITIVES)
    for (lang,) in enough.select("lang").collect():
        own = bins.filter(F.col("lang") == lang).select("low", "high", "n", "toxic").collect()
        model.thresholds[lang] = best_threshold([tuple(r) for r in own])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model with thresholds."""
    model, fitted = fit_sample(docs, labels, id_col, text_col)
    if not model.fitted:
        return model
    return calibrate(model, materialise(scored(docs, model, id_col, text_col), "toxicity-scores"), labels, fitted)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang, score): one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in lean(batches) for s in slices(whole, 2, SLICE)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(shared.value.scores(b.column(2).to_pylist()))], ["doc_id", "held_out", "lang", "score"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang string, score double")


def threshold(model: Model, lang: Column) -> Column:
    common = F.lit(model.thresholds.get(None, THRESHOLD))
    own = [x for k, v in model.thresholds.items() if k is not None for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*own), lang), common) if own else common


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, threshold): one row per row."""
    return scored(docs, model, id_col, text_col).withColumn("threshold", threshold(model, F.col("lang"))).drop("lang")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows under their language's threshold, with all their columns; no text is shuffled, and each is scored
    once: the rows are written with their scores, and the thresholds are taken from there."""
    model, fitted = fit_sample(docs, labels, text_col=text_col)
    if not model.fitted:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = unused(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in lean(batches) for s in slices(whole, whole.schema.get_field_index(text_col), SLICE)):
            yield b.append_column(name, pa.array(shared.value.scores(b.column(text_col).to_pylist())))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = materialise(docs.mapInArrow(run, f"{names}, `{name}` double"), "toxicity-scored")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    calibrate(model, rows.select("doc_id", lang.alias("lang"), F.col(name).alias("score")), labels, fitted)
    return rows.filter(F.col(name) < threshold(model, lang)).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, fitted = fit_sample(docs, labels)
    rows = materialise(scored(docs, model), "toxicity-scores")
    if model.fitted:
        calibrate(model, rows, labels, fitted)
    out = rows.withColumn("threshold", threshold(model, F.col("lang"))).drop("lang")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumn("rejected", F.col("score") >= F.col("threshold"))

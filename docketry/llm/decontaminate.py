"""Operator 3, benchmark decontamination by winnowing, DataFrame functions only.

The hashes of all GRAM-word grams are laid out over a text; of each window of ten words (six grams) the smallest
hash is kept (one of equal ones), once for all the windows in which it is the smallest: some two of seven
grams. Two texts that share ten words share that window's fingerprint, so joining the fingerprints of documents and
benchmark loses no shared span of ten words. Each hit is extended to the windows around its gram, their words are
compared, and overlapping windows unite into spans of any length. Benchmark items of fewer than ten words are one
window each: their fingerprint is the hash of all their words, looked up at each position, in the same scan.

One scan of the documents gives the fingerprints. The benchmark's fingerprints and windows are broadcast where their
bytes are counted to be at most BROADCAST_BYTES, and the hits are extended in the scan; beyond, the join shuffles
(row key, position, hash) of the documents' fingerprints and the texts of the documents that were hit.

Defined results: null text has no words (n_words 0, not contaminated); rows that repeat a doc_id are judged
each by its own text; repeated rows give repeated results; a null item has no windows; equal items all count;
extra columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, materialise, unused, without

WINDOW = 10
GRAM = 5
GRAMS = WINDOW - GRAM + 1
BROADCAST_BYTES = 64 << 20
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROW = ["doc_id", "row_key", "n_words"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def grams(w: Column) -> Column:
    """The hashes of the grams of a text of ten words or more, in order; the low three bits are the place's."""
    hashed = lambda i: F.xxhash64(F.slice(w, i, GRAM)).bitwiseAND(-8).bitwiseOR((i - 1).bitwiseAND(7))
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - GRAM + 1), hashed))


def least_gram(g: Column, i: Column) -> Column:
    """The smallest gram of the ten words from position i (from 0)."""
    return F.least(*(F.get(g, i + j) for j in range(GRAMS)))


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[int]]:
    """(length, key, wtext, set_id), one row per distinct window; (set_id, items); the lengths that occur.

    Windows found in the same items share one set of items, so a passage of many items is listed once."""
    w = materialise(bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0), "bench-words")
    lengths = sorted(r[0] for r in w.select(F.least(F.size("w"), F.lit(WINDOW)).alias("n")).distinct().collect())  # ten at most
    length = F.least(F.size("w"), F.lit(WINDOW))
    at = w.select("item", "w", grams(F.col("w")).alias("g"), length.alias("length"))
    at = at.select("item", "w", "g", "length", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("i"))
    key = F.when(F.col("length") == WINDOW, least_gram(F.col("g"), F.col("i"))).otherwise(F.xxhash64("w"))
    each = at.select("item", "length", key.bitwiseAND(-8).alias("key"), F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ").alias("wtext"))
    each = each.groupBy("length", "key", "wtext").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = materialise(each.withColumn("set_id", F.sha2(F.to_json("items"), 256)), "bench-windows")
    sets = materialise(each.groupBy("set_id").agg(F.first("items").alias("items")), "bench-sets")
    return each.drop("items"), sets, lengths


def _sized(df: DataFrame, size: Column) -> tuple[DataFrame, bool]:
    """Broadcast only where the rows' bytes, summed up, allow it; else the join shuffles."""
    small = (df.agg(F.sum(size + 40)).first()[0] or 0) <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def fingerprints(base: DataFrame, lengths: list[int]) -> DataFrame:
    """(ROW, w, length, p, key): the winnowed grams of each row, p the gram's position; and one row of length -1."""
    last = F.size("w") - min(lengths, default=WINDOW)
    at = base.select(*ROW, "w", grams(F.col("w")).alias("g"))
    at = at.select(*ROW, "w", "g", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))).alias("i"))
    w, g, i, found = F.col("w"), F.col("g"), F.col("i"), []
    for n in lengths:
        inside = (i >= 0) & (i + n <= F.col("n_words"))
        if n == WINDOW:
            v = least_gram(g, i)
            inside = inside & ((i == 0) | (v != least_gram(g, i - 1)))
        else:
            v = F.xxhash64(F.slice(w, F.greatest(i, F.lit(0)) + 1, n))
        found.append(F.when(inside, F.struct(F.lit(n).alias("length"), v.alias("v"))))
    mark = F.when(i < 0, F.struct(F.lit(-1).alias("length"), F.lit(0).cast("long").alias("v")))
    rows = at.select(*ROW, "w", "i", F.explode(F.array(mark, *found)).alias("f")).filter("f is not null")
    place = F.when(F.col("f.length") == WINDOW, i + F.pmod(F.col("f.v") - i, F.lit(8)).cast("int")).otherwise(i)
    return rows.select(*ROW, "w", "f.length", place.alias("p"), F.col("f.v").bitwiseAND(-8).alias("key"))


def hits(docs: DataFrame, table: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(ROW, i, length, set_id): a row for each window occurrence, and one row with i = -1 for each document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), words(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))
    known, small = _sized(table.select("length", "key").distinct().withColumn("known", F.lit(True)), F.lit(0))
    fps = fingerprints(base, lengths)
    met = (F.col("length") < 0) | F.col("known")
    marks = None  # of each document; they meet no table where that would shuffle them
    if small:
        found = fps.join(known, ["length", "key"], "left").filter(met)
    else:
        marks = base.select(*ROW, F.lit(-1).alias("i"), F.lit(-1).alias("length"), F.lit(None).cast("string").alias("set_id"))
        found = materialise(fps.filter("length >= 0").drop("w").join(known, ["length", "key"]), "bench-hits")
        texts = base.join(found.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"])
        found = found.join(texts.select("row_key", "w"), "row_key", "left")
    whole = F.col("length") == WINDOW
    low, high = F.when(whole, F.greatest(F.col("p") - GRAMS + 1, F.lit(0))).otherwise(F.col("p")), F.when(whole, F.least("p", F.col("n_words") - WINDOW)).otherwise(F.col("p"))
    around = found.select(*ROW, "w", "length", F.explode(F.sequence(low, high)).alias("i"))
    around = around.select(*ROW, "length", "i", F.when(F.col("i") >= 0, F.array_join(F.slice("w", F.col("i") + 1, F.greatest("length", F.lit(0))), " ")).alias("wtext"))
    checked, small_too = _sized(table.select("length", "wtext", "set_id"), F.octet_length("wtext") + 64)
    if small and not small_too:
        around = materialise(around, "bench-around")
        marks = around.filter("i < 0").select(*ROW, "i", "length", F.lit(None).cast("string").alias("set_id"))
        around = around.filter("i >= 0")
    out = around.join(checked, ["length", "wtext"], "left").filter("i < 0 or set_id is not null").select(*ROW, "i", "length", "set_id")
    return out if marks is None else out.unionByName(marks)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), spans (merged [start, end) word ranges)."""
    table, sets, lengths = windows(bench)
    rows = hits(docs, table, lengths, id_col, text_col)
    hit = F.col("i") >= 0
    by_doc = rows.groupBy(*ROW).agg(
        F.count(F.when(~hit, 1)).alias("times"),
        F.array_sort(F.collect_set(F.when(hit, F.struct("i", (F.col("i") + F.col("length")).alias("e"))))).alias("ranges"),
        F.collect_set("set_id").alias("set_ids"),
    )
    merged = F.expr("""aggregate(ranges, cast(array() as array<struct<i:int,e:int>>), (acc, r) ->
        if(size(acc) > 0 and element_at(acc, -1).e >= r.i,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('i', element_at(acc, -1).i, 'e', greatest(element_at(acc, -1).e, r.e)))),
           concat(acc, array(named_struct('i', r.i, 'e', r.e)))))""")
    by_doc = by_doc.withColumn("spans", merged).drop("ranges")
    listed = by_doc.select(*ROW, "times", "spans", F.explode_outer("set_ids").alias("set_id"))
    listed = listed.join(_sized(sets, F.octet_length(F.to_json("items")))[0], "set_id", "left")
    listed = listed.groupBy(*ROW).agg(F.first("times").alias("times"), F.first("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("items", F.expr("cast(array() as array<string>)")))))).alias("items"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.e - s.i)")
    out = listed.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__t"))
    return out.drop("__t")


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns; a clean text does not shuffle (`without`)."""
    table, _, lengths = windows(bench)
    own, name = unused(docs, "own", "gone")
    gone = hits(docs, table, lengths, id_col, text_col).filter("i >= 0").select(F.col("doc_id").alias(own), F.col("row_key").alias(name)).distinct()
    return without(docs, materialise(gone, "contaminated"), {id_col: own}, F.xxhash64(id_col, text_col), name)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM di) JOIN bw USING (n, t)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""

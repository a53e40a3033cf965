"""Operator 1, token-id output as sorted-string-table shards.

Documents are dealt into ranges of doc_id (AQE sizes the ranges), encoded in their range, and each range is
written as one shard file through Spark's own writer and commit protocol, so it works on any file system that
Spark writes to and a lost executor's task is written again. A shard is a series of sections, each ended by one
newline byte (it is the writer's line separator; offsets count it):

    block ...   zstandard of entries: varint shared key bytes, varint further key bytes, varint value bytes,
                the further key bytes, the value; about BLOCK_BYTES before compression, the first key whole
    index       zstandard of, per block: first key, last key, offset, length, documents, tokens
    bloom       BLOOM_BITS bits a key, probed at BLOOM_PROBES places
    footer      fixed size: offsets and lengths of index and bloom, documents, tokens, id width, magic

A key is 0x01 and the big-endian doc_id with its sign bit flipped (0x00 alone for a null doc_id), so that byte
order is doc_id order, nulls first. A value is the ids, little-endian, of 2 or 4 bytes as the vocabulary needs.

Encoding cuts texts where no token of the byte-level pattern spans: before runs of ASCII white space, and between an
ASCII letter and an ASCII mark, by the bytes. The
distinct pieces of a slice of texts that the memo lacks are encoded by the tokenizers library; texts in which other
white space or special token text stands are encoded by the library whole.

Defined results: null counts as empty and has the end id alone; rows with one doc_id are kept each, ordered by
a hash of their texts; a null doc_id sorts first; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, lean, materialise, scratch, slices

BLOCK_BYTES = 1 << 16
BLOOM_BITS = 10
BLOOM_PROBES = 7
FOOTER = struct.Struct("<QQQQQQBB6s")
MAGIC = b"DKTSS1"
MEMO = 250_000  # pieces of a generation; a worker keeps two
SLICE = 1 << 22

#: White space and separators other than plain ASCII ones (and NUL, the cut mark): such texts are encoded whole.
ODD = r"[\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
MARKS = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
SPACED = re.compile(r" [^ \t-\r]+")


def cut_pieces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts, one after the other, and where each text's begin. A piece begins with white space after
    something else, or with an ASCII mark after an ASCII letter: there the tokenizer's own pattern begins anew as well."""
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    white = WHITE[raw]
    begins = white.copy()
    begins[1:] &= ~white[:-1]
    begins[1:] |= MARKS[raw[1:]] & LETTERS[raw[:-1]]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    cuts = np.flatnonzero(begins)
    pieces = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(raw)).astype(np.int32)), pa.py_buffer(raw))
    return pieces.dictionary_encode(), np.searchsorted(cuts, offsets)


class Encoder:
    """Byte-level BPE of whole texts through the tokenizers library, with a memo of pieces."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(content)
        spec = json.loads(content)
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        if not plain:
            raise ValueError("a byte-level tokenizer file without normalizer is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = self.lib.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with the byte of a space
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.odd = "|".join([ODD, *(re.escape(x) for x in self.special)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Pieces of one leading space are encoded joined; each of their tokens with a space starts a piece."""
        joined: list[str] = []
        rest: list[str] = []
        for p in pieces:
            (joined if SPACED.fullmatch(p) else rest).append(p)
        for at in range(0, len(joined), 512):
            some = joined[at : at + 512]
            (e,) = self.lib.encode_batch_fast(["".join(some)], add_special_tokens=False)  # one at a time: these are large
            ids = np.array(e.ids, self.dtype)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(some):
                rest += some
                continue
            cut = [*(first * self.width).tolist(), len(ids) * self.width]
            raw = ids.tobytes()
            self.young.update(zip(some, (raw[a:b] for a, b in zip(cut, cut[1:], strict=False)), strict=True))
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for p, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.young[p] = np.array(e.ids, self.dtype).tobytes()

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; what is used again moves to the younger of two generations."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        lacking = [p for p in pieces if p not in self.young]
        again = [p for p in lacking if p in self.old]
        self.young.update((p, self.old[p]) for p in again)
        if len(again) < len(lacking):
            self.learn([p for p in lacking if p not in self.old] if again else lacking)
        return [self.young[p] for p in pieces]

    def batch(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as bytes."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        pieces, offsets = cut_pieces(pc.if_else(odd, "", texts))
        ids = pa.array(self.known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(pieces.indices)
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids), b"")
        if pc.any(odd).as_py():
            own = pa.array([self.whole(t) for t in texts.filter(odd).to_pylist()], pa.binary())
            out = pc.replace_with_mask(out, odd, own)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    """One encoder per Python worker and file."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while b[at] > 127:
        n |= (b[at] & 127) << shift
        shift += 7
        at += 1
    return n | b[at] << shift, at + 1


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    return [(h + i * ((h >> 32) | 1)) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Turns entries in key order into a shard's sections."""

    def __init__(self, width: int) -> None:
        self.width, self.zip = width, zstandard.ZstdCompressor(level=1)
        self.block, self.first, self.last, self.docs, self.tokens = bytearray(), b"", b"", 0, 0
        self.index = bytearray()
        self.keys: list[bytes] = []
        self.at = self.all_docs = self.all_tokens = 0

    def add(self, key: bytes, value: bytes) -> bytes | None:
        """The section that this entry completes, if any."""
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.docs += 1
        self.tokens += len(value) // self.width
        return self.close_block() if len(self.block) >= BLOCK_BYTES else None

    def close_block(self) -> bytes:
        out = self.zip.compress(bytes(self.block))
        for x in (self.first, self.last):
            self.index += varint(len(x)) + x
        for n in (self.at, len(out), self.docs, self.tokens):
            self.index += varint(n)
        self.at += len(out) + 1
        self.all_docs += self.docs
        self.all_tokens += self.tokens
        self.block, self.docs, self.tokens = bytearray(), 0, 0
        return out

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self.close_block()
        index = self.zip.compress(bytes(self.index))
        yield index
        bits = max(64, len(self.keys) * BLOOM_BITS)
        flags = np.zeros(bits, np.uint8)
        for k in self.keys:
            flags[probes(k, bits)] = 1
        bloom = struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes()
        yield bloom
        at = self.at
        yield FOOTER.pack(at, len(index), at + len(index) + 1, len(bloom), self.all_docs, self.all_tokens, self.width, 1, MAGIC)


class Shard:
    """Reads one shard file's bytes."""

    def __init__(self, content: bytes) -> None:
        self.b = content
        at, n, bloom, m, self.n_docs, self.n_tokens, self.width, _, magic = FOOTER.unpack(content[-FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.unzip = zstandard.ZstdDecompressor()
        raw, i = self.unzip.decompress(content[at : at + n]), 0
        self.blocks = []
        while i < len(raw):
            row: list = []
            for _ in range(2):
                k, i = read_varint(raw, i)
                row.append(raw[i : i + k])
                i += k
            for _ in range(4):
                k, i = read_varint(raw, i)
                row.append(k)
            self.blocks.append(tuple(row))
        self.bits = struct.unpack("<Q", content[bloom : bloom + 8])[0]
        self.bloom = content[bloom + 8 : bloom + m]

    def entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        raw, i, key = self.unzip.decompress(self.b[block[2] : block[2] + block[3]]), 0, b""
        while i < len(raw):
            shared, i = read_varint(raw, i)
            more, i = read_varint(raw, i)
            size, i = read_varint(raw, i)
            key = key[:shared] + raw[i : i + more]
            i += more
            yield key, raw[i : i + size]
            i += size

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: Bloom filter, then binary search in the sparse index, then one block or more."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        out = []
        for block in self.blocks[bisect_left([b[1] for b in self.blocks], key) :]:
            if block[0] > key:
                break
            out += [v for k, v in self.entries(block) if k == key]
        return out

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and write the shards of a table to `path`."""
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(content.value)
        out, end, some = Writer(e.width), np.array([end_id], e.dtype).tobytes(), False
        section = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["value"])
        for whole in lean(batches):
            for b in slices(whole, 1, SLICE):
                for doc_id, ids in zip(b.column(0).to_pylist(), e.batch(b.column(1).cast(pa.string())).to_pylist(), strict=True):
                    some = True
                    if (block := out.add(key_of(doc_id), ids + end)) is not None:
                        yield section(block)
        if some:
            yield from map(section, out.finish())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    blocks = rows.mapInArrow(run, "value binary")
    blocks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(shard, content, path) of each shard file."""
    files = spark.read.format("binaryFile").schema(FILES).option("pathGlobFilter", "part-*").load(path)
    return files.filter(F.col("length") > 0).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content", "path")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard: one row per stored document, in no order.

    Starts within a shard are summed where it is read; the shards' totals, one row a file, are summed up after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column(1)[i].as_py())
                start = 0
                for block in shard.blocks:
                    keys, ns, starts, crcs = [], [], [], []
                    for key, value in shard.entries(block):
                        ids = shard.ids(value)
                        keys.append(id_of(key))
                        ns.append(len(ids))
                        starts.append(start)
                        crcs.append(zlib.crc32(ids.tobytes()))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], ["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = materialise(_files(spark, path).mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long"), "sst-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(totals, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard")


def key_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(path, first_key, last_key, n_docs, n_tokens): one row per shard, from its index and footer. Keys sort as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, name in zip(b.column(1), b.column(2), strict=True):
                s = Shard(content.as_py())
                row = (name.as_py(), s.blocks[0][0], s.blocks[-1][1], s.n_docs, s.n_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "first_key", "last_key", "n_docs", "n_tokens"])

    return materialise(_files(spark, path).mapInArrow(run, "path string, first_key binary, last_key binary, n_docs long, n_tokens long"), "sst-ranges")


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None], ranges: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of the documents asked for, found by each shard's Bloom filter and index. With the table of
    `key_ranges` (kept by the caller) only shards are opened whose range holds a key that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column(1)[i].as_py())
                found = [(k, shard.ids(v).tolist()) for k in doc_ids for v in shard.get(key_of(k))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    schema = "doc_id long, ids array<long>"
    if ranges is None:
        return _files(spark, path).mapInArrow(run, schema)
    asked = F.broadcast(spark.createDataFrame([(key_of(k),) for k in doc_ids], "key binary"))  # as many as were asked for
    within = F.col("key").between(F.col("first_key"), F.col("last_key"))
    names = [r[0] for r in ranges.join(asked, within, "left_semi").select("path").collect()]
    return _files(spark, names).mapInArrow(run, schema) if names else spark.createDataFrame([], schema)


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "sstable")
    write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, path)

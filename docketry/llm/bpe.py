"""Operator 5, BPE encoding and decoding by a pair occurrence index.

Texts are cut at ASCII white space, which no token spans, by Arrow; the pieces of a slice of texts are encoded once
each (Arrow's dictionary), and the pieces not met before are normalised and cut into words as the tokenizer's file
says. The words not met before are laid out as one array of linked symbols. An index maps each pair that has a
merge to all its positions; the active ranks are applied in ascending order, each at all its positions at once, and
the positions of the pairs beside each are added to their lists. In a trained file a pair of a merge's result ranks
after that merge, which is verified, so no rank comes back once it is done. Results are kept in a memo of bounded
size per Python worker: a generation of MEMO pieces, and the one before.

The vocabulary file is a parameter; its content is broadcast, so executors need no such file.

Defined results: null counts as empty and has no tokens; the special tokens' own strings in a text become their
ids, as in the tokenizers library; a piece of white space alone has none; repeated rows give repeated results;
extra columns are ignored; texts of any length are encoded whole. `decode` passes over ids that the file lacks and
nulls; a null array decodes to an empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, slices

MEMO = 60_000
SLICE = 1 << 21
SHORT = 24
MARK = "<|"  # each special token begins so
CONTROL = re.compile("[\0-\x08\x0e-\x1f\x7f]")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|\n|[^ \t-\ra-z0-9]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Memo:
    """Two generations: what is used again moves to the younger, the older is dropped when that is full."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def lacking(self, keys) -> list:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if (v := old.get(k)) is not None:
                    young[k] = v
                else:
                    out.append(k)
        return out


class Codec:
    """Encoder and decoder of a word-end BPE tokenizer file."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or spec.get("decoder") or any(not t["content"].startswith(MARK) for t in spec["added_tokens"]) or SPLIT not in json.dumps(spec, ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError("only word-end BPE files without unknown token, byte fallback and decoder are read")
        self.lib = Tokenizer.from_str(content)  # for normalising and cutting words with other than ASCII
        vocab: dict[str, int] = model["vocab"]
        end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.base = max(token) + 1
        self.tokens = pa.array([token.get(i) for i in range(self.base)], pa.string())
        self.decimals = pa.array([str(i) for i in range(self.base)], pa.string())
        pairs = [tuple(p if isinstance(p, list) else p.split(" ")) for p in model["merges"]]
        made: dict[str, int] = {}
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = [(vocab[a], vocab[b]) for a, b in pairs]
        for rank, (a, b) in enumerate(pairs):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or a + b in made:
                raise ValueError("a pair ranks before the merge that makes its half")
            made[a + b] = rank
        keys = np.array([a * self.base + b for a, b in self.pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.inner, self.last = np.full(512, -1, np.int64), np.full(512, -1, np.int64)  # symbols of a byte's character
        for x in self.byte.values():
            self.inner[ord(x)], self.last[ord(x)] = vocab[x], vocab[x + end]
        self.words, self.memo = Memo(MEMO), Memo(MEMO)  # -> ids, as bytes of four each

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; -1 where it has none."""
        k = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (left >= 0) & (right >= 0), self.order[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and where each word's end; all merged together through
        the pair index."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.inner[chars]
        sym[ends - 1] = self.last[chars[ends - 1]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate(([0], ends[:-1]))] = -1
        rank = np.full(n, -1, np.int64)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        first, starts = np.unique(rank[at], return_index=True)
        index = dict(zip(first.tolist(), map(np.ndarray.tolist, np.split(at, starts[1:])), strict=True)) if len(at) else {}
        active = list(index)
        heapify(active)
        s, f, b, pairs, results = memoryview(sym), memoryview(after), memoryview(before), self.pairs, self.results.tolist()
        while active:
            rank = heappop(active)
            places = index.pop(rank)
            left, right = pairs[rank]
            new = results[rank]
            if len(places) < SHORT or left == right:
                places.sort()
                done = []
                for i in places:
                    j = f[i]
                    if s[i] == left and j >= 0 and s[j] == right:  # else an earlier merge took one of the two
                        k = f[j]
                        s[i], s[j], f[i] = new, -1, k
                        if k >= 0:
                            b[k] = i
                        done.append(i)
                places = np.array(done, np.int64)
            else:
                places = np.unique(places)
                j = after[places]
                ok = (sym[places] == left) & (j >= 0) & (sym[j] == right)
                places, j = places[ok], j[ok]
                k = after[j]
                sym[places], sym[j], after[places] = new, -1, k
                before[k[k >= 0]] = places[k >= 0]
            lefts, rights = before[places], after[places]
            lefts, places = np.concatenate((lefts, places)), np.concatenate((places, rights))
            some = (lefts >= 0) & (places >= 0)
            lefts, places = lefts[some], places[some]
            for r, i in zip(self.ranks(sym[lefts], sym[places]).tolist(), lefts.tolist(), strict=True):
                if r >= 0:
                    if r not in index:
                        index[r] = []
                        heappush(active, r)
                    index[r].append(i)
        alive = sym >= 0
        return sym[alive], np.cumsum(alive)[ends - 1]

    def decode_lists(self, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        """The text of each list of ids."""
        tokens = self.tokens.take(ids)
        if tokens.null_count:
            keep = np.asarray(tokens.is_valid())
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            tokens = tokens.drop_null()
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")

    def learn_words(self, words: list[str]) -> None:
        ids, ends = self.merge(words)
        raw, cut = ids.astype("<i4").tobytes(), [0, *(ends * 4).tolist()]
        self.words.young.update(zip(words, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))

    def cut_words(self, pieces: list[str]) -> list[list[str]]:
        """The words of each piece without special tokens, each byte as its character."""
        out: list[list[str]] = [[] for _ in pieces]
        plain = [i for i, p in enumerate(pieces) if p.isascii()]
        rest = [i for i, p in enumerate(pieces) if not p.isascii()]
        n, own = 0, out[plain[0]] if plain else []
        for w in ASCII_WORD.findall("\n".join([pieces[i] for i in plain]).lower()):
            if w == "\n":
                n += 1
                own = out[plain[n]]
            else:
                own.append(w if not CONTROL.search(w) else "".join([self.byte[ord(c)] for c in w]))
        if rest:
            whole = self.lib.normalizer.normalize_str(" ".join([pieces[i] for i in rest]))
            parts = whole.split(" ")
            if len(parts) == len(rest):  # no piece holds white space of other kinds
                starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
                found = self.lib.pre_tokenizer.pre_tokenize_str(whole)
                for k, (w, _) in zip(np.searchsorted(starts, [a for _, (a, _) in found], side="right").tolist(), found, strict=True):
                    out[rest[k - 1]].append(w)
            else:
                for i in rest:
                    out[i] = [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(pieces[i]))]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Fill the memo for pieces that it lacks."""
        special = [p for p in pieces if MARK in p and self.cut.search(p)]
        if special:
            pieces = [p for p in pieces if MARK not in p or not self.cut.search(p)]
        parts = [[x for x in self.cut.split(p) if x] for p in special]
        cuts = self.cut_words(pieces + [x for part in parts for x in part if x not in self.special])
        lacking = self.words.lacking(dict.fromkeys(chain.from_iterable(cuts)))
        if lacking:
            self.learn_words(lacking)
        known, memo = self.words.young, self.memo.young
        rest = iter(cuts[len(pieces) :])
        cuts += [[w for x in part for w in ([x] if x in self.special else next(rest))] for part in parts]
        of_special = {x: i.to_bytes(4, "little") for x, i in self.special.items()} if special else {}
        for p, own in zip(pieces, cuts, strict=False):
            memo[p] = known[own[0]] if len(own) == 1 else b"".join([known[w] for w in own])
        for p, own in zip(special, cuts[len(cuts) - len(special) :], strict=True):
            memo[p] = b"".join([of_special.get(w) or known[w] for w in own])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text the number of ids, the ids as decimal numbers joined by a space, and the decoded text."""
        texts = pc.fill_null(texts, "")
        simple = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, MARK)))
        texts = pc.if_else(simple, pc.ascii_lower(texts), texts)
        cut = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(cut.offsets).astype(np.int64)
        pieces = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if lacking := self.memo.lacking(names):
            self.learn(lacking)
        memo = self.memo.young
        found = [memo[x] for x in names]
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, of_piece = pa.array(np.frombuffer(b"".join(found), "<i4")), np.concatenate(([0], np.cumsum(count)))
        numbers = pc.binary_join(pa.ListArray.from_arrays(pa.array(of_piece, pa.int32()), self.decimals.take(ids)), " ")
        where = np.asarray(pieces.indices)
        counts = count[where]
        if not count.all():  # pieces without ids, as between two separators
            keep = counts > 0
            where, counts, offsets = where[keep], counts[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
        total = np.concatenate(([0], np.cumsum(counts)))[offsets]
        where, lists = pa.array(where), pa.array(offsets, pa.int32())
        joined = [pc.binary_join(pa.ListArray.from_arrays(lists, x.take(where)), " ") for x in (numbers, self.decode_lists(ids, of_piece))]
        return np.diff(total), *joined


_CODECS: dict[str, Codec] = {}


def codec(content: str) -> Codec:
    """One codec per Python worker and file."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if full, ids (array) and decoded."""
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        for whole in lean(batches):
            for b in slices(whole, 1, SLICE):
                n, ids, texts = c.batch(b.column(1).cast(pa.string()))
                more = [pa.array([list(map(int, x.split())) for x in ids.to_pylist()], pa.list_(pa.int32())), texts] if full else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), digests(ids), digests(texts), *more], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the text of each row's ids."""
    with open(path, encoding="utf-8") as f:
        content = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        for b in batches:
            lists = b.column(1)
            ids = lists.flatten()
            inside = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, c.base))
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))))
            yield pa.RecordBatch.from_arrays([b.column(0), c.decode_lists(pc.if_else(inside, ids, None), offsets)], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), full=False)

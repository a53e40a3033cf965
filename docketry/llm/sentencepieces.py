"""Operator 12, SentencePiece encoding and decoding by a score-ordered agenda.

Merge-type vocabularies (BPE with byte fallback, no normalisation): a text gets a blank before it, each blank becomes the
mark U+2581, and the adjacent pair of symbols whose joined piece has the highest score is joined, the leftmost of equal
ones first, until no pair is a piece. The pairs wait in an agenda, a heap by score and place; a pair that an earlier
join has changed is passed over when it comes up. Characters that are no piece become the pieces of their bytes.

A text falls into chunks, each encoded once a slice: two bytes that stand side by side in no piece and in no character are
never joined, so a chunk ends between them (before a blank, around a line end, between a word and a comma). Chunks are cut
from the UTF-8 bytes and met once by Arrow's dictionary; a memo of bounded size in each Python worker keeps their ids.
Every chunk that enters the memo is encoded by the sentencepiece library too, in one call a slice, and a difference ends
the job.

The model's content is broadcast; its path is a parameter.

Defined results: null counts as empty and has no ids; the strings of control pieces in a text are ordinary text; a mark
U+2581 in a text is read as a blank; repeated rows give repeated results; extra columns are ignored; texts of any length
are encoded whole. `decode` passes over nulls and control ids, writes the library's sign for the unknown id and U+FFFD for
bytes that are no UTF-8; a null array decodes to an empty text, an id outside of the vocabulary is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo
from .common import documents, lean, slices

MEMO = 200_000
SLICE = 1 << 21
MARK = "▁"
PLACE, LEFT = 40, (1 << 40) - 1
#: Fixed value: what the library writes for the unknown id where the model says nothing else.
UNKNOWN = " ⁇ "


class Pieces:
    """Encoder and decoder of a merge-type model."""

    def __init__(self, content: bytes, check: bool = True) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = ModelProto.FromString(content)
        kinds = ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with byte fallback, a blank before the text and no normalisation are read")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces that users define and unused pieces are not read")
        self.lib = SentencePieceProcessor(model_proto=content) if check else None
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.joined = np.zeros((256, 256), bool)  # bytes that stand side by side in a piece or in a character
        self.joined[:, 128:192] = True
        for p in normal:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        if self.joined[10, :128].any():
            raise ValueError("a piece goes on after a line end")
        self.ids = normal
        order = {x: r for r, x in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        self.rank = {p: order[model.pieces[i].score] for p, i in normal.items() if len(p) > 1}
        self.bytes = np.zeros(256, np.int64)
        self.text: list[bytes | None] = []  # None: a control piece
        for i, p in enumerate(model.pieces):
            raw = p.piece.replace(MARK, " ").encode()
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                raw = bytes([int(p.piece[1:-1], 16)])
            self.text.append(None if p.type == kinds.CONTROL else (model.trainer_spec.unk_surface or UNKNOWN).encode() if p.type == kinds.UNKNOWN else raw)
        self.is_byte = {i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = model.trainer_spec.unk_id
        self.decimals = pa.array([str(i) for i in range(len(model.pieces))], pa.string())
        self.memo = Memo(MEMO)  # chunk -> ids, as bytes of four each

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk. The agenda's numbers hold the score's rank above and the place of the left symbol below."""
        s, rank = list(chunk), self.rank.get
        n = len(s)
        agenda = [r << PLACE | i for i, p in enumerate(map(add, s, s[1:])) if (r := rank(p)) is not None]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                top = heappop(agenda)
                i = top & LEFT
                j = after[i]
                if not s[i] or j >= n or rank(piece := s[i] + s[j]) != top >> PLACE:
                    continue  # an earlier join took one of the two
                k, h = after[j], before[i]
                s[i], s[j], after[i] = piece, "", k
                if k < n:
                    before[k] = i
                    if (r := rank(piece + s[k])) is not None:
                        heappush(agenda, r << PLACE | i)
                if h >= 0 and (r := rank(s[h] + piece)) is not None:
                    heappush(agenda, r << PLACE | h)
        ids = [self.ids.get(p) for p in s if p]
        if None in ids:
            ids = [i for p in s if p for i in ([self.ids[p]] if p in self.ids else self.bytes[list(p.encode())].tolist())]
        return ids

    def learn(self, chunks: list[str]) -> None:
        own = [self.merge(c.replace(" ", MARK)) for c in chunks]
        if self.lib:
            self.check(chunks, own)
        self.memo.young.update(zip(chunks, [np.array(x, "<i4").tobytes() for x in own], strict=True))

    def check(self, chunks: list[str], own: list[list[int]]) -> None:
        """Compare with the library. A chunk is encoded behind a line end, so that the library's own blank stays apart."""
        head = self.lib.encode("\n")
        for c, x, y in zip(chunks, own, self.lib.encode(["\n" + c for c in chunks], num_threads=1), strict=True):
            if head + x != y:
                raise ValueError(f"the library encodes {c!r} otherwise: {y[len(head) :]}, not {x}")

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The chunks of all texts, one after the other, and where each text's begin."""
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        texts = pc.if_else(pc.match_substring(texts, MARK), pc.replace_substring(texts, MARK, " "), texts)
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        begins = np.ones(len(raw), bool)
        begins[1:] = ~self.joined[raw[:-1], raw[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        cuts = np.flatnonzero(begins)
        chunks = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(raw)).astype(np.int32)), pa.py_buffer(raw))
        return chunks.dictionary_encode(), np.searchsorted(cuts, offsets)

    def decode(self, ids: list[int | None]) -> str:
        out, raw, blank = [], bytearray(), True  # the blank that was put before the text is taken off

        def flush() -> None:
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()

        for i in ids:
            if i is None:
                continue
            if (text := self.piece(i)) is None:
                flush()
                continue
            if i in self.is_byte:
                raw += text
            else:
                flush()
                out.append((text.removeprefix(b" ") if blank and i != self.unknown else text).decode())
            blank = False
        flush()
        return "".join(out)

    def piece(self, i: int) -> bytes | None:
        if not 0 <= i < len(self.text):
            raise ValueError(f"{i} is outside of the vocabulary")
        return self.text[i]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[str]]:
        """For each text the number of ids, the ids as decimal numbers joined by a comma, and the decoded text."""
        chunks, offsets = self.cut(texts)
        names = chunks.dictionary.to_pylist()
        if lacking := self.memo.lacking(names):
            self.learn(lacking)
        memo = self.memo.young
        found = [memo[x] for x in names]
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, of_chunk = np.frombuffer(b"".join(found), "<i4"), np.concatenate(([0], np.cumsum(count)))
        lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
        numbers = pc.binary_join(lists(of_chunk, self.decimals.take(pa.array(ids))), ",")
        ids = ids.tolist()
        words = pa.array([utf8(b"".join([self.text[i] for i in ids[a:b]])) for a, b in zip(of_chunk.tolist(), of_chunk[1:].tolist(), strict=False)], pa.string())
        total = np.concatenate(([0], np.cumsum(count[np.asarray(chunks.indices)])))[offsets]
        joined = [pc.binary_join(lists(offsets, x.take(chunks.indices)), sep) for x, sep in ((numbers, ","), (words, ""))]
        return np.diff(total), joined[0], pc.utf8_slice_codeunits(joined[1], 1)  # without the blank put before the text


def utf8(raw: bytes) -> str:
    """Each byte that is no UTF-8 becomes U+FFFD, as in the library."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return utf8(raw[: e.start]) + "�" + utf8(raw[e.start + 1 :])


_PIECES: dict[str, Pieces] = {}


def pieces(content: bytes, check: bool = True) -> Pieces:
    """One codec per Python worker and model."""
    key = f"{hashlib.sha256(content).hexdigest()} {check}"
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = Pieces(content, check)
    return _PIECES[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if full, ids (array) and decoded."""
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def digests(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(content.value, check)
        for whole in lean(batches):
            for b in slices(whole, 1, SLICE):
                n, ids, texts = codec.batch(b.column(1).cast(pa.string()))
                more = [pa.array([list(map(int, x.split(","))) if x else [] for x in ids.to_pylist()], pa.list_(pa.int32())), texts] if full else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), digests(ids), digests(texts), *more], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the text of each row's ids."""
    with open(path, "rb") as f:
        content = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces(content.value, False)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def op12_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), full=False)

"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from docketry.llm import sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "é", "漢", "​", "\0", "<s>", "</s>", "<unk>", "<0x0A>", "1", "23", "ing", "tion", "　", "😀", "\r\n", "é", "    ", "\x1f", "\x7f", "�", "a" * 20, "ß", "İ", "==", "();", "),"]


@pytest.fixture(scope="module")
def lib():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return sentencepieces.Pieces(open(MODEL, "rb").read())


def expected(lib, doc_id, text):
    ids = lib.encode(text or "")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))


def test_query(spark, sf, lib):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, sentencepieces.op12_sentencepieces(spark, sf).collect())) == sorted(expected(lib, *r) for r in docs)


def test_random_texts(lib, own):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(128, 0x3000), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(0, 40))) for _ in range(1000)]
    texts += ["", " ", "\n", "▁", "▁▁", "x" * 5000, " " * 3000, "=" * 700]
    n, ids, decoded = own.batch(pa.array(texts, pa.string()))
    for text, size, got, back in zip(texts, n.tolist(), ids.to_pylist(), decoded.to_pylist(), strict=True):
        want = lib.encode(text)
        assert (size, got, back) == (len(want), ",".join(map(str, want)), lib.decode(want)), text
        assert own.decode(want) == back


def test_decode_any_ids(spark, lib, own):
    rnd = random.Random(5)
    lists = [[rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(259, 300), rnd.randrange(3, 32000), 259, 260, 28705]) for _ in range(rnd.randint(0, 8))] for _ in range(4000)]
    rows = spark.createDataFrame([*enumerate(lists), (-1, None), (-2, [None, 400, None])], "doc_id long, ids array<long>")
    got = {r[0]: r[1] for r in sentencepieces.decode(rows, MODEL).collect()}
    assert got.pop(-1) == "" and got.pop(-2) == lib.decode([400])
    assert got == {i: lib.decode(x) for i, x in enumerate(lists)}
    with pytest.raises(ValueError, match="outside"):
        own.decode([32000])


def test_odd_rows(spark, odd, odd_rows, empty, lib):
    got = sentencepieces.encode(odd, MODEL)
    assert sorted(map(str, (r[:4] for r in got.collect()))) == sorted(map(str, (expected(lib, *r[:2]) for r in odd_rows)))
    back = sentencepieces.decode(got.select("doc_id", "ids"), MODEL)
    assert sorted(map(str, back.collect())) == sorted(map(str, got.select("doc_id", "decoded").collect()))
    assert sentencepieces.encode(empty, MODEL).count() == 0


def test_a_difference_from_the_library_ends_the_job(own):
    wrong = sentencepieces.Pieces(open(MODEL, "rb").read())
    wrong.rank = {}
    with pytest.raises(ValueError, match="otherwise"):
        wrong.batch(pa.array(["there are words"]))


def test_memo_and_slices(monkeypatch, lib):
    small = sentencepieces.Pieces(open(MODEL, "rb").read())
    small.memo.size = 3
    texts = [f"word{i % 7} and {i} more" for i in range(40)]
    for k in range(0, 40, 4):
        assert small.batch(pa.array(texts[k : k + 4]))[1].to_pylist() == [",".join(map(str, lib.encode(t))) for t in texts[k : k + 4]]

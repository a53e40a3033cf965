import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard int, __row long, rate double"
BASE = "the quick brown fox jumps over the lazy dog while seven small cats watch from a warm window sill today and wonder about it"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977} {BASE}" for i in range(3000))
    texts = [None, "", " \n\t ", BASE, BASE.upper(), BASE, BASE + " x", long, "don't <|endoftext|> stop <|startoftext|>", "naïve ÄÖ ß 日本語\u00a0 x  y\u3000z", "a\x00b\x1cc", "one", "one two", "ÀÉ", "àé", "x\r\n\r\ny  \n", "  lead", "12 345 ... !?", "Σας ΟΔΟΣ İ"]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "q", 1, 5, 0.5) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[3], rows[3], (3, "other text of id three", "en", "s", 1, "q", 1, 5, 0.5)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)

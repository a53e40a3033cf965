"""The automaton over pages against plain substring search."""

import random

import pytest

from docketry.operators import termscan

TERMS, PAGES = "doc long, term string", "doc long, page int, text string"


def expected(terms, pages):
    out = set()
    for doc, term in set(terms):
        own = sorted((p, c) for d, p, c in pages if d == doc and d is not None and c)
        if term and term in "".join(c for _, c in own):
            out.add((doc, term, next((p for p, c in own if term in c), None)))
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_random(spark, block):
    rnd = random.Random(block)
    word = lambda n: "".join(rnd.choice("ab招标") for _ in range(n))
    pages = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.randrange(40), rnd.choice(["", None, word(1), word(rnd.randint(0, 9)), word(30)])) for _ in range(220)]
    terms = [(rnd.choice([1, 1, 2, 3, 5, None]), rnd.choice(["", None, word(1), word(rnd.randint(1, 5)), word(rnd.randint(1, 9)), "zz"])) for _ in range(150)]
    text = "".join(c or "" for d, _, c in sorted((p for p in pages if p[0] == 1), key=lambda p: (p[1], p[2] or "")))
    terms += [(1, text[i : i + n]) for i, n in ((3, 40), (90, 77), (10, 3), (0, len(text)))]  # over many pages, and the whole text
    got = {tuple(r) for r in termscan.term_hits(spark.createDataFrame(terms, TERMS).repartition(3), spark.createDataFrame(pages, PAGES).repartition(4), block).collect()}
    assert got == expected(terms, pages) and any(r[2] is None for r in got)


def test_empty_and_text_keys(spark):
    terms, pages = spark.createDataFrame([("d", "ab")], "doc string, term string"), spark.createDataFrame([("d", 7, "xa"), ("d", 9, "by")], "doc string, page long, text string")
    assert [tuple(r) for r in termscan.term_hits(terms, pages, 1).collect()] == [("d", "ab", None)]
    assert termscan.term_hits(terms.limit(0), pages).count() == termscan.term_hits(terms, pages.limit(0)).count() == 0

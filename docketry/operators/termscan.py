"""Which of a document's terms stand in its pages: one pass of an automaton over the text, whatever the number of terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # pages that one task reads without a break


class _Finder:
    """The automaton of one document's terms."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.reach = max(map(len, terms)) - 1  # characters of the text before that may begin a term
        self.machine = ahocorasick.Automaton()
        for t in terms:
            self.machine.add_word(t, t)
        self.machine.make_automaton()

    def ends(self, before: str, text: str) -> Iterator[tuple[str, bool]]:
        """(term, whether it lies in the text by itself) for each term that ends in the text."""
        for end, term in self.machine.iter(before + text):
            if end >= len(before):
                yield term, end - len(term) + 1 >= len(before)

    def last(self, text: str) -> str:
        return text[-self.reach :] if self.reach else ""


def term_hits(terms: DataFrame, pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """terms (doc, term) and pages (doc, page, text), page an integer -> (doc, term, page): the terms of a document that
    its pages hold, one after the other without anything between them, and the first page that holds the term by itself
    (null: none does, the term runs over a page's end).

    Blocks of pages are read in page order by one automaton of the document's terms; each page carries on the tail of
    the text before it. A block hands out its own head and tail, and a second pass, over one row a block, looks for the
    terms that run over the blocks' ends. A document of any size is thus spread over its blocks, and no task holds more
    than one page, the terms of one document and what it has found of them. Rows without a document, a term or a text are
    left out; pages of equal number are read in the order of their text."""
    doc_type, page_type = dict(pages.dtypes)["doc"], dict(pages.dtypes)["page"]
    own = terms.select(F.col("doc").cast(doc_type).alias("doc"), "term").filter("doc is not null and term <> ''").distinct()
    read = pages.filter("doc is not null and text <> ''").withColumn("block", F.floor(F.col("page") / block).cast("long"))
    none = F.lit(None).cast("string")
    asked = own.join(read.select("doc", "block").distinct(), "doc").select("doc", "block", F.lit(0).alias("kind"), F.lit(None).cast(page_type).alias("page"), F.col("term").alias("text"))
    rows = asked.unionByName(read.select("doc", "block", F.lit(1).alias("kind"), "page", "text"))
    schema = f"doc {doc_type}, kind int, block long, term string, page {page_type}, head string, tail string"
    types = [pa.field(n, t) for n, t in zip(("kind", "block", "term", "head", "tail"), (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]

    def table(out: list[tuple], doc_field: pa.Field, page_field: pa.Field) -> pa.RecordBatch:
        fields = [doc_field.with_name("doc"), *types[:3], page_field.with_name("page"), *types[3:]]
        columns = zip(*out, strict=True) if out else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], [f.name for f in fields])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 1: a block's head and tail; kind 2: a term with its first page."""
        at, owner, words, finder, out, found, head, tail = None, None, [], None, [], {}, "", ""

        def close() -> None:
            if finder and at is not None:
                out.extend((at[0], 2, at[1], t, p, None, None) for t, p in found.items())
                out.append((at[0], 1, at[1], None, None, head, tail))

        for b in batches:
            for doc, number, kind, page, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (doc, number) != at:
                    close()
                    at, found, head, tail = (doc, number), {}, "", ""
                    if doc != owner:
                        owner, words, finder = doc, [], None
                if kind == 0:
                    if not finder:  # the next block of a document brings the same terms
                        words.append(text)
                    continue
                if not finder and words:
                    finder = _Finder(words)
                if finder:
                    for term, alone in finder.ends(tail, text):
                        if alone and found.get(term) is None:
                            found[term] = page
                        else:
                            found.setdefault(term, None)
                    if len(head) < finder.reach:
                        head += text[: finder.reach - len(head)]
                    tail = finder.last(tail + text)
            yield table(out, b.schema.field(0), b.schema.field(3))
            out.clear()
        close()
        if out:
            yield table(out, b.schema.field(0), b.schema.field(3))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits go on as they are; those over the blocks' ends are added."""
        owner, words, finder, carried = None, [], None, ""
        for b in batches:
            out = []
            for doc, kind, block_, term, page, head, tail in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if doc != owner:
                    owner, words, finder, carried = doc, [], None, ""
                if kind == 0:
                    words.append(term)
                elif kind == 2:
                    out.append((doc, 2, block_, term, page, None, None))
                else:
                    if carried and not finder:
                        finder = _Finder(words)
                    if carried:
                        out += [(doc, 2, block_, t, None, None, None) for t in {t for t, alone in finder.ends(carried, head) if not alone}]
                    carried = (carried + tail)[-(max(map(len, words)) - 1) or len(carried + tail) :]
            yield table(out, b.schema.field(0), b.schema.field(4))

    blocks = rows.repartition("doc", "block").sortWithinPartitions("doc", "block", "kind", "page", "text").mapInArrow(inside, schema)
    again = own.select("doc", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "term", F.lit(None).cast(page_type).alias("page"), none.alias("head"), none.alias("tail"))
    both = again.unionByName(blocks).repartition("doc").sortWithinPartitions("doc", "kind", "block")
    return both.mapInArrow(between, schema).groupBy("doc", "term").agg(F.min("page").alias("page"))

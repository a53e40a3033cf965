"""Boxes of a page that overlap: a join by bins of several sizes, and sums over all pairs without the pairs."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.sources.shared import scratch

STEP = 4.0  # from one size of bins to the next
LEVELS = (-8, 40)
SPAN = 16.0  # from one size of tiles to the next, in `totals`
BLOCK = 1 << 17  # pairs that are compared at once
_NONE = np.iinfo(np.int64).min  # no box was met


def met(a: DataFrame, b: DataFrame, page: str, axes: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b): the rows of both as structs, for each pair of one page whose open intervals overlap on every axis (lo, hi).

    On each axis a box belongs to the least size of bins that is as long as itself, so it lies in two of them at most. It
    is dealt to its bins of that size and of each greater size that any box has. Two boxes meet at the greater of their
    sizes, where one of them is at home, and there in the first bin that both have. A page of any number of boxes is so
    spread over its bins, and boxes far apart never meet. Boxes without a page or a bound meet nothing."""
    n = range(len(axes))

    def side(df: DataFrame, name: str) -> DataFrame:
        out = {}
        for k, (lo, hi) in enumerate(axes):
            x, y = F.col(lo).cast("double"), F.col(hi).cast("double")
            out |= {f"lo{k}": F.least(x, y), f"hi{k}": F.greatest(x, y), f"own{k}": _level(F.abs(y - x))}
        rows = df.select(F.col(page).alias("__page"), F.struct(*df.columns).alias(name), *(v.alias(f"{name}_{c}") for c, v in out.items()))
        known = [F.col("__page").isNotNull(), *(F.col(f"{name}_{c}{k}").isNotNull() & ~F.isnan(f"{name}_{c}{k}") for k in n for c in ("lo", "hi"))]
        return rows.filter(reduce(Column.__and__, known))

    left, right = side(a, "a"), side(b, "b")
    sizes = left.select(*(F.col(f"a_own{k}").alias(f"own{k}") for k in n)).unionByName(right.select(*(F.col(f"b_own{k}").alias(f"own{k}") for k in n)))
    sizes = F.broadcast(sizes.agg(*(F.collect_set(f"own{k}").alias(f"sizes{k}") for k in n)))  # one row of some tens of numbers

    def dealt(df: DataFrame, name: str) -> DataFrame:
        df = df.crossJoin(sizes)
        for k in n:
            df = df.withColumn(f"size{k}", F.explode(f"sizes{k}")).filter(F.col(f"size{k}") >= F.col(f"{name}_own{k}"))
            width = F.pow(F.lit(STEP), F.col(f"size{k}"))
            df = df.withColumn(f"{name}_first{k}", F.floor(F.col(f"{name}_lo{k}") / width))
            df = df.withColumn(f"bin{k}", F.explode(F.sequence(F.col(f"{name}_first{k}"), F.floor(F.col(f"{name}_hi{k}") / width))))
        return df.drop(*(f"sizes{k}" for k in n), *(f"{name}_hi{k}" for k in n), *(f"{name}_lo{k}" for k in n))

    both = dealt(left, "a").join(dealt(right, "b"), ["__page", *(f"{x}{k}" for k in n for x in ("size", "bin"))])
    for k, (lo, hi) in enumerate(axes):
        home = (F.col(f"size{k}") == F.col(f"a_own{k}")) | (F.col(f"size{k}") == F.col(f"b_own{k}"))
        first = F.col(f"bin{k}") == F.greatest(f"a_first{k}", f"b_first{k}")
        both = both.filter(home & first & (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}")))
    return both.select("a", "b")


def totals(df: DataFrame, page: str, item: str, axes: Sequence[tuple[str, str]]) -> DataFrame:
    """(page, pairs, items, area): the pairs of rows of a page whose boxes overlap as in `met` and whose items (whole
    numbers) differ, the items that overlap a greater one, and the sum of the pairs' common areas. No pair becomes a row.

    Equal boxes are one with a count and their greatest item. Boxes are dealt to tiles as in `met` and compared there in
    blocks, in order of the first axis; a tile keeps its sums, and each box the greatest item that it meets. As
    overlapping is mutual, pairs with one item less than the other are all pairs without those of one item.

    Time grows with the pairs of unlike boxes in a tile, memory with the tile's boxes; a tile is compared by one task."""
    n = range(len(axes))
    ends = [c for k in n for c in (f"lo{k}", f"hi{k}")]
    rows = df.select(F.col(page).alias("page"), F.col(item).cast("long").alias("item"), *(F.col(c).cast("double").alias(f"{e}{k}") for k, axis in enumerate(axes) for e, c in zip(("lo", "hi"), axis, strict=True)))
    rows = rows.filter(reduce(Column.__and__, [F.col("page").isNotNull(), F.col("item").isNotNull(), *(F.col(c).isNotNull() & ~F.isnan(c) for c in ends)]))
    alone = reduce(Column.__and__, (F.col(f"lo{k}") < F.col(f"hi{k}") for k in n))  # a box overlaps its like, if it is not flat
    own = reduce(Column.__mul__, (F.greatest(F.lit(0.0), F.col(f"hi{k}") - F.col(f"lo{k}")) for k in n))
    kinds = rows.groupBy("page", *ends).agg(F.count("*").alias("n"), F.max("item").alias("top"))

    tiled = _tiled(kinds, rows, len(axes))
    tile = ["page", *(f"{c}{k}" for k in n for c in ("size", "bin"))]
    schema = f"page {dict(rows.dtypes)['page']}, {', '.join(f'{c} double' for c in ends)}, met long, pairs double, area double"
    shared = tiled.repartition(F.xxhash64(*tile)).sortWithinPartitions(*tile, "lo0").select(*tile, *ends, "home", "n", "top")
    seen = shared.mapInArrow(_compared(tile, len(axes)), schema)
    seen = kinds.select("page", *ends, "n", "top", F.lit(None).cast("long").alias("met"), F.lit(0.0).alias("pairs"), F.lit(0.0).alias("area")).unionByName(seen.withColumns({"n": F.lit(None).cast("long"), "top": F.lit(None).cast("long")}))
    kinds = seen.groupBy("page", *ends).agg(F.max("n").alias("n"), F.max("top").alias("top"), F.max("met").alias("met"), F.sum("pairs").alias("pairs"), F.sum("area").alias("area"))
    like = F.when(alone, F.col("n") * (F.col("n") - 1) / 2).otherwise(0.0)
    path = scratch(df.sparkSession, "boxes")
    kinds.select("page", *ends, "top", F.greatest("met", F.when(alone, F.col("top"))).alias("met"), (F.col("pairs") + like).alias("pairs"), (F.col("area") + like * own).alias("area")).write.parquet(path)
    kinds = df.sparkSession.read.parquet(path)
    sums = kinds.groupBy("page").agg(F.sum("pairs").alias("pairs"), F.sum("area").alias("area"))

    by_item = rows.groupBy("page", "item").agg(F.count("*").alias("of"))
    last = kinds.filter(F.col("met").isNull() | (F.col("met") <= F.col("top"))).select("page", *ends, "met")
    lost = rows.join(last, ["page", *ends]).filter(F.col("met").isNull() | (F.col("item") >= F.col("met"))).groupBy("page", "item").agg(F.count("*").alias("lost"))
    items = by_item.join(lost, ["page", "item"], "left").filter(F.col("lost").isNull() | (F.col("lost") < F.col("of"))).groupBy("page").agg(F.count("*").alias("items"))

    several = rows.join(by_item.filter("of > 1"), ["page", "item"]).withColumn("key", F.struct("page", "item"))
    twins = met(several, several, "key", [(f"lo{k}", f"hi{k}") for k in n])
    common = reduce(Column.__mul__, (F.greatest(F.lit(0.0), F.least(f"a.hi{k}", f"b.hi{k}") - F.greatest(f"a.lo{k}", f"b.lo{k}")) for k in n))
    twins = twins.groupBy(F.col("a.page").alias("page")).agg(F.count("*").alias("twins"), F.sum(common).alias("twin_area"))
    selves = several.filter(alone).groupBy("page").agg(F.count("*").alias("selves"), F.sum(own).alias("self_area"))
    out = sums.join(twins, "page", "left").join(selves, "page", "left").join(items, "page", "left")
    less = lambda a, b: (F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))) / 2
    out = out.select("page", (F.col("pairs") - less("twins", "selves")).cast("long").alias("pairs"), F.coalesce("items", F.lit(0)).alias("items"), (F.col("area") - less("twin_area", "self_area")).alias("area"))
    return out.filter("pairs > 0")


def _tiled(kinds: DataFrame, rows: DataFrame, axes: int) -> DataFrame:
    """Boxes in their tiles, see `met`; the sizes are those of the rows, which need no shuffle. `home` has two bits an axis:
    the tile is of the box's size, and is its first."""
    n = range(axes)
    extent = [F.abs(F.col(f"hi{k}") - F.col(f"lo{k}")) for k in n]
    sizes = rows.agg(*(F.collect_set(_level(extent[k], SPAN)).alias(f"sizes{k}") for k in n))
    df, home = kinds.crossJoin(F.broadcast(sizes)), F.lit(0)
    for k in n:
        df = df.withColumn(f"own{k}", _level(extent[k], SPAN)).withColumn(f"size{k}", F.explode(f"sizes{k}")).filter(F.col(f"size{k}") >= F.col(f"own{k}"))
        width = F.pow(F.lit(SPAN), F.col(f"size{k}"))
        df = df.withColumn(f"first{k}", F.floor(F.least(f"lo{k}", f"hi{k}") / width))
        df = df.withColumn(f"bin{k}", F.explode(F.sequence(F.col(f"first{k}"), F.floor(F.greatest(f"lo{k}", f"hi{k}") / width))))
        home = home + F.when(F.col(f"size{k}") == F.col(f"own{k}"), 1 << 2 * k).otherwise(0) + F.when(F.col(f"bin{k}") == F.col(f"first{k}"), 2 << 2 * k).otherwise(0)
    return df.withColumn("home", home.cast("tinyint"))


def _compared(tile: Sequence[str], axes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted tiles: each box with the greatest item that it meets; its first box bears the tile's sums."""
    ends = [c for k in range(axes) for c in (f"lo{k}", f"hi{k}")]

    def one(t: pa.Table, lo: np.ndarray, hi: np.ndarray, home: np.ndarray, count: np.ndarray, top: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, full = len(home), (1 << 2 * axes) - 1
        met, pairs, area, none, i = np.full(size, _NONE), 0.0, 0.0, np.int64(_NONE), 0
        until = np.maximum.accumulate(np.searchsorted(lo[0], hi[0], "left"))
        while i < size - 1:
            j = min(size - 1, i + max(1, min(256, BLOCK // max(1, int(until[min(size - 1, i + 255)]) - i))))
            end = max(int(until[j - 1]), i)
            a, b = slice(i, j), slice(i + 1, end)
            if end > i + 1:
                both = (home[a, None] | home[None, b]) == full
                both &= np.arange(i, j)[:, None] < np.arange(i + 1, end)[None, :]
                common = None
                for k in range(axes):
                    both &= lo[k][a, None] < hi[k][None, b]
                    both &= lo[k][None, b] < hi[k][a, None]
                    part = np.minimum(hi[k][a, None], hi[k][None, b])
                    part -= np.maximum(lo[k][a, None], lo[k][None, b])
                    np.maximum(part, 0.0, out=part)
                    common = part if common is None else np.multiply(common, part, out=common)
                common *= both
                pairs += float(count[a] @ (both @ count[b]))
                area += float(count[a] @ (common @ count[b]))
                met[a] = np.maximum(met[a], np.where(both, top[None, b], none).max(1))
                met[b] = np.maximum(met[b], np.where(both, top[a, None], none).max(0))
            i = j
        keep = np.flatnonzero(met != _NONE)
        if len(keep):
            sums = np.zeros((2, len(keep)))
            sums[:, 0] = pairs, area
            t = t.select(["page", *ends]).take(pa.array(keep))
            for name, values in (("met", met[keep]), ("pairs", sums[0]), ("area", sums[1])):
                t = t.append_column(name, pa.array(values))
            yield from t.combine_chunks().to_batches()

    def compared(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(parts)
        if len(t) > 1:
            lo, hi = ([t[f"{e}{k}"].to_numpy() for k in range(axes)] for e in ("lo", "hi"))
            yield from one(t, lo, hi, t["home"].to_numpy(), t["n"].to_numpy().astype(float), t["top"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None  # the parts of the tile that is not yet known to end
        for t in (pa.Table.from_batches([b]) for b in batches if len(b)):
            new = np.zeros(len(t) - 1, bool)
            for c in tile:
                new |= pc.not_equal(t[c][1:], t[c][:-1]).to_numpy()
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(t)]
            for x, y in itertools.pairwise(starts):
                key = [t[c][x].as_py() for c in tile]
                if key != at:
                    yield from compared(held) if held else ()
                    held, at = [], key
                held.append(t.slice(x, y - x))
        yield from compared(held) if held else ()

    return run


def _level(extent: Column, step: float = STEP) -> Column:
    least, most = LEVELS
    return F.least(F.lit(most), F.ceil(F.log(F.greatest(extent, F.lit(step**least))) / F.log(F.lit(step)))).cast("int")

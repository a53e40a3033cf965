"""State transitions of a relational store, as snapshots in and snapshots out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order per key, by partial aggregation: a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    return latest(old.unionByName(new), keys, [version])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert, or do nothing where the key is there."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def compare_and_set(old: DataFrame, changes: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """Changes bear the revision that they read: APPLIED with revision + 1, or CONFLICT with the stored one."""
    c = changes.select(F.col(key).alias("__k"), F.col(revision).alias("__seen"))
    joined = old.join(c, old[key] == F.col("__k"))
    same = F.col("__seen") == F.col(revision)
    return joined.select(key, F.when(same, F.col(revision) + 1).otherwise(F.col(revision)).alias(revision), F.when(same, "APPLIED").otherwise("CONFLICT").alias("outcome"))


def delete_cascade(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def merge_non_null(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    p = patch.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in patch.columns if c != key))
    joined = old.join(p, old[key] == F.col("__k"), "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in patch.columns and c != key else F.col(c) for c in old.columns))


def keep_live(df: DataFrame, at: str, now: Column, ttl: str) -> DataFrame:
    return df.filter(F.col(at) >= now - F.expr(ttl))


def diff(current: DataFrame, other: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """added, removed or changed, per key; equal rows are left out."""
    a = current.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("__a"))
    b = other.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("__b"))
    both = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(~F.col("new_value").eqNullSafe(F.col("old_value")), "changed")
    return both.withColumn("change", change).filter("change is not null").drop("__a", "__b")


def page_after(df: DataFrame, order: Sequence[str], last: Sequence, size: int) -> DataFrame:
    """The next page in descending order after the row `last`; sorts only the top rows."""
    cond, same = F.lit(False), F.lit(True)
    for c, v in zip(order, last, strict=True):
        cond, same = cond | (same & (F.col(c) < F.lit(v))), same & (F.col(c) == F.lit(v))
    return df.filter(cond).orderBy(*(F.desc(c) for c in order)).limit(size)


def search(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower())))


def visible(projects: DataFrame, members: DataFrame, user: str, role: str | None = None) -> DataFrame:
    """What a user may see: an owner or admin every project, others those without members, or with this one."""
    if role in ("OWNER", "ADMIN"):
        return projects
    open_ = projects.join(members.select("project_id"), "project_id", "left_anti")
    return open_.unionByName(projects.join(members.filter(F.col("user_id") == user).select("project_id"), "project_id", "left_semi"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def by_key(df: DataFrame, **key) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    for name, value in key.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def get_or_create(asked: DataFrame, table: DataFrame, keys: Sequence[str], **default: Column) -> DataFrame:
    """One row per key asked for: the stored one, or one of defaults; `created` tells which."""
    both = asked.select(*keys).distinct().join(table.withColumn("found", F.lit(True)), list(keys), "left")
    both = both.withColumns({n: F.when(F.col("found"), F.col(n)).otherwise(v) for n, v in default.items()})
    return both.withColumn("created", F.col("found").isNull()).drop("found")


def replace_children(children: DataFrame, parents: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The children of the parents given give way to the new ones; those of other parents stay."""
    return children.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new)


def returned(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that an update changed, as they are after it."""
    values = [c for c in old.columns if c not in keys]
    before = old.select(*keys, F.struct(*values).alias("before"))
    return new.join(before, list(keys), "left").filter(~F.struct(*values).eqNullSafe(F.col("before"))).drop("before")


def same_ids(given: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(side, key) of ids that only one of the two has: none if the sets are equal."""
    a, b = given.select(key).distinct(), wanted.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("not_wanted").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("not_given").alias("side"), key))


def met_on_either(rows: DataFrame, known: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose key is in any of the columns of the known rows."""
    urls = known.select(F.explode(F.array(*columns)).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return rows.join(urls, key, "left_semi")


def to_documents(df: DataFrame, keys: Sequence[str], document: str = "document") -> DataFrame:
    """All but the keys packed into one JSON text."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys))).alias(document))


def from_documents(df: DataFrame, schema: str, keys: Sequence[str], document: str = "document") -> DataFrame:
    """The rows back; a text that is no JSON object gives nulls and is marked."""
    parsed = F.from_json(document, schema)
    is_object = F.coalesce(F.trim(document).startswith("{"), F.lit(False)) & F.try_parse_json(document).isNotNull()
    return df.select(*keys, F.when(is_object, parsed).alias("d"), is_object.alias("valid")).select(*keys, "d.*", "valid")

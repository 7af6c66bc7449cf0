"""Upserts, replacements and assignments of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.operators.similarity import number


def one_each(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, lg_new): a row for each key, that of the greatest `columns`; null is a key like others."""
    value = F.struct(F.lit(1).alias("lg_any"), *columns)
    return rows.groupBy(*keys).agg(F.max(value).alias("lg_new"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], id_col: str | None = None) -> DataFrame:
    """`old` with the rows of `new` put in: a row of `new` replaces that of its key, other rows stay.

    With `id_col`, which `new` lacks, a replaced row keeps its id and a new key
    has the next ones, in order of keys.  A null in `new` is written as such.
    Of rows of `new` with one key the greatest, by its other columns in their
    order, is put in.  A null in a key is a value like others, so that doing
    the same again changes nothing.
    """
    columns = [c for c in old.columns if c not in keys and c != id_col]
    fresh = one_each(new, keys, columns).withColumnsRenamed({k: f"lg_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"lg_{k}")) for k in keys]
    both = old.withColumn("lg_old", F.lit(True)).join(fresh, same, "full_outer")
    name = [F.when(F.col("lg_old"), F.col(k)).otherwise(F.col(f"lg_{k}")).alias(k) for k in keys]
    pick = [F.when(F.col("lg_new").isNotNull(), F.col(f"lg_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    out = both.select(*name, *pick, *([id_col] if id_col else []))
    if id_col:
        top = old.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
        known = out.where(F.col(id_col).isNotNull())
        added = number(out.where(F.col(id_col).isNull()).drop(id_col), list(keys), top + 1).withColumnRenamed("number", id_col)
        out = known.unionByName(added)
    return out.select(*old.columns)


def numbered(new: DataFrame, order: Sequence[str], id_col: str, top: int) -> DataFrame:
    """`new` with ids after `top`, in the order of `order`."""
    return number(new, list(order), top + 1).withColumnRenamed("number", id_col)


def put_in(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], id_col: str | None, top: int, small: bool) -> DataFrame:
    """As `upsert`, for `fresh` from `one_each`; if that is `small`, the stored rows stay where they are.

    Stored rows meet the fresh ones by broadcast, and the keys found among them,
    no more than there are fresh ones, come back the same way to tell new keys.
    New keys get ids after `top`.
    """
    sent = F.broadcast if small else lambda x: x
    columns = [c for c in stored.columns if c not in keys and c != id_col]
    other = fresh.withColumnsRenamed({k: f"lg_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"lg_{k}")) for k in keys]
    pick = [F.when(F.col("lg_new").isNotNull(), F.col(f"lg_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    kept = stored.join(sent(other), same, "left").select(*keys, *pick, *([id_col] if id_col else []))
    found = stored.select(*keys).join(sent(other.drop("lg_new")), same, "left_semi").distinct()
    added = other.join(sent(found), same, "left_anti").select(*[F.col(f"lg_{k}").alias(k) for k in keys], *[f"lg_new.{c}" for c in columns])
    if id_col:
        added = numbered(added, keys, id_col, top)
    return kept.select(*stored.columns).unionByName(added.select(*stored.columns))


def replace_of(old: DataFrame, new: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """`old` without the rows of the keys in `touched`, and `new`: what was said of them before goes, even if nothing is said now."""
    gone = touched.select(key).distinct()
    return old.join(gone, key, "left_anti").unionByName(new.select(*old.columns))


def assign(old: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """`old` with `column` set where `values` (key, column) has the key; keys that `old` lacks, and null keys, change nothing.

    Of several values of a key the greatest is set.
    """
    new = one_each(values, [key], [column]).withColumnRenamed(key, "lg_key")
    out = old.join(new, F.col(key) == F.col("lg_key"), "left")
    return out.withColumn(column, F.when(F.col("lg_new").isNotNull(), F.col(f"lg_new.{column}")).otherwise(F.col(column))).select(*old.columns)


def get_or_create(persons: DataFrame, names: DataFrame) -> DataFrame:
    """`persons` (id, name) with each name of `names` in it; new ones have the next ids, in order of names."""
    new = names.select("name").where("name IS NOT NULL").distinct().join(persons, "name", "left_anti")
    top = persons.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return persons.unionByName(number(new, ["name"], top + 1).select(F.col("number").alias("id"), "name"))


def rename(persons: DataFrame, person_id: int, name: str) -> DataFrame:
    """`persons` with one renamed; a name that another has is an error."""
    if not persons.where((F.col("name") == name) & (F.col("id") != person_id)).isEmpty():
        raise ValueError(f"another person has the name {name!r}")
    return persons.withColumn("name", F.when(F.col("id") == person_id, F.lit(name)).otherwise(F.col("name")))

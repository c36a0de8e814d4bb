"""Shapes that several stages share: anti-join and upsert, first and last of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. A row number is enough for a partial limit
    before the shuffle, so hot keys don't travel whole."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def last_by(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The last row of each key by ``pos``."""
    return first_by(df, keys, [F.desc(pos)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def new_ids(ids: DataFrame, cached: DataFrame, key: str = "pmid") -> DataFrame:
    """Ids that are not cached yet."""
    return ids.join(cached.select(key).distinct(), key, "left_anti")


def in_ids(df: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is listed; no list at all lets everything through, an empty
    one nothing."""
    return df if ids is None else df.join(ids.select(key).distinct(), key, "left_semi")


def lookup(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Fill nulls of ``column`` from ``values`` (key, column), one row for each key."""
    one = values.groupBy(key).agg(F.min(column).alias("_new"))
    return df.join(one, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def flag(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Whether the key occurs in ``keys``."""
    marked = keys.select(key).distinct().withColumn("_in", F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")


def first_source(df: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """Left join to the first of several sources that has the key; adds
    ``source_pos`` and the sources' columns."""
    tagged = [s.withColumn("source_pos", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    return df.join(first_by(every, [key], [F.col("source_pos")]), key, "left")


def union_ids(ids: list[DataFrame], distinct: bool = False) -> DataFrame:
    out = ids[0]
    for x in ids[1:]:
        out = out.union(x)
    return out.distinct() if distinct else out


def merged_maps(right_wins: Column, over: Column) -> Column:
    """Entries of both maps; of a key in both the entry of ``right_wins``."""
    rest = F.map_filter(over, lambda k, _: ~F.map_contains_key(right_wins, k))
    return F.map_concat(rest, right_wins)

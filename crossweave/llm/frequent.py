"""Most frequent items among billions by exact spillable aggregation (problem 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.functions.keys import with_keys


def item_counts(tables: list[DataFrame], item: str = "itemId") -> DataFrame:
    """(item_key, n_rows) over all tables taken as one; absent ids don't count. Each map task combines its rows into one
    state per key, so a hot key shuffles one row a task; hash tables that don't fit spill sorted runs."""
    keys = reduce(DataFrame.unionByName, [with_keys(t, {"item_key": item}) for t in tables])
    return keys.where("item_key is not null").groupBy("item_key").agg(F.count(F.lit(1)).alias("n_rows"))


def most_frequent(tables: list[DataFrame], k: int, item: str = "itemId") -> DataFrame:
    """(item_key, n_rows, total): the k most frequent keys, equal counts by key; total counts all rows with a key. The
    counts are exact. Each partition keeps its own k best and one final limit merges those, so the driver and the last
    task see k rows a partition, never the distinct keys."""
    counts = item_counts(tables, item)
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"))
    return counts.orderBy(F.desc("n_rows"), "item_key").limit(k).withColumn("total", total.scalar())


def frequent_keys(tables: list[DataFrame], share: tuple[int, int], item: str = "itemId") -> DataFrame:
    """(item_key, n_rows, total) of the keys with at least share[0] / share[1] of the rows. No more than share[1] //
    share[0] keys can have that, so it is a filter on that many most frequent ones."""
    best = most_frequent(tables, share[1] // share[0], item)
    return best.where(F.col("n_rows") * share[1] >= F.col("total") * share[0])

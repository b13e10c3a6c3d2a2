"""Dense ids for users and items, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.operators.scale import lookup, rank_rows


def dense_ids(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Adds ``out``: 0.. in the given order, which has to be total; no window spans ranges of rows, see rank_rows."""
    return rank_rows(df, order, out).withColumn(out, F.col(out) - 1)


def user_presence(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(userId, in_src, in_tgt) of all users that aren't null."""
    one = src.select("userId", F.lit(True).alias("s"), F.lit(False).alias("t"))
    two = tgt.select("userId", F.lit(False).alias("s"), F.lit(True).alias("t"))
    return one.unionByName(two).where("userId is not null").groupBy("userId").agg(F.max("s").alias("in_src"), F.max("t").alias("in_tgt"))


def user_index(presence: DataFrame, domain: str) -> DataFrame:
    """(userId, uid, is_shared) of one domain ('src' or 'tgt'): shared users first, in the order of their ids, then the
    domain's own. So shared users have one uid in both domains and every other uid stands for different people."""
    mine = presence.where(f"in_{domain}").select("userId", (F.col("in_src") & F.col("in_tgt")).alias("is_shared"))
    return dense_ids(mine, [F.desc("is_shared"), "userId"], "uid").select("userId", "uid", "is_shared")


def item_index(ratings: DataFrame) -> DataFrame:
    """(itemId, iid) in the order of itemId."""
    return dense_ids(ratings.select("itemId").where("itemId is not null").distinct(), ["itemId"], "iid").select("itemId", "iid")


def item_index_first_seen(ratings: DataFrame, position: str) -> DataFrame:
    """(itemId, iid) in the order in which items first appear by an explicit position, then itemId."""
    first = ratings.where("itemId is not null").groupBy("itemId").agg(F.min(position).alias("_first"))
    return dense_ids(first, [F.asc_nulls_last("_first"), "itemId"], "iid").select("itemId", "iid")


def apply_index(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """ratings with uid and iid in place of userId and itemId; rows that name neither are dropped."""
    return lookup(lookup(ratings, users.select("userId", "uid"), ["userId"]), items, ["itemId"]).drop("userId", "itemId")


def dataset_stats(indexed: DataFrame, n_shared: int, domain: str) -> DataFrame:
    """(domain, n_users, n_items, n_shared)."""
    return indexed.agg(F.countDistinct("uid").alias("n_users"), F.countDistinct("iid").alias("n_items")).select(F.lit(domain).alias("domain"), "n_users", "n_items", F.lit(n_shared).cast("long").alias("n_shared"))

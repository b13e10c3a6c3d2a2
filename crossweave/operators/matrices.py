"""Sparse matrices as (row, column, value) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators.scale import lookup


def ui_matrix(train: DataFrame) -> DataFrame:
    """(uid, iid, cnt) of positives; repeated rows add up."""
    return train.where("r = 1").groupBy("uid", "iid").agg(F.sum("r").cast("long").alias("cnt"))


def user_pos_counts(matrix: DataFrame) -> DataFrame:
    """(uid, n_pos): distinct positives of each user."""
    return matrix.groupBy("uid").agg(F.count(F.lit(1)).alias("n_pos"))


def sim_pairs(paths: DataFrame, src_items: DataFrame, tgt_items: DataFrame, strict: bool = False) -> DataFrame:
    """(src_iid, tgt_iid), distinct, of the paths (n1_asin, n2_asin). Paths with an unknown end are left out (see
    missing_items); strict raises when there is one."""
    if strict and not missing_items(paths, src_items, tgt_items).isEmpty():
        raise ValueError("a path names an item that isn't in the index")
    x = lookup(paths.select("n1_asin", "n2_asin").distinct(), src_items.select(F.col("itemId").alias("n1_asin"), F.col("iid").alias("src_iid")), ["n1_asin"])
    return lookup(x, tgt_items.select(F.col("itemId").alias("n2_asin"), F.col("iid").alias("tgt_iid")), ["n2_asin"]).select("src_iid", "tgt_iid").distinct()


def missing_items(paths: DataFrame, src_items: DataFrame, tgt_items: DataFrame) -> DataFrame:
    """(n1_asin, n2_asin), distinct, of paths with an end that isn't in the index or is null."""
    p = paths.select("n1_asin", "n2_asin").distinct()
    a = lookup(p, src_items.select(F.col("itemId").alias("n1_asin")), ["n1_asin"], "left_anti")
    b = lookup(p, tgt_items.select(F.col("itemId").alias("n2_asin")), ["n2_asin"], "left_anti")
    return a.unionByName(b).distinct()


def sim_adjacency(sim: DataFrame) -> DataFrame:
    """(src_iid, n_tgt, tgt_iids): targets of each source item, joined with commas in ascending order."""
    return sim.groupBy("src_iid").agg(F.count(F.lit(1)).alias("n_tgt"), F.array_join(F.sort_array(F.collect_list("tgt_iid")), ",").alias("tgt_iids"))

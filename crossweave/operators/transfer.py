"""Items that shared users' source tastes suggest in the target domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators.scale import is_small, lookup, tasks_of

#: Items of a block.
ITEM_BLOCK = 4096


def warm_users(src_matrix: DataFrame, n_shared: int, above: int = 15) -> DataFrame:
    """(uid, n_pos) of shared users with more than ``above`` source positives."""
    return src_matrix.where(F.col("uid") < n_shared).groupBy("uid").agg(F.count(F.lit(1)).alias("n_pos")).where(F.col("n_pos") > above)


def cold_users(tgt_matrix: DataFrame, n_shared: int, at_most: int = 5) -> DataFrame:
    """(uid, n_pos) of shared users with no more than ``at_most`` target positives, those with none included."""
    counts = tgt_matrix.where(F.col("uid") < n_shared).groupBy("uid").agg(F.count(F.lit(1)).alias("_n"))
    everyone = tgt_matrix.sparkSession.range(n_shared).withColumnRenamed("id", "uid")
    return everyone.join(counts, "uid", "left").select("uid", F.coalesce("_n", F.lit(0)).alias("n_pos")).where(F.col("n_pos") <= at_most)


def transfer_users(warm: DataFrame, cold: DataFrame) -> DataFrame:
    return warm.select("uid").join(cold.select("uid"), "uid", "left_semi")


def transfer_candidates(top: DataFrame, users: DataFrame, sim: DataFrame) -> DataFrame:
    """(uid, iid), distinct: target items that a path joins to a top source item of one of users. The users are cut down
    before the expansion. A source item with many paths and many users is spread by salting, see lookup."""
    mine = top.join(users.select("uid"), "uid", "left_semi").select("uid", F.col("iid").alias("src_iid"))
    return lookup_many(mine, sim).select("uid", F.col("tgt_iid").alias("iid")).distinct()


def lookup_many(mine: DataFrame, sim: DataFrame) -> DataFrame:
    """mine joined with the targets of src_iid, gathered in lists of one item block each, so that no list grows with the
    paths of an item."""
    lists = sim.groupBy("src_iid", F.floor(F.col("tgt_iid") / ITEM_BLOCK).alias("_block")).agg(F.collect_list("tgt_iid").alias("_t"))
    return lookup(mine, lists.drop("_block"), ["src_iid"]).select("uid", F.explode("_t").alias("tgt_iid"))


def transfer_pairs(candidates: DataFrame, tgt_matrix: DataFrame) -> DataFrame:
    """Candidates that aren't target positives of the user; few positives are broadcast, so that candidates stay in place."""
    known = tgt_matrix.select("uid", "iid")
    return candidates.join(F.broadcast(known) if is_small(known) else known, ["uid", "iid"], "left_anti")


def negative_candidates(users: DataFrame, items: DataFrame, tgt_matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, iid): all items for each of users but their target positives and transfer items, for any number of users.
    Each user meets each block of items once, as an array, and what the user has in that block is taken out of it: the
    product never goes through a shuffle, only to the result."""
    block = F.floor(F.col("iid") / ITEM_BLOCK).alias("_block")
    users, items = users.select("uid").distinct(), items.select("iid").distinct()
    known = tgt_matrix.select("uid", "iid").unionByName(pairs.select("uid", "iid")).join(users, "uid", "left_semi")
    known = known.groupBy("uid", block).agg(F.collect_set("iid").alias("_known"))  # ITEM_BLOCK items at most
    blocks = items.groupBy(block).agg(F.collect_list("iid").alias("_items"))
    last = items.agg(F.coalesce(F.max(F.floor(F.col("iid") / ITEM_BLOCK)), F.lit(-1)).alias("_last")).scalar()
    met = users.withColumn("_last", last).where("_last >= 0").select("uid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_block"))
    met = met.repartition(tasks_of(users.sparkSession), "uid", "_block").join(known, ["uid", "_block"], "left")  # few small rows become many
    left = F.when(F.col("_known").isNull(), F.col("_items")).otherwise(F.array_except("_items", "_known"))
    return lookup(met, blocks, ["_block"]).select("uid", F.explode(left).alias("iid"))

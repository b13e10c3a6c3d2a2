"""Sampled negatives: uniform draws with replacement by a seeded hash, marked where they hit a train positive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.functions.hashing import seeded_hash


def draw_hash(n_items: int, seed: int | str) -> Column:
    """Item of a draw, from uid, pos_iid and draw: a hash of 60 bits taken modulo the number of items, so that every item
    of any catalogue may be drawn and none is favoured by more than n_items / 2**60."""
    return F.pmod(seeded_hash(seed, "draw", "uid", "pos_iid", "draw"), F.lit(n_items).cast("long"))


def draws(positives: DataFrame, matrix: DataFrame, n_items: int, m: int, seed: int | str) -> DataFrame:
    """(uid, pos_iid, draw, iid, is_false): m draws for each (uid, pos_iid); is_false marks items that are train
    positives of the user. Draws may repeat, and may hit a held-out positive, which the sampler can't know."""
    x = positives.select("uid", "pos_iid", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("draw")).withColumn("iid", draw_hash(n_items, seed))
    known = matrix.select("uid", "iid", F.lit(1).alias("_k"))
    return x.join(known, ["uid", "iid"], "left").select("uid", "pos_iid", "draw", "iid", F.col("_k").isNotNull().cast("int").alias("is_false"))


def first_true(drawn: DataFrame) -> DataFrame:
    """(uid, pos_iid, neg_iid, is_false): the first true negative, or the first draw if none is."""
    order = F.struct("is_false", "draw")
    return drawn.groupBy("uid", "pos_iid").agg(F.min_by("iid", order).alias("neg_iid"), F.min("is_false").alias("is_false"))


def keep_best(drawn: DataFrame, n: int) -> DataFrame:
    """(uid, pos_iid, slot, iid): n draws, true ones first, in drawing order; slots from 1. Groups have m rows each."""
    w = Window.partitionBy("uid", "pos_iid").orderBy("is_false", "draw")
    return drawn.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n).select("uid", "pos_iid", "slot", "iid")

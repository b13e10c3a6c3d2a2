"""Epochs as tables: shuffled batches and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.functions.hashing import seeded_hash
from crossweave.operators import logic, splits


def epoch_batches(positives: DataFrame, size: int, epoch: int, seed: int | str = 0) -> DataFrame:
    """(uid, iid, batch): the epoch's own shuffle by hash, cut into batches. Ranked in ranges of the hash, not in one task."""
    ranked = splits.ranked(positives, [], seeded_hash(seed, f"batch {epoch}", "uid", "iid"))
    return ranked.select("uid", "iid", F.floor((F.col("rn") - 1) / size).alias("batch"))


def batch_count(positives: DataFrame, size: int) -> DataFrame:
    return positives.agg(F.ceil(F.count(F.lit(1)) / size).alias("n_batches"))


def epoch_summary(scored: DataFrame, p: float) -> DataFrame:
    """(loss, sat): means over batches of the batches' own loss and satisfaction; scored has batch, pos_score, neg_score."""
    pos, neg = F.col("pos_score"), F.col("neg_score")
    per = scored.groupBy("batch").agg(F.avg(logic.softplus_loss(pos, neg)).alias("l"), logic.forall(logic.truth(pos, neg), p).alias("s"))
    return per.agg(F.round(F.avg("l"), 6).alias("loss"), F.round(F.avg("s"), 6).alias("sat"))

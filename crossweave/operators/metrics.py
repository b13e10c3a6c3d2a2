"""Ranking and pairwise metrics over candidate tables."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.operators.logic import softplus_loss


class Metric(Enum):
    """Metrics by name; the number after @ is k."""

    AUC = "AUC"
    LOSS = "LOSS"
    NDCG10 = "NDCG@10"
    HR10 = "HR@10"

    @property
    def k(self) -> int | None:
        return int(self.value.split("@")[1]) if "@" in self.value else None

    @property
    def of_pairs(self) -> bool:
        """Whether it is taken of pairs of scores instead of candidate rankings."""
        return self in (Metric.AUC, Metric.LOSS)


ROW = ["uid", "pos_iid"]


def ranked_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each row (uid, pos_iid) by score descending, then candidate position."""
    w = Window.partitionBy(*ROW).orderBy(F.desc("score"), "cand_pos")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ndcg_at_k(candidates: DataFrame, k: int) -> DataFrame:
    """(uid, pos_iid, value): candidates is (uid, pos_iid, cand_pos, is_pos, score), is_pos the relevance; null without any
    relevant candidate. k may exceed the number of candidates."""
    gain = F.sum(F.col("is_pos") / F.log2(F.col("rank") + 1))
    got = ranked_candidates(candidates, k).groupBy(*ROW).agg(gain.alias("_g"))
    w = Window.partitionBy(*ROW).orderBy(F.desc("is_pos"), "cand_pos")
    ideal = candidates.where("is_pos > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy(*ROW).agg(gain.alias("_i"))
    return got.join(ideal, ROW, "left").select(*ROW, F.round(F.try_divide("_g", "_i"), 6).alias("value"))


def hit_at_k(candidates: DataFrame, k: int) -> DataFrame:
    """(uid, pos_iid, value): 1 if a relevant candidate is among the first k, else 0."""
    return ranked_candidates(candidates, k).groupBy(*ROW).agg((F.max("is_pos") > 0).cast("int").alias("value"))


def row_metrics(candidates: DataFrame, k: int) -> DataFrame:
    """(uid, pos_iid, ndcg, hit) for rows with one relevant candidate, in one aggregation: its rank alone gives both."""
    w = Window.partitionBy(*ROW).orderBy(F.desc("score"), "cand_pos")
    return of_rank(candidates.withColumn("rank", F.row_number().over(w)).where("is_pos = 1"), k)


def of_rank(at: DataFrame, k: int) -> DataFrame:
    """(uid, pos_iid, ndcg, hit) of the rank of each row's one relevant candidate."""
    hit = F.col("rank") <= k
    return at.select(*ROW, F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0).alias("ndcg"), hit.cast("int").alias("hit"))


def auc_user_macro(pairs: DataFrame) -> DataFrame:
    """(auc): mean over users of the share of their pairs whose positive scores strictly higher."""
    per_user = pairs.groupBy("uid").agg(F.avg((F.col("pos_score") > F.col("neg_score")).cast("double")).alias("_a"))
    return per_user.agg(F.round(F.avg("_a"), 6).alias("auc"))


def eval_summary(rows: DataFrame, n_shared: int) -> DataFrame:
    """(n_rows, ndcg10, hr10, ndcg10_shared, hr10_shared) in one pass over row_metrics; null where there are no rows."""
    shared = lambda c: F.avg(F.when(F.col("uid") < n_shared, F.col(c)))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("ndcg"), 6).alias("ndcg10"), F.round(F.avg("hit"), 6).alias("hr10"),
        F.round(shared("ndcg"), 6).alias("ndcg10_shared"), F.round(shared("hit"), 6).alias("hr10_shared"),
    )


def compute(metric: Metric, table: DataFrame) -> DataFrame:
    """The rows of a metric: pairs (uid, pos_score, neg_score) for AUC and LOSS, candidates for the others."""
    if metric is Metric.AUC:
        return auc_user_macro(table)
    if metric is Metric.LOSS:
        return table.agg(F.round(F.avg(softplus_loss(F.col("pos_score"), F.col("neg_score"))), 6).alias("loss"))
    if metric is Metric.NDCG10:
        return ndcg_at_k(table, metric.k)
    if metric is Metric.HR10:
        return hit_at_k(table, metric.k)
    raise ValueError(f"unknown metric {metric}")

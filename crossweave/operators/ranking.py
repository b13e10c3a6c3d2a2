"""The adaptive number of top items for each user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least ideal gain, to keep a user without relevant items from dividing by 0. Fixed value: the step of doubles at 1.
EPSILON = 2.220446049250313e-16


def with_relevance(ranking: DataFrame, positives: DataFrame) -> DataFrame:
    """ranking (uid, iid, rank, ...) with rel, 1 for the user's positives."""
    p = positives.select("uid", "iid", F.lit(1).alias("_p"))
    return ranking.join(p, ["uid", "iid"], "left").withColumn("rel", F.coalesce("_p", F.lit(0))).drop("_p")


def ndcg_curve(ranking: DataFrame, counts: DataFrame, n_items: int) -> DataFrame:
    """(uid, k, ndcg) for k from n to 2n, n being the user's n_pos in counts, at most n_items; ranking (uid, rank, rel)
    has the first 2n places."""
    w = Window.partitionBy("uid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = ranking.join(counts, "uid").withColumn("gain", F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).over(w))
    x = x.withColumn("ideal", F.sum(F.when(F.col("rank") <= F.col("n_pos"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).over(w))
    x = x.where((F.col("rank") >= F.col("n_pos")) & (F.col("rank") <= F.least(2 * F.col("n_pos"), F.lit(n_items))))
    return x.select("uid", F.col("rank").alias("k"), F.round(F.col("gain") / F.greatest("ideal", F.lit(EPSILON)), 6).alias("ndcg"))


def best_k(curve: DataFrame, counts: DataFrame) -> DataFrame:
    """(uid, n_pos, best_k): the first k at which the curve is highest."""
    best = curve.groupBy("uid").agg(F.max_by("k", F.struct("ndcg", -F.col("k"))).alias("best_k"))
    return best.join(counts, "uid").select("uid", "n_pos", "best_k")


def best_k_closed_form(ranking: DataFrame, counts: DataFrame) -> DataFrame:
    """(uid, n_pos, best_k) without the curve: from n on the ideal gain is constant and the gain never falls, so the first
    maximum is at the last positive within 2n, or at n. One aggregation instead of two running sums."""
    x = ranking.join(counts, "uid")
    last = F.max(F.when((F.col("rel") > 0) & (F.col("rank") <= 2 * F.col("n_pos")), F.col("rank")))
    return x.groupBy("uid", "n_pos").agg(last.alias("_last")).select("uid", "n_pos", F.greatest("n_pos", F.coalesce("_last", F.lit(0))).cast("int").alias("best_k"))


def top_k(ranking: DataFrame, best: DataFrame) -> DataFrame:
    """(uid, iid, rank) of each user's first best_k places."""
    return ranking.join(best.select("uid", "best_k"), "uid").where("rank <= best_k").select("uid", "iid", "rank")

"""Scores of matrix-factorization models, for given pairs and for the best items of each user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.operators.scale import cut, lookup, rank_in_groups

#: Users and items of a block; a task holds one block of scores of USER_BLOCK x ITEM_BLOCK doubles.
USER_BLOCK, ITEM_BLOCK = 512, 4096
#: Places of one user that one window ranks at most.
WINDOW_ROWS = 2_000_000


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of one length, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def checked(score: Column) -> Column:
    """The score; a NaN is an error."""
    return F.when(F.isnan(score), F.raise_error(F.lit("a score is NaN"))).otherwise(score)


def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, global_bias: float = 0.0) -> DataFrame:
    """pairs (uid, iid, ...) with score: dot product plus user, item and global bias, rounded to 6 places. users is (uid,
    v, b), items (iid, v, b)."""
    u = users.select("uid", F.col("v").alias("_u"), F.col("b").alias("_bu"))
    i = items.select("iid", F.col("v").alias("_i"), F.col("b").alias("_bi"))
    x = lookup(lookup(pairs, u, ["uid"]), i, ["iid"])
    s = F.round(dot(F.col("_u"), F.col("_i")) + F.col("_bu") + F.col("_bi") + F.lit(float(global_bias)), 6)
    return x.withColumn("score", checked(s)).select(*pairs.columns, "score")


def _blocks(df: DataFrame, key: str, size: int, extra: list[str] = ()) -> DataFrame:
    """One row for each block of about ``size`` keys: arrays of keys and extra columns, and all vectors end to end."""
    members = F.collect_list(F.struct(F.col(key), *[F.col(c) for c in extra], "v"))
    b = df.groupBy(F.floor(F.col(key) / size).alias("_block")).agg(members.alias("_m"))
    field = lambda c, kind: F.transform("_m", lambda x: x[c].cast(kind))
    columns = [field(key, "long").alias(f"{key}s"), *[field(c, "long").alias(f"{key}_{c}") for c in extra]]
    return b.select(*columns, F.flatten(field("v", "array<double>")).alias(f"{key}_v"))


def top_scores(users: DataFrame, items: DataFrame) -> DataFrame:
    """As ranked_scores, with users of equal vectors ranked once, at the depth that the neediest of them asks for. The
    vectors' numbers are written, so that both sides of the join have the same."""
    if users.select("v").distinct().count() * 2 > users.count():
        return ranked_scores(users, items)
    distinct = cut(users.groupBy("v").agg(F.max("need").alias("need"), F.min("uid").alias("_as")))
    mine = users.join(distinct.select("v", "_as"), "v").select("uid", "need", "_as")
    places = ranked_scores(distinct.select(F.col("_as").alias("uid"), "need", "v"), items).withColumnRenamed("uid", "_as")
    lists = places.groupBy("_as", F.floor((F.col("rank") - 1) / ITEM_BLOCK)).agg(F.collect_list(F.struct("iid", "score", "rank")).alias("_p")).select("_as", "_p")
    x = lookup(mine, lists, ["_as"]).select("uid", "need", F.explode("_p").alias("p"))
    return x.select("uid", "need", "p.*").where(F.col("rank") <= F.col("need")).select("uid", "iid", "score", "rank")


def ranked_scores(users: DataFrame, items: DataFrame) -> DataFrame:
    """(uid, iid, score, rank) of the best ``need`` items of each user of users (uid, need, v) among items (iid, v): score
    descending, rounded to 6 places, then iid.

    Blocks of users meet blocks of items; a block pair is one matrix product that gives on each user's best ``need``
    items only, so all pairs are scored but never become rows. What is left of a user, at most need rows for each item
    block, is ranked in a window, or, if one user could have more than WINDOW_ROWS, in sorted ranges that cut users up.
    Neither side goes through the driver."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                uid, need, iid = get("uids"), get("uid_need"), get("iids")
                order = np.argsort(iid, kind="stable")
                u, v = get("uid_v").reshape(len(uid), -1), get("iid_v").reshape(len(iid), -1)[order]
                iid, scores = iid[order], np.round(u @ v.T, 6) + 0.0
                if np.isnan(scores).any():
                    raise ValueError("a score is NaN")
                out_u, out_i, out_s = [], [], []
                for row in range(len(uid)):
                    n = min(int(need[row]), len(iid))
                    if n <= 0:
                        continue
                    s = scores[row]
                    if n < len(iid):
                        least = -np.partition(-s, n - 1)[n - 1]
                        at = np.flatnonzero(s >= least)
                    else:
                        at = np.arange(len(iid))
                    at = at[np.argsort(-s[at], kind="stable")][:n]
                    out_u.append(np.full(n, uid[row]))
                    out_i.append(iid[at])
                    out_s.append(s[at])
                if out_u:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_u, out_i, out_s)], ["uid", "iid", "score"])

    left, right = _blocks(users, "uid", USER_BLOCK, ["need"]), _blocks(items, "iid", ITEM_BLOCK)
    met = left.repartition(F.col("uids")[0]).join(right)  # every block of users with every block of items
    rows = met.mapInArrow(best, "uid long, iid long, score double")
    order = [F.desc("score"), "iid"]
    most = users.agg(F.coalesce(F.max("need"), F.lit(0))).first()[0]
    n_items, last = items.agg(F.count(F.lit(1)), F.coalesce(F.max("iid"), F.lit(0))).first()
    if min(n_items, most * (last // ITEM_BLOCK + 1)) > WINDOW_ROWS:
        ranks = rank_in_groups(rows, ["uid"], order, "rank").withColumn("rank", F.col("rank").cast("int"))
    else:
        ranks = rows.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*order)))
    x = lookup(ranks, users.select("uid", "need"), ["uid"])
    return x.where(F.col("rank") <= F.col("need")).select("uid", "iid", "score", "rank")

"""Reproducible splits and thinning. Randomness is a hash of seed, purpose and the row's ids, so the result doesn't hang on
partitioning, two seeds have nothing in common, and no user's rows are one task's work."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.functions.hashing import seeded_hash
from crossweave.operators.scale import lookup, rank_in_groups


def split_hash(seed: int | str) -> Column:
    """The order of a split."""
    return seeded_hash(seed, "split", "uid", "iid")


def ranked(df: DataFrame, group: list[str], hashed: Column) -> DataFrame:
    """Adds n, the rows of the group, and rn, the row's place in it by (hashed, uid, iid), from 1; see rank_in_groups for
    how a group with most of the rows is spread."""
    x = rank_in_groups(df.withColumn("_h", hashed), group, ["_h", "uid", "iid"], "rn", "n")
    return x.drop("_h")


def _two_picks(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with split: of each user's positives the first by ``order`` is the test row if there are two or more, and the
    second the validation row if there are three or more; all else is train. Each task keeps three rows a user before
    rows meet by user, and the picks go back by (uid, iid), so a user with most rows is spread out. Equal rows are told
    apart by their number."""
    x = df.withColumn("_d", F.row_number().over(Window.partitionBy("uid", "iid", "r").orderBy(*order)))
    mine = Window.partitionBy("uid")
    first = x.where("r = 1").withColumn("_k", F.row_number().over(mine.orderBy(*order, "_d"))).where("_k <= 3")
    label = F.when((F.col("_k") == 1) & (F.col("_n") >= 2), "test").when((F.col("_k") == 2) & (F.col("_n") >= 3), "val")
    picks = first.withColumn("_n", F.max("_k").over(mine)).select("uid", "iid", F.lit(1).alias("r"), "_d", label.alias("_s")).where("_s is not null")
    return x.join(picks, ["uid", "iid", "r", "_d"], "left").withColumn("split", F.coalesce("_s", F.lit("train"))).select(*df.columns, "split")


class SplitStrategy(Protocol):
    """Anything that labels rows (uid, iid, r, ...) with split in train, val, test."""

    def split(self, df: DataFrame) -> DataFrame: ...


class LeaveOneOut:
    """One random positive of each user for test and one of the rest for validation."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def split(self, df: DataFrame) -> DataFrame:
        return _two_picks(df, [split_hash(self.seed), F.col("iid")])


class LeaveLastOut:
    """As LeaveOneOut with the last positive by time; equal times by iid descending, null times first."""

    def __init__(self, time: str = "dt"):
        self.time = time

    def split(self, df: DataFrame) -> DataFrame:
        return _two_picks(df, [F.desc_nulls_last(self.time), F.desc("iid")])


class PercentSplit:
    """Shares of test and of what is left for validation: per user and class (at least one row of each class with two or
    more, and none of users without positives), or over all users, stratified by class (floor of the share)."""

    def __init__(self, seed: int = 0, val_size: float = 0.25, test_size: float = 0.2, user_level: bool = True):
        if val_size + test_size > 1:
            raise ValueError("val_size + test_size has to be 1 at most")
        self.seed, self.val_size, self.test_size, self.user_level = seed, val_size, test_size, user_level

    def split(self, df: DataFrame) -> DataFrame:
        x = ranked(df, ["uid", "r"] if self.user_level else ["r"], split_hash(self.seed))
        if self.user_level:
            quota = lambda n, f: F.when(n > 1, F.greatest(F.lit(1), F.floor(n * f))).otherwise(0)
            x = lookup(x, df.where("r = 1").select("uid").distinct().withColumn("_any", F.lit(True)), ["uid"], "left")
        else:
            quota = lambda n, f: F.floor(n * f)
            x = x.withColumn("_any", F.lit(True))
        test = quota(F.col("n"), self.test_size)
        val = quota(F.col("n") - test, self.val_size)
        label = F.when(F.col("_any").isNull(), "train").when(F.col("rn") <= test, "test").when(F.col("rn") <= test + val, "val").otherwise("train")
        return x.withColumn("split", label).select(*df.columns, "split")


def thin_shared(df: DataFrame, keep: float, n_shared: int, seed: int) -> DataFrame:
    """Rows of shared users (uid < n_shared) thinned to the share ``keep`` of each user's rows, half-even rounded; other
    users' rows stay. 0 and 1 need no ranking."""
    if not 0 <= keep <= 1:
        raise ValueError("keep has to be between 0 and 1")
    if keep == 1:
        return df
    others = df.where(F.col("uid") >= n_shared)
    if keep == 0:
        return others
    kept = ranked(df.where(F.col("uid") < n_shared), ["uid"], seeded_hash(seed, "thin", "uid", "iid")).where(F.col("rn") <= F.bround(F.lit(float(keep)) * F.col("n")))
    return kept.select(*df.columns).unionByName(others)


def only_shared(df: DataFrame, n_shared: int) -> DataFrame:
    return df.where(F.col("uid") < n_shared)

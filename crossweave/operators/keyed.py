"""Per-key results of tables in which a handful of keys hold most rows (problem 3).

No key is ever one task's work: a first aggregation by the pair (key, partner) is combined on the map side, so a hot
key is spread over its partners and a repeated pair over the map tasks; what is left of it are mergeable states
(rows, valid ratings, their sum), and a second algebraic aggregation, again combined on the map side, sends one
compact state per task and key. Spark's hash aggregation falls back to sorted spilling when its table is full, so
memory doesn't grow with the number of keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.functions.keys import with_keys


def row_states(df: DataFrame, user: str = "userId", item: str = "itemId", value: str | None = "rating", low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(user_key, item_key, n, n_valid, total) of each row; absent ids are null keys. Values that are null, NaN or outside
    [low, high] count as rows but not for the mean."""
    keep = [df[value].cast("double").alias("v")] if value else [F.lit(None).cast("double").alias("v")]
    x = with_keys(df, {"user_key": user, "item_key": item}, keep)
    valid = F.col("v").between(low, high) & ~F.isnan("v")
    return x.select("user_key", "item_key", F.lit(1).cast("long").alias("n"), F.when(valid, 1).otherwise(0).cast("long").alias("n_valid"), F.when(valid, F.col("v")).alias("total"))


def pair_states(df: DataFrame, user: str = "userId", item: str = "itemId", value: str | None = "rating", low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(user_key, item_key, n, n_valid, total): the row_states of each pair merged into one."""
    x = row_states(df, user, item, value, low, high)
    return x.groupBy("user_key", "item_key").agg(*[F.sum(c).alias(c) for c in ("n", "n_valid", "total")])


def per_key(states: DataFrame, by: list[str] = ()) -> DataFrame:
    """(*by, field_name, key_value, n_rows, n_partners, mean_value) of pair states: for every present user and item its
    rows, distinct present partners and mean of the valid values (null if it has none, rounded to 6 places after
    adding 1e-9, so that sums taken in another order don't round otherwise)."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("userId").alias("field_name"), F.col("user_key").alias("key_value"), F.col("item_key").isNotNull().alias("partner")),
            F.struct(F.lit("itemId").alias("field_name"), F.col("item_key").alias("key_value"), F.col("user_key").isNotNull().alias("partner")),
        )
    )
    x = states.select(*by, sides.alias("s"), "n", "n_valid", "total").select(*by, "s.*", "n", "n_valid", "total").where("key_value is not null")
    return x.groupBy(*by, "field_name", "key_value").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("partner").cast("long")).alias("n_partners"),
        F.round(F.try_divide(F.sum("total"), F.sum("n_valid").cast("double")) + F.lit(1e-9), 6).alias("mean_value"),
    )


def heavy_keys(results: DataFrame, by: list[str], share: tuple[int, int]) -> DataFrame:
    """The rows of per_key results whose key holds at least share[0] / share[1] of the rows of its field. The totals
    have one row for each table and field, so their broadcast doesn't grow with the data."""
    totals = results.groupBy(*by, "field_name").agg(F.sum("n_rows").alias("_all"))
    x = results.join(F.broadcast(totals), [*by, "field_name"])
    return x.where(F.col("n_rows") * share[1] >= F.col("_all") * share[0]).drop("_all")


def union_of(states: dict[str, DataFrame], label: str = "table_name") -> DataFrame:
    parts = [df.withColumn(label, F.lit(name)) for name, df in states.items()]
    return reduce(DataFrame.unionByName, parts)


def key_results(tables: dict[str, tuple[DataFrame, str, float, float]], partners: bool = True) -> DataFrame:
    """per_key over several tables given as {name: (df, value column, low, high)}, with table_name. Without ``partners``
    there is no n_partners and no state for each pair: one aggregation by key, of which a task shuffles one row a key."""
    if partners:
        return per_key(union_of({n: pair_states(df, value=v, low=lo, high=hi) for n, (df, v, lo, hi) in tables.items()}), ["table_name"])
    rows = union_of({n: row_states(df, value=v, low=lo, high=hi) for n, (df, v, lo, hi) in tables.items()})
    return per_key(rows, ["table_name"]).drop("n_partners")


def is_finite(c: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))

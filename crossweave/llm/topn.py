"""Top N items within every group by descending score bands (problem 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.operators.keyed import is_finite
from crossweave.operators.scale import cut

#: Shares of the rows above each band's lower bound; the last band takes the rest. They steer the work only.
BANDS = (0.1, 0.4)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(group, item, score, rank): the n best distinct items of every group; an item scored more than once has its
    highest score; equal scores are ordered by item ascending in byte order. Rows with a null group or item, or a null,
    NaN or infinite score don't count; -0.0 equals 0.0. A group with fewer than n items has all of them.

    The score range is cut at approximate quantiles and read from the top. A band only sees the groups that aren't
    full yet; with what they had from higher bands (fewer than n rows a group) its rows are made distinct and ranked.
    A group that now has n items is finished, as all other rows score strictly less: cuts never part equal scores. The
    filter on the score reaches the scan of every band.

    A hot group is no single task: pairs are made distinct by (group, item), and each task keeps its n best rows of a
    group before rows meet by group."""
    if n < 1:
        raise ValueError("n has to be 1 or more")
    finite = is_finite(F.col("s"))
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s")).where(F.col("g").isNotNull() & F.col("i").isNotNull() & finite)
    cuts = sorted(set(rows.approxQuantile("s", [1 - b for b in bands], 0.01)), reverse=True) if bands else []
    ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))).where(F.col("rank") <= n)
    done: list[DataFrame] = []
    state = full = None
    for k in range(len(cuts) + 1):
        band = rows.where(F.col("s") >= cuts[k]) if k < len(cuts) else rows
        band = band.where(F.col("s") < cuts[k - 1]) if k else band
        if k:
            band = band.join(full, "g", "left_anti").unionByName(state)
        best = ranked(band.groupBy("g", "i").agg(F.max("s").alias("s")))
        if k == len(cuts):
            done.append(best)
            break
        best = cut(best)
        filled = best.where(F.col("rank") == n).select("g")
        done.append(best.join(filled, "g", "left_semi"))
        state = best.join(filled, "g", "left_anti").drop("rank")
        full = filled if full is None else full.unionByName(filled)
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("rank").cast("int").alias("rank"))

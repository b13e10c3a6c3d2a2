"""Fuzzy-logic aggregates and the pairwise loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.operators.scoring import sigmoid


def truth(pos: Column, neg: Column) -> Column:
    """Degree to which the positive is preferred."""
    return sigmoid(pos - neg)


def forall(x: Column, p: float, epsilon: float = 0.0) -> Column:
    """Aggregate 'for all': 1 minus the p-mean of the errors 1 - x. epsilon keeps x off 0 and 1."""
    x = F.least(F.greatest(x, F.lit(epsilon)), F.lit(1 - epsilon)) if epsilon else x
    return 1 - F.pow(F.avg(F.pow(1 - x, F.lit(float(p)))), F.lit(1.0 / p))


def sat_agg(truths: list[Column], p: float) -> Column:
    """'For all' over the truth values of axioms, row by row."""
    mean = sum((F.pow(1 - t, F.lit(float(p))) for t in truths[1:]), F.pow(1 - truths[0], F.lit(float(p)))) / len(truths)
    return 1 - F.pow(mean, F.lit(1.0 / p))


def softplus_loss(pos: Column, neg: Column) -> Column:
    """log(1 + exp(-(pos - neg))) without overflow."""
    d = pos - neg
    return F.log1p(F.exp(-F.abs(d))) + F.greatest(-d, F.lit(0.0))


def early_stop_trace(metrics: DataFrame, patience: int) -> DataFrame:
    """(epoch, score, best_so_far, flat_epochs, stopped) of a metrics table (epoch, score): flat_epochs counts the epochs
    since the last strict rise of the best score; training stops at the first epoch where it exceeds patience, and later
    epochs aren't in the trace. One row an epoch, so one window."""
    from pyspark.sql.window import Window

    w = Window.orderBy("epoch")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = metrics.withColumn("best_so_far", F.max("score").over(so_far))
    x = x.withColumn("_up", F.when(F.col("best_so_far") > F.coalesce(F.lag("best_so_far").over(w), F.lit(float("-inf"))), F.col("epoch")))
    x = x.withColumn("_n", F.row_number().over(w)).withColumn("_at", F.when(F.col("_up").isNotNull(), F.col("_n")))
    x = x.withColumn("flat_epochs", (F.col("_n") - F.max("_at").over(so_far)).cast("int"))
    x = x.withColumn("stopped", F.col("flat_epochs") > patience)
    over = F.sum(F.col("stopped").cast("int")).over(so_far)
    return x.withColumn("_o", over).where("_o <= 1").where("_o = 0 or stopped").select("epoch", "score", "best_so_far", "flat_epochs", "stopped")

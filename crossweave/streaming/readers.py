"""Streams of the row-wise readers: files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.feedback import implicit
from crossweave.sources.readers import PATHS, RATINGS


def stream_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(n1_asin, n2_asin) of JSON Lines files as they arrive; with a folder already complete and the available-now trigger
    it reads what sources.readers.read_paths reads."""
    return spark.readStream.schema(PATHS).json(folder)


def stream_implicit(spark: SparkSession, folder: str) -> DataFrame:
    """(userId, itemId, r) of CSV files with the columns of RATINGS as they arrive; a header in another order is an error."""
    ratings = spark.readStream.schema(RATINGS).option("header", True).option("enforceSchema", False).csv(folder)
    return ratings.select("userId", "itemId", implicit(F.col("rating")).alias("r"))

"""Readers with fixed schemas: columns by name, ids always strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RATINGS = T.StructType([T.StructField("userId", T.StringType()), T.StructField("itemId", T.StringType()), T.StructField("rating", T.DoubleType())])
PATHS = T.StructType([T.StructField("n1_asin", T.StringType()), T.StructField("n2_asin", T.StringType())])


def read_ratings(spark: SparkSession, path: str, time: str | None = None) -> DataFrame:
    """(userId, itemId, rating) of CSV files with a header, plain or compressed by gzip or bzip2; other columns aren't
    parsed, and the files' column order is free. ``time`` names a column of seconds to read as dt. Archives in other
    formats have to be unpacked first. A rating that isn't a number is null; a missing column is an error."""
    header = spark.read.option("header", True).csv(path)
    wanted = [*RATINGS.fieldNames(), *([time] if time else [])]
    if missing := set(wanted) - set(header.columns):
        raise ValueError(f"{path} lacks {sorted(missing)}")
    cols = ["userId", "itemId", "try_cast(rating as double) as rating"]
    return header.selectExpr(*cols, *([f"timestamp_seconds(try_cast(`{time}` as bigint)) as dt"] if time else []))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(n1_asin, n2_asin) of JSON Lines files; other keys are ignored, missing ones null, and lines that aren't JSON give
    nulls at both ends."""
    return spark.read.schema(PATHS).json(path)


def parse_paths(lines: bytes) -> list:
    """Arrow batches (n1_asin, n2_asin) of JSON Lines held in memory; other keys are ignored, missing ones null, and a line
    that isn't JSON is an error."""
    import pyarrow as pa
    from pyarrow import json

    how = json.ParseOptions(explicit_schema=pa.schema([(c, pa.string()) for c in PATHS.names]), unexpected_field_behavior="ignore")
    return json.read_json(pa.BufferReader(lines), json.ReadOptions(use_threads=False, block_size=len(lines)), how).to_batches()


class Registry:
    """Files by data-set name and by pair of names."""

    def __init__(self, ratings: dict[str, str], paths: dict[tuple[str, str], str]):
        self.ratings, self.paths = dict(ratings), dict(paths)

    def pair(self, source: str, target: str) -> tuple[str, str, str]:
        """Paths of the source's and the target's ratings and of the paths between them."""
        for name in (source, target):
            if name not in self.ratings:
                raise KeyError(f"no data set {name}")
        if (source, target) not in self.paths:
            raise KeyError(f"no paths from {source} to {target}")
        return self.ratings[source], self.ratings[target], self.paths[source, target]

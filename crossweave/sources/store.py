"""Prepared tables in a folder of Parquet files, made on first use and read from then on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import fields, is_dataclass
from enum import Enum

from pyspark.sql import DataFrame, SparkSession


def config_key(**parts) -> str:
    """Name of a cache for a configuration: a digest of its canonical JSON. Objects count with their class and fields, so
    two strategies with equal fields differ, and everything that a table hangs on, seeds included, belongs in it."""

    def plain(x):
        if isinstance(x, Enum):
            return [type(x).__name__, x.name]
        if is_dataclass(x):
            return {"class": type(x).__name__, **{f.name: plain(getattr(x, f.name)) for f in fields(x)}}
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if x is None or isinstance(x, (str, int, float, bool)):
            return x
        return {"class": type(x).__name__, **{k: plain(v) for k, v in sorted(vars(x).items())}}

    return hashlib.sha256(json.dumps(plain(parts), sort_keys=True).encode()).hexdigest()[:24]


class Store:
    """Tables by name under one folder, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        """Whether the table was written to its end."""
        done = self._path(f"{name}/_SUCCESS")
        return self._fs(done).exists(done)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows, such as metrics of a run, to a table."""
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table, made and written if it isn't there."""
        return self.read(name) if self.has(name) else self.write(name, make())

    def clear(self) -> None:
        path = self._path("")
        self._fs(path).delete(path, True)

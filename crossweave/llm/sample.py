"""A reproducible sample that stays stable as data grows (problem 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.functions.keys import with_keys
from crossweave.operators.scale import rank_rows

BITS = 40
#: The odd whole number nearest to 2**40 / golden ratio.
GOLDEN = 679535556991


def low_discrepancy(seq: Column, shift: int) -> Column:
    """(seq * GOLDEN + shift) mod 2**40 as a long, without overflow for any seq below 2**62."""
    half = 1 << (BITS // 2)
    low, high = F.pmod(seq, F.lit(half)), F.pmod(F.shiftright(seq, BITS // 2), F.lit(half))
    lifted = F.pmod(high * (GOLDEN % half), F.lit(half)) * half
    return F.pmod(low * GOLDEN + lifted + F.lit(shift), F.lit(1 << BITS))


def sequence_numbers(df: DataFrame, keys: list[str], batch: str, start: int = 0) -> DataFrame:
    """(*keys, first_batch, seq) for every distinct key: seq counts from ``start`` in the order (first batch, hash of the key,
    key), the hash being the first 60 bits of the key's md5. Rows of later batches give new keys higher numbers and change
    none. A null batch counts as -1, before all others. Rows are sorted in ranges and each range counts from the rows
    before it, so no batch, however large, and no number of batches is one task's work."""
    first = df.groupBy(*keys).agg(F.min(F.coalesce(F.col(batch).cast("long"), F.lit(-1))).alias("first_batch"))
    hashed = first.withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 15), 16, 10).cast("long"))
    x = rank_rows(hashed, ["first_batch", "_h", *keys], "seq")
    return x.select(*keys, "first_batch", (F.col("seq") - 1 + F.lit(start)).alias("seq"))


class Numbers:
    """Sequence numbers kept in a folder that all executors share. Every ``extend`` numbers the keys that have none yet and
    adds them as one more part; numbers given once never change, whatever rows are deleted, come late or have no batch."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _parts(self) -> list[str]:
        """Folders of parts that were written to their end, oldest first."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        found = sorted(str(s.getPath().getName()) for s in fs.listStatus(hadoop))
        return [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}/_SUCCESS"))]

    def read(self) -> DataFrame | None:
        """All numbers given so far: (*keys, first_batch, seq)."""
        parts = self._parts()
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else None

    def extend(self, df: DataFrame, keys: list[str], batch: str) -> DataFrame:
        """Numbers of all keys known, those of df included. The numbers are stored by one writer at a time; a part that
        wasn't written to its end is written again."""
        known = self.read()
        start = 0 if known is None else known.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        new = df if known is None else df.join(known.select(*keys), keys, "left_anti")
        path = f"{self.folder}/part-{len(self._parts()):08d}"
        sequence_numbers(new, keys, batch, start).write.mode("overwrite").parquet(path)
        return self.read()


def stable_sample(df: DataFrame, keys: list[str], batch: str, rate: float, shift: int = 123456789, numbers: Numbers | None = None) -> DataFrame:
    """(*keys, first_batch, seq) of the sampled keys: those whose low-discrepancy point lies below ``rate``. Any run of
    m consecutive sequence numbers holds rate * m keys but for a difference that grows as log m, so each batch is
    covered evenly.

    Numbers come from the keys' first batches, and so persist as long as older rows do and no rows without a batch are
    added; with ``numbers`` they are stored, and members stay members whatever happens to the rows: the sample is then of
    all keys ever seen. keys may not be null."""
    if not 0 <= rate <= 1:
        raise ValueError("rate has to be between 0 and 1")
    x = sequence_numbers(df, keys, batch) if numbers is None else numbers.extend(df, keys, batch)
    return x.where(low_discrepancy(F.col("seq"), shift) < F.lit(round(rate * (1 << BITS))))


def rating_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(dom, user_key, item_key, batch_no) of all rating tables."""
    parts = [with_keys(t, {"user_key": "userId", "item_key": "itemId"}, [F.lit(dom).alias("dom"), t["batch_no"]]) for dom, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def sample_users(tables: dict[str, DataFrame], rate: float, numbers: Numbers | None = None) -> DataFrame:
    """(user_key, first_batch, seq): users of both domains are one population; a shared user is one user."""
    return stable_sample(rating_keys(tables).where("user_key is not null"), ["user_key"], "batch_no", rate, numbers=numbers)


def sample_pairs(tables: dict[str, DataFrame], rate: float, numbers: Numbers | None = None) -> DataFrame:
    """(dom, user_key, item_key, first_batch, seq) of pairs of which neither end is absent."""
    x = rating_keys(tables).where("user_key is not null and item_key is not null")
    return stable_sample(x, ["dom", "user_key", "item_key"], "batch_no", rate, numbers=numbers)

"""Building blocks that keep plans even: measured broadcasts, salting, prefix sums without a single-task window, and
lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A side is broadcast only if it was measured to have no more rows and bytes than this.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 24 << 20
#: A key with no more rows than this is never spread.
HOT_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. A temporary folder is set only where none
    is set and the master runs in this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="crossweave-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and approximate bytes of df; one aggregation job."""
    width: Column = F.lit(16)
    for f in df.schema.fields:
        c = df[f"`{f.name}`"]
        if isinstance(f.dataType, T.StringType):
            width = width + 24 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + 24 + 24 * F.greatest(F.size(c), F.lit(0))
        else:
            width = width + 8
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return n, size


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    n, b = measured(df)
    return n <= rows and b <= size


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(facts: DataFrame, on: list[str], least: int = HOT_ROWS) -> DataFrame:
    """(*on, _parts): the keys with more rows than a task should have, which is ``least`` or a task's even share if that is
    more, and into how many parts they have to be cut. Counted with map-side combining. As each has more than an even share,
    there are no more of them than shuffle tasks: the table may be broadcast."""
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    share = F.greatest(F.lit(least), F.ceil(total.scalar() / tasks_of(facts.sparkSession)))
    x = counts.withColumn("_share", share).where(F.col("_n") > F.col("_share"))
    return x.select(*on, F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_parts"))


def salted(facts: DataFrame, dim: DataFrame, on: list[str], how: str, hot: DataFrame, spread: Column | None = None) -> DataFrame:
    """The equi-join of facts with dim in which only the keys of ``hot`` (see hot_keys) are dealt over parts by ``spread``,
    and only their rows of dim are repeated, once for each part."""
    if hot.isEmpty():
        return facts.join(dim, on, how)
    hot, salt = F.broadcast(hot), "_salt"
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]) if spread is None else spread
    parts = F.coalesce("_parts", F.lit(1))
    a = facts.join(hot, on, "left").withColumn(salt, F.pmod(spread, parts).cast("int")).drop("_parts")
    b = dim.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*on, salt], how).drop(salt)


def lookup(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", spread: Column | None = None, small: bool | None = None) -> DataFrame:
    """facts joined with dim (one row for each key): broadcast if dim was measured to be small, else an equi-join in
    which keys of facts that hold more rows than a task should are spread, see salted. ``how``: inner, left, left_semi or
    left_anti. dim is read once to be measured, unless the caller has and says whether it is ``small``; facts are read
    once to be counted if dim isn't."""
    if is_small(dim) if small is None else small:
        return facts.join(F.broadcast(dim), on, how)
    return salted(facts, dim, on, how, hot_keys(facts, on), spread)


def rank_rows(df: DataFrame, order: list[str | Column], rank: str) -> DataFrame:
    """Adds ``rank``, the row's place from 1 by ``order``, which has to be total. The rows are sorted in ranges and
    checkpointed with their places in their range; one row a range says how many rows lie before it."""
    at, place = "_range", (1 << 33) - 1
    x = cut(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))  # the range above 33 bits, the row below
    sizes = x.groupBy(F.shiftright(at, 33).alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    pieces = sizes.agg(F.sort_array(F.collect_list(F.struct("_at", "_c"))).alias("_p")).select(F.posexplode("_p").alias("_i", "_q"), "_p")
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda s, p: s + p["_c"])
    pieces = F.broadcast(pieces.select("_q._at", before.alias("_before")))
    return x.join(pieces, F.shiftright(at, 33) == F.col("_at")).withColumn(rank, F.col("_before") + F.col(at).bitwiseAND(place) + 1).select(*df.columns, rank)


def rank_in_groups(df: DataFrame, group: list[str], order: list[str | Column], rank: str, size: str | None = None) -> DataFrame:
    """Adds ``rank``, the row's place from 1 within its group by ``order``, and ``size``, the rows of the group, if named.
    ``order`` has to be total, or equal rows get their places arbitrarily.

    The rows are sorted by (group, order) into ranges and checkpointed, so a group with most of the rows spans many
    ranges. Each range ranks its own rows; a group that spans ranges adds the rows of those before. As ranges are
    consecutive, that table has at most two rows a range and may be broadcast."""
    if not group and size is None:
        return rank_rows(df, order, rank)
    at = "_range"
    x = cut(df.orderBy(*group, *order).withColumn(at, F.spark_partition_id()))
    sizes = x.groupBy(at, *group).agg(F.count(F.lit(1)).alias("_c"))
    pieces = sizes.groupBy(*group).agg(F.sum("_c").alias("_all"), F.sort_array(F.collect_list(F.struct(at, "_c"))).alias("_p"))  # ranges of a group
    pieces = pieces.where(F.size("_p") > 1).select(*group, "_all", F.posexplode("_p").alias("_i", "_q"), "_p")
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda s, p: s + p["_c"])
    pieces = pieces.select(*[F.col(c).alias(f"_at_{c}") for c in group], F.col(f"_q.{at}").alias("_at"), before.alias("_before"), "_all")
    own = Window.partitionBy(at, *group)
    x = x.withColumn(rank, F.row_number().over(own.orderBy(*order)).cast("long"))
    if size:
        x = x.withColumn(size, F.count(F.lit(1)).over(own))
    on = reduce(lambda p, q: p & q, [F.col(at) == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in group]])
    x = x.join(F.broadcast(pieces), on, "left").withColumn(rank, F.col(rank) + F.coalesce("_before", F.lit(0)))
    if size:
        x = x.withColumn(size, F.coalesce("_all", F.col(size)))
    return x.select(*df.columns, rank, *([size] if size else []))


def running_total(
    df: DataFrame, part: list[str], lead: list[str], hashed: str, ties: list[str], value: Column, out: str, digits: int = 3
) -> DataFrame:
    """Adds ``out``: the sum of value over the rows before this one in the order (lead, hashed, ties) within part.

    ``hashed`` is an even hexadecimal hash of the row's key. Rows are cut into 16**digits ranges of it; the ranges'
    sums make a small table whose own running sum gives each range its offset, and only the rest is summed inside a
    range. No window holds a whole part, and the result doesn't hang on ``digits`` or on the layout. ``ties`` have to
    make the order total; equal rows beyond that share their order arbitrarily. part, lead and hashed may not be null:
    plain equality lets the join's partitioning serve the window as well."""
    b, v = "_range", "_value"
    x = df.withColumns({b: F.substring(F.col(hashed), 1, digits), v: value.cast("long")})
    sums = x.groupBy(*part, *lead, b).agg(F.sum(v).alias("_sum"))
    before = Window.orderBy(*lead, b) if not part else Window.partitionBy(*part).orderBy(*lead, b)
    keys = [*part, *lead, b]
    offset = (F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_offset")
    offsets = sums.select(*[F.col(c).alias(f"_at_{c}") for c in keys], offset)
    inner = Window.partitionBy(*keys).orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, 0)
    on = reduce(lambda p, q: p & q, [(F.col(c) == F.col(f"_at_{c}")) for c in keys])
    joined = x.join(offsets, on).drop(*[f"_at_{c}" for c in keys])
    return joined.withColumn(out, F.col("_offset") + F.sum(v).over(inner) - F.col(v)).drop(b, v, "_offset")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

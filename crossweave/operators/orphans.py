"""References to records that do not exist (problem 2).

``direct_orphans`` finds references without a parent record that holds at the record's time; ``cascade`` then walks
down the foreign-key graph from the orphaned records, one semi-join for each level, until no record is added; edges within
a table, which may be thousands of levels deep, are walked by ``inherited_chains`` in doubling steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.operators.scale import BROADCAST_BYTES, BROADCAST_ROWS, cut, lookup


#: Parents with more distinct periods than this are swept by time instead of being gathered in one row.
MAX_PERIODS = 1000
_DAY = 86_400_000_000


def periods_by_key(parents: DataFrame, key: list[str]) -> DataFrame:
    """(*key, periods): all distinct [s, e) periods of a key of parents (*key, s, e) in one row; a null end is open. Empty
    periods and those without a start never hold, but a key that has only such ones keeps its row."""
    kept = F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("s")))
    return parents.groupBy(*key).agg(F.collect_set(F.when(kept, F.struct("s", "e"))).alias("periods"))


def _swept(refs: DataFrame, parents: DataFrame, key: list[str], time: str) -> DataFrame:
    """The rows of refs, all with a time, at which no period of their key holds: starts count 1 and ends -1, and a running
    count in time order, cut at days so that no window holds a whole key, is 0 at these rows."""
    live = parents.where("s is not null and (e is null or e > s)")
    events = live.select(*key, F.col("s").alias("_t"), F.lit(1).alias("_v")).unionByName(live.where("e is not null").select(*key, F.col("e").alias("_t"), F.lit(-1).alias("_v")))
    x = refs.withColumns({"_t": F.col(time), "_v": F.lit(0), "_ref": F.lit(1)}).unionByName(events.withColumn("_ref", F.lit(0)), allowMissingColumns=True)
    x = x.withColumn("_day", F.floor(F.unix_micros("_t") / _DAY))
    days = x.groupBy(*key, "_day").agg(F.sum("_v").alias("_d"))
    before = F.sum("_d").over(Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_d")
    inside = Window.partitionBy(*key, "_day").orderBy("_t", "_ref").rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(days.select(*key, "_day", before.alias("_before")), [*key, "_day"]).withColumn("_n", F.col("_before") + F.sum("_v").over(inside))
    return y.where("_ref = 1 and _n = 0").select(*refs.columns)


def direct_orphans(refs: DataFrame, parents: DataFrame, key: list[str], time: str = "at") -> DataFrame:
    """The rows of refs that have all of ``key`` (a null part means the reference is absent: no orphan) and for which no
    row of parents (*key, s, e) holds at ``time``: s <= time and e null or time < e. If the time is null, any parent of
    the key will do.

    Each reference meets at most one parent row, which lists the key's periods; see ``lookup`` for how hot keys are
    spread. Keys with more than MAX_PERIODS periods are swept by time. One job reads the parents to measure both."""
    whole = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    refs, parents = whole(refs), whole(parents).select(*key, "s", "e").distinct()
    width = sum((F.octet_length(F.col(k).cast("string")) for k in key), F.lit(40 + 24 * len(key)))
    sizes = parents.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    most, keys, size = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(width + 48 * F.col("_n")), F.lit(0))).first()
    swept = None
    if most > MAX_PERIODS:
        many = cut(sizes.where(F.col("_n") > MAX_PERIODS).drop("_n"))
        hot = lookup(refs, many, key, "left_semi").where(F.col(time).isNotNull())
        swept = _swept(hot, parents.join(many, key, "left_semi"), key, time)
        refs = lookup(refs, many.withColumn("_many", F.lit(True)), key, "left").where("_many is null").drop("_many")  # without a time any row will do
        parents = parents.join(many, key, "left_anti")
    x = lookup(refs, periods_by_key(parents, key), key, "left", small=keys <= BROADCAST_ROWS and size <= BROADCAST_BYTES)
    at = F.col(time)
    holds = F.exists("periods", lambda p: (p["s"] <= at) & (p["e"].isNull() | (at < p["e"])))
    found = F.col("periods").isNotNull() & (at.isNull() | F.coalesce(holds, F.lit(False)))
    out = x.where(~found).drop("periods")
    return out if swept is None else out.unionByName(swept.select(*out.columns))


@dataclass(frozen=True)
class Edge:
    """Rows of ``child`` refer by ``field`` to rows of ``parent`` with the same ``link`` value."""

    child: str
    parent: str
    field: str = "link"


#: Levels that are kept apart before they are written as one, so that plans stay short however deep the graph is.
LEVELS = 8
COLUMNS = ["table_name", "field_name", "row_key", "at"]


def cascade(direct: DataFrame, links: dict[Edge, tuple[DataFrame, DataFrame]], levels: int | None = None) -> DataFrame:
    """(table_name, field_name, row_key, at, kind, depth) of all orphaned records: ``direct`` (table_name, field_name,
    row_key, at) at depth 0, one row for each orphaned field, and 'inherited' ones, whose parents under an edge are all
    orphaned, at 1 + the depth at which that became true. ``levels`` ends the walk at that depth; None walks to the fixpoint.

    links: for each edge the child side (row_key, link, at) and the parent side (row_key, link). A child with several
    parent rows is inherited only when the last of them is orphaned; so a level is decided for the links that the new
    orphans touch: a semi-join finds them, and an anti-join drops those with a live parent. The loop ends at the first
    level that adds nothing, and cycles end too, since a record is added once. Null links and keys never match. An edge
    within one table on which each row has one parent is better walked by ``inherited_chains``.

    Each level is checkpointed, so a lost executor costs no finished level, and its files go when Spark's cleaner finds
    them unused (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    frontier = cut(direct.select(*COLUMNS, F.lit("direct").alias("kind"), F.lit(0).alias("depth")))
    known = [frontier]
    for depth in count(1):
        every = reduce(DataFrame.unionByName, known)
        if levels is not None and depth > levels:
            return every
        fresh_in = {r["table_name"] for r in frontier.select("table_name").distinct().collect()}  # as many as there are tables
        edges = {e: x for e, x in links.items() if e.parent in fresh_in}
        if not edges:
            return every
        if len(known) >= LEVELS:
            every = cut(every)
            known = [every]
        new: list[DataFrame] = []
        for edge, (child, parent) in edges.items():
            fresh = frontier.where(F.col("table_name") == edge.parent).select("row_key").distinct()
            touched = parent.join(fresh, "row_key", "left_semi").select("link").where("link is not null").distinct()
            gone = every.where(F.col("table_name") == edge.parent).select("row_key")
            live = parent.join(touched, "link", "left_semi").join(gone, "row_key", "left_anti").select("link")
            dead = touched.join(live, "link", "left_anti")
            already = every.where(F.col("table_name") == edge.child).select("row_key")
            rows = child.join(dead, "link", "left_semi").join(already, "row_key", "left_anti")
            new.append(rows.select(F.lit(edge.child).alias("table_name"), F.lit(edge.field).alias("field_name"), "row_key", "at"))
        found = reduce(DataFrame.unionByName, new).dropDuplicates(["table_name", "row_key"])
        frontier = cut(found.select(*COLUMNS, F.lit("inherited").alias("kind"), F.lit(depth).alias("depth")))
        known.append(frontier)


def inherited_chains(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """(row_key, depth) of the rows of (row_key, link) that descend from ``lost`` (row_key), with the number of steps to the
    nearest lost ancestor; each row has one parent, the row whose key its link is.

    The fixpoint of the cascade along a self-edge by pointer jumping: each round every undecided row jumps to where its
    ancestor points, so reach doubles and a chain of any depth takes log2(depth) + 1 rounds instead of one a level. A row
    is decided when its pointer meets a lost or decided row, and dropped when it leaves the table or meets a row without
    a parent. Rounds end with one that decides none: then no chain goes on. Rows on cycles are never decided. A parent of
    very many rows is spread, see lookup. Null keys and links never match."""
    lost = cut(lost.select("row_key").where("row_key is not null").distinct())
    start = rows.where("row_key is not null and link is not null and link != row_key").dropDuplicates(["row_key"])
    pending = cut(lookup(start, lost, ["row_key"], "left_anti").select("row_key", F.col("link").alias("up"), F.lit(1).cast("long").alias("steps")))
    none = F.lit(None).cast(pending.schema["up"].dataType)
    decided: list[DataFrame] = []
    last = lost.select(F.col("row_key").alias("up"), none.alias("_next"), F.lit(0).cast("long").alias("_more"), F.lit(True).alias("_done"))
    while True:
        ahead = last.unionByName(pending.select(F.col("row_key").alias("up"), F.col("up").alias("_next"), F.col("steps").alias("_more"), F.lit(False).alias("_done")))
        y = cut(lookup(pending, ahead, ["up"]).select("row_key", F.col("_next").alias("up"), (F.col("steps") + F.col("_more")).alias("steps"), F.col("_done").alias("done")))
        new = y.where("done").select("row_key", F.col("steps").alias("depth"))
        if new.isEmpty():
            break
        decided.append(new)
        last = last.unionByName(new.select(F.col("row_key").alias("up"), none.alias("_next"), F.col("depth").alias("_more"), F.lit(True).alias("_done")))
        pending = y.where("not done").drop("done")
    empty = pending.limit(0).select("row_key", F.lit(0).cast("long").alias("depth"))
    return reduce(DataFrame.unionByName, decided, empty).where("depth > 0").select("row_key", F.col("depth").cast("int").alias("depth"))

"""The item references of the rating, path and similarity tables, and their foreign-key graph (problem 2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.functions.keys import with_keys
from crossweave.operators.orphans import COLUMNS, Edge, cascade, direct_orphans, inherited_chains
from crossweave.operators.scale import cut

# Fixed values: (table, field, domain of the parent, row key, time, whether the reference is a number).
REFERENCES = (
    ("src_ratings", "itemId", "src", "row_id", "ts", False),
    ("tgt_ratings", "itemId", "tgt", "row_id", "ts", False),
    ("kg_paths", "n1_asin", "src", "path_id", "found_at", False),
    ("kg_paths", "n2_asin", "tgt", "path_id", "found_at", False),
    ("sim", "src_iid", "src", "sim_id", "built_at", True),
    ("sim", "tgt_iid", "tgt", "sim_id", "built_at", True),
)


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, field_name, row_key, at, dom, ref) of all of REFERENCES. Numbers get the prefix '#', which no key
    contains, so that one join serves both."""
    parts = []
    for name, field, dom, row, at, number in REFERENCES:
        df = tables[name]
        keep = [F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), df[row].alias("row_key"), df[at].alias("at"), F.lit(dom).alias("dom")]
        parts.append(df.select(*keep, F.concat(F.lit("#"), df[field].cast("string")).alias("ref")) if number else with_keys(df, {"ref": field}, keep))
    return reduce(DataFrame.unionByName, parts)


def item_periods(item_index: DataFrame) -> DataFrame:
    """(dom, ref, s, e) for both ways of naming an item; absent ids and null numbers name none."""
    keep = [item_index[c] for c in ("dom", "iid", "listed_at", "removed_at")]
    x = with_keys(item_index, {"key": "itemId"}, keep)
    names = F.explode(F.array("key", F.concat(F.lit("#"), F.col("iid").cast("string"))))
    return x.select("dom", names.alias("ref"), F.col("listed_at").alias("s"), F.col("removed_at").alias("e"))


def orphan_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, field_name, row_key, at, dom, ref) of the references without an item that holds at their time."""
    return direct_orphans(references(tables), item_periods(tables["item_index"]), ["dom", "ref"])


def _pair(df: DataFrame, row: str, dom, at: str, user: str, item: str) -> DataFrame:
    x = with_keys(df, {"u": user, "i": item}, [df[row].alias("row_key"), dom.alias("d"), df[at].alias("at")])
    ok = F.col("u").isNotNull() & F.col("i").isNotNull() & F.col("d").isNotNull()
    return x.select("row_key", F.when(ok, F.concat_ws("|", "d", "u", "i")).alias("link"), "at")


def _posts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("row_key"), F.col("parent_id").alias("link"), F.col("posted_at").alias("at"))


# The fields that inherited orphans of these tables refer by.
SPLIT_FIELD, POST_FIELD = "userId, itemId", "parent_id"


def orphan_fields(tables: dict[str, DataFrame], levels: int | None = None) -> DataFrame:
    """(table_name, field_name, row_key, at, kind, depth) of all orphaned records, one row for each orphaned field.

    The graph: a split row comes from the rating rows of its domain, user and item; a forum post answers another post.
    A post whose parent isn't there is direct, and so is what answers it, level by level, inherited. With levels = 0 only
    direct references are looked for, without those of posts, which no other table lists."""
    own = orphan_references(tables).select(*COLUMNS)
    if levels == 0:
        return cascade(own, {}, 0)
    split_ratings = tables["split_ratings"]
    split = _pair(split_ratings, "row_id", split_ratings["dom"], "ts", "userId", "itemId")
    links = {Edge("split_ratings", f"{d}_ratings", SPLIT_FIELD): (split, _pair(tables[f"{d}_ratings"], "row_id", F.lit(d), "ts", "userId", "itemId").drop("at")) for d in ("src", "tgt")}
    found = cascade(own, links, levels)
    posts = _posts(tables["documents"])
    there = posts.select(F.col("row_key").alias("link")).where("link is not null").distinct()
    lost = cut(posts.where("link is not null").join(there, "link", "left_anti"))
    chains = inherited_chains(posts, lost)
    chains = chains if levels is None else chains.where(F.col("depth") <= levels)
    label = lambda df, kind, depth: df.select(F.lit("documents").alias("table_name"), F.lit(POST_FIELD).alias("field_name"), "row_key", "at", F.lit(kind).alias("kind"), depth.alias("depth"))
    return found.unionByName(label(lost, "direct", F.lit(0))).unionByName(label(posts.join(chains, "row_key"), "inherited", F.col("depth")))


def orphan_records(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_key, kind, depth): records with a direct orphan reference, and those that inherit it."""
    return orphan_fields(tables).select("table_name", "row_key", "kind", "depth").distinct()


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, field_name, month, n_refs, n_direct, n_inherited) of the references that aren't absent: how many there
    are, how many lack their record, and how many belong to a record that inherits that from its parents. The month of a
    null time is null. All counts are combined on the map side."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    split_ratings = tables["split_ratings"]
    split = _pair(split_ratings, "row_id", split_ratings["dom"], "ts", "userId", "itemId").select(F.lit("split_ratings").alias("table_name"), F.lit(SPLIT_FIELD).alias("field_name"), "link", "at")
    posts = _posts(tables["documents"]).select(F.lit("documents").alias("table_name"), F.lit(POST_FIELD).alias("field_name"), "link", "at")
    count = lambda df, kind: df.groupBy("table_name", "field_name", month, kind.alias("kind")).count()
    parts = [
        count(references(tables).where("ref is not null"), F.lit("any")), count(split.where("link is not null"), F.lit("any")),
        count(posts.where("link is not null"), F.lit("any")), count(orphan_fields(tables), F.col("kind")),
    ]
    of = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0)).alias(name)
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", "field_name", "month").agg(of("any", "n_refs"), of("direct", "n_direct"), of("inherited", "n_inherited"))

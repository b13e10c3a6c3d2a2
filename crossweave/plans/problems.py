"""Queries of the general problems (2 and 3), over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.operators import item_references, keyed
from crossweave.operators.scale import table

Query = Callable[[SparkSession, str], DataFrame]
INF = float("inf")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    names = ("src_ratings", "tgt_ratings", "kg_paths", "sim", "item_index", "split_ratings", "documents")
    return {n: table(spark, d, n) for n in names}


def p2_found(spark, d):
    """The cascade is walked to its fixpoint; of its records those that lack an item themselves are cases."""
    lost = item_references.orphan_fields(_tables(spark, d))
    own = F.struct("table_name", "field_name").isin(*[F.struct(F.lit(t), F.lit(f)) for t, f, *_ in item_references.REFERENCES])
    return lost.where((F.col("kind") == "direct") & own).select("table_name", "field_name", "row_key")


def p2_report(spark, d):
    return item_references.orphan_report(_tables(spark, d))


def p2_records(spark, d):
    return item_references.orphan_records(_tables(spark, d))


def _key_results(spark: SparkSession, d: str, partners: bool = True) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return keyed.key_results({
        "src_ratings": (t("src_ratings"), "rating", 1.0, 5.0),
        "tgt_ratings": (t("tgt_ratings"), "rating", 1.0, 5.0),
        "item_scores": (t("item_scores"), "score", -1.7976931348623157e308, 1.7976931348623157e308),
    }, partners)


def p3_found(spark, d):
    counts = _key_results(spark, d, partners=False).select("table_name", "field_name", "key_value", "n_rows")  # one aggregation serves totals and keys
    counts = counts.where("not (table_name = 'item_scores' and field_name = 'itemId')")
    return keyed.heavy_keys(counts, ["table_name"], (1, 100)).select("table_name", "field_name", "key_value")


def p3_keys(spark, d):
    return _key_results(spark, d)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_report, p2_records, p3_found, p3_keys)}

"""Queries of the problems tagged llm, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossweave.llm import encode, frequent, mix, overlaps, pairs, sample, textstats, topn
from crossweave.operators.scale import table

Query = Callable[[SparkSession, str], DataFrame]

SAMPLE_RATE = 0.05
MAX_Q = 0.01


def _ratings(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"src": table(spark, d, "src_ratings"), "tgt": table(spark, d, "tgt_ratings")}


def p1_found(spark, d):
    """Pairs that the stated counts and lift make cases, and whose surprise under the null leaves a false-discovery rate of
    one in a hundred at most."""
    return pairs.found_pairs(table(spark, d, "src_ratings"), 12, 20, MAX_Q)


def p1_pairs(spark, d):
    """Every pair that shares a basket, those rarer than chance included."""
    return pairs.item_pairs(table(spark, d, "src_ratings"), min_count=1)


def p4_found(spark, d):
    return overlaps.overlapping_rows(table(spark, d, "split_ratings"))


def p4_report(spark, d):
    return overlaps.overlap_report(table(spark, d, "split_ratings"))


def p5_found(spark, d):
    x = topn.top_n(table(spark, d, "item_scores"), "userId", "itemId", "score", 10)
    return x.selectExpr("userId as user_key", "itemId as item_key")


def p5_ranked(spark, d):
    return topn.top_n(table(spark, d, "item_scores"), "userId", "itemId", "score", 10)


def p6_users(spark, d):
    return sample.sample_users(_ratings(spark, d), SAMPLE_RATE)


def p6_pairs(spark, d):
    return sample.sample_pairs(_ratings(spark, d), SAMPLE_RATE)


def p7_found(spark, d):
    return frequent.frequent_keys(list(_ratings(spark, d).values()), (3, 1000)).select("item_key")


def p7_top(spark, d):
    return frequent.most_frequent(list(_ratings(spark, d).values()), 100).select("item_key", "n_rows")


def p8_ids(spark, d):
    return encode.encode(table(spark, d, "documents"))


def p8_round_trip(spark, d):
    """Whether each text comes back from its ids; null texts come back empty."""
    docs = table(spark, d, "documents")
    back = encode.decode(encode.encode(docs)).withColumnRenamed("text", "back")
    return docs.select("doc_id", "text").join(back, "doc_id").selectExpr("doc_id", "back = coalesce(text, '') as same")


def p9_mix(spark, d):
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark, d):
    return mix.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return textstats.structured_documents(table(spark, d, "documents"), table(spark, d, "frequent_words"))


def p10_stats(spark, d):
    return textstats.text_stats(table(spark, d, "documents"), table(spark, d, "frequent_words"))


def queries() -> dict[str, Query]:
    fs = (p1_found, p1_pairs, p4_found, p4_report, p5_found, p5_ranked, p6_pairs, p6_users, p7_found, p7_top, p8_ids, p8_round_trip, p9_mix, p9_report, p10_found, p10_stats)
    return {f.__name__: f for f in fs}

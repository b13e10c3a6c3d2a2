import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same, views
from pyspark.sql import functions as F

from crossweave.operators import scoring, transfer
from crossweave.plans import fixture as fixtures, queries, queries_sql
from crossweave.sources.readers import parse_paths

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def _never(*_):
    raise AssertionError("made though the query doesn't need it")


@pytest.fixture
def fresh(spark):
    fixtures.forget()
    yield views(FOLDER)
    fixtures.forget()


def _same(spark, c, name):
    assert_same(queries.queries()[name](spark, FOLDER), c, queries_sql.oracle_sql()[name])


def test_evaluation_keeps_no_candidates(spark, fresh, monkeypatch):
    monkeypatch.setattr(fixtures.Fixture, "eval_candidates", _never)
    for name in ("auc_user_macro", "hit_at_k", "seed_summary"):
        _same(spark, fresh, name)


def test_many_vectors_take_the_general_way(spark, fresh, monkeypatch):
    monkeypatch.setattr(fixtures, "MOST_VECTORS", 1)
    _same(spark, fresh, "hit_at_k")


def test_few_users_need_no_pairs_of_all(spark, fresh, monkeypatch):
    for made in ("pairs", "candidates", "sim", "kg_paths"):
        monkeypatch.setattr(fixtures.Fixture, made, property(_never))
    _same(spark, fresh, "reg_batch")


def test_paths_are_not_spelt_out_to_be_followed(spark, fresh, monkeypatch):
    monkeypatch.setattr(fixtures.Fixture, "kg_paths", property(_never))
    for name in ("sim_pairs", "sim_missing_items", "transfer_pairs_retained", "reg_negative_candidates"):
        _same(spark, fresh, name)


def _shuffle_files(spark):
    x = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(x.size()) if (n := x.apply(k).getName()).startswith("shuffle_")}


def test_shuffle_files_end_with_their_table(spark, fresh):
    before = _shuffle_files(spark)
    fixtures.fixture(spark, FOLDER)._keep("some", spark.range(1000).repartition(3))
    end = time.monotonic() + 20
    while (left := _shuffle_files(spark) - before) and time.monotonic() < end:
        time.sleep(0.1)
    assert not left


def test_transfer_pairs_need_no_target_ratings(spark, fresh, monkeypatch):
    """Those of shared users aren't kept, and only shared users are warm."""
    f = fixtures.fixture(spark, FOLDER)
    assert f.matrix_no_shared.join(f.warm, "uid", "left_semi").isEmpty() and not f.warm.isEmpty()
    fixtures.forget()
    monkeypatch.setattr(fixtures.Fixture, "matrix_no_shared", property(_never))
    _same(spark, fresh, "transfer_pairs")


def test_negatives_of_all_users_are_dealt_once(spark, fresh, monkeypatch):
    monkeypatch.setattr(fixtures.Fixture, "matrix_no_shared", property(_never))
    monkeypatch.setattr(fixtures, "PAIRS_IN_TASK", 1)
    df = queries.reg_negative_candidates(spark, FOLDER)
    assert "RoundRobinPartitioning" not in df._jdf.queryExecution().toString() and df.rdd.getNumPartitions() > 4
    _same(spark, fresh, "reg_negative_candidates")


@pytest.mark.parametrize("block", [3, 4096])
def test_lists_of_targets_are_full(spark, fresh, monkeypatch, block):
    """Items of a class lie far apart; that doesn't cut its lists."""
    monkeypatch.setattr(transfer, "ITEM_BLOCK", block)
    f = fixtures.fixture(spark, FOLDER)
    sizes = {r.code: r.n for r in f.sim_targets.join(f.target_classes, ["p_brand", "s2"]).groupBy("code").agg(F.countDistinct("tgt_iid").alias("n")).collect()}
    lists = {r.code: r["count"] for r in f.target_lists.groupBy("code").count().collect()}
    assert lists.keys() == sizes.keys() and all(lists[c] <= -(-n // block) for c, n in sizes.items())
    _same(spark, fresh, "reg_negative_candidates")


def test_equal_vectors_are_ranked_once(spark, fresh, monkeypatch):
    ranked, seen = scoring.ranked_scores, []
    monkeypatch.setattr(scoring, "ranked_scores", lambda users, items: seen.append(users.count()) or ranked(users, items))
    v = [0.5, -1.0]
    users = spark.createDataFrame([(1, 2, v), (2, 1, v), (3, 3, v), (4, 2, [-v[0], v[1]])], "uid long, need int, v array<float>")
    items = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(5)], "iid long, v array<float>")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(scoring.top_scores(users, items)) == key(ranked(users, items)) and seen == [2]
    _same(spark, fresh, "best_k_closed_form")


def test_paths_of_odd_parts_come_once(spark, tmp_path, monkeypatch):
    """Repeated parts, items of two sizes or brands, items whose keys are cut to the same nine digits, and nulls."""
    sizes = [1, 3, 6, 9, 12, 50]
    parts = [(k, f"B{k % 2}", ("PROMO", "LARGE")[k % 3 == 0], sizes[k % 5]) for k in range(60)] + [(k, "B0", t, s) for t in ("SMALL", "STANDARD") for k in (7, 9) for s in sizes]
    parts += parts[:30] + [(9, "B1", "LARGE", 3), (None, "B1", "ECONOMY", 3), (None, "B1", "LARGE", 3), (61, None, "PROMO", 3), (62, "B0", "LARGE", None), (63, "B1", None, 3)]
    parts += [(10**9 + k, "B0", t, 3) for k in range(3) for t in ("MEDIUM", "STANDARD")]
    t = pa.table(dict(zip(("p_partkey", "p_brand", "p_type", "p_size"), map(list, zip(*parts, strict=True)), strict=True)), schema=pa.schema([("p_partkey", pa.int64()), ("p_brand", pa.string()), ("p_type", pa.string()), ("p_size", pa.int32())]))
    pq.write_table(t, tmp_path / "part.parquet")
    for of_text, in_task in ((100, 4_000_000), (1, 20)):
        monkeypatch.setattr(fixtures, "PATH_LINES", of_text)
        monkeypatch.setattr(fixtures, "PATHS_IN_TASK", in_task)
        fixtures.forget()
        got = queries.scan_kg_paths(spark, str(tmp_path))
        assert_same(got, views(tmp_path), queries_sql.oracle_sql()["scan_kg_paths"])
        assert got.rdd.getNumPartitions() == max(4, -(-got.count() // in_task))
    fixtures.forget()


def test_no_paths(spark, tmp_path):
    t = pa.table({"p_partkey": pa.array([1, 2], pa.int64()), "p_brand": ["a", "b"], "p_type": ["PROMO", "LARGE"], "p_size": pa.array([1, 1], pa.int32())})
    pq.write_table(t, tmp_path / "part.parquet")
    assert queries.scan_kg_paths(spark, str(tmp_path)).isEmpty()


def test_lines_are_parsed_as_json():
    lines = b'{"n2_asin":"\\u0041\\"","n1_asin":null,"more":[1]}\n{"n1_asin":"b"}\n'
    assert [r for batch in parse_paths(lines) for r in batch.to_pylist()] == [{"n1_asin": None, "n2_asin": 'A"'}, {"n1_asin": "b", "n2_asin": None}]
    with pytest.raises(ValueError):
        parse_paths(b"{]\n")

"""Hand-sized cases of the recommendation operators."""

import math
import os
import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from crossweave.operators import indexing, logic, matrices, metrics, negatives, ranking, scoring, splits, transfer
from crossweave.plans import queries
from crossweave.training import batches
from crossweave.functions.feedback import implicit
from crossweave.functions.hashing import seeded_hash
from crossweave.plans.fixture import fixture

FOLDER = "/root/testdata/sf0.001"


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_index(spark):
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "userId string")
    p = indexing.user_presence(one(["d", "a", "b", "a", None]), one(["c", "b", "a"]))
    assert _rows(indexing.user_index(p, "src"), "userId", "uid", "is_shared") == [("a", 0, True), ("b", 1, True), ("d", 2, False)]
    assert _rows(indexing.user_index(p, "tgt"), "userId", "uid") == [("a", 0), ("b", 1), ("c", 2)]
    items = spark.createDataFrame([("z", 3), ("y", 1), ("z", 0), ("x", None), (None, 1)], "itemId string, pos int")
    assert _rows(indexing.item_index(items), "itemId", "iid") == [("x", 0), ("y", 1), ("z", 2)]
    assert _rows(indexing.item_index_first_seen(items, "pos"), "itemId", "iid") == [("x", 2), ("y", 1), ("z", 0)]
    many = spark.range(5000).select(F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("itemId")).repartition(9)
    assert indexing.item_index(many).where("cast(substr(itemId, 2) as bigint) != iid").count() == 0


def test_implicit(spark):
    df = spark.createDataFrame([(3.9,), (4.0,), (5.0,), (None,), (float("nan"),)], "x double")
    assert [r.r for r in df.select(implicit(F.col("x")).alias("r")).collect()] == [0, 1, 1, 0, 0]


def _split_counts(df, user):
    c = {(r.split, r.r): r["count"] for r in df.where(F.col("uid") == user).groupBy("split", "r").count().collect()}
    return tuple(c.get((s, 1), 0) for s in ("train", "val", "test")), tuple(c.get((s, 0), 0) for s in ("train", "val", "test"))


RATED = [(u, i, 1) for u, n in ((0, 1), (1, 2), (2, 3), (3, 5)) for i in range(n)] + [(u, 50 + i, 0) for u in (0, 3, 4) for i in range(4)]


@pytest.mark.parametrize("strategy", [splits.LeaveOneOut(3), splits.LeaveLastOut("dt")])
def test_leave_out(spark, strategy):
    df = spark.createDataFrame([(*r, r[1]) for r in RATED], "uid long, iid long, r int, dt int")
    x = strategy.split(df).cache()
    assert [_split_counts(x, u)[0] for u in range(4)] == [(1, 0, 0), (1, 0, 1), (1, 1, 1), (3, 1, 1)]
    assert x.where("r = 0 and split != 'train'").count() == 0 and x.count() == len(RATED)
    if isinstance(strategy, splits.LeaveLastOut):
        assert _rows(x.where("uid = 3 and split = 'test'"), "iid") == [(4,)] and _rows(x.where("uid = 3 and split = 'val'"), "iid") == [(3,)]
    twice = strategy.split(df.unionByName(df))
    assert twice.where("split = 'test'").groupBy("uid").count().where("count > 1").count() == 0 and twice.count() == 2 * len(RATED)
    assert strategy.split(df.limit(0)).count() == 0


def test_percent(spark):
    rows = [(0, i, 1) for i in range(10)] + [(0, 20 + i, 0) for i in range(3)] + [(1, 0, 1), (1, 1, 0), (1, 2, 0)] + [(2, i, 0) for i in range(4)]
    x = splits.PercentSplit(0, 0.25, 0.2).split(spark.createDataFrame(rows, "uid long, iid long, r int")).cache()
    assert _split_counts(x, 0) == ((6, 2, 2), (1, 1, 1)) and _split_counts(x, 1) == ((1, 0, 0), (1, 0, 1)) and _split_counts(x, 2) == ((0, 0, 0), (4, 0, 0))
    with pytest.raises(ValueError):
        splits.PercentSplit(0, 0.6, 0.5)


def test_ranked_in_ranges(spark):
    df = spark.createDataFrame([(u, i, 1) for u in range(3) for i in range(2000 * (u == 0) + 5)], "uid long, iid long, r int")
    h = {(r.uid, r.iid): r.h for r in df.withColumn("h", seeded_hash(1, "x", "uid", "iid")).collect()}
    assert len(set(h.values())) == len(h) and all(0 <= x < 1 << 60 for x in h.values())
    for group in (["uid"], [], ["uid", "r"]):
        got = splits.ranked(df.repartition(7), group, seeded_hash(1, "x", "uid", "iid")).collect()
        for u in range(3) if group else [None]:
            mine = sorted((r for r in got if u in (None, r.uid)), key=lambda r: h[r.uid, r.iid])
            assert [r.rn for r in mine] == list(range(1, len(mine) + 1)) and {r.n for r in mine} == {len(mine)}
    assert splits.ranked(df.limit(0), ["uid"], seeded_hash(1, "x", "uid", "iid")).count() == 0


def test_seeds_share_no_more_than_chance(spark):
    n = 20
    df = spark.range(300).selectExpr("id as uid").join(spark.range(n).selectExpr("id as iid")).withColumn("r", F.lit(1))
    pick = lambda s: {(r.uid, r.iid) for r in splits.LeaveOneOut(s).split(df).where("split = 'test'").collect()}
    assert len(pick(0)) == 300 and pick(0) == pick(0) and len(pick(0) & pick(1)) < 2.5 * 300 / n
    b = lambda e, s: {(r.uid, r.iid) for r in batches.epoch_batches(df, 600, e, s).where("batch = 0").collect()}
    first = b(0, 0)
    for other in (b(1, 0), b(0, 1)):
        assert len(first) == 600 and 20 < len(first & other) < 110  # 60 by chance


def test_draws_reach_all_items_evenly(spark):
    pos = spark.range(400).selectExpr("id as uid", "id * 3 as pos_iid")
    none = spark.createDataFrame([], "uid long, iid long")
    n = 20_000_000
    got = [r.iid for r in negatives.draws(pos, none, n, 50, 0).collect()]
    counts = np.bincount([x * 20 // n for x in got], minlength=20)
    assert len(counts) == 20 and ((counts - 1000) ** 2 / 1000).sum() < 50  # chi-square with 19 degrees of freedom
    again = [r.iid for r in negatives.draws(pos, none, n, 50, 1).collect()]
    assert len(set(got) & set(again)) < 40


def test_thinning(spark):
    df = spark.createDataFrame([(n, i, 1) for n in range(1, 8) for i in range(n)] + [(100, i, 1) for i in range(7)], "uid long, iid long, r int")
    kept = {r.uid: r["count"] for r in splits.thin_shared(df, 0.5, 100, 0).groupBy("uid").count().collect()}
    assert [kept.get(n, 0) for n in range(1, 8)] == [0, 1, 2, 2, 2, 3, 4] and kept[100] == 7
    assert splits.thin_shared(df, 0.0, 100, 0).count() == 7 and splits.thin_shared(df, 1.0, 100, 0) is df


def test_matrix_and_paths(spark):
    assert _rows(matrices.ui_matrix(spark.createDataFrame([(1, 2, 1), (1, 2, 1), (1, 3, 0)], "uid long, iid long, r int")), "uid", "iid", "cnt") == [(1, 2, 2)]
    paths = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "q"), (None, "x")], "n1_asin string, n2_asin string")
    s, t = spark.createDataFrame([("a", 0)], "itemId string, iid long"), spark.createDataFrame([("x", 0)], "itemId string, iid long")
    assert _rows(matrices.sim_pairs(paths, s, t), "src_iid", "tgt_iid") == [(0, 0)] and matrices.missing_items(paths, s, t).count() == 2
    with pytest.raises(ValueError):
        matrices.sim_pairs(paths, s, t, strict=True)


def _candidates(spark, rank, n=101):
    return spark.createDataFrame([(1, 7, k, int(k == 0), 0.5 if k == 0 else (0.9 if k < rank else 0.1)) for k in range(n)], "uid long, pos_iid long, cand_pos int, is_pos int, score double")


@pytest.mark.parametrize("rank,want", [(1, 1.0), (2, 0.63093), (3, 0.5), (10, 0.289065), (11, 0.0)])
def test_ndcg_and_hits(spark, rank, want):
    c = _candidates(spark, rank)
    assert metrics.ndcg_at_k(c, 10).first()["value"] == want and metrics.hit_at_k(c, 10).first()["value"] == int(rank <= 10)
    row = metrics.row_metrics(c, 10).first()
    assert round(row.ndcg, 6) == want and row.hit == int(rank <= 10)
    assert metrics.compute(metrics.Metric.NDCG10, c).first()["value"] == want and metrics.Metric.HR10.k == 10


def test_auc_and_empty_summary(spark):
    pairs = spark.createDataFrame([(1, 0.9, 0.1), (1, 0.2, 0.3), (2, 0.5, 0.5)], "uid long, pos_score double, neg_score double")
    assert metrics.compute(metrics.Metric.AUC, pairs).first()["auc"] == 0.25
    assert metrics.eval_summary(metrics.row_metrics(_candidates(spark, 1).limit(0), 10), 5).first()["n_rows"] == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_candidates_of_all_users(spark, monkeypatch, block):
    monkeypatch.setattr(transfer, "ITEM_BLOCK", block)
    rng = random.Random(6)
    some = lambda n: {(rng.randint(0, 29), rng.randint(0, 19)) for _ in range(n)}
    rated, pairs = some(80) | {(4, i) for i in range(20)}, some(60)
    frame = lambda x: spark.createDataFrame(sorted(x), "uid long, iid long")
    users = spark.range(0, 24, 2).withColumnRenamed("id", "uid")
    got = transfer.negative_candidates(users, spark.range(20).withColumnRenamed("id", "iid"), frame(rated), frame(pairs))
    assert _rows(got, "uid", "iid") == [(u, i) for u in range(0, 24, 2) for i in range(20) if (u, i) not in rated | pairs]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_ranking_query_has_2n_places(spark):
    f = fixture(spark, FOLDER)
    places = {r.uid: r["count"] for r in queries.queries()["src_ranking"](spark, FOLDER).groupBy("uid").count().collect()}
    assert places and places == {r.uid: min(2 * r.n_pos, f.n_items["src"]) for r in f.warm.collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_candidate_query_has_every_transfer_user(spark):
    f = fixture(spark, FOLDER)
    pairs, rated = ({(r.uid, r.iid) for r in x.collect()} for x in (f.pairs, f.matrix_no_shared))
    items = [r.iid for r in f.items["tgt"].collect()]
    users = {u for u, _ in pairs}
    assert len(users) > 10
    assert _rows(queries.reg_negative_candidates(spark, FOLDER), "uid", "iid") == sorted((u, i) for u in users for i in items if (u, i) not in pairs | rated)


@pytest.mark.parametrize("hits,best", [((1, 4), 4), ((1, 2), 2), ((1, 5), 2), ((3, 9), 3)])
def test_best_k_cases(spark, hits, best):
    r = spark.createDataFrame([(1, k, int(k in hits)) for k in range(1, 11)], "uid long, rank int, rel int")
    n = spark.createDataFrame([(1, 2)], "uid long, n_pos long")
    assert ranking.best_k_closed_form(r, n).first()["best_k"] == best == ranking.best_k(ranking.ndcg_curve(r.where("rank <= 4"), n, 10), n).first()["best_k"]


def test_transfer(spark):
    top = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], "uid long, iid long, rank int")
    sim = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "src_iid long, tgt_iid long")
    users = spark.createDataFrame([(1,)], "uid long")
    c = transfer.transfer_candidates(top, users, sim)
    rated = spark.createDataFrame([(1, 2, 1)], "uid long, iid long, cnt long")
    assert _rows(transfer.transfer_pairs(c, rated), "uid", "iid") == [(1, 1)]
    items = spark.range(5).withColumnRenamed("id", "iid")
    assert _rows(transfer.negative_candidates(users, items, rated, transfer.transfer_pairs(c, rated)), "iid") == [(0,), (3,), (4,)]
    counts = lambda n: spark.createDataFrame([(u, i, 1) for u, k in enumerate(n) for i in range(k)], "uid long, iid long, cnt long")
    assert _rows(transfer.warm_users(counts([15, 16, 40]), 2), "uid") == [(1,)]
    assert _rows(transfer.cold_users(counts([5, 6]), 3), "uid", "n_pos") == [(0, 5), (2, 0)]


def test_negatives(spark):
    pos = spark.createDataFrame([(1, 7)], "uid long, pos_iid long")
    drawn = spark.createDataFrame([(1, 7, 0, 3, 1), (1, 7, 1, 4, 1), (1, 7, 2, 5, 1)], "uid long, pos_iid long, draw int, iid long, is_false int")
    assert tuple(negatives.first_true(drawn).first()) == (1, 7, 3, 1)
    mixed = drawn.withColumn("is_false", (F.col("draw") != 1).cast("int"))
    assert tuple(negatives.first_true(mixed).first()) == (1, 7, 4, 0) and _rows(negatives.keep_best(mixed, 2), "slot", "iid") == [(1, 4), (2, 3)]
    known = spark.createDataFrame([(1, i) for i in range(0, 20, 2)], "uid long, iid long")
    x = negatives.draws(pos, known, 20, 50, 0).collect()
    assert len(x) == 50 and all(0 <= r.iid < 20 and r.is_false == int(r.iid % 2 == 0) for r in x)


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_top_scores(spark, monkeypatch, most):
    monkeypatch.setattr(scoring, "WINDOW_ROWS", most)
    monkeypatch.setattr(scoring, "USER_BLOCK", 3)
    monkeypatch.setattr(scoring, "ITEM_BLOCK", 4)
    rng = np.random.default_rng(0)
    u, i = np.round(rng.normal(size=(7, 3)), 1), np.round(rng.normal(size=(11, 3)), 1)
    i[5] = i[2]  # a tie
    need = [0, 1, 2, 5, 11, 30, 4]
    users = spark.createDataFrame([(k, need[k], u[k].tolist()) for k in range(7)], "uid long, need int, v array<double>")
    items = spark.createDataFrame([(k, i[k].tolist()) for k in range(11)], "iid long, v array<double>")
    want = []
    for k in range(7):
        s = np.round(u[k] @ i.T, 6)
        want += [(k, int(j), r + 1) for r, j in enumerate(sorted(range(11), key=lambda j: (-s[j], j))[: need[k]])]
    assert _rows(scoring.top_scores(users, items), "uid", "iid", "rank") == sorted(want)


def test_scores(spark):
    users = spark.createDataFrame([(1, [1.0, 2.0], 0.5)], "uid long, v array<double>, b double")
    items = spark.createDataFrame([(2, [3.0, -1.0], 0.25), (3, [float("nan"), 0.0], 0.0)], "iid long, v array<double>, b double")
    pairs = spark.createDataFrame([(1, 2)], "uid long, iid long")
    assert scoring.score_pairs(pairs, users, items, 1.0).first()["score"] == 2.75
    with pytest.raises(Exception, match="NaN"):
        scoring.score_pairs(spark.createDataFrame([(1, 3)], "uid long, iid long"), users, items).collect()


def test_logic(spark):
    one = lambda c, x: spark.createDataFrame([(v,) for v in x], "x double").agg(c.alias("r")).first()["r"]
    assert round(one(logic.forall(F.col("x"), 2), [1.0, 0.5]), 6) == 0.646447 and one(logic.forall(F.col("x"), 1), [1.0, 0.5]) == 0.75
    assert round(spark.range(1).select(logic.sat_agg([F.lit(0.8), F.lit(0.6)], 2).alias("r")).first()["r"], 6) == 0.683772
    assert round(one(F.avg(logic.softplus_loss(F.col("x"), F.lit(0.0))), [0.0, math.log(3)]), 6) == 0.490415
    assert one(F.avg(logic.softplus_loss(F.col("x"), F.lit(0.0))), [-1000.0]) == 1000.0


def test_early_stop(spark):
    trace = logic.early_stop_trace(spark.createDataFrame(list(enumerate([0.1, 0.2, 0.2, 0.2, 0.2, 0.9], 1)), "epoch int, score double"), 2).orderBy("epoch").collect()
    assert [r.epoch for r in trace] == [1, 2, 3, 4, 5] and [r.flat_epochs for r in trace] == [0, 0, 1, 2, 3] and [r.stopped for r in trace] == [False] * 4 + [True]


def test_closed_form_equals_curve(spark):
    rng = random.Random(4)
    counts, rows = [], []
    for u in range(60):
        n = rng.randint(1, 12)
        hits = set(rng.sample(range(1, 41), n))
        counts.append((u, n))
        rows += [(u, k, int(k in hits)) for k in range(1, 2 * n + 1)]
    r, n = spark.createDataFrame(rows, "uid long, rank int, rel int"), spark.createDataFrame(counts, "uid long, n_pos long")
    assert _rows(ranking.best_k_closed_form(r, n), "uid", "best_k") == _rows(ranking.best_k(ranking.ndcg_curve(r, n, 1000), n), "uid", "best_k")

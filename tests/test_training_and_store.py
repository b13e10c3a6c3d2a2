import gzip
import math

import numpy as np
from pyspark.sql import functions as F
import pytest

from crossweave.operators.metrics import Metric
from crossweave.operators.splits import LeaveLastOut, LeaveOneOut
from crossweave.pipeline import Pipeline
from crossweave.sources.readers import Registry, read_paths, read_ratings
from crossweave.sources.store import Store, config_key
from crossweave.streaming.readers import stream_implicit, stream_paths
from crossweave.training import batches, initial, steps, sweep
from crossweave.training.config import Experiment, LtnParams, MfParams, experiment, mf_experiment

K = 3


def _model(rng):
    return rng.normal(size=(4, K)), rng.normal(size=(5, K)), rng.normal(size=5)


def _frames(spark, p, q, b):
    users = spark.createDataFrame([(k, x.tolist(), 0.0) for k, x in enumerate(p)], "uid long, v array<double>, b double")
    return users, spark.createDataFrame([(k, x.tolist(), float(y)) for k, (x, y) in enumerate(zip(q, b))], "iid long, v array<double>, b double")


def _d(p, q, b, triples):
    return np.array([p[u] @ (q[i] - q[j]) + b[i] - b[j] for u, i, j in triples])


def _bpr(p, q, b, t):
    return np.log1p(np.exp(-_d(p, q, b, t))).mean()


def _ltn(p, q, b, one, two, ps):
    sat = [1 - ((1 - 1 / (1 + np.exp(-_d(p, q, b, t)))) ** e).mean() ** (1 / e) for t, e in zip((one, two), ps)]
    return np.mean([(1 - a) ** ps[2] for a in sat]) ** (1 / ps[2])


ONE, TWO = [(0, 1, 2), (0, 3, 2), (1, 2, 4), (3, 0, 1)], [(1, 1, 3), (2, 4, 0)]


def _check(got, loss, p, q, b):
    """Gradients against finite differences."""
    got = {(r.entity, r.id): r.g for r in got.collect()}
    for kind, rows in (("user", range(4)), ("item", range(5))):
        for k in rows:
            for j in range(K + (kind == "item")):
                def moved(e):
                    x = [p.copy(), q.copy(), b.copy()]
                    if j < K:
                        x[0 if kind == "user" else 1][k, j] += e
                    else:
                        x[2][k] += e
                    return loss(*x)

                want = (moved(1e-6) - moved(-1e-6)) / 2e-6
                assert abs(got.get((kind, k), [0.0] * (K + 1))[j] - want) < 1e-7


def test_gradients(spark):
    p, q, b = _model(np.random.default_rng(5))
    users, items = _frames(spark, p, q, b)
    t = lambda x: spark.createDataFrame(x, "uid long, pos_iid long, neg_iid long")
    _check(steps.gradients(steps.bpr_coefficients(steps.with_differences(t(ONE), users, items)), K), lambda *x: _bpr(*x, ONE), p, q, b)
    _check(steps.ltn_gradients(t(ONE), t(TWO), users, items, 3, 2, 4), lambda *x: _ltn(*x, ONE, TWO, (3, 2, 4)), p, q, b)


def test_clip_and_adamw(spark):
    g = spark.createDataFrame([("user", 0, [3.0, 0.0]), ("item", 0, [0.0, 4.0])], "entity string, id long, g array<double>")
    assert {r.entity: [round(x, 9) for x in r.g] for r in steps.clip(g, 1.0).collect()} == {"user": [0.6, 0.0], "item": [0.0, 0.8]}
    assert {r.entity: r.g for r in steps.clip(g, 10.0).collect()} == {"user": [3.0, 0.0], "item": [0.0, 4.0]}
    with pytest.raises(Exception, match="finite"):
        steps.clip(g.withColumn("g", F.array(F.lit(float("nan")))), 1.0).collect()
    users, items = _frames(spark, np.ones((1, 1)), np.ones((2, 1)), np.zeros(2))
    after = {(r.entity, r.id): r.w for r in steps.adamw(steps.state(users, items), g, 1, 0.1, 0.5).collect()}
    assert math.isclose(after["user", 0][0], 0.95 - 0.1, rel_tol=1e-6) and after["item", 1] == [0.95, 0.0]  # decay without a gradient


def test_training_lowers_the_loss_and_is_reproducible(spark):
    ids = lambda n, c: spark.range(n).withColumnRenamed("id", c)
    users, items = initial.factors(ids(4, "uid"), "uid", 4, K, 1), initial.factors(ids(5, "iid"), "iid", 5, K, 1)
    triples = spark.createDataFrame(ONE, "uid long, pos_iid long, neg_iid long")
    loss = lambda u, i: steps.with_differences(triples, u, i).agg(F.avg(F.log1p(F.exp(-F.col("d"))))).first()[0]
    grad = lambda step, u, i: steps.gradients(steps.bpr_coefficients(steps.with_differences(triples, u, i)), K)
    best, trace = steps.train(users, items, grad, 4, 0.1, 0.01, validate=lambda u, i: -loss(u, i))
    assert len(trace) == 4 and trace[-1][1] > -loss(users, items) and [s for _, s in trace] == sorted(s for _, s in trace)
    again, _ = steps.train(users.repartition(3), items, grad, 4, 0.1, 0.01)
    one, two = ({(r.entity, r.id): r.w for r in x.collect()} for x in (best, again))
    assert all(np.allclose(one[k], two[k], atol=1e-12) for k in one)
    _, flat = steps.train(users, items, grad, 9, 0.1, 0.01, validate=lambda u, i: 0.5, patience=1)
    assert len(flat) == 3  # the first rises, two are flat


def test_initial_spread(spark):
    v = np.array([r.v for r in initial.factors(spark.range(2000).withColumnRenamed("id", "uid"), "uid", 2000, 8, 3).collect()])
    assert abs(v.std() / math.sqrt(2 / 2008) - 1) < 0.03 and abs(v.mean()) < 0.001


def test_batches(spark):
    pos = spark.createDataFrame([(u, i) for u in range(5) for i in range(7)], "uid long, iid long")
    sizes = sorted(r["count"] for r in batches.epoch_batches(pos, 10, 0).groupBy("batch").count().collect())
    assert sizes == [5, 10, 10, 10] and batches.batch_count(pos, 10).first()["n_batches"] == 4


def test_sweep():
    rows = sweep.trials(200, 1)
    assert rows == sweep.trials(200, 1) != sweep.trials(200, 2)
    assert all(1e-5 <= r[2] <= 1e-1 and 1e-6 <= r[3] <= 1e-1 and r[1] in sweep.N_FACTORS and 1 <= r[5] <= 10 for r in rows)
    assert sweep.search(rows, lambda t: -t["learning_rate"])[0][0] == min(rows, key=lambda r: r[2])[0]


def test_tuning_trains_each_trial(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([(f"u{u}", f"{x}{i}", 5.0 if (u + i) % 3 else 1.0) for u in range(3) for i in range(18)], "userId string, itemId string, rating double")
    paths = spark.createDataFrame([], "n1_asin string, n2_asin string")
    base = Experiment("a", "b", epochs=1, eval_draws=6, eval_kept=4)
    made = []

    def pipeline(trial):
        made.append(Pipeline(rows("s"), rows("t"), paths, sweep.with_trial(base, "source_model", trial), str(tmp_path)))
        return made[-1]

    trials = [(0, 1, 0.05, 0.01, 128, 2, 2, 2), (1, 2, 0.01, 0.1, 256, 3, 3, 3)]
    got = {r.trial: r for r in sweep.tune(pipeline, "source_model", trials, Store(spark, str(tmp_path / "out"))).collect()}
    assert [p.config.source_mf for p in made] == [MfParams(1, 0.05, 0.01, 128), MfParams(2, 0.01, 0.1, 256)]
    assert {k: r.score for k, r in got.items()} == {k: p.store.read("metrics").first().score for k, p in enumerate(made)}
    assert got[1].batch_size == 256 and sweep.with_trial(base, "target_ltn", dict(got[1].asDict())).target_ltn.p_sat == 3


def test_store_and_keys(spark, tmp_path):
    s, made = Store(spark, str(tmp_path / "x")), []
    make = lambda: made.append(1) or spark.range(3)
    assert s.table("t", make).count() == s.table("t", make).count() == 3 and len(made) == 1
    s.append("m", spark.range(1))
    s.append("m", spark.range(1))
    assert s.read("m").count() == 2
    s.clear()
    assert not s.has("t")
    keys = {config_key(s=LeaveOneOut(0)), config_key(s=LeaveOneOut(1)), config_key(s=LeaveLastOut("0")), config_key(c=Experiment("a", "b")), config_key(c=Experiment("a", "b", seed=1))}
    assert len(keys) == 5 and config_key(c=Experiment("a", "b")) in keys
    assert experiment("music", "movies").target_ltn.n_factors == 100
    with pytest.raises(KeyError):
        experiment("movies", "books")
    with pytest.raises(ValueError):
        Experiment("a", "b", sparsity_sh=1.5)


def test_seeds_draw_splits(spark):
    rated = spark.createDataFrame([(u, i, 1) for u in range(4) for i in range(60)], "uid long, iid long, r int")
    test = lambda s: sorted((r.uid, r.iid) for r in s.split(rated).where("split = 'test'").collect())
    one, two = experiment("music", "movies", seed=1), experiment("music", "movies", seed=2)
    assert test(one.source_split) != test(two.source_split) and test(one.target_split) != test(two.target_split)
    assert test(one.source_split) == test(one.target_split) and experiment("music", "movies", seed=1, target_split=LeaveLastOut()).target_split.time == "dt"


def test_readers(spark, tmp_path):
    csv = "timestamp,rating,userId,itemId,more\n1500000000,4.0,u1,007,x\n,bad,u2,b,y\n"
    with gzip.open(tmp_path / "r.csv.gz", "wt") as f:
        f.write(csv)
    got = read_ratings(spark, str(tmp_path / "r.csv.gz"), "timestamp").collect()
    assert [tuple(r)[:3] for r in got] == [("u1", "007", 4.0), ("u2", "b", None)] and got[0].dt.year == 2017 and got[1].dt is None
    with pytest.raises(ValueError):
        read_ratings(spark, str(tmp_path / "r.csv.gz"), "when")
    (tmp_path / "p.jsonl").write_text('{"n1_asin": "a", "n2_asin": "b", "path": [1]}\n{"n2_asin": "c"}\nnot json\n')
    assert sorted(map(tuple, read_paths(spark, str(tmp_path / "p.jsonl")).collect()), key=str) == [("a", "b"), (None, "c"), (None, None)]
    r = Registry({"a": "1", "b": "2"}, {("a", "b"): "3"})
    assert r.pair("a", "b") == ("1", "2", "3")
    with pytest.raises(KeyError):
        r.pair("b", "a")


def test_streams(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.jsonl").write_text('{"n1_asin": "a", "n2_asin": "b"}\n')
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.csv").write_text("userId,itemId,rating\nu,i,4.5\nu,j,2\n")
    for df, name, want in ((stream_paths(spark, str(tmp_path / "p")), "paths_now", [("a", "b")]), (stream_implicit(spark, str(tmp_path / "r")), "implicit_now", [("u", "i", 1), ("u", "j", 0)])):
        q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and sorted(map(tuple, spark.table(name).collect())) == want


def test_auc_validates_by_auc(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([(f"u{u}", f"{x}{i}", 5.0 if (u + i) % 3 else 1.0) for u in range(3) for i in range(18)], "userId string, itemId string, rating double")
    p = Pipeline(rows("s"), rows("t"), spark.createDataFrame([], "n1_asin string, n2_asin string"), Experiment("a", "b", eval_draws=6, eval_kept=4, metric=Metric.AUC), str(tmp_path))
    model = lambda b: (p.users["src"].selectExpr("uid", "array(0D) as v", "0D as b"), p.items["src"].selectExpr("iid", "array(0D) as v", f"{b} as b"))
    assert p._validate("src")(*model("0D")) == 0.0  # all scores equal: none is strictly higher, though NDCG ranks the positive first
    found = {}
    for r in p.candidates("src", "val", "src", *model("cast(iid as double)")).where("cand_pos <= 1").collect():
        found.setdefault(r.uid, {})[r.is_pos] = r.score
    assert len(found) == 3 and abs(p._validate("src")(*model("cast(iid as double)")) - sum(x[1] > x[0] for x in found.values()) / 3) < 1e-6


def test_an_epoch_is_all_positives(spark, tmp_path, monkeypatch):
    rows = lambda x: spark.createDataFrame([(f"u{u}", f"{x}{i}", 5.0 if (u + i) % 3 else 1.0) for u in range(3) for i in range(18)], "userId string, itemId string, rating double")
    paths = spark.createDataFrame([], "n1_asin string, n2_asin string")
    p = Pipeline(rows("s"), rows("t"), paths, Experiment("a", "b", source_mf=MfParams(2, 0.05, 0.01, 12), epochs=2, eval_draws=6, eval_kept=4), str(tmp_path))
    seen, whole = [], steps.with_differences
    monkeypatch.setattr(steps, "with_differences", lambda t, *x: seen.append([(r.uid, r.pos_iid) for r in t.collect()]) or whole(t, *x))
    p.source_model
    want = sorted((r.uid, r.iid) for r in p.matrix["src"].collect())
    n = math.ceil(len(want) / 12)
    assert n > 1 and len(seen) == 2 * n and all(len(b) <= 12 for b in seen)
    for epoch in (seen[:n], seen[n:]):
        assert sorted(sum(epoch, [])) == want
    assert len(set(seen[0]) & set(seen[n])) < 11  # another shuffle, not the first one shifted
    assert [r.epoch for r in p.store.read("metrics").orderBy("epoch").collect()] == [1, 2]


def _small(spark, tmp_path, **more):
    rows = lambda x: spark.createDataFrame([(f"u{u}", f"{x}{i}", 5.0 if (u + i) % 3 else 1.0) for u in range(3) for i in range(18)], "userId string, itemId string, rating double")
    config = Experiment("a", "b", source_mf=MfParams(2, 0.05, 0.01, 64), target_ltn=LtnParams(2, 0.05, 0.01, 64, 3, 2, 2), epochs=1, eval_draws=6, eval_kept=4, **more.pop("config", {}))
    return Pipeline(rows("s"), rows("t"), spark.createDataFrame([], "n1_asin string, n2_asin string"), config, str(tmp_path), **more)


def own_draws(positives, matrix, n_items, m, seed):
    """Always the last item."""
    x = positives.select("uid", "pos_iid", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("draw"))
    return x.withColumn("iid", F.lit(n_items - 1).cast("long")).withColumn("is_false", F.lit(0))


def test_hooks_projections_and_losses(spark, tmp_path):
    p = _small(spark, tmp_path, config={"metric": Metric.LOSS, "sparsity_sh": 1.0}, sampler=own_draws)
    assert p.store.folder != _small(spark, tmp_path, config={"metric": Metric.LOSS, "sparsity_sh": 1.0}).store.folder
    assert {r.neg_iid for r in p._epoch("tgt", 0, 64).collect()} == {17}
    assert set(p.comparison_tables) == set(p.target_tables) - {"sim", "src_matrix"} and set(p.pretrain_tables) == {"train", "val", "test", "matrix", "users", "items"}
    users, items = p.target_axiom
    assert users.count() == 3 and items.count() == 18
    assert p.store.read("metrics").where("model = 'target_axiom'").first().score < 0  # a loss below 0: higher is better
    model = (p.users["tgt"].selectExpr("uid", "array(0D) as v", "0D as b"), p.items["tgt"].selectExpr("iid", "array(0D) as v", "0D as b"))
    assert abs(p._validate("tgt")(*model) + math.log(2)) < 1e-6


def test_axiom_gradient(spark):
    p, q, b = _model(np.random.default_rng(6))
    users, items = _frames(spark, p, q, b)
    one = lambda *x: ((1 - 1 / (1 + np.exp(-_d(*x, ONE)))) ** 3).mean() ** (1 / 3)
    _check(steps.axiom_gradients(spark.createDataFrame(ONE, "uid long, pos_iid long, neg_iid long"), users, items, 3, (True, True)), one, p, q, b)


def test_over_seeds_and_biases():
    assert 0 <= initial.global_bias(1) < 1 and initial.global_bias(1) != initial.global_bias(2)
    assert mf_experiment("books", "music", seed=3).target_split.seed == 3
    with pytest.raises(KeyError):
        mf_experiment("music", "books")


def _numpy_epoch(p, q, b, batches, lr, decay):
    """Batches of AdamW on the pairwise loss, from fresh moments."""
    w = {("user", k): np.append(x, 0.0) for k, x in enumerate(p)} | {("item", k): np.append(x, y) for k, (x, y) in enumerate(zip(q, b))}
    m, s = {k: np.zeros(K + 1) for k in w}, {k: np.zeros(K + 1) for k in w}
    for t, batch in enumerate(batches, 1):
        g = {k: np.zeros(K + 1) for k in w}
        for u, i, j in batch:
            pu, qi, qj = w["user", u], w["item", i], w["item", j]
            d = pu[:K] @ (qi[:K] - qj[:K]) + qi[K] - qj[K]
            c = -1 / (1 + np.exp(d)) / len(batch)
            g["user", u][:K] += c * (qi[:K] - qj[:K])
            g["item", i] += c * np.append(pu[:K], 1.0)
            g["item", j] -= c * np.append(pu[:K], 1.0)
        for k in w:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
            w[k] = w[k] * (1 - lr * decay) - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return w


def test_an_epoch_equals_numpy(spark):
    p, q, b = _model(np.random.default_rng(7))
    users, items = _frames(spark, p, q, b)
    parts = [ONE[:2], ONE[2:], TWO]
    frames = [spark.createDataFrame(x, "uid long, pos_iid long, neg_iid long") for x in parts]
    grad = lambda step, u, i: steps.gradients(steps.bpr_coefficients(steps.with_differences(frames[step - 1], u, i, (True, True))), K)
    best, _ = steps.train(users, items, grad, 1, 0.05, 0.1, batches=3)
    want = _numpy_epoch(p, q, b, parts, 0.05, 0.1)
    assert all(np.allclose(r.w, want[r.entity, r.id], atol=1e-9) for r in best.collect())


def test_whole_experiment(spark, tmp_path):
    rows = lambda items, users: spark.createDataFrame([(f"u{u}", f"{items}{i}", float(1 + (u * 7 + i * 3 + u * i) % 5)) for u in users for i in range(60)], "userId string, itemId string, rating double")
    paths = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(60)], "n1_asin string, n2_asin string")
    small = MfParams(2, 0.05, 0.01, 16)
    config = Experiment("a", "b", source_mf=small, target_mf=small, target_ltn=LtnParams(2, 0.05, 0.01, 8, 2, 2, 2), epochs=1, eval_draws=12, eval_kept=8)
    p = Pipeline(rows("s", range(6)), rows("t", range(3, 9)), paths, config, str(tmp_path))
    got = p.evaluate("ltn").first()
    assert got.n_rows > 0 and 0 <= got.ndcg10 <= 1 and p.transfer_pairs.count() > 0 and p.store.read("metrics").count() == 2
    again = Pipeline(p.ratings["src"], p.ratings["tgt"], paths, config, str(tmp_path))
    assert again.evaluate("ltn").first() == got

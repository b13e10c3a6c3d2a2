import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from crossweave.llm import pairs, queries

SCHEMA = "userId string, itemId string, code long, n long, user_key int"  # the last three clash with names used inside


def _rows(seed=1, users=60, items=25):
    rng = random.Random(seed)
    out = [("U0", f"I{i}") for i in range(items)] * 2  # one user holds everything, twice
    for u in range(1, users):
        for _ in range(rng.randint(0, 9)):
            out.append((rng.choice([f"u{u}", f" U{u}", f"Ｕ{u}"]), rng.choice([f"I{rng.randint(0, items - 1)}", None, "none", ""])))
    return [(u, i, 7, None, 3) for u, i in out]


def _brute(rows, least):
    baskets = defaultdict(set)
    for u, i, *_ in rows:
        if i not in (None, "none", ""):
            baskets[u.strip().upper().replace("Ｕ", "U")].add(i)
    both, one = Counter(), Counter(i for b in baskets.values() for i in b)
    for b in baskets.values():
        both.update(itertools.combinations(sorted(b), 2))
    return {p: (c, one[p[0]], one[p[1]], len(baskets)) for p, c in both.items() if c >= least}


@pytest.mark.parametrize("least,cell", [(1, 512), (2, 512), (3, 3), (12, 2)])
def test_counts_are_exact(spark, monkeypatch, least, cell):
    monkeypatch.setattr(pairs, "CELL", cell)  # small cells: baskets are cut up
    rows = _rows()
    got = pairs.item_pairs(spark.createDataFrame(rows, SCHEMA), min_count=least).collect()
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in got} == _brute(rows, least)
    assert all(0 <= r.q_value <= 1 and r.surprise >= 0 and math.isclose(r.lift, r.n_ab * r.n_baskets / r.n_a / r.n_b, abs_tol=1e-5) for r in got)


def test_query_reports_every_pair(spark, tmp_path):
    rows = _rows(4, 120, 8)
    spark.createDataFrame([r[:2] for r in rows], "userId string, itemId string").write.parquet(str(tmp_path / "src_ratings.parquet"))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets, r.lift) for r in queries.p1_pairs(spark, str(tmp_path)).collect()}
    want = _brute(rows, 1)
    assert {p: x[:4] for p, x in got.items()} == want
    assert min(x[0] for x in got.values()) < 12 and min(x[4] for x in got.values()) < 1


def test_lift_prunes_nothing_it_should_keep(spark):
    rows = _rows(2, 400, 60)
    want = {p for p, (c, a, b, n) in _brute(rows, 2).items() if c * n >= 2 * a * b}
    assert {tuple(r) for r in pairs.found_pairs(spark.createDataFrame(rows, SCHEMA), 2, 2).collect()} == want


def test_q_values_select(spark):
    planted = [(f"p{k}", i, 7, None, 3) for k in range(30) for i in ("PA", "PB")]  # always together
    df = spark.createDataFrame(_rows(2, 400, 60) + planted, SCHEMA)
    q = {(r.item_a, r.item_b): r.q_value for r in pairs.item_pairs(df, min_count=2, min_lift=2).collect()}
    assert {tuple(r) for r in pairs.found_pairs(df, 2, 2, 0.01).collect()} == {p for p, v in q.items() if v <= 0.01} == {("PA", "PB")}
    assert len(q) > 50


def test_items_beyond_packed_codes_and_gap(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), SCHEMA)
    want = sorted(map(tuple, pairs.item_pairs(df, min_count=2).collect()))
    monkeypatch.setattr(pairs, "PACKED", 3)
    assert sorted(map(tuple, pairs.item_pairs(df, min_count=2).collect())) == want
    assert pairs.fit_null([50, 10], [2, 8], [3, 9], [20, 10], [5, 8]).gap < 1e-6
    with pytest.warns(RuntimeWarning, match="rounds"):
        assert pairs.fit_null([50, 10], [2, 28], [3, 9], [20, 10], [5, 28], rounds=1).gap > pairs.GAP


def test_no_rows(spark):
    assert pairs.item_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pairs.item_pairs(spark.createDataFrame([(None, None, 1, 1, 1), ("a", None, 1, 1, 1)], SCHEMA), min_count=1).count() == 0
    with pytest.raises(ValueError):
        pairs.item_pairs(spark.createDataFrame([], SCHEMA), min_count=0)


def test_null_model_meets_degrees():
    nu, du, ni, di = np.array([50, 20, 2]), np.array([2.0, 6, 30]), np.array([30, 9, 1]), np.array([4.0, 15, 45])
    scale = (nu * du).sum() / (ni * di).sum()
    null = pairs.fit_null(nu, du, [1, 2, 3], ni, di * scale)
    p = null.x[:, None] * null.y[None, :] / (1 + null.x[:, None] * null.y[None, :])
    assert np.allclose((p * ni).sum(1), du, rtol=1e-5) and np.allclose((p * nu[:, None]).sum(0), di * scale, rtol=1e-5)


def test_tails_against_convolution():
    rng = np.random.default_rng(3)
    q, m = rng.uniform(0.001, 0.3, 12), rng.integers(1, 30, 12).astype(float)
    dist = np.array([1.0])
    for p, k in zip(q, m):
        for _ in range(int(k)):
            dist = np.convolve(dist, [1 - p, p])
    ns = [1, 3, 10, int((q * m).sum()), int((q * m).sum()) + 1, 45, 70, 0, int(m.sum()) + 1]
    mean, log10 = pairs.tails(np.tile(q, (len(ns), 1)), m, np.array(ns))
    assert np.allclose(mean, (q * m).sum())
    for n, t in zip(ns[:7], log10):
        assert abs(10**t / dist[n:].sum() - 1) < 0.06, (n, dist[n:].sum(), 10**t)
    assert log10[7] == 0 and log10[8] == -math.inf
    far = pairs.tails(np.full((1, 3), 1e-4), np.array([10.0, 50, 1000]), np.array([200]))[1][0]
    exact = (math.lgamma(1061) - math.lgamma(201) - math.lgamma(861) + 200 * math.log(1e-4) + 860 * math.log1p(-1e-4)) / math.log(10)
    assert abs(far - exact) < 0.05  # the first term of a tail that falls fast


def test_q_values_are_benjamini_hochberg(spark):
    s = [0.0, 0.5, 1.0, 1.0, 3.0, 8.0]
    got = {r.surprise: r.q_value for r in pairs.with_q_values(spark.createDataFrame([(x,) for x in s], "surprise double"), 10).collect()}
    p = sorted(10**-x for x in s)
    for x in s:
        want = min(min(1.0, 10 * v / (sum(w <= v for w in p))) for v in p if v >= 10**-x)
        assert math.isclose(got[x], want, rel_tol=1e-9)

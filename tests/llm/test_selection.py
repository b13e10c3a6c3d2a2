import random

from pyspark.sql import functions as F
import pytest

from crossweave.llm import frequent, sample, topn


def _top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s and abs(s) < float("inf"):
            best[g, i] = max(s, best.get((g, i), s))
    out = []
    for g in {g for g, _ in best}:
        mine = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, i, -s + 0.0, k + 1) for k, (s, i) in enumerate(mine)]
    return sorted(out)


@pytest.mark.parametrize("bands", [(), (0.1, 0.4), (0.01, 0.02, 0.5, 0.9)])
def test_top_n(spark, bands):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), rng.choice([None, "é", "z", "Z"] + [f"i{k}" for k in range(40)]), rng.choice([*odd, round(rng.random(), 1), -rng.random()])) for _ in range(1500)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "g string, item string, s double, rank int, i int")
    got = topn.top_n(df, "g", "item", "s", 4, bands).collect()
    assert sorted(tuple(r) for r in got) == _top(rows, 4)


def test_top_n_of_nothing(spark):
    assert topn.top_n(spark.createDataFrame([], "u string, i string, s double"), "u", "i", "s").count() == 0
    assert topn.top_n(spark.createDataFrame([("u", "i", None)], "u string, i string, s double"), "u", "i", "s").count() == 0
    with pytest.raises(ValueError):
        topn.top_n(spark.createDataFrame([], "u string, i string, s double"), "u", "i", "s", 0)


def test_frequent(spark):
    rows = [("a",)] * 50 + [("Ａ",)] * 10 + [(" b ",)] * 30 + [("n/a",)] * 500 + [(None,)] * 500 + [(f"x{k}",) for k in range(10)]
    one, two = spark.createDataFrame(rows[::2], "itemId string"), spark.createDataFrame(rows[1::2], "itemId string")
    assert [tuple(r) for r in frequent.most_frequent([one, two], 3).collect()] == [("A", 60, 100), ("B", 30, 100), ("X0", 1, 100)]
    assert {r.item_key for r in frequent.frequent_keys([one, two], (30, 100)).collect()} == {"A", "B"}
    empty = spark.createDataFrame([], "itemId string")
    assert frequent.most_frequent([empty], 5).count() == 0 and frequent.frequent_keys([empty], (1, 10)).count() == 0


def _rating_rows(n, batches):
    rng = random.Random(9)
    return [(rng.choice([f"u{rng.randint(0, n)}", "hot", None, "na"]), f"i{rng.randint(0, 99)}", rng.choice([*range(batches), None])) for _ in range(n * 3)]


def test_sample_is_stable(spark):
    rows = _rating_rows(400, 6)
    full = spark.createDataFrame(rows, "userId string, itemId string, batch_no int")
    members = lambda df: {tuple(r) for r in sample.sample_pairs({"src": df}, 0.2).collect()}
    grown = members(full)
    for b in (0, 2, 4):
        early = full.where((F.col("batch_no") <= b) | F.col("batch_no").isNull())
        before = members(early)
        assert before <= grown and before
    assert members(full.repartition(7)) == grown == members(full.orderBy("itemId").coalesce(1))
    assert sample.sample_pairs({"src": full}, 0).count() == 0
    assert sample.sample_pairs({"src": full}, 1).count() == full.where("userId not in ('na')").select("userId", "itemId").distinct().count()


def test_sample_covers_evenly(spark):
    df = spark.createDataFrame([(f"u{k}", "i", k // 1000) for k in range(5000)], "userId string, itemId string, batch_no int")
    numbers = sample.sequence_numbers(df, ["userId"], "batch_no")
    assert sorted(r.seq for r in numbers.collect()) == list(range(5000))
    got = sample.sample_users({"src": df}, 0.1).groupBy("first_batch").count().collect()
    assert all(abs(r["count"] - 100) <= 3 for r in got) and len(got) == 5


def test_stored_numbers_lose_no_member(spark, tmp_path):
    """Old rows go, rows without a batch and rows of old batches come: every member stays one."""
    rows = _rating_rows(300, 6)
    full = spark.createDataFrame([r for r in rows if r[2] is not None], "userId string, itemId string, batch_no int")
    numbers = sample.Numbers(spark, str(tmp_path / "numbers"))
    one = {tuple(r) for r in sample.sample_pairs({"src": full}, 0.2, numbers).collect()}
    fewer = full.where("batch_no >= 3")
    late = spark.createDataFrame([(f"new{k}", "i", [None, 0, 9][k % 3]) for k in range(200)], "userId string, itemId string, batch_no int")
    two = {tuple(r) for r in sample.sample_pairs({"src": fewer.unionByName(late)}, 0.2, numbers).collect()}
    assert one and one < two and len({r[-1] for r in two}) == len(two)
    assert abs(len(two - one) - 40) <= 3
    again = {tuple(r) for r in sample.sample_pairs({"src": fewer}, 0.2, numbers).collect()}
    seqs = sorted(r.seq for r in numbers.read().collect())
    assert again == two and seqs == list(range(len(seqs)))
    unstored = {r[:3] for r in map(tuple, sample.sample_pairs({"src": fewer.unionByName(late)}, 0.2).collect())}
    assert not {r[:3] for r in one} <= unstored  # what storing them is for


def test_low_discrepancy_is_modular(spark):
    seqs = [0, 1, 2**20 - 1, 2**20, 2**31 + 5, 2**45 + 12345, 2**61]
    df = spark.createDataFrame([(s,) for s in seqs], "s long").select("s", sample.low_discrepancy(F.col("s"), 99).alias("p"))
    assert {r.s: r.p for r in df.collect()} == {s: (s * sample.GOLDEN + 99) % (1 << sample.BITS) for s in seqs}


def test_sample_of_nothing(spark):
    assert sample.sample_users({"src": spark.createDataFrame([], "userId string, itemId string, batch_no int")}, 0.5).count() == 0
    with pytest.raises(ValueError):
        sample.sample_users({"src": spark.createDataFrame([], "userId string, itemId string, batch_no int")}, 1.5)

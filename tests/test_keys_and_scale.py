import random
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T
import pytest

from crossweave.functions.keys import ABSENT_KEYS, with_keys
from crossweave.operators import scale


def _key(s):
    if s is None:
        return None
    k = "".join(c for c in unicodedata.normalize("NFKC", s) if c.isascii() and c.isalnum()).upper()
    return None if k in ABSENT_KEYS else k


def test_keys(spark):
    ids = ["A1", " a1 ", "Ａ１", "a-1\n", "ﬁ½", "Å1", "Å1", "B̊1", "", " ", "n/a", "NaN", "nu ll", "Unknown", "ｎｏｎｅ", None, "日本", "①②", "x​y", "A" * 5000, "A1\n"]
    got = with_keys(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "k int, id string"), {"key": "id"}, ["k"]).collect()
    assert {r.k: r.key for r in got} == {i: _key(x) for i, x in enumerate(ids)}


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.randint(0, 3), k, rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "p string, lead int, id int, v int").withColumn("h", F.md5(F.col("id").cast("string")))
    for digits in (1, 3):
        got = scale.running_total(df, ["p"], ["lead"], "h", ["id"], F.col("v"), "before", digits).collect()
        seen = {"x": 0, "y": 0}
        for r in sorted(got, key=lambda r: (r.lead, r.h, r.id)):
            assert r.before == seen[r.p]
            seen[r.p] += r.v
        assert len(got) == 500
    assert scale.running_total(df.limit(0), ["p"], [], "h", ["id"], F.lit(1), "n").count() == 0


@pytest.mark.parametrize("small,hot", [(True, 500_000), (False, 500_000), (False, 20)])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_either_way(spark, monkeypatch, small, hot, how):
    monkeypatch.setattr(scale.hot_keys, "__defaults__", (hot,))
    monkeypatch.setattr(scale, "is_small", lambda df: small)
    facts = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)] + [(1000, None)], "id int, key string")
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, x int")
    got = sorted(map(tuple, scale.lookup(facts, dim, ["key"], how).select("id").collect()))
    assert got == sorted(map(tuple, facts.join(dim, "key", how).select("id").collect()))


def test_measured(spark):
    df = spark.createDataFrame([("abc", [1, 2]), (None, None)], T.StructType([T.StructField("a b", T.StringType()), T.StructField("c", T.ArrayType(T.IntegerType()))]))
    n, size = scale.measured(df)
    assert n == 2 and size > 64 and scale.measured(df.limit(0)) == (0, 0)


def test_hot_keys(spark):
    facts = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)], "id int, key string")
    assert [tuple(r) for r in scale.hot_keys(facts, ["key"], 20).collect()] == [("hot", 3)]  # more than 300 rows / 4 tasks
    assert scale.hot_keys(facts, ["key"]).count() == 0 and scale.hot_keys(facts.limit(0), ["key"], 1).count() == 0

from collections import defaultdict
import random

from crossweave.operators import keyed

SCHEMA = "userId string, itemId string, rating double, n int, total int, v int"


def test_per_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + [" HOT", "u1", "u2", None, "na"]), rng.choice(["i1", "I1", "i2", None]), rng.choice([None, float("nan"), -1.0, 99.0, 1.0, 4.5, 5.0]), 1, 1, 1) for _ in range(800)]
    got = {(r.field_name, r.key_value): r for r in keyed.key_results({"t": (spark.createDataFrame(rows, SCHEMA), "rating", 1.0, 5.0)}).collect()}
    clean = lambda x: None if x in (None, "na") else x.strip().upper()
    n, partners, values = defaultdict(int), defaultdict(set), defaultdict(list)
    for u, i, v, *_ in rows:
        u, i = clean(u), clean(i)
        for k, other in ((("userId", u), i), (("itemId", i), u)):
            if k[1]:
                n[k] += 1
                partners[k] |= {other} - {None}
                values[k] += [v] if v is not None and 1 <= v <= 5 else []
    assert set(got) == set(n)
    for k, r in got.items():
        assert (r.n_rows, r.n_partners) == (n[k], len(partners[k])) and abs(r.mean_value - sum(values[k]) / len(values[k])) < 1e-5
    light = {(r.field_name, r.key_value): (r.n_rows, r.mean_value) for r in keyed.key_results({"t": (spark.createDataFrame(rows, SCHEMA), "rating", 1.0, 5.0)}, partners=False).collect()}
    assert light == {k: (r.n_rows, r.mean_value) for k, r in got.items()}
    heavy = {(r.field_name, r.key_value) for r in keyed.heavy_keys(keyed.key_results({"t": (spark.createDataFrame(rows, SCHEMA), "rating", 1.0, 5.0)}), ["table_name"], (1, 4)).collect()}
    assert heavy == {k for k in n if n[k] * 4 >= sum(c for j, c in n.items() if j[0] == k[0])}


def test_no_valid_value_and_no_rows(spark):
    one = spark.createDataFrame([("u", "i", None, 1, 1, 1)], SCHEMA)
    assert [r.mean_value for r in keyed.key_results({"t": (one, "rating", 1.0, 5.0)}).collect()] == [None, None]
    none = keyed.key_results({"t": (one.limit(0), "rating", 1.0, 5.0)})
    assert none.count() == 0 and keyed.heavy_keys(none, ["table_name"], (1, 100)).count() == 0

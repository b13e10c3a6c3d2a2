from datetime import datetime, timedelta
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.llm import overlaps

SCHEMA = "row_id long, dom string, userId string, itemId string, split string, r int, ts timestamp, block int, n int"
NOW = datetime(2020, 1, 2, 3, 4, 5)


def _brute(rows):
    key = lambda x: None if x in (None, "na", "") else x.strip().upper()
    out = set()
    for a in rows:
        for b in rows:
            if a[4] == "train" and b[4] in ("val", "test") and a[1] and a[1] == b[1] and key(a[2]) and key(a[3]) and key(a[2]) == key(b[2]) and key(a[3]) == key(b[3]):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def _rows():
    rng = random.Random(4)
    rows = []
    for k in range(400):
        u = rng.choice(["hot"] * 3 + [f"u{rng.randint(0, 9)}", f" U{rng.randint(0, 9)}", None, "na"])
        rows.append((k, rng.choice(["src", "tgt", None]), u, rng.choice(["top", "Top ", f"i{rng.randint(0, 9)}", None]), rng.choice(["train", "train", "val", "test", None]), rng.choice([0, 1, None]), rng.choice([NOW, NOW + timedelta(days=rng.randint(0, 3)), None]), 1, 1))
    return rows


def test_pairs_and_report(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "PAIRS_A_TASK", 50)  # hot classes are split
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in overlaps.overlapping_rows(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    report = overlaps.overlap_report(df).where("kind = 'same'").agg(F.sum("n_pairs")).first()[0]
    assert report == len(got)


def test_every_near_record_is_found(spark):
    """Against brute force over all pairs: copies, other values and times, and one or two ids with a typing error."""
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))

    def typo(x):
        k = rng.randrange(len(x))
        return x[:k] + rng.choice(["", rng.choice(letters), x[k] + rng.choice(letters)]) + x[k + 1 :]

    base = [(word(12), word(10), rng.choice([0, 1]), NOW + timedelta(seconds=k)) for k in range(300)]
    rows = [(k, "src", u, i, "train", r, t, 1, 1) for k, (u, i, r, t) in enumerate(base)]
    for k, (u, i, r, t) in enumerate(base):
        kind = k % 5
        u, i = typo(u) if kind in (1, 4) else u, typo(i) if kind in (2, 4) else i
        rows.append((1000 + k, "src", u, i, "test", 1 - r if kind == 3 else r, t + timedelta(days=9) if kind == 3 else t, 1, 1))
    sets = lambda x: {f"^{x}$"[k : k + 3] for k in range(len(x))}
    near = lambda x, y: len(sets(x) & sets(y)) / len(sets(x) | sets(y))
    value = lambda a, b: 0.4 * near(a[2], b[2]) + 0.4 * near(a[3], b[3]) + 0.15 * (a[6] == b[6]) + 0.05 * (a[5] == b[5])
    want = {(a[2], a[3], b[2], b[3]): round(value(a, b), 6) for a in rows[:300] for b in rows[300:] if value(a, b) >= overlaps.SIMILAR - 1e-9}
    found = {(r.user_key_a, r.item_key_a, r.user_key_b, r.item_key_b): r.similarity for r in overlaps.overlapping_classes(overlaps.record_rows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert all(want[k] == v for k, v in found.items())
    same = lambda x: {k for k in x if k[:2] == k[2:]}
    assert same(want) == same(found) and len(same(found)) >= 120
    one = {k for k in want if (k[0] == k[2]) != (k[1] == k[3])}
    assert len(one) > 80 and len(one & found.keys()) >= 0.98 * len(one)
    assert len(found) >= 0.9 * len(want)


@pytest.mark.parametrize("pairs_a_second", [0, 10_000])
def test_no_near_record_is_left_out(spark, monkeypatch, pairs_a_second):
    """Both ids written wrongly, long ids at another time or without one, and ids beyond the radius, against brute force."""
    monkeypatch.setattr(overlaps, "PAIRS_A_SECOND", pairs_a_second)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(n))

    def typo(x):
        k = rng.randrange(len(x))
        return x[:k] + rng.choice(["", "Z", x[k] + "Z"]) + x[k + 1 :]

    base = [(word(n), word(n), k % 2, NOW + timedelta(seconds=k // 25)) for k in range(100) for n in (12, 60)]
    rows = [(k, "src", u, i, "train", r, t, 1, 1) for k, (u, i, r, t) in enumerate(base)]
    for k, (u, i, r, t) in enumerate(base):
        kind = k // 2 % 4
        u, i = typo(u) if kind != 3 else u + u[:1], typo(i) if kind != 2 else i
        rows.append((1000 + k, "src", u, i, "test", r, [t, t + timedelta(days=9), None, t][kind], 1, 1))
    rows += [(5000, "src", "AAAA", "BBBBBB", "train", 0, None, 1, 1), (5001, "src", "AAAAAA", "BBBB", "val", 1, NOW, 1, 1)]  # other ids of equal shingles
    sets = lambda x: {f"^{x}$"[k : k + 3] for k in range(len(x))}
    near = lambda x, y: len(sets(x) & sets(y)) / len(sets(x) | sets(y))
    value = lambda a, b: 0.4 * near(a[2], b[2]) + 0.4 * near(a[3], b[3]) + 0.15 * (a[6] is not None and a[6] == b[6]) + 0.05 * (a[5] == b[5])
    want = {(a[2], a[3], b[2], b[3]): round(value(a, b), 6) for a in rows if a[4] == "train" for b in rows if b[4] != "train" and value(a, b) >= overlaps.SIMILAR - 1e-9}
    got = overlaps.overlapping_classes(overlaps.record_rows(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(want) > 70 and {(r.user_key_a, r.item_key_a, r.user_key_b, r.item_key_b): r.similarity for r in got} == want
    assert sum(k[0] != k[2] and k[1] != k[3] for k in want) > 30


def test_similar_ids_have_similar_codes():
    rng = random.Random(2)
    ids = ["".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(12)) for _ in range(200)]
    a, b = (overlaps.simhash(pd.Series(x)).to_numpy() for x in (ids, [x[:5] + "Z" + x[6:] for x in ids]))
    far = np.array([bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b])
    other = np.array([bin(int(x) & (2**64 - 1)).count("1") for x in a ^ np.roll(a, 1)])
    assert far.mean() < 20 and (far <= overlaps.RADIUS).mean() > 0.98 and other.mean() > 28
    odd = pd.Series([None, "A", "A" * 500_000, "A", ""])
    x = overlaps.simhash(odd)
    assert x[0] == 0 and x[1] == x[3] and len(x) == 5


def test_nothing(spark):
    assert overlaps.overlapping_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert overlaps.overlap_report(spark.createDataFrame([(1, "src", None, "i", "val", 1, None, 1, 1)], SCHEMA)).count() == 0

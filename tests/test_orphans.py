from datetime import datetime as D
import random

from pyspark.sql import functions as F
import pytest

from crossweave.operators import item_references, orphans, scale
from crossweave.operators.item_references import orphan_fields, orphan_records, orphan_references, orphan_report
from crossweave.operators.orphans import Edge, cascade, inherited_chains
from crossweave.plans import problems

RATING = "row_id long, userId string, itemId string, rating double, ts timestamp, ingested_at timestamp, batch_no int, dom string, ref string"


def _day(k):
    return None if k is None else D(2020, 1, 1 + k)


def _tables(spark, seed=0, empty=False):
    rng = random.Random(seed)
    item = lambda: rng.choice(["A1", " a1", "B2", "b-2", "C3", "D4", None, "na", "Ｅ５"])
    day = lambda: rng.choice([None, *range(10)])
    rating = lambda n: [(k, rng.choice(["u", "U ", "v", None]), item(), 1.0, _day(day()), None, 0, "x", "y") for k in range(n)]
    n = 0 if empty else 1
    rows = {
        "src_ratings": (rating(60 * n), RATING),
        "tgt_ratings": (rating(40 * n), RATING),
        "kg_paths": ([(k, item(), item(), _day(day())) for k in range(40 * n)], "path_id long, n1_asin string, n2_asin string, found_at timestamp"),
        "sim": ([(k, rng.choice([1, 2, 9, None]), rng.choice([1, 2, 9, None]), _day(day())) for k in range(40 * n)], "sim_id long, src_iid long, tgt_iid long, built_at timestamp"),
        "item_index": ([(rng.choice(["src", "tgt"]), item(), rng.choice([1, 2, 3, None]), _day(a), _day(rng.choice([None, a, 9 if a is None else min(9, a + 3)]))) for a in [day() for _ in range(14 * n)]], "dom string, itemId string, iid long, listed_at timestamp, removed_at timestamp"),
        "split_ratings": ([(k, rng.choice(["src", "tgt", None]), rng.choice(["u", "v", None]), item(), "train", _day(day())) for k in range(30 * n)], "row_id long, dom string, userId string, itemId string, split string, ts timestamp"),
        "documents": ([(k, rng.choice([None, k - 1, k - 2, 500]), _day(day())) for k in range(25 * n)], "doc_id long, parent_id long, posted_at timestamp"),
    }
    return {k: spark.createDataFrame(*v) for k, v in rows.items()}, {k: v[0] for k, v in rows.items()}


def _key(x):
    k = None if x is None else x.strip().upper().replace("-", "").replace("Ｅ５", "E5")
    return None if k in (None, "NA") else k


def _brute(t):
    def holds(dom, ref, at, number):
        for d, i, iid, a, b in t["item_index"]:
            if d == dom and (iid if number else _key(i)) == ref and (at is None or a is not None and a <= at and (b is None or at < b)):
                return True
        return False

    out = set()
    for name, field, dom, col, at, number in [("src_ratings", "itemId", "src", 2, 4, 0), ("tgt_ratings", "itemId", "tgt", 2, 4, 0), ("kg_paths", "n1_asin", "src", 1, 3, 0), ("kg_paths", "n2_asin", "tgt", 2, 3, 0), ("sim", "src_iid", "src", 1, 3, 1), ("sim", "tgt_iid", "tgt", 2, 3, 1)]:
        for r in t[name]:
            ref = r[col] if number else _key(r[col])
            if ref is not None and not holds(dom, ref, r[at], number):
                out.add((name, field, r[0]))
    return out


@pytest.mark.parametrize("seed,small,periods", [(0, True, 1000), (1, True, 0), (2, False, 1000), (3, True, 1), (4, False, 1)])
def test_direct(spark, monkeypatch, seed, small, periods):
    monkeypatch.setattr(orphans, "MAX_PERIODS", periods)
    monkeypatch.setattr(scale, "is_small", lambda df: small)
    frames, rows = _tables(spark, seed)
    got = [tuple(r) for r in orphan_references(frames).select("table_name", "field_name", "row_key").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    assert {tuple(r) for r in orphan_fields(frames, 0).select("table_name", "field_name", "row_key").collect()} == set(got)
    if seed not in (0, 3):
        return
    report = orphan_report(frames).collect()
    records = orphan_records(frames).where("table_name in ('documents', 'split_ratings')").collect()
    of = lambda c, mine: sum(r[c] for r in report if (r.table_name in ("documents", "split_ratings")) == mine)
    assert of("n_direct", False) == len(got) and of("n_inherited", False) == 0 and all(r.n_direct + r.n_inherited <= r.n_refs for r in report)
    assert of("n_direct", True) == sum(r.kind == "direct" for r in records) and of("n_inherited", True) == sum(r.kind == "inherited" for r in records)


def test_records_inherit(spark):
    frames, rows = _tables(spark, 3)
    got = {(r.table_name, r.row_key): (r.kind, r.depth) for r in orphan_records(frames).collect()}
    want = {(n, k): ("direct", 0) for n, _, k in _brute(rows)}
    there, depth = {k for k, *_ in rows["documents"]}, {}
    for k, p, _ in rows["documents"]:  # parents have lower ids
        if p is not None and p not in there:
            depth[k] = 0
        elif p in depth:
            depth[k] = depth[p] + 1
    want |= {("documents", k): ("inherited" if n else "direct", n) for k, n in depth.items()}
    for k, dom, u, i, *_ in rows["split_ratings"]:
        if dom and u and _key(i):
            name = f"{dom}_ratings"
            parents = [r[0] for r in rows[name] if r[1] and r[1].strip().lower() == u and _key(r[2]) == _key(i)]
            if parents and all((name, p) in want for p in parents):
                want["split_ratings", k] = ("inherited", 1)
    assert got == want


def test_found_walks_the_cascade(spark, monkeypatch):
    frames, rows = _tables(spark, 3)
    walked, cascade_ = [], item_references.cascade
    monkeypatch.setattr(item_references, "cascade", lambda direct, links, levels=None: walked.append((len(links), levels)) or cascade_(direct, links, levels))
    monkeypatch.setattr(problems, "_tables", lambda spark, d: frames)
    got = [tuple(r) for r in problems.p2_found(spark, "").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    assert walked == [(2, None)]  # all edges, to the fixpoint


def test_cycles_end(spark):
    docs = spark.createDataFrame([(1, 3, None), (2, 1, None), (3, 2, None), (4, 2, None)], "row_key long, link long, at timestamp")
    ids = docs.select("row_key", F.col("row_key").alias("link"))
    start = spark.createDataFrame([("d", "f", 2, None)], "table_name string, field_name string, row_key long, at timestamp")
    got = {r.row_key: r.depth for r in cascade(start, {Edge("d", "d"): (docs, ids)}).collect()}
    assert got == {2: 0, 3: 1, 4: 1, 1: 2}


@pytest.mark.parametrize("small", [False])
def test_deep_cascades_and_chains(spark, monkeypatch, small):
    monkeypatch.setattr(scale, "is_small", lambda df: small)
    monkeypatch.setattr(orphans, "LEVELS", 3)
    rng = random.Random(5)
    parent = {k: k - 1 if k % 40 else None for k in range(1, 161)}  # four chains of 40
    parent |= {k: rng.randint(1, 160) for k in range(161, 200)} | {300: 301, 301: 302, 302: 300, 303: 300, 304: 304, 305: 77_777}
    lost = {1, 60, 61, 199}
    want = {}
    for k in parent:
        seen, x, n = set(), k, 0
        while x is not None and x not in lost and x not in seen:
            seen.add(x)
            x, n = parent.get(x), n + 1
        if x in lost and n:
            want[k] = n
    rows = spark.createDataFrame([(k, p) for k, p in parent.items()] + [(None, 1)], "row_key long, link long")
    gone = spark.createDataFrame([(k,) for k in lost] + [(None,)], "row_key long")
    assert {r.row_key: r.depth for r in inherited_chains(rows, gone).collect()} == want and max(want.values()) >= 38
    assert inherited_chains(rows.limit(0), gone).count() == inherited_chains(rows, gone.limit(0)).count() == 0
    few = rows.where("row_key < 9").withColumn("at", F.lit(None).cast("timestamp"))
    start = gone.where("row_key = 1").select(F.lit("d").alias("table_name"), F.lit("f").alias("field_name"), "row_key", F.lit(None).cast("timestamp").alias("at"))
    x = cascade(start, {Edge("d", "d"): (few, few.select("row_key", F.col("row_key").alias("link")))})
    assert {r.row_key: r.depth for r in x.collect()} == {k: k - 1 for k in range(1, 9)}


def test_empty(spark):
    frames, _ = _tables(spark, 0, empty=True)
    assert orphan_references(frames).count() == orphan_report(frames).count() == orphan_records(frames).count() == 0

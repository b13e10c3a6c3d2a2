"""Same or near-same records across splits by similarity-hash fingerprints (problem 4).

A record is an interaction: user, item, rating and time. Its fingerprint has three segments of 64 bits: similarity hashes
of the character shingles of the user's and of the item's key (each bit the majority of the shingles' hash bits, so ids
that share most shingles share most bits), and a hash of the second of its time. Two records are candidates if two of
the three segments agree, which is an equality join on blocks of 128 bits, and if the third segment, when it is an id's,
lies within the Hamming distance RADIUS. Candidates are then verified on their texts: their similarity is 0.4 times the
Jaccard similarity of the users' shingles, plus the same of the items', plus 0.15 for one second and 0.05 for one rating.

* Records of one user and item always agree in two segments and have a similarity of 0.8 or more, whatever their time
  and rating: none is lost. They are 'same'.
* 'near' records are all others that reach 0.8. Those whose fingerprints don't meet (both ids written differently, another
  time, an id beyond the radius) are found by ``missed_pairs``, which is exact: such a similarity bounds how many shingles
  differ, so of one more parts of the shingles than that, one part is equal on both sides, and equal parts are joined.

Records of one split that are alike in all parts are one class until the end, so copies never meet row by row before the
match is verified. Blocks that only one side has are dropped before records travel, and blocks with many pairs are dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.functions.keys import with_keys
from crossweave.operators.scale import cut, lookup

RADIUS, SHINGLE, SIMILAR = 28, 3, 0.8
#: Pairs of one class or block that one task makes at most, about.
PAIRS_A_TASK = 2_000_000
PARTS = ["dom", "user_key", "item_key", "r", "second"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole numbers."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def simhash(ids: pd.Series) -> pd.Series:
    """The similarity hash of each id: bit b is set if it is in more than half of the id's shingles' hashes. A null id's is
    0. Ids of one length are hashed at once; memory is bounded for ids of any length."""
    out = np.zeros(len(ids), np.int64)
    raw = [None if x is None else b"^" + x.encode() + b"$" for x in ids]
    lengths = np.array([0 if x is None else len(x) for x in raw])
    for n in np.unique(lengths[lengths >= SHINGLE]):
        rows, wide = np.flatnonzero(lengths == n), int(n) - SHINGLE + 1
        step = max(1, 200_000 // wide)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            a = np.frombuffer(b"".join(raw[k] for k in part), np.uint8).reshape(len(part), n).astype(np.uint64)
            counts = np.zeros((len(part), 64), np.int64)
            for c in range(0, wide, 200_000):
                end = min(wide, c + 200_000)
                codes = sum(a[:, c + j : end + j] << np.uint64(8 * j) for j in range(SHINGLE))
                counts += np.unpackbits(_mixed(codes + np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(len(part), end - c, 8), axis=2).sum(1, dtype=np.int64)
            out[part] = np.packbits(2 * counts > wide, axis=1).view(np.int64)[:, 0]
    return pd.Series(out, index=ids.index)


def shingles(key: Column) -> Column:
    """The distinct character shingles of a key with its ends marked, as simhash takes them; none of an empty key."""
    text = F.concat(F.lit("^"), key, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key)), lambda k: F.substr(text, k, F.lit(SHINGLE))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two keys' shingles; 1 of equal keys."""
    x, y = shingles(a), shingles(b)
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def record_rows(df: DataFrame) -> DataFrame:
    """(row_id, dom, split, r, second, user_key, item_key) of the rows with a domain, split, user and item."""
    keep = [df["row_id"], df["dom"], df["split"], df["r"], F.unix_seconds(df["ts"].cast("timestamp")).alias("second")]
    x = with_keys(df, {"user_key": "userId", "item_key": "itemId"}, keep)
    return x.where("dom is not null and split is not null and user_key is not null and item_key is not null")


def record_classes(rows: DataFrame) -> DataFrame:
    """(*PARTS, split, n, fu, fi): records of one split that are alike in all parts as one row, with the ids' segments."""
    code = F.pandas_udf(simhash, "long")
    x = rows.groupBy(*PARTS, "split").agg(F.count(F.lit(1)).alias("n"))
    return x.withColumns({"fu": code("user_key"), "fi": code("item_key")})


def _blocks(classes: DataFrame) -> DataFrame:
    """classes with k and block: 0 both ids, 1 the user and the second, 2 the item and the second. Null seconds agree with
    none."""
    pair = lambda k, a, b: F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), "dom", a, b).alias("block"))
    all_ = F.array(pair(0, "fu", "fi"), pair(1, "fu", "second"), pair(2, "fi", "second"))
    found = F.when(F.col("second").isNull(), F.slice(all_, 1, 1)).otherwise(all_)
    return classes.select("*", F.explode(found).alias("_b")).select(*classes.columns, "_b.*")


def _meet(x: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs of rows of x (block, mine, *columns) of one block, a mine and a not mine: columns with the suffixes _a and
    _b. Blocks that only one side has are dropped first, and blocks with many pairs are dealt."""
    counts = x.groupBy("block").agg(F.count(F.when(F.col("mine"), 1)).alias("_t"), F.count(F.when(~F.col("mine"), 1)).alias("_h")).where("_t > 0 and _h > 0")
    live = cut(counts.select("block", F.ceil(F.col("_t") * F.col("_h") / PAIRS_A_TASK).cast("int").alias("parts")))
    x = lookup(x, live, ["block"])
    side = lambda df, s: df.select("block", "part", *[F.col(c).alias(f"{c}_{s}") for c in columns])
    a = side(x.where("mine").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "a")
    b = side(x.where("not mine").withColumn("part", F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int")), "b")
    return a.join(b, ["block", "part"])


CLASS = [*PARTS, "split", "n", "fu", "fi"]
#: Seconds with no more pairs than this are met as they are.
PAIRS_A_SECOND = 10_000
#: What the likest ids of records of one second have to share, and both ids of others: the most that time and rating add is
#: 0.2 and 0.05. Less a margin for rounding.
LIKE_ONE, LIKE_BOTH = (SIMILAR - 0.2) / 0.8 - 1e-4, (SIMILAR - 0.05) / 0.4 - 1 - 1e-4


def _by_fingerprint() -> tuple[Column, Column]:
    """The Hamming distance of two classes, and whether their fingerprints make them candidates."""
    far = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    distance = far("fu") + far("fi")
    second = F.coalesce(F.col("second_a") == F.col("second_b"), F.lit(False))
    return distance, (distance == 0) | (second & ((far("fu") == 0) | (far("fi") == 0)) & (distance <= RADIUS))


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """The pairs of classes (with mine) that two segments and the radius make candidates, with their distance."""
    met = _meet(_blocks(classes), [*CLASS, "k"]).where("dom_a = dom_b and k_a = k_b")
    distance, near = _by_fingerprint()
    met = met.withColumn("distance", distance)
    # a pair that agrees in several blocks counts in the first one only, in which all of it is decided
    first = F.when(F.col("distance") == 0, 0).when(F.col("fu_a") == F.col("fu_b"), 1).otherwise(2)
    return met.where((F.col("k_a") == first) & near).drop("block", "part", "k_a", "k_b")


def like_blocks(key: Column, least: float) -> Column:
    """Hashes of parts of the key's shingles, of which two keys with a Jaccard similarity of ``least`` or more have one in
    common: 2 n (1 - least) / (1 + least) shingles differ at most, n being those of the longer key, and the shingles are
    cut into one part more by hash. A key has the parts for its own n and for the longer ones that it may meet."""
    x = shingles(key)
    parts = lambda n: (F.floor(n * (2 * (1 - least) / (1 + least))) + 1).cast("int")
    part = lambda m, j: F.xxhash64(m, j, F.sort_array(F.filter(x, lambda s: F.pmod(F.hash(s), m) == j)))
    every = F.sequence(parts(F.size(x)), parts(F.floor(F.size(x) / least)))
    return F.flatten(F.transform(every, lambda m: F.transform(F.sequence(F.lit(0), m - 1), lambda j: part(m, j))))


def _met_once(x: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs of rows of x (blocks, mine, *columns) with a block in common, each once."""
    met = _meet(x.withColumn("blocks", F.array_distinct("blocks")).withColumn("block", F.explode("blocks")), [*columns, "blocks"])
    return met.where(F.col("block") == F.array_min(F.array_intersect("blocks_a", "blocks_b"))).drop("block", "part", "blocks_a", "blocks_b")


def _like_keys(classes: DataFrame, c: str) -> DataFrame:
    """(dom, c, likes): of the held-out keys with such, the other train keys that are as like as LIKE_BOTH."""
    keys = classes.select("dom", F.col(c).alias("key"), "mine").distinct()
    salted = F.transform(like_blocks(F.col("key"), LIKE_BOTH), lambda h: F.xxhash64("dom", h))
    met = _met_once(cut(keys.withColumn("blocks", salted)), ["dom", "key"])
    met = met.where((F.col("dom_a") == F.col("dom_b")) & (F.col("key_a") != F.col("key_b"))).where(jaccard(F.col("key_a"), F.col("key_b")) >= LIKE_BOTH)
    return met.groupBy(F.col("dom_b").alias("dom"), F.col("key_b").alias(c)).agg(F.collect_set("key_a").alias(f"{c}_likes"))


def missed_pairs(classes: DataFrame) -> DataFrame:
    """The pairs of classes (with mine) that may reach SIMILAR though their fingerprints don't make them candidates.

    Of one second: the likest ids agree in a part of their shingles, see like_blocks; seconds with few pairs need no parts.
    Of other seconds: both ids are the same or very like, so held-out classes look for train classes under the ids that
    are like theirs."""
    timed = classes.where("second is not null")
    count = lambda mine: F.count(F.when(F.col("mine") == mine, 1))
    seconds = timed.groupBy("dom", "second").agg(count(True).alias("_t"), count(False).alias("_h")).where("_t > 0 and _h > 0")
    timed = cut(lookup(timed, cut(seconds.select("dom", "second", (F.col("_t") * F.col("_h") > PAIRS_A_SECOND).alias("_many"))), ["dom", "second"]))
    of = lambda k, *ids: F.xxhash64(F.lit(k), "dom", *ids)
    each = lambda k, c: F.transform(like_blocks(F.col(c), LIKE_ONE), lambda h: of(k, "second", h))
    blocks = F.when(F.col("_many"), F.concat(each(0, "user_key"), each(1, "item_key"))).otherwise(F.array(of(2, "second")))
    found = _met_once(timed.withColumn("blocks", blocks), CLASS).where("second_a = second_b")

    likes = {c: cut(_like_keys(classes, c)) for c in ("user_key", "item_key")}
    if not all(x.isEmpty() for x in likes.values()):
        found = found.unionByName(_other_seconds(classes, likes))
    distance, near = _by_fingerprint()
    return found.where("dom_a = dom_b").withColumn("distance", distance).where(~near)


def _other_seconds(classes: DataFrame, likes: dict[str, DataFrame]) -> DataFrame:
    """The pairs of classes of other seconds, or without, whose ids are the same or one of each other's likes."""
    held = classes.where("not mine")
    for c, x in likes.items():
        held = lookup(held, x, ["dom", c], "left")
    of = lambda *ids: F.xxhash64("dom", *ids)
    both = lambda c: F.concat(F.array(c), F.coalesce(f"{c}_likes", F.array().cast("array<string>")))
    held = held.where("user_key_likes is not null or item_key_likes is not null")
    held = held.withColumn("blocks", F.flatten(F.transform(both("user_key"), lambda u: F.transform(both("item_key"), lambda i: of(u, i))))).select(*CLASS, "mine", "blocks")
    train = classes.where("mine").select(*CLASS, "mine", F.array(of("user_key", "item_key")).alias("blocks"))
    return _met_once(train.unionByName(held), CLASS).where("second_a is null or second_b is null or second_a != second_b")


def overlapping_classes(rows: DataFrame, train: str = "train", held_out: tuple[str, ...] = ("val", "test"), near: bool = True) -> DataFrame:
    """(dom, split, kind, similarity, distance, n_train, n_held, and user_key, item_key, r, second of both sides with the
    suffixes _a for train and _b): all pairs of a train class and a held-out class that are the same or nearly. Without
    ``near`` all that are the same, none of which fingerprints miss. The classes with their codes, and the blocks that both
    sides have, are checkpointed."""
    classes = cut(record_classes(rows)).withColumn("mine", F.col("split") == train).where(F.col("mine") | F.col("split").isin(*held_out))
    met = fingerprint_pairs(classes)
    if near:
        met = met.unionByName(missed_pairs(classes))
    value = 0.4 * jaccard(F.col("user_key_a"), F.col("user_key_b")) + 0.4 * jaccard(F.col("item_key_a"), F.col("item_key_b"))
    value = value + F.when(F.col("second_a") == F.col("second_b"), 0.15).otherwise(0.0) + F.when(F.col("r_a") == F.col("r_b"), 0.05).otherwise(0.0)
    same = (F.col("user_key_a") == F.col("user_key_b")) & (F.col("item_key_a") == F.col("item_key_b"))
    met = met.withColumns({"similarity": F.round(value, 6), "kind": F.when(same, "same").otherwise("near")})
    met = met.where((F.col("similarity") >= SIMILAR) if near else same)
    both = [f"{c}_{s}" for s in "ab" for c in ("user_key", "item_key", "r", "second")]
    return met.select(F.col("dom_a").alias("dom"), F.col("split_b").alias("split"), "kind", "similarity", "distance", F.col("n_a").alias("n_train"), F.col("n_b").alias("n_held"), *both)


def overlap_report(df: DataFrame) -> DataFrame:
    """(dom, split, kind, n_records, n_rows, n_pairs, least_similarity): distinct (user, item) of a held-out split that are in
    train too, the same or nearly, its rows that hold them, and the pairs of rows. Needs no pair of rows to be written."""
    held = ["dom", "split", "kind", "user_key_b", "item_key_b"]
    x = overlapping_classes(record_rows(df)).groupBy(*held, "r_b", "second_b").agg(F.max("n_held").alias("n"), F.sum(F.col("n_train") * F.col("n_held")).alias("p"), F.min("similarity").alias("s"))
    x = x.groupBy(*held).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.min("s").alias("s"))
    return x.groupBy("dom", "split", "kind").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("n_rows"), F.sum("p").alias("n_pairs"), F.min("s").alias("least_similarity"))


def overlapping_rows(df: DataFrame) -> DataFrame:
    """(row_a, row_b), row_a < row_b: each pair of a train and a held-out row that are the same interaction: the operator's
    classes of the kind 'same', an exact check of the keys. An interaction with many pairs is split: its held-out rows are
    dealt to parts, and its train rows go to each part."""
    rows = record_rows(df).select("row_id", "dom", "split", "user_key", "item_key")
    link = ["dom", "user_key", "item_key"]
    same = overlapping_classes(record_rows(df), near=False)
    found = same.groupBy("dom", F.col("user_key_a").alias("user_key"), F.col("item_key_a").alias("item_key")).agg(F.sum(F.col("n_train") * F.col("n_held")).alias("pairs"))
    parts = cut(found.select(*link, F.ceil(F.col("pairs") / PAIRS_A_TASK).cast("int").alias("parts")))
    own = lookup(rows, parts, link)
    train = own.where(F.col("split") == "train").select(*link, F.col("row_id").alias("t"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = own.where(F.col("split").isin("val", "test")).select(*link, F.col("row_id").alias("h"), F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"))
    pairs = train.join(held, [*link, "part"])
    return pairs.select(F.least("t", "h").alias("row_a"), F.greatest("t", "h").alias("row_b"))

"""Items that appear together (problem 1).

Counts are exact. A basket is the set of items of one user. Of baskets of all sizes only those are spelt out as pairs
that have to be:

* with a least count c, a pair lies together in at least one basket outside the c - 1 largest ones. So the c - 1
  largest baskets are never spelt out: every item carries a mask of which of them hold it, and a pair found elsewhere
  gets the number of common mask bits added. With c = 12 one basket with a third of all records costs a bit.
* an item in fewer than c baskets is in no such pair; with a least lift f, neither is one in more than N / f.
* other baskets are cut into cells of at most about CELL x CELL items that tasks share out, however large the basket.

The null model is the bipartite configuration model, fitted to both degree sequences: user u holds item i with
probability x_u y_i / (1 + x_u y_i), where expected degrees equal the observed ones. Under it the count of a pair is a
Poisson-binomial variable; its upper tail gives the surprise, and Benjamini-Hochberg over all pairs of eligible items
the false-discovery rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.functions.keys import with_keys
from crossweave.operators.scale import cut, lookup, running_total

CELL = 512
#: Degrees up to EXACT are classes of their own; above, classes are 1 % wide. So the histogram of degrees that the
#: driver sees has at most EXACT + 100 * ln(largest degree / EXACT) rows, about 2,500 for 10**12 records.
EXACT, WIDTH = 256, 0.01
#: Kinds of pairs whose tails are computed at once.
TRIPLES = 512
#: Relative distance of fitted degrees beyond which a null counts as not converged.
GAP = 1e-3
#: Codes below this fit two to a long; more items than that are paired as two longs.
PACKED = 1 << 31


def baskets(df: DataFrame, user: str = "userId", item: str = "itemId") -> DataFrame:
    """Distinct (user_key, item_key); rows with an absent user or item don't count."""
    return with_keys(df, {"user_key": user, "item_key": item}).where("user_key is not null and item_key is not null").distinct()


def _class(n):
    """Class of a degree as a column: the degree up to EXACT, then a logarithmic bin."""
    log = F.floor(F.log(n.cast("double") / EXACT) / WIDTH)
    return F.when(n <= EXACT, n).otherwise(F.lit(EXACT + 1) + log).cast("long")


@dataclass(frozen=True)
class Null:
    """A fitted bipartite configuration model on classes of degrees. user_count users have the parameter x each, an
    item of class k the parameter y[k]. gap is the largest relative distance between a fitted and an observed degree."""

    user_count: np.ndarray
    x: np.ndarray
    item_class: np.ndarray
    y: np.ndarray
    gap: float = 0.0


def fit_null(user_count, user_degree, item_class, item_count, item_degree, rounds: int = 2000, tolerance: float = 1e-9) -> Null:
    """Fixed-point iteration for the maximum-likelihood parameters; degrees are class means. Warns if the fitted degrees
    are still further than GAP from the observed ones after the last round; they are named in the result."""
    nu, du = np.asarray(user_count, float), np.asarray(user_degree, float)
    ni, di = np.asarray(item_count, float), np.asarray(item_degree, float)
    if not len(nu):
        return Null(nu, du, np.asarray(item_class), di)
    du, di = np.minimum(du, ni.sum() - 1e-6), np.minimum(di, nu.sum() - 1e-6)  # a full row has an infinite parameter
    edges = (nu * du).sum()
    x, y = du / np.sqrt(edges), di / np.sqrt(edges)
    for _ in range(rounds):
        x_new = du / ((ni * y)[None, :] / (1 + x[:, None] * y[None, :])).sum(1)
        y_new = di / ((nu * x_new)[:, None] / (1 + x_new[:, None] * y[None, :])).sum(0)
        moved = max(np.abs(x_new / x - 1).max(), np.abs(y_new / y - 1).max())
        x, y = x_new, y_new
        if moved < tolerance:
            break
    held = x[:, None] * y[None, :] / (1 + x[:, None] * y[None, :])
    gap = float(max(np.abs(held @ ni / du - 1).max(), np.abs(nu @ held / di - 1).max()))
    if not gap <= GAP:
        warnings.warn(f"the null's degrees are off by up to {gap:.2g} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return Null(nu, x, np.asarray(item_class), y, gap)


def tails(q: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, log10 P(X >= n)) for each row k of q, X being the sum over the columns j of Binomial(m[j], q[k, j]).

    Saddle point with the Lugannani-Rice formula and its continuity correction for lattice variables; the relative
    error is a few percent at n = 1 and falls with n. Far tails are computed in logs, so they don't vanish."""
    n = np.asarray(n, float)
    mean, top = q @ m, (q > 0) @ m
    out = np.zeros(len(n))
    out[n > top] = -np.inf
    full = (n == top) & (n > 0)
    if full.any():
        out[full] = np.log10(np.clip(q[full], 1e-300, 1)) @ m
    rows = np.flatnonzero((n > 0) & (n < top))
    if not len(rows):
        return mean, out
    q, n = np.clip(q[rows], 1e-300, 1 - 1e-12), n[rows]
    mu = q @ m
    s = np.clip(np.log(n / mu), -500, 500)
    lo, hi = np.full(len(n), -700.0), np.full(len(n), 700.0)
    odds = q / (1 - q)
    for _ in range(200):  # Newton, kept inside a bracket: the mean under the tilt s has to be n
        t = odds * np.exp(np.minimum(s, 600.0))[:, None]
        p = t / (1 + t)
        gap, variance = p @ m - n, (p * (1 - p)) @ m
        lo, hi = np.where(gap < 0, s, lo), np.where(gap < 0, hi, s)
        if (np.abs(gap) <= 1e-10 * n).all():
            break
        step = s - gap / np.maximum(variance, 1e-300)
        step = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        s = np.where(np.abs(gap) <= 1e-10 * n, s, step)
    k = np.log1p(q * np.expm1(np.minimum(s, 600.0))[:, None]) @ m
    near = np.abs(s) < 1e-4  # at the mean the formula has a limit
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * n - k), 1e-300))
    u = -np.expm1(-s) * np.sqrt(variance)
    with np.errstate(all="ignore"):
        mills = 1 / w - 1 / w**3 + 3 / w**5 - 15 / w**7
        far = -w * w / 2 - 0.5 * np.log(2 * np.pi) + np.log(np.maximum(mills + 1 / u - 1 / w, 1e-300))
        z = np.where(near, (n - 0.5 - mu) / np.sqrt(variance), w)
        tail = 0.5 * _erfc(z / np.sqrt(2)) + np.where(near, 0.0, np.exp(-w * w / 2) / np.sqrt(2 * np.pi) * (1 / u - 1 / w))
        log = np.where(~near & (w > 5), far, np.log(np.clip(tail, 1e-300, 1)))
    out[rows] = np.minimum(log, 0) / np.log(10)
    return mean, out


def _erfc(x: np.ndarray) -> np.ndarray:
    from math import erfc

    return np.array([erfc(v) for v in x])


def _degrees(df: DataFrame, key: str) -> tuple[DataFrame, pd.DataFrame]:
    """(key, n, cls) and its histogram by class, which is bounded (see EXACT)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("cls", _class(F.col("n")))
    return sizes, sizes.groupBy("cls").agg(F.count(F.lit(1)).alias("c"), F.avg("n").alias("d")).orderBy("cls").toPandas()


def item_pairs(df: DataFrame, user: str = "userId", item: str = "itemId", min_count: int = 12, min_lift: float | None = None) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, expected, surprise, q_value) of every pair of item keys
    item_a < item_b that at least min_count baskets hold both of and, if min_lift is given, that is found at least so
    many times more often than chance (lift = n_ab * n_baskets / (n_a * n_b)).

    expected and surprise (-log10 of the upper tail) come from the configuration null; q_value is Benjamini-Hochberg
    over all pairs of items in at least min_count baskets, conservative as pairs below min_count aren't ranked.
    An empty table gives no rows. Runs jobs for both histograms, the largest baskets and the q-values; baskets and
    pairs are checkpointed once each. df may have any other columns."""
    if min_count < 1:
        raise ValueError("min_count has to be 1 or more")
    spark = df.sparkSession
    members = cut(baskets(df, user, item))
    users, user_hist = _degrees(members, "user_key")
    items, item_hist = _degrees(members, "item_key")
    n_baskets, n_items = int(user_hist["c"].sum()), int(item_hist["c"].sum())
    null = fit_null(user_hist["c"], user_hist["d"], item_hist["cls"], item_hist["c"], item_hist["d"])

    eligible = items.where(F.col("n") >= min_count)
    if min_lift is not None:  # n_ab <= the smaller of n_a and n_b, so the larger one is at most N / min_lift
        eligible = eligible.where(F.col("n") * F.lit(float(min_lift)) <= F.lit(float(n_baskets)))
    heavy = [r["user_key"] for r in users.orderBy(F.desc("n"), "user_key").limit(min(min_count - 1, 63)).collect()]
    big = spark.createDataFrame([(u, 1 << i) for i, u in enumerate(heavy)], "user_key string, bit long")  # 63 rows at most
    big, small = F.broadcast(big), members.join(F.broadcast(big), "user_key", "left_anti")

    masks = members.join(big, "user_key").groupBy("item_key").agg(F.bit_or("bit").alias("mask"))
    # codes go up with the number of mask bits, so that a code tells it and a pair can be judged before its items are joined
    eligible = eligible.join(masks, "item_key", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    eligible = eligible.withColumns({"bits": F.bit_count("mask"), "h": F.md5("item_key")})
    coded = running_total(eligible, [], ["bits"], "h", ["item_key"], F.lit(1), "code")
    coded = cut(coded.select("item_key", "code", "n", "cls", "mask", "bits"))
    levels = coded.where("bits > 0").groupBy("bits").agg(F.min("code").alias("start")).orderBy("bits").collect()  # 63 rows at most

    codes = coded.select("item_key", "code")
    light = lookup(small, codes, ["item_key"]).select("user_key", "code")
    sized = light.groupBy("user_key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = lookup(light, sized.select("user_key", F.ceil(F.col("m") / CELL).cast("int").alias("cells")), ["user_key"])
    mine = F.pmod(F.xxhash64("code"), F.col("cells")).cast("int")
    rows = rows.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    cells = rows.groupBy("user_key", "lo", "hi").agg(
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("lo"), F.col("code")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("hi"), F.col("code")))).alias("b"),
    )
    if n_items < PACKED:
        pack = lambda x, y: F.shiftleft(F.least(x, y), 31).bitwiseOR(F.greatest(x, y))
        lower, higher = F.shiftright("ab", 31), F.col("ab").bitwiseAND(PACKED - 1)
    else:
        pack = lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
        lower, higher = F.col("ab.x"), F.col("ab.y")
    inside = F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.greatest(F.size("a"), F.lit(1))), lambda y: pack(x, y)))
    across = F.transform("a", lambda x: F.transform("b", lambda y: pack(x, y)))
    spelt = cells.select(F.explode(F.flatten(F.when(F.col("lo") == F.col("hi"), inside).otherwise(across))).alias("ab"))
    counted = spelt.groupBy("ab").agg(F.count(F.lit(1)).alias("n_light"))

    # a pair has at most as many common mask bits as its item with fewer, and the lower code has fewer
    upper = F.lit(0)
    for level in levels:
        upper = F.when(lower >= level["start"], F.lit(level["bits"])).otherwise(upper)
    counted = counted.where(F.col("n_light") + upper >= min_count)
    side = lambda s: coded.select(F.col("code").alias(f"code_{s}"), F.col("item_key").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"), F.col("cls").alias(f"cls_{s}"), F.col("mask").alias(f"mask_{s}"))
    split = counted.select(lower.alias("code_a"), higher.alias("code_b"), "n_light")
    pairs = lookup(lookup(split, side("a"), ["code_a"], spread=F.xxhash64("code_b")), side("b"), ["code_b"], spread=F.xxhash64("code_a"))
    pairs = pairs.withColumn("n_ab", F.col("n_light") + F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b")))).where(F.col("n_ab") >= min_count)
    if min_lift is not None:
        pairs = pairs.where(reaches(min_lift, n_baskets))
    swap = F.col("item_a") > F.col("item_b")
    pick = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c))
    pairs = pairs.select(
        pick("item_a", "item_b").alias("item_a"), pick("item_b", "item_a").alias("item_b"), "n_ab",
        pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), F.least("cls_a", "cls_b").alias("lo"), F.greatest("cls_a", "cls_b").alias("hi"),
    )
    pairs = cut(pairs)

    def surprise(batches):
        held = [null.x * y / (1 + null.x * y) for y in null.y]
        where = {int(c): k for k, c in enumerate(null.item_class)}
        for b in batches:
            for at in range(0, len(b), TRIPLES):
                part = b.iloc[at : at + TRIPLES]
                q = np.stack([held[where[lo]] * held[where[hi]] for lo, hi in zip(part["lo"], part["hi"])])
                mean, log10 = tails(q, null.user_count, part["n_ab"].to_numpy())
                yield part.assign(expected=mean.round(6), surprise=np.maximum(0.0, -log10).round(4))

    kinds = pairs.select("lo", "hi", "n_ab").distinct()
    scored = kinds.mapInPandas(surprise, "lo long, hi long, n_ab long, expected double, surprise double")
    pairs = lookup(pairs, cut(scored), ["lo", "hi", "n_ab"], spread=F.xxhash64("item_a", "item_b"))
    tested = int(item_hist.loc[item_hist["d"] >= min_count, "c"].sum())
    return with_q_values(pairs, tested * (tested - 1) / 2).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"),
        F.round(F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b")), 6).alias("lift"), "expected", "surprise", "q_value",
    )


def reaches(lift: float, n_baskets: int):
    """n_ab * n_baskets >= lift * n_a * n_b, in whole numbers of up to 38 digits where lift is one."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    if float(lift).is_integer():
        return exact("n_ab") * F.lit(n_baskets).cast("decimal(19,0)") >= exact("n_a") * exact("n_b") * F.lit(int(lift))
    return F.col("n_ab") * F.lit(float(n_baskets)) >= F.lit(float(lift)) * F.col("n_a") * F.col("n_b")


def with_q_values(pairs: DataFrame, tests: float) -> DataFrame:
    """Adds q_value = min over all surprises s <= own of tests * 10**-s / (rows with at least s), at most 1.

    The surprise is taken down to two places (conservative) and at most 320, so the table that the window runs over
    has at most 32,001 rows, whatever the number of pairs."""
    x = pairs.withColumn("_s", F.floor(F.least(F.col("surprise"), F.lit(320.0)) * 100).cast("long"))
    steps = x.groupBy("_s").agg(F.count(F.lit(1)).alias("c"))
    down = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    raw = steps.withColumn("_r", F.lit(float(max(tests, 1.0))) * F.pow(F.lit(10.0), -F.col("_s") / 100) / F.sum("c").over(down))
    q = raw.select("_s", F.least(F.lit(1.0), F.min("_r").over(up)).alias("q_value"))
    return x.join(F.broadcast(q), "_s").drop("_s")


def found_pairs(df: DataFrame, min_count: int = 12, lift: int = 20, max_q: float = 1.0) -> DataFrame:
    """(item_a, item_b) of item_pairs with n_ab >= min_count, n_ab * n_baskets >= lift * n_a * n_b, in whole numbers, and a
    false-discovery rate under the fitted null of at most max_q."""
    return item_pairs(df, min_count=min_count, min_lift=lift).where(F.col("q_value") <= max_q).select("item_a", "item_b")

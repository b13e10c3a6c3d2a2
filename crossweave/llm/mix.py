"""Mixing sources to target weights along a time-varying curriculum (problem 9).

The size of the mixture is found first: targets are renormalised over the sources that have documents, and the total is
the largest at which the shares, with every source capped by its repeats, are off the targets by no more than a stated
total variation. Each source then has a demand of tokens, and its documents, in a fixed order that a hash gives, supply
it: a document's copy r starts where r whole passes and the documents before it end. The source's weight schedule over
training time is integrated; a copy that starts at the fraction y of the demand is due at the time at which the integral
reaches y. Sorting by that position mixes the sources as the schedules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.encode import token_counts
from crossweave.operators.scale import cut, lookup, running_total

#: Total variation between reached and target shares that the default total allows.
TOLERANCE = 0.02
#: Totals that one job tries, and rounds of ever closer ones.
GRID, ROUNDS = 32, 4

Knots = list[tuple[float, float]]
PIECES = "array<struct<y0:double,y1:double,t0:double,w0:double,slope:double>>"
# Fixed values, the usual schedules: sources that may be repeated, which are the small ones, rise from half to one and a
# half of their mean weight, so that their repetitions come late; the others stay level.
RISING, LEVEL = [(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.0), (1.0, 1.0)]


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(y0, y1, t0, w0, slope) of each piece of a piecewise-linear schedule over [0, 1], scaled to the integral 1."""
    ks = sorted(knots)
    if len(ks) < 2 or ks[0][0] != 0 or ks[-1][0] != 1 or any(w < 0 for _, w in ks):
        raise ValueError("a schedule needs knots from 0 to 1 and no negative weight")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(ks, ks[1:]))
    if area <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    out, y = [], 0.0
    for (t0, w0), (t1, w1) in zip(ks, ks[1:]):
        if t1 <= t0:
            continue
        step = (t1 - t0) * (w0 + w1) / 2 / area
        out.append((y, y + step, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        y += step
    return out


def _pieces(knots) -> Column:
    names = ("y0", "y1", "t0", "w0", "slope")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, s)]) for s in segments(knots)])


def largest_total(plan: DataFrame, tolerance: float) -> float:
    """The largest total T of plan (target, cap), both above 0 and the targets' sum 1, at which taking least(target * T, cap)
    tokens of each source gives shares whose total variation from the targets is at most tolerance; 0 without sources. At
    the least cap / target of all sources shares are exact, at the greatest all sources are used up: the total is sought
    between these, by jobs that try GRID totals each, down to their distance / GRID ** ROUNDS."""
    low, high = plan.agg(F.min(F.col("cap") / F.col("target")), F.max(F.col("cap") / F.col("target"))).first()
    if low is None:
        return 0.0
    for _ in range(ROUNDS):
        if high <= low:
            break
        grid = [low + (high - low) * k / GRID for k in range(1, GRID + 1)]
        x = plan.select("target", "cap", F.explode(F.array(*map(F.lit, grid))).alias("t")).withColumn("d", F.least(F.col("target") * F.col("t"), F.col("cap")))
        sums = F.broadcast(x.groupBy("t").agg(F.sum("d").alias("all")))  # GRID rows
        off = x.join(sums, "t").groupBy("t").agg(F.sum(F.greatest(F.col("d") / F.col("all") - F.col("target"), F.lit(0.0))).alias("off"))
        best = off.where(F.col("off") <= tolerance).agg(F.max("t")).first()[0]
        step = (high - low) / GRID
        low, high = (low, low + step) if best is None else (best, min(high, best + step))
    return low


def source_plan(sized: DataFrame, targets: DataFrame, total: int | None, tolerance: float, schedules: dict[str, Knots]) -> DataFrame:
    """(source, weight, target, max_repeat, available, demand, pieces) of every target source: target is the weight
    renormalised over the sources that have tokens (0 for the others), demand the tokens that the mixture is to take. One
    row for each target, whose number has no bound: it never goes through the driver."""
    t = targets.where("source is not null and weight > 0 and not isnan(weight) and max_repeat > 0").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    x = t.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("n")), "source", "left").withColumn("available", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    usable = x.where("available > 0").agg(F.sum("weight").alias("w"))
    x = cut(x.withColumn("target", F.when(F.col("available") > 0, F.col("weight") / usable.scalar()).otherwise(0.0)).withColumn("cap", F.col("max_repeat") * F.col("available")))
    size = largest_total(x.where("target > 0").select("target", F.col("cap").cast("double").alias("cap")), tolerance) if total is None else float(total)
    demand = F.least(F.floor(F.col("target") * F.lit(size) + F.lit(1e-6)).cast("long"), F.col("cap"))
    pieces = F.when(F.col("max_repeat") > 1, _pieces(RISING)).otherwise(_pieces(LEVEL))
    for name, knots in schedules.items():
        pieces = F.when(F.col("source") == name, _pieces(knots)).otherwise(pieces)
    return x.select("source", "weight", "target", "max_repeat", "available", demand.alias("demand"), pieces.cast(PIECES).alias("pieces"))


def mixed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(position, source, doc_id, copy, n_tokens) of sized documents (source, doc_id, n_tokens) by a source_plan."""
    table = plan.where("demand > 0").select("source", "available", "demand", "pieces")
    hashed = sized.withColumn("_h", F.md5(F.col("doc_id").cast("string")))
    placed = running_total(hashed, ["source"], [], "_h", ["doc_id"], F.col("n_tokens"), "before")
    x = lookup(placed, table, ["source"]).where("before < demand")
    passes = F.floor((F.col("demand") - 1 - F.col("before")) / F.col("available")).cast("int")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(0), passes)))
    x = x.withColumn("y", (F.col("copy") * F.col("available") + F.col("before")) / F.col("demand"))
    x = x.withColumn("p", F.element_at(F.filter("pieces", lambda p: (p["y1"] > F.col("y")) | (p["y1"] >= 1 - 1e-9)), 1))
    rest = F.greatest(F.col("y") - F.col("p.y0"), F.lit(0.0))
    root = F.sqrt(F.greatest(F.col("p.w0") * F.col("p.w0") + 2 * F.col("p.slope") * rest, F.lit(0.0)))
    at = F.col("p.t0") + F.coalesce(F.try_divide(2 * rest, F.col("p.w0") + root), F.lit(0.0))
    return x.select(F.least(at, F.lit(1.0)).alias("position"), "source", "doc_id", "copy", "n_tokens")


def _sized(documents: DataFrame, targets: DataFrame, path: str | None) -> DataFrame:
    names = targets.select("source").where("source is not null").distinct()
    mine = lookup(documents.select("doc_id", "source", "text"), names, ["source"], "left_semi", F.xxhash64("doc_id"))
    return cut(token_counts(mine, ["doc_id", "source"], path).where("n_tokens > 0"))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, schedules: dict[str, Knots] | None = None, path: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(position, source, doc_id, copy, n_tokens), sorted by position in [0, 1]: the mixture in training order.

    The total is the largest within ``tolerance`` of the targets (total variation), or ``total`` tokens, of which sources
    give what their repeats allow. Documents of a null source, or of one that isn't in targets, and those without tokens
    (empty and null texts) aren't part of it; neither are targets without weight, repeats or documents, whose weight the
    others share. A source's last document may exceed its demand by less than its own length; no document has more than
    max_repeat copies. Sizes are counted once and checkpointed. A source with most of the rows is summed up in hash
    ranges, see running_total."""
    sized = _sized(documents, targets, path)
    return mixed(sized, source_plan(sized, targets, total, tolerance, schedules or {})).orderBy("position", "source", "doc_id", "copy")


def mix_report(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, weight, target_share, max_repeat, available_tokens, demand_tokens, n_rows, most_copies, mixed_tokens, share,
    total_variation): what each target source really reached, 0 for sources without documents; total_variation is half
    the sum of all distances between share and target_share, the same in each row."""
    sized = _sized(documents, targets, path)
    plan = cut(source_plan(sized, targets, total, tolerance, {}))
    got = mixed(sized, plan).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.max("copy").alias("c"), F.sum("n_tokens").alias("t"))
    x = cut(plan.join(got, "source", "left").selectExpr(
        "source", "weight", "round(target, 6) as target_share", "max_repeat", "available as available_tokens", "demand as demand_tokens",
        "coalesce(n_rows, 0) as n_rows", "coalesce(c + 1, 0) as most_copies", "coalesce(t, 0) as mixed_tokens",
    ))
    all_ = x.agg(F.sum("mixed_tokens").alias("n"))
    x = x.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("mixed_tokens"), all_.scalar()), F.lit(0.0)), 6))
    off = x.agg(F.round(F.sum(F.abs(F.col("share") - F.col("target_share"))) / 2, 6).alias("v"))
    return x.withColumn("total_variation", off.scalar()).orderBy("source")

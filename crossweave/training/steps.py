"""One distributed training step, and the loop around it.

The score difference of a triple (user, positive, negative) is d = p_u . (q_pos - q_neg) + b_pos - b_neg: user and
global biases cancel. A step joins triples with factors, forms each triple's coefficient dL/dd in column expressions
and sums the gradients by entity, combined on the map side. Parameters never leave the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.operators import logic
from crossweave.operators.scale import cut, lookup
from crossweave.operators.scoring import dot, sigmoid

# The usual settings of Adam.
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8


#: Whether the users' and the items' factors are small enough to be broadcast; None measures them at each step.
Small = tuple[bool, bool] | None


def with_differences(triples: DataFrame, users: DataFrame, items: DataFrame, small: Small = None) -> DataFrame:
    """triples (uid, pos_iid, neg_iid) with vectors pu, qd = q_pos - q_neg and d."""
    of_users, of_items = small or (None, None)
    x = lookup(triples.select("uid", "pos_iid", "neg_iid"), users.select("uid", F.col("v").alias("pu")), ["uid"], small=of_users)
    side = lambda s: items.select(F.col("iid").alias(f"{s}_iid"), F.col("v").alias(f"q_{s}"), F.col("b").alias(f"b_{s}"))
    x = lookup(lookup(x, side("pos"), ["pos_iid"], small=of_items), side("neg"), ["neg_iid"], small=of_items)
    x = x.withColumn("qd", F.zip_with("q_pos", "q_neg", lambda a, b: a.cast("double") - b.cast("double")))
    return x.withColumn("d", dot(F.col("pu"), F.col("qd")) + F.col("b_pos") - F.col("b_neg")).select("uid", "pos_iid", "neg_iid", "pu", "qd", "d")


def gradients(x: DataFrame, k: int) -> DataFrame:
    """(entity, id, g ARRAY<DOUBLE>): sums over the triples of x, which has the coefficient c = dL/dd; of items the last
    element is the bias."""
    scaled = lambda v, c, last: F.concat(F.transform(v, lambda a: a.cast("double") * c), F.array(last))
    c, none = F.col("c"), F.lit(0.0)
    rows = F.explode(F.array(
        F.struct(F.lit("user").alias("entity"), F.col("uid").alias("id"), scaled(F.col("qd"), c, none).alias("g")),
        F.struct(F.lit("item").alias("entity"), F.col("pos_iid").alias("id"), scaled(F.col("pu"), c, c).alias("g")),
        F.struct(F.lit("item").alias("entity"), F.col("neg_iid").alias("id"), scaled(F.col("pu"), -c, -c).alias("g")),
    ))
    y = x.select(rows.alias("r")).select("r.*")
    sums = y.groupBy("entity", "id").agg(*[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(k + 1)])
    return sums.select("entity", "id", F.array(*[f"g{i}" for i in range(k + 1)]).alias("g"))


def clip(grads: DataFrame, max_norm: float) -> DataFrame:
    """Gradients scaled so that their norm over all entities is max_norm at most; a norm that isn't finite is an error."""
    square = grads.agg(F.sum(F.aggregate("g", F.lit(0.0), lambda s, a: s + a * a)).alias("n"))
    norm = F.sqrt(F.coalesce(square.scalar(), F.lit(0.0)))
    norm = F.when(F.isnan(norm) | (norm == float("inf")), F.raise_error(F.lit("the gradient isn't finite"))).otherwise(norm)
    return grads.withColumn("_n", norm).withColumn("g", F.transform("g", lambda a: a * F.least(F.lit(1.0), F.lit(max_norm) / F.greatest(F.col("_n"), F.lit(1e-300))))).drop("_n")


def state(users: DataFrame, items: DataFrame) -> DataFrame:
    """(entity, id, w, m, s): parameters with the bias last, and zero moments."""
    one = lambda df, e, key: df.select(F.lit(e).alias("entity"), F.col(key).cast("long").alias("id"), F.concat(F.transform("v", lambda a: a.cast("double")), F.array(F.col("b").cast("double"))).alias("w"))
    x = one(users, "user", "uid").unionByName(one(items, "item", "iid"))
    zero = F.transform("w", lambda _: F.lit(0.0))
    return x.withColumns({"m": zero, "s": zero})


def adamw(params: DataFrame, grads: DataFrame, step: int, learning_rate: float, weight_decay: float) -> DataFrame:
    """The state after one step; rows without a gradient have a zero one and decay all the same."""
    x = params.join(grads, ["entity", "id"], "left").withColumn("g", F.coalesce("g", F.transform("w", lambda _: F.lit(0.0))))
    x = x.withColumn("m", F.zip_with("m", "g", lambda m, g: BETA1 * m + (1 - BETA1) * g)).withColumn("s", F.zip_with("s", "g", lambda s, g: BETA2 * s + (1 - BETA2) * g * g))
    update = F.zip_with("m", "s", lambda m, s: learning_rate * (m / (1 - BETA1**step)) / (F.sqrt(s / (1 - BETA2**step)) + EPS))
    return x.withColumn("w", F.zip_with("w", update, lambda w, u: w * (1 - learning_rate * weight_decay) - u)).drop("g")


def factors(params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """users (uid, v, b) and items (iid, v, b) of a state."""
    one = lambda e, key: params.where(F.col("entity") == e).select(F.col("id").alias(key), F.slice("w", F.lit(1), F.size("w") - 1).alias("v"), F.element_at("w", -1).alias("b"))
    return one("user", "uid"), one("item", "iid")


def long_form(params: DataFrame) -> DataFrame:
    """(entity, id, dim, value)."""
    return params.select("entity", "id", F.posexplode("w").alias("dim", "value"))


def bpr_coefficients(x: DataFrame) -> DataFrame:
    """c of the mean of log(1 + exp(-d))."""
    return x.withColumn("_n", F.lit(1.0) * x.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("c", -sigmoid(-F.col("d")) / F.col("_n")).drop("_n")


def axiom_coefficients(x: DataFrame, p: float, outer: Column) -> DataFrame:
    """c of outer * (d sat / dd) for one axiom, sat = 1 - mean((1 - sigmoid(d))^p)^(1/p)."""
    t = sigmoid(F.col("d"))
    m = x.agg(F.avg(F.pow(1 - t, F.lit(float(p)))).alias("m"))
    n = x.agg(F.count(F.lit(1)).alias("n"))
    x = x.withColumns({"_m": m.scalar(), "_n": n.scalar()})
    slope = F.pow(F.greatest(F.col("_m"), F.lit(1e-300)), F.lit(1.0 / p - 1)) * F.pow(1 - t, F.lit(float(p - 1))) * t * (1 - t) / F.col("_n")
    return x.withColumn("c", outer * slope).drop("_m", "_n")


def _size(users: DataFrame) -> int:
    row = users.select(F.size("v").alias("k")).first()
    return row["k"] if row else 0


def mf_step(triples: DataFrame, users: DataFrame, items: DataFrame, learning_rate: float = 1e-3, weight_decay: float = 1e-2) -> DataFrame:
    """(entity, id, dim, value) after one pairwise step from fresh moments."""
    grads = gradients(bpr_coefficients(with_differences(triples, users, items)), _size(users))
    return long_form(adamw(state(users, items), grads, 1, learning_rate, weight_decay))


def axiom_gradients(triples: DataFrame, users: DataFrame, items: DataFrame, p: float, small: Small = None) -> DataFrame:
    """Gradients of 1 - sat of the first axiom alone."""
    return gradients(axiom_coefficients(with_differences(triples, users, items, small), p, F.lit(-1.0)), _size(users))


def ltn_gradients(triples: DataFrame, reg: DataFrame, users: DataFrame, items: DataFrame, p1: float, p2: float, p_sat: float, small: Small = None) -> DataFrame:
    """Gradients of 1 - SatAgg of both axioms."""
    one, two = with_differences(triples, users, items, small), with_differences(reg, users, items, small)
    sat = lambda x, p: x.agg(F.coalesce(logic.forall(sigmoid(F.col("d")), p), F.lit(1.0)).alias("a")).scalar()
    k = _size(users)
    parts = []
    for x, p in ((one, p1), (two, p2)):
        y = x.withColumns({"_a1": sat(one, p1), "_a2": sat(two, p2)}).withColumn("_own", F.col("_a1") if x is one else F.col("_a2"))
        m = (F.pow(1 - F.col("_a1"), F.lit(float(p_sat))) + F.pow(1 - F.col("_a2"), F.lit(float(p_sat)))) / 2
        outer = -F.pow(F.greatest(m, F.lit(1e-300)), F.lit(1.0 / p_sat - 1)) * F.pow(1 - F.col("_own"), F.lit(float(p_sat - 1))) / 2
        parts.append(axiom_coefficients(y, p, outer).drop("_a1", "_a2", "_own"))
    return gradients(reduce(DataFrame.unionByName, parts), k)


def ltn_step(triples: DataFrame, reg: DataFrame, users: DataFrame, items: DataFrame, p1: float, p2: float, p_sat: float, learning_rate: float = 1e-3, weight_decay: float = 1e-2) -> DataFrame:
    """(entity, id, dim, value) after one two-axiom step with clipped gradients from fresh moments."""
    grads = clip(ltn_gradients(triples, reg, users, items, p1, p2, p_sat), 1.0)
    return long_form(adamw(state(users, items), grads, 1, learning_rate, weight_decay))


def train(users: DataFrame, items: DataFrame, gradient, epochs: int, learning_rate: float, weight_decay: float, max_norm: float | None = None, validate=None, patience: int = 5, batches: int = 1) -> tuple[DataFrame, list[tuple[int, float]]]:
    """(best state, metrics): up to ``epochs`` epochs of ``batches`` steps each; gradient(step, users, items) gives (entity,
    id, g) and step counts on from 1 through all epochs. validate(users, items) -> score after each epoch stops after more
    than ``patience`` epochs without a strict rise; the best state is always kept. Every state is checkpointed, so the
    lineage doesn't grow and a lost executor costs one step."""
    params = cut(state(users, items))
    best, metrics, top, flat = params, [], float("-inf"), 0
    for epoch in range(1, epochs + 1):
        for step in range((epoch - 1) * batches + 1, epoch * batches + 1):
            grads = gradient(step, *factors(params))
            params = cut(adamw(params, grads if max_norm is None else clip(grads, max_norm), step, learning_rate, weight_decay))
        if validate is None:
            best = params
            continue
        score = validate(*factors(params))
        metrics.append((epoch, score))
        if score != score:
            break
        if score > top:
            best, top, flat = params, score, 0
        elif (flat := flat + 1) > patience:
            break
    return best, metrics

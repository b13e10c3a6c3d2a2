"""Seeded random search over hyperparameters, kept as a local table."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The search space.
N_FACTORS = (1, 5, 10, 25, 50, 100, 150, 200)
BATCH_SIZES = (128, 256, 512)
LEARNING_RATE = (1e-5, 1e-1)
WEIGHT_DECAY = (1e-6, 1e-1)
P_RANGE = (1, 10)
SCHEMA = "trial int, n_factors int, learning_rate double, weight_decay double, batch_size int, p_axiom1 int, p_axiom2 int, p_sat int"


def log_uniform(rng: random.Random, low: float, high: float) -> float:
    return math.exp(rng.uniform(math.log(low), math.log(high)))


def trials(count: int, seed: int) -> list[tuple]:
    """Rows of SCHEMA; the same for the same seed."""
    rng = random.Random(seed)
    whole = lambda: rng.randint(*P_RANGE)
    return [(k, rng.choice(N_FACTORS), log_uniform(rng, *LEARNING_RATE), log_uniform(rng, *WEIGHT_DECAY), rng.choice(BATCH_SIZES), whole(), whole(), whole()) for k in range(count)]


def trials_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def search(rows: list[tuple], objective: Callable[[dict], float]) -> list[tuple]:
    """(trial, score) of each trial, best first; equal scores by trial."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return sorted(((r[0], objective(dict(zip(names, r)))) for r in rows), key=lambda x: (-x[1], x[0]))


def tune(pipeline: Callable[[dict], object], model: str, rows: list[tuple], store) -> DataFrame:
    """Trains ``model`` (source_model, target_mf or target_ltn) of the pipeline that ``pipeline(trial)`` gives for each
    trial, and writes the trials with their best validation score, null without one, as table sweep_<model> of store."""

    def objective(trial: dict) -> float:
        p = pipeline(trial)
        getattr(p, model)
        best = p.store.read("metrics").where((F.col("model") == model) & ~F.isnan("score")).agg(F.max("score")).first()[0] if p.store.has("metrics") else None
        return float("-inf") if best is None else best

    scores = dict(search(rows, objective))
    scored = [(*r, None if scores[r[0]] == float("-inf") else scores[r[0]]) for r in rows]
    return store.write(f"sweep_{model}", store.spark.createDataFrame(scored, f"{SCHEMA}, score double"))


def with_trial(config, model: str, trial: dict):
    """The experiment with a trial's parameters for ``model``."""
    name = {"source_model": "source_mf"}.get(model, model)
    kind = type(getattr(config, name))
    return replace(config, **{name: kind(**{f.name: trial[f.name] for f in fields(kind)})})

"""Initial parameters of factor models."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _normal(seed: int, key: Column, salt: str, dim: Column) -> Column:
    """A standard normal number by hash (Box-Muller): the same for the same seed, key and place, in any layout."""
    unit = lambda part: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key, dim, F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))


def global_bias(seed: int) -> float:
    """A number in [0, 1), the same for the same seed. It moves all scores of a model alike and so no ranking."""
    return int(hashlib.md5(f"{seed}|global bias".encode()).hexdigest()[:13], 16) / 16**13


def factors(ids: DataFrame, key: str, n_rows: int, k: int, seed: int) -> DataFrame:
    """(key, v ARRAY<DOUBLE>, b DOUBLE) for every id: normal with the deviation sqrt(2 / (n_rows + k)) for factors and
    sqrt(2 / (n_rows + 1)) for the bias."""
    v = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: _normal(seed, F.col(key), f"{key}-factor", j) * math.sqrt(2 / (n_rows + k)))
    return ids.select(key, v.alias("v"), (_normal(seed, F.col(key), f"{key}-bias", F.lit(0)) * math.sqrt(2 / (n_rows + 1))).alias("b"))

"""Implicit feedback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the least rating that counts as positive.
POSITIVE = 4


def implicit(rating: Column) -> Column:
    """1 for ratings of POSITIVE or more, else 0, for null and NaN too."""
    return F.when((rating >= POSITIVE) & ~F.isnan(rating), 1).otherwise(0)

"""Seeded hashes of ids for all random choices: any engine with md5 gives the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes are whole numbers in [0, 2**HASH_BITS).
HASH_BITS = 60


def seeded_hash(seed: int | str, salt: str, *ids: str | Column) -> Column:
    """The first 15 hexadecimal digits of md5("seed|salt|id|id..."), as a long. Seed, salt (what the choice is for) and ids
    are mixed, so one seed's or one salt's order says nothing about another's. Null ids leave the text out."""
    text = F.concat_ws("|", F.lit(f"{seed}|{salt}"), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

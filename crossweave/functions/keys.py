"""Keys of ids.

The key of an id is what is left of its Unicode compatibility form (NFKC) when only ASCII letters and digits are
kept, in upper case. An id is absent if it is null, its key is empty, or its key is one of ``ABSENT_KEYS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that mean "no id".
ABSENT_KEYS = ("", "NULL", "NONE", "NAN", "NA", "UNKNOWN")


def id_key(c: Column) -> Column:
    """Key of an id; null only for null. Stays in the JVM: NFKC comes from the ICU library on Spark's own class path,
    and is called for the few ids that aren't plain ASCII. Spark counts such a call as non-deterministic, so the
    result has to be a selected column before it is grouped by or joined on; ``with_keys`` does that."""
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    kept = lambda x: F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c.rlike(r"\A[A-Z0-9]*\z"), c)
        .when(c.rlike(r"\A[\x00-\x7F]*\z"), kept(c))
        .otherwise(kept(nfkc))
    )


def present(key: Column) -> Column:
    """The key, or null if it means "absent"."""
    return F.when(~key.isin(*ABSENT_KEYS), key)


def with_keys(df: DataFrame, ids: dict[str, str], keep: list[str | Column] = ()) -> DataFrame:
    """``keep`` columns of df, and for each ``{new: id column}`` the key, null where the id is absent."""
    keyed = df.select(*keep, *[id_key(df[old]).alias(new) for new, old in ids.items()])
    return keyed.withColumns({new: present(F.col(new)) for new in ids})

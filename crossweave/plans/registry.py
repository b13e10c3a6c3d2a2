"""All queries outside the llm package, and their SQL."""

from __future__ import annotations

from crossweave.plans import problems, problems_sql, queries as pipeline, queries_sql

FLAGSHIP = "transfer_pairs"


def queries():
    return {**pipeline.queries(), **problems.queries()}


def oracle_sql():
    return {**queries_sql.oracle_sql(), **problems_sql.oracle_sql()}

"""Registered queries and, where SQL can say the same, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixtures import sql_samples
from ..schema import q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

IBE_SQL = """balanced AS (
  SELECT *, coalesce(na, 0e0) * 1e0 + coalesce(ca, 0e0) * 2e0 + coalesce(mg, 0e0) * 2e0 AS cations,
         coalesce(cl, 0e0) * 1e0 + coalesce(hco3, 0e0) * 1e0 + coalesce(so4, 0e0) * 2e0 AS anions
  FROM samples),
ibe AS (
  SELECT *, CASE WHEN cations + anions >= 1e-9 THEN (cations - anions) / (cations + anions) * 100e0 END AS ibe
  FROM balanced)"""


def register(sql: str | None = None, ctes: str | None = None):
    """Register a query under its function name; ``sql`` is a SELECT over the sample CTEs plus ``ctes``.

    A trailing underscore only keeps the function apart from an operator of the same name.
    """

    def add(function: Query) -> Query:
        name = function.__name__.rstrip("_")
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = f"WITH {sql_samples()}{', ' + ctes if ctes else ''}\n{sql.strip()}"
        return function

    return add


def r(expression: str, digits: int = 6) -> str:
    """SQL rounding whose zero is never negative."""
    return f"(round({expression}, {digits}) + 0e0)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The same rounding on DataFrame columns: sums are added in another order by another engine."""
    return df.withColumns({c: F.round(q(c), digits) + F.lit(0.0) for c in columns})

"""Collects named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def r6(c: Column | str) -> Column:
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to six decimals."""
    return df.select(
        *[r6(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )

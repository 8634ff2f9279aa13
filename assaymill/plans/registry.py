"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.plans.fixtures import SQL, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r(expression: str) -> str:
    """Six digits, and no negative zero."""
    return f"round({expression}, 6) + 0.0"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(select: str | None = None, *ctes: str) -> Callable[[Callable[[Fixtures], DataFrame]], Callable[[Fixtures], DataFrame]]:
    """Register a function of the fixtures under its name; ``select`` and ``ctes`` recompute it in DuckDB."""

    def register(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Fixtures(spark, sf_dir)))
        if select is not None:
            ORACLES[f.__name__] = "WITH RECURSIVE " + ",\n".join([SQL.strip(), *ctes]) + "\n" + select
        return f

    return register

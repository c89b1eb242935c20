"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductrisk.plans.oracle import sql as with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **tables: str):
    """Register a query; `sql` may use the shared table expressions by name."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql, **tables)
        return fn

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding 0.0 turns -0.0 into 0.0."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def text_time(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps and days as text, so that both engines give the same value."""
    kinds = dict(df.dtypes)
    fmt = lambda n: "yyyy-MM-dd" if kinds[n] == "date" else "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return df.withColumns({n: F.date_format(n, fmt(n)) for n in names})


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL twin of `rounded`."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name or expr}"


def T(expr: str, name: str | None = None) -> str:
    """SQL twin of `text_time` for timestamps."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expr}"


def D(expr: str, name: str | None = None) -> str:
    """SQL twin of `text_time` for days."""
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr}"

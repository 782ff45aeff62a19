"""Registry of checked queries: a Spark callable and, where SQL can express it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Views, oracle_views


@dataclass(frozen=True)
class Check:
    run: Callable[[Views], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}
_VIEWS = oracle_views()


def check(name: str, sql: str | None = None, views: str = "", ctes: str = ""):
    """Register a query. ``views`` names the derived tables its SQL reads, ``ctes`` are further WITH items."""
    full = None
    if sql is not None:
        parts = [f"{v} AS ({_VIEWS[v]})" for v in views.split()] + ([ctes.strip()] if ctes.strip() else [])
        full = (f"WITH {', '.join(parts)} " if parts else "") + sql

    def keep(run: Callable[[Views], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"duplicate query {name}")
        CHECKS[name] = Check(run, full)
        return run
    return keep


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return CHECKS[name].run(Views(spark, sf_dir))
    return run


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round values whose last bits depend on summation order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# shared pieces of oracle SQL
COUNTS = ("count(*) AS \"rows\", count(*) FILTER (WHERE sentiment = 'Positive') AS pos, "
          "count(*) FILTER (WHERE sentiment = 'Negative') AS neg, count(*) FILTER (WHERE sentiment = 'Neutral') AS neu")
NSS = 'coalesce(CAST(pos - neg AS DOUBLE) / nullif("rows", 0) * 100, 0)'


def pct(part: str, rows: str = '"rows"') -> str:
    return f"CAST({part} AS DOUBLE) / greatest({rows}, 1) * 100"

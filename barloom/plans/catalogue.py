"""Registry of runnable queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Runner], Runner]:
    """Register ``run(spark, sf_dir)`` under ``name`` with an optional DuckDB equivalent."""

    def add(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def rounded(value: str | Column, digits: int = 8) -> Column:
    """Round for comparison across engines, without negative zero."""
    column = F.round(F.col(value) if isinstance(value, str) else value, digits)
    return F.when(column == 0, F.lit(0.0)).otherwise(column)


def round_columns(frame: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return frame.withColumns({name: rounded(name, digits) for name in names})

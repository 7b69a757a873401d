"""The list of queries, and how their results are handed over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DecimalType

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_output(function(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return function

    return add


def as_output(table: DataFrame) -> DataFrame:
    """Exact decimals leave as doubles, the type both engines print alike."""
    return table.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
            else F.col(f"`{f.name}`")
            for f in table.schema.fields
        ]
    )

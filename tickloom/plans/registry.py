"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UNROUNDED: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[
        (F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def query(name: str, sql: str | None = None, keys: str = "", digits: int = 9):
    """Register a query; ``keys`` lists the SQL columns that are not floating point."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(spark, sf_dir), digits)
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql:
            UNROUNDED[name] = sql
            lead = f"{keys}, " if keys else ""
            skip = f" EXCLUDE ({keys})" if keys else ""
            ORACLES[name] = f"SELECT {lead}round(COLUMNS(*{skip}), {digits}) + 0.0 FROM ({sql})" if digits else sql
        return run
    return register


def plain(name: str, sql: str):
    """Register a query whose results hold no floating-point columns."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        ORACLES[name] = sql
        return run
    return register

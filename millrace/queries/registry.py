"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.columns import named, quoted
from millrace.session import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_made: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query together with its oracle."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name], ORACLE[name] = function, sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """The folder of an input derived from the tables; written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _made:
        path = fresh_dir(spark, label)
        write(path)
        _made[key] = path
    return _made[key]


def new_database(spark: SparkSession) -> str:
    """A database of its own for one query run, with its files in the shared folder."""
    location = fresh_dir(spark, "db")
    name = location.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {quoted(name)} LOCATION '{location}'")
    return name


def plain_names(df: DataFrame) -> DataFrame:
    """Dots in column names as double underscores, so that any tool can refer to them."""
    return df.toDF(*[c.replace(".", "__") for c in df.columns])


def wall_clock(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as the wall clock they were read from, whatever the session's zone."""
    return df.withColumns({c: named(c).cast("timestamp_ntz") for c in columns})


def time_text(column: str, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS"):
    return F.date_format(F.col(column), pattern)

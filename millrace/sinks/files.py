"""Parquet sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.folders import add, current, exists, publish
from millrace.operators.distribution import cluster

MODES = ("append", "overwrite", "replace")


class StreamedFolder(ValueError):
    """Readers of the folder trust the log of a stream, and would not see what is appended beside it."""


def refuse_stream(spark: SparkSession, path: str) -> None:
    """A folder that a file stream writes to takes no other appends."""
    if exists(spark, f"{path.rstrip('/')}/_spark_metadata"):
        raise StreamedFolder(f"{path} is written by a stream; appended files would not be read")


def write_partitioned(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    mode: str = "append",
    clustered: bool = False,
) -> None:
    """Hive-style partition directories; a NULL key goes to the default partition.

    ``append`` only adds files, so a rerun duplicates rows. ``overwrite`` replaces the
    directories that ``df`` has rows for and leaves the others alone; ``replace`` publishes the
    rows in the place of all of them, once they are written (see :mod:`millrace.folders`). Rows
    are brought together by key, unless ``clustered`` says they are already.
    """
    if mode not in MODES:
        raise ValueError(f"write_partitioned: mode {mode!r} is none of {', '.join(MODES)}")
    spark, rows = df.sparkSession, df if clustered else cluster(df, by)

    def write(folder: str) -> None:
        writer = rows.write.mode("append" if mode == "append" else "overwrite").partitionBy(*by)
        writer = writer.option("partitionOverwriteMode", "static" if mode == "replace" else "dynamic")
        writer.option("compression", "snappy").parquet(folder)

    if mode == "replace":
        publish(spark, path, write)
        return
    refuse_stream(spark, path)
    write(current(spark, path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet without partitions; by default it is published in the place of what the path stood for."""
    spark = df.sparkSession

    def write(folder: str) -> None:
        df.write.mode(mode).option("compression", "snappy").parquet(folder)

    if mode == "overwrite":
        publish(spark, path, write)
        return
    if mode == "append":
        refuse_stream(spark, path)
    write(current(spark, path))


def append_partitions(df: DataFrame, path: str, by: Sequence[str], name: str | None = None) -> list[str]:
    """Add rows to Hive-style partition directories, all of them or none, and return the directories that got files.

    They are what a catalog has to hear of, see :func:`millrace.sources.catalog.add_partitions`. With a ``name``, a run that is repeated
    adds nothing twice.
    """
    refuse_stream(df.sparkSession, path)
    write = lambda folder: cluster(df, by).write.partitionBy(*by).option("compression", "snappy").parquet(folder)
    return add(df.sparkSession, path, write, name) or []

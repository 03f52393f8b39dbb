"""Spreading rows over the cluster, and bringing rows of one directory together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.functions.columns import named



def _unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """Round-robin redistribution, to ``n`` partitions or to as many as the data size asks for.

    Spark sorts rows locally before dealing them out, so a task that is rerun after an
    executor loss deals them the same way again.
    """
    return df.repartition(n) if n else df.hint("rebalance")


def deal_scan(scan: DataFrame) -> DataFrame:
    """Deal out the rows that come straight from a file scan, by their number.

    A file is read in the same order whenever its task is rerun, so the numbers are the
    same as well. That saves the local sort by which :func:`spread` keeps reruns alike,
    and which one task would have to do for the whole of a large file.
    """
    row = _unused(scan, "__row")
    numbered = scan.withColumn(row, F.monotonically_increasing_id())
    return numbered.hint("rebalance", named(row)).drop(row)


def cluster(df: DataFrame, by: Sequence[str], salts: int | None = None) -> DataFrame:
    """Rows of one key together, so that a partitioned write makes few files per directory.

    The rebalance hint lets adaptive execution merge small keys into one task and split
    a hot key over many, which a plain hash repartition does not. In a session without
    adaptive execution, a key is salted with the partition its row comes from: that is
    the same when a task is rerun, and it splits a hot key even if all its rows are alike.
    ``salts`` is the number of tasks a key may take then, by default that of shuffle partitions.
    """
    keys = [named(c) for c in by]
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", *keys)
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = _unused(df, "__salt")
    salted = df.withColumn(salt, F.spark_partition_id() % salts)
    return salted.repartition(*keys, named(salt)).drop(salt)

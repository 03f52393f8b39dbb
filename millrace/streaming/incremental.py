"""Incremental ingestion: each file of a growing folder is taken in once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.folders import add, current, forget, names, touch
from millrace.functions.columns import named
from millrace.operators.distribution import cluster
from millrace.operators.quality import READING, WRITING, metrics_row, write_metrics
from millrace.session import small_methods
from millrace.sinks.files import refuse_stream

BAD_RECORD = "__bad_record"
PARSED = ("json", "csv")  # formats with malformed records
MARK = "millrace-"  # of the file that names a checkpoint


@dataclass(frozen=True)
class IngestRun:
    """What the batches of one call read, rejected and wrote."""

    batches: int
    read: int
    bad: int
    written: int


def _checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """A name for this checkpoint, kept in it: another one, even at the same path, has another name."""
    found = [n for n in names(spark, checkpoint) if n.startswith(MARK)]
    if not found:
        found = [f"{MARK}{uuid.uuid4().hex}"]
        touch(spark, f"{checkpoint.rstrip('/')}/{found[0]}")
    return found[0]


def ingest_incremental(
    spark: SparkSession,
    src: str,
    dst: str,
    schema: StructType | str,
    checkpoint: str,
    *,
    fmt: str = "json",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    partition_by: Sequence[str] = (),
    files_per_batch: int = 10_000,
    job: str = "ingest",
    directory: str | None = None,
    metrics_path: str | None = None,
    **options: str,
) -> IngestRun:
    """Add the rows of files not seen before to a Parquet folder, and return their numbers.

    The checkpoint folder remembers the files. Each batch is written aside and added under its number (see
    :func:`millrace.folders.add`), so that a batch that is run again after a failure adds nothing twice; the folder
    is plain Parquet, to which other jobs may append. A large backlog is worked off in bounded batches; the call returns when
    none is left. Rows are brought together by ``partition_by``, so that a batch does not leave a file per task and
    directory. A malformed record stops the run before its batch counts; with ``mode`` ``DROPMALFORMED`` such records are
    left out and counted. With ``metrics_path`` each batch appends its reading and writing records to the metrics
    table. Rows read are counted by the tasks that scan: one that is run again after an executor loss counts again.
    """
    refuse_stream(spark, current(spark, dst))
    options = {"mode": "FAILFAST", **options}
    drops = fmt in PARSED and options["mode"].upper() == "DROPMALFORMED"
    if drops:
        parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = StructType([*parsed.fields, StructField(BAD_RECORD, StringType())])
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD}
    stream = spark.readStream.format(fmt).schema(schema).options(**options)
    stream = stream.option("maxFilesPerTrigger", files_per_batch).load(src)
    name, seen = _checkpoint_id(spark, checkpoint), []

    def take(batch: DataFrame, number: int) -> None:
        scanned, wrote = Observation(), Observation()
        counts = [F.count(F.lit(1)).alias("read"), *([F.count(named(BAD_RECORD)).alias("bad")] if drops else [])]
        rows = batch.observe(scanned, *counts)
        if drops:
            rows = rows.filter(named(BAD_RECORD).isNull()).drop(BAD_RECORD)
        rows = transform(rows) if transform else rows
        rows = cluster(rows, partition_by) if partition_by else rows
        rows = rows.observe(wrote, F.count(F.lit(1)).alias("written"))

        def write(folder: str) -> None:
            writer = rows.write.option("compression", "snappy")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)

        if add(spark, dst, write, f"{name}-{number:012d}") is None:
            return  # added before the last run was cut short
        forget(spark, dst, name)
        run = IngestRun(1, scanned.get["read"], scanned.get.get("bad", 0), wrote.get["written"])
        seen.append(run)
        if metrics_path:
            label = directory or src
            records = metrics_row(spark, job, label, run.read, READING)
            write_metrics(records.union(metrics_row(spark, job, label, run.written, WRITING)), metrics_path)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take)
    with small_methods(spark):
        query = writer.start()
    query.awaitTermination()
    return IngestRun(len(seen), *(sum(getattr(r, field) for r in seen) for field in ("read", "bad", "written")))

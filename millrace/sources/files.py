"""Scans of JSON, CSV and Parquet files."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.folders import current
from millrace.functions.columns import named
from millrace.operators.distribution import deal_scan
from millrace.session import fresh_dir


# Standard CSV quoting: a quote inside a quoted value is doubled, and blanks belong to the value.
# Spark takes CSV columns by position; a file whose header says otherwise is to be an error.
CSV_OPTIONS = {
    "header": "true",
    "enforceSchema": "false",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# The column of a line of text. Directories can have any key, ``value=`` as well, which is what Spark calls it.
LINE = "__millrace_line"


def _skip_files(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Rows of the files whose names match no glob; must come right after the scan."""
    name = F.col("_metadata.file_name")
    return reduce(lambda kept, glob: kept.filter(~name.rlike(f"^{fnmatch.translate(glob)}")), exclude, df)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The keys of ``key=value`` directories below a path, outermost first."""
    return [c for c in spark.read.schema(f"{LINE} string").text(path).columns if c != LINE]


def read_json(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    *,
    exclude: Sequence[str] = (),
    recursive: bool = False,
    multiline: bool = False,
    bad_record: str | None = None,
    fail_fast: bool = False,
    rechunk_over: int | None = None,
) -> DataFrame:
    """JSON files below a path, plain or compressed (by suffix), one object per line.

    A line may also be an array of objects, each a record, or of none. Without a schema,
    it is inferred in an extra pass with every leaf as text. ``exclude`` holds globs of
    file names to skip; names starting with ``_`` or ``.`` always are. ``multiline`` reads
    files that are one object or one array of objects.

    A line that is no JSON gives a row of NULLs; ``bad_record`` adds a column for its text,
    and ``fail_fast`` lets the first such line stop the job. Only one task can read a gzip
    file: those of more than ``rechunk_over`` bytes are first rewritten, line by line, as
    small files in the shared folder, below the same ``key=value`` directories, so that many
    tasks parse them; the rows are the same for any limit. These three need a schema and one
    object per line.
    """
    path = current(spark, path)
    files = spark.read.option("recursiveFileLookup", recursive)
    if schema is None or multiline:
        if bad_record or fail_fast or rechunk_over is not None:
            raise ValueError("read_json: bad records and rechunking need a schema and one object per line")
        files = files.option("multiLine", multiline).option("primitivesAsString", schema is None)
        if schema is None:
            schema = _inferred(spark, path, exclude, recursive, multiline)
        return _skip_files(files.schema(schema).json(path), exclude)

    if bad_record:
        parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = StructType(parsed.fields + [StructField(bad_record, StringType())])
    options = {
        "recursiveFileLookup": recursive,
        "mode": "FAILFAST" if fail_fast else "PERMISSIVE",
        "columnNameOfCorruptRecord": bad_record or "",
    }

    def scan(folder: str, columns: StructType | str) -> DataFrame:
        return spark.read.options(**options).schema(columns).json(folder)

    records = _skip_files(scan(path, schema), exclude)
    if rechunk_over is None:
        return records
    large = (F.col("_metadata.file_size") > rechunk_over) & F.lower("_metadata.file_name").endswith(".gz")
    # The directories of the chunks are read with the types that the whole folder has.
    by = [] if recursive else partition_columns(spark, path)
    whole = records.schema
    text = StructType([StructField(LINE, StringType()), *[whole[c] for c in by]])
    lines = _skip_files(files.schema(text).text(path), exclude).filter(large).select(LINE, *[named(c) for c in by])
    chunks = fresh_dir(spark, "chunks")
    writer = deal_scan(lines).write.option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).text(chunks)
    return records.filter(~large).unionByName(scan(chunks, whole))


def _inferred(spark: SparkSession, path: str, exclude: Sequence[str], recursive: bool, multiline: bool) -> StructType:
    """The schema of the files that are not excluded, partition directories included."""
    files = lambda: spark.read.option("recursiveFileLookup", recursive)
    reader = spark.read.options(recursiveFileLookup=recursive, multiLine=multiline, primitivesAsString=True)
    if not exclude:
        return reader.json(path).schema
    lines = files().schema(f"{LINE} string").text(path)
    # Names only; the contents of the files are not read for this.
    found = _skip_files(files().format("binaryFile").load(path), exclude).select("_metadata.file_path").collect()
    seen = reader.json([unquote(r[0]) for r in found]).schema if found else StructType([])
    by = [f for f in lines.schema.fields if f.name != LINE]
    return StructType([f for f in seen.fields if f.name not in {c.name for c in by}] + by)


def oversized_gzip(spark: SparkSession, path: str, recursive: bool = False, limit: int | None = None) -> int | None:
    """The size beyond which a gzip file would hold up the scan, if there is such a file.

    By default that is the size at which Spark splits files that can be split
    (``spark.sql.files.maxPartitionBytes``). Reads file sizes only.
    """
    if limit is None:
        size = spark.conf.get("spark.sql.files.maxPartitionBytes")
        limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)
    files = spark.read.option("recursiveFileLookup", recursive).format("binaryFile").load(current(spark, path))
    gzip_length = F.when(F.lower("_metadata.file_name").endswith(".gz"), F.col("_metadata.file_size"))
    largest = files.agg(F.max(gzip_length)).first()[0]
    return limit if (largest or 0) > limit else None


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    *,
    bad_record: str | None = None,
    fail_fast: bool = False,
    **options: str | bool,
) -> DataFrame:
    """CSV files with a header line; without a schema, types are inferred in an extra pass.

    ``inferSchema=False`` takes all columns as text instead. Values that contain line
    breaks need ``multiLine=True``; a file is then read by one task. A row with more or
    fewer values than columns is malformed: ``bad_record`` adds a column for its text
    (that needs a schema), and ``fail_fast`` lets the first such row stop the job.
    """
    if bad_record:
        if schema is None:
            raise ValueError("read_csv: bad records need a schema")
        parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = StructType(parsed.fields + [StructField(bad_record, StringType())])
        options = {"columnNameOfCorruptRecord": bad_record, **options}
    if fail_fast:
        options = {"mode": "FAILFAST", **options}
    reader = spark.read.options(**{**CSV_OPTIONS, "inferSchema": schema is None, **options})
    return (reader.schema(schema) if schema is not None else reader).csv(current(spark, path))


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet files, those published last; columns and row groups that a query does not need are not read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current(spark, path))

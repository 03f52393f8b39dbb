"""The Spark session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_local_dirs: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)  # of each thread its own


def local_session(app: str = "millrace", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks. A cluster brings its own session."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus) if str(cpus).isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is missing, a temporary folder will do for a single-process
    session only; on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return _local_dirs[context.applicationId]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used before; it is not created."""
    folder = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    if (made := _scratch.get()) is not None:
        made.append(folder)
    return folder


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path in its terms."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of a job that failed or not, the fresh folders that were made within."""
    made: list[str] = []
    before = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(before)
        for folder in made:
            fs, path = hadoop_path(spark, folder)
            fs.delete(path, True)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Plan what runs inside for the JIT compiler, which leaves methods over 8000 bytes alone.

    A projection of dozens of casts in one fused method exceeds that and would be
    interpreted; with this limit Spark cuts it into methods that are compiled.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)

"""Crawling: the folders below a prefix become tables, and what was discovered before is not read again.

Folders. A folder that holds data files, or ``key=value`` directories with data files, is a table, of the format that
the file names tell. Folders beside one another whose files have one format and like columns are one table over the folder above,
as long as nothing else lies there. Names with an underscore or a dot in front are passed over, as Spark does, but for what
is published below them (:mod:`millrace.folders`).

Discovery. For each table a ledger below the database's folder holds the files looked at, by path, size and time, and
the columns found. Where only new files have come, only these are looked at and their columns merged with the recorded
ones; where none has, it takes a listing. Files that vanished or changed are a reason to look at all again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegralType, NumericType, StringType, StructField, StructType

from millrace.folders import PUBLISHED, current, exists as path_exists, publish, qualified
from millrace.functions.columns import quoted
from millrace.session import fresh_dir, hadoop_path, scratch
from millrace.sources import catalog
from millrace.sources.catalog import DISCOVERY, SchemaChange, discover_schema, discover_table, schema_changes

# Formats by the end of a file's name, without that of its compression.
FORMATS = {"json": "json", "jsonl": "json", "ndjson": "json", "csv": "csv", "parquet": "parquet"}
COMPRESSED = re.compile(r"\.(gz|bz2|zst|snappy|lz4|deflate)$")
LIKE = 0.7  # share of columns that folders have in common to be one table
CRAWLED = "millrace.crawled"  # table property: the prefix
LEDGER = "_discovered"


class Folder(NamedTuple):
    """A folder with data: where, of which format, and the keys of its directories."""

    path: str
    fmt: str
    keys: tuple[str, ...]


class Found(NamedTuple):
    """A table after a crawl."""

    table: str
    path: str
    fmt: str
    changes: list[SchemaChange]


def _format(name: str) -> str | None:
    return FORMATS.get(COMPRESSED.sub("", name.lower()).rpartition(".")[2])


def _children(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Names of directories and of files."""
    fs, folder = hadoop_path(spark, path)
    found = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(folder)]
    return sorted(n for n, d in found if d), sorted(n for n, d in found if not d)


def _inside(spark: SparkSession, path: str) -> tuple[str | None, tuple[str, ...]]:
    """Format and keys of a folder, told by its files or else by one branch of its ``key=value`` directories."""
    directories, files = _children(spark, path)
    fmt = next((f for f in map(_format, files) if f), None)
    if fmt:
        return fmt, ()
    for name in directories:
        if "=" in name and not name.startswith((".", "_")):
            fmt, keys = _inside(spark, f"{path}/{name}")
            if fmt:
                return fmt, (name.partition("=")[0], *keys)
    return None, ()


def folders_below(spark: SparkSession, prefix: str) -> Iterator[Folder]:
    """The folders with data, outermost first. Below ``key=value`` directories only one branch is listed."""
    place = prefix.rstrip("/")
    directories, _ = _children(spark, place)
    inner = current(spark, place)
    fmt, keys = _inside(spark, inner)
    if fmt:
        yield Folder(place, fmt, keys)
    if PUBLISHED in directories:
        return  # all that counts lies in the published folder
    for name in directories:
        if not name.startswith((".", "_")) and "=" not in name:
            yield from folders_below(spark, f"{place}/{name}")


def likeness(a: StructType, b: StructType) -> float:
    """The share of columns, by name and type, that two schemas have in common."""
    x, y = ({(f.name.lower(), f.dataType.simpleString()) for f in s.fields} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def grouped(spark: SparkSession, prefix: str, options: dict[str, str] | None = None) -> list[tuple[Folder, bool]]:
    """The tables below a prefix, and whether one stands for the folders below it."""
    found = list(folders_below(spark, prefix))
    by_parent: dict[str, list[Folder]] = {}
    for folder in found:
        by_parent.setdefault(folder.path.rpartition("/")[0], []).append(folder)
    out = []
    for parent, own in by_parent.items():
        others = [f for f in found if f not in own and (f.path == parent or f.path.startswith(f"{parent}/"))]
        plain = len(own) > 1 and len({f.fmt for f in own}) == 1 and not any(f.keys for f in own)
        if plain and not others and parent != prefix.rstrip("/"):
            schemas = [discover_schema(spark, f.path, f.fmt, **(options or {})) for f in own]
            if all(likeness(schemas[0], s) >= LIKE for s in schemas[1:]):
                out.append((Folder(parent, own[0].fmt, ()), True))
                continue
        out += [(f, False) for f in own]
    return sorted(out)


def _names(folders: list[Folder], prefix: str) -> dict[str, str]:
    """A table name for each folder: its own, with those above it where that is not enough."""
    clean = lambda text: re.sub(r"\W+", "_", text.strip("/")).strip("_").lower() or "data"
    below = {f.path: f.path[len(prefix.rstrip("/")) :].strip("/").split("/") for f in folders}
    names: dict[str, str] = {}
    for path, parts in below.items():
        for depth in range(1, len(parts) + 1):
            name = clean("_".join(parts[-depth:])) if parts[-1] else clean(prefix.rpartition("/")[2])
            if not any(p != path and clean("_".join(q[-depth:])) == name for p, q in below.items()):
                break
        names[path] = name
    return names


def crawl(spark: SparkSession, db: str, prefix: str, **options: str) -> list[Found]:
    """Register or update a table for each folder of data below ``prefix``; tables whose folder is gone are deprecated."""
    place = qualified(spark, prefix).rstrip("/")
    tables = grouped(spark, place, options) if path_exists(spark, place) else []
    names = _names([f for f, _ in tables], place)
    out = []
    for folder, over_folders in tables:
        more = {"recursiveFileLookup": "true"} if over_folders else {}
        changes = discover_new(spark, db, names[folder.path], folder.path, folder.fmt, **options, **more)
        catalog._set_properties(spark, db, names[folder.path], {CRAWLED: place})
        out.append(Found(names[folder.path], folder.path, folder.fmt, changes))
    for name in [t.name for t in spark.catalog.listTables(quoted(db))]:
        if name not in names.values() and catalog.describe(spark, db, name).get("table_properties", {}).get(CRAWLED) == place:
            catalog.mark_deprecated(spark, db, name)
    return out


# Discovery of what is new


def _ledger(spark: SparkSession, db: str, name: str) -> str:
    return f"{spark.catalog.getDatabase(db).locationUri.rstrip('/')}/{LEDGER}/{name.lower()}"


def _listing(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = ("file_path", "file_size", "file_modification_time")
    return files.select(*[F.col(f"_metadata.{c}").alias(c) for c in names])


def merged_type(a: DataType, b: DataType) -> DataType:
    """What holds the values of both: records and lists field by field, numbers in the wider one, else text."""
    if a == b:
        return a
    if isinstance(a, StructType) and isinstance(b, StructType):
        return merged(a, b)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(merged_type(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, NumericType) and isinstance(b, NumericType):
        sizes = ["tinyint", "smallint", "int", "bigint"]
        if isinstance(a, IntegralType) and isinstance(b, IntegralType):
            return max(a, b, key=lambda t: sizes.index(t.simpleString()))
        return DoubleType()
    return StringType()


def merged(a: StructType, b: StructType) -> StructType:
    """The columns of ``a``, then those that only ``b`` has."""
    of_b = {f.name.lower(): f for f in b.fields}
    known = {f.name.lower() for f in a.fields}
    both = [
        StructField(f.name, merged_type(f.dataType, of_b[f.name.lower()].dataType) if f.name.lower() in of_b else f.dataType)
        for f in a.fields
    ]
    return StructType(both + [StructField(f.name, f.dataType) for f in b.fields if f.name.lower() not in known])


def discover_new(spark: SparkSession, db: str, name: str, path: str, fmt: str, **options: str) -> list[SchemaChange]:
    """Like :func:`millrace.sources.catalog.discover_table`, looking at files that are new only, where the rest has stayed.

    The order of columns matters for CSV and directories are columns: where new files bring anything but columns at the end, and for
    tables with ``key=value`` directories, the whole folder is discovered.
    """
    with scratch(spark):
        return _discover_new(spark, db, name, path, fmt, options)


def _discover_new(spark: SparkSession, db: str, name: str, path: str, fmt: str, options: dict[str, str]) -> list[SchemaChange]:
    ledger, location = _ledger(spark, db, name), current(spark, path)
    known = catalog.exists(spark, db, name) and path_exists(spark, ledger)
    listed = None
    if path_exists(spark, location):
        # As of now: what comes while files are looked at is new the next time.
        stored = fresh_dir(spark, "listing")
        _listing(spark, location).write.parquet(stored)
        listed = spark.read.parquet(stored)
    if known and listed is not None:
        seen = spark.read.parquet(current(spark, ledger))
        keys = listed.columns
        gone = not seen.join(listed, keys, "left_anti").isEmpty()
        new = [] if gone else [r.file_path for r in listed.join(seen, keys, "left_anti").select("file_path").collect()]
        plain = not catalog._partitioned(spark, db, name) and not catalog.is_deprecated(spark, db, name)
        if not gone and not new:
            return []
        if not gone and plain and fmt != "csv":
            reader = spark.read.format(fmt).options(**{**DISCOVERY.get(fmt, {}), **options})
            old = spark.table(catalog.table_name(db, name)).schema
            found = merged(old, reader.load([unquote(p) for p in new]).schema)
            changes = schema_changes(old, found)
            if all(c.change == "added" for c in changes):
                if changes:
                    columns = ", ".join(f"{quoted(c.column)} {c.new_type}" for c in changes)
                    spark.sql(f"ALTER TABLE {catalog.table_name(db, name)} ADD COLUMNS ({columns})")
                spark.catalog.refreshTable(catalog.table_name(db, name))
                _record(listed, ledger)
                return changes
    changes = discover_table(spark, db, name, path, fmt, **options)
    if listed is not None:
        _record(listed, ledger)
    return changes


def _record(listed: DataFrame, ledger: str) -> None:
    publish(listed.sparkSession, ledger, listed.write.parquet)

"""Flattening of nested records: structs become dotted columns, arrays become child tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from millrace.functions.columns import named, quoted
from millrace.session import fresh_dir

ROW_ID = "__row_id"


def require_distinct(names: Sequence[str], action: str) -> None:
    """Column names must differ by more than case, or later references are ambiguous."""
    seen: dict[str, str] = {}
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"{action}: columns {seen[name.lower()]!r} and {name!r} have the same name")
        seen[name.lower()] = name


def _leaves(schema: StructType, sep: str, name: str = "", path: str = "") -> Iterator[tuple[str, str]]:
    for field in schema.fields:
        leaf_name = f"{name}{sep}{field.name}" if name else field.name
        leaf_path = f"{path}.{quoted(field.name)}" if path else quoted(field.name)
        if isinstance(field.dataType, StructType):
            yield from _leaves(field.dataType, sep, leaf_name, leaf_path)
        else:
            yield leaf_name, leaf_path


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every struct field, however deep, as one top-level column with a dotted name.

    A NULL struct gives NULL fields. Arrays and maps stay as they are.
    """
    leaves = list(_leaves(df.schema, sep))
    require_distinct([name for name, _ in leaves], "flatten")
    return df.selectExpr(*[f"{path} as {quoted(name)}" for name, path in leaves])


def relationalize(
    df: DataFrame,
    root: str = "root",
    key_cols: Sequence[str] | None = None,
    staging: str | None = None,
) -> dict[str, DataFrame]:
    """Split nested records into a flat root table and one child table per array column.

    In the root, an array column is replaced by the key of its child rows (NULL where
    the array is NULL). A child has ``id``, ``index`` and ``<path>.val`` columns, one
    row per array element; arrays inside arrays give further children, whose ``id`` is
    the struct of the parent's ``id`` and ``index``.

    ``key_cols`` must identify a record and be non-NULL: one column becomes the ``id``
    as it is, several become a struct. Without them, records are numbered and written
    once to ``staging`` so that root and children agree however often, and on whichever
    executors, they are computed. With ``key_cols``, giving ``staging`` saves parsing the
    records again for every table.
    """
    if key_cols:
        keys = [named(k) for k in key_cols]
        key = keys[0] if len(keys) == 1 else F.struct(*keys)
        if staging:
            df.write.mode("overwrite").parquet(staging)
            df = df.sparkSession.read.parquet(staging)
        records = flatten(df)
    else:
        staging = staging or fresh_dir(df.sparkSession, "relationalize")
        df.withColumn(ROW_ID, F.monotonically_increasing_id()).write.mode("overwrite").parquet(staging)
        records = flatten(df.sparkSession.read.parquet(staging))
        key = named(ROW_ID)
    tables: dict[str, DataFrame] = {}
    _split(records, root, root, key, tables)
    return tables


def _split(records: DataFrame, table: str, root: str, key: Column, tables: dict[str, DataFrame]) -> None:
    fields = [f for f in records.schema.fields if f.name != ROW_ID]
    arrays = [f.name for f in fields if isinstance(f.dataType, ArrayType)]
    tables[table] = records.select(
        *[
            F.when(named(f.name).isNotNull(), key).alias(f.name) if f.name in arrays else named(f.name)
            for f in fields
        ]
    )
    for name in arrays:
        elements = records.select(key.alias("id"), F.posexplode(named(name)).alias("index", f"{name}.val"))
        child_fields = [f for f in elements.schema.fields if f.name not in ("id", "index")]
        leaves = list(_leaves(StructType(child_fields), "."))
        child = elements.selectExpr("id", "index", *[f"{path} as {quoted(leaf)}" for leaf, path in leaves])
        _split(child, f"{root}_{name}", root, F.struct("id", "index"), tables)


def strip_name(df: DataFrame, text: str) -> DataFrame:
    """Remove every occurrence of ``text`` from every column name."""
    names = [name.replace(text, "") for name in df.columns]
    require_distinct(names, f"strip_name({text!r})")
    return df.toDF(*names)


def absorb(df: DataFrame, struct: str) -> DataFrame:
    """Move columns that stand beside a struct, but are fields of it as well, into the struct.

    Where both have a value, that in the struct stays. Rows without any such column set,
    which is to say most, keep their struct as it is.
    """
    fields = [f.name for f in df.schema[struct].dataType.fields]
    beside = [c for c in df.columns if c in fields]
    if not beside:
        return df
    merged = [
        f"'{name}', coalesce({quoted(struct)}.{quoted(name)}, {quoted(name)})"
        if name in beside
        else f"'{name}', {quoted(struct)}.{quoted(name)}"
        for name in fields
    ]
    found = f"coalesce({', '.join(quoted(name) for name in beside)})"
    whole = f"if({found} is null, {quoted(struct)}, named_struct({', '.join(merged)})) as {quoted(struct)}"
    return df.selectExpr(*[whole if c == struct else quoted(c) for c in df.columns if c not in beside])

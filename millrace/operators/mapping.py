"""Declarative choice, renaming and casting of columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StringType, StructField, StructType

from millrace.functions.columns import cast_or_null, parsed_type, quoted
from millrace.operators.flatten import require_distinct


class Mapping(NamedTuple):
    source: str
    source_type: str
    target: str
    target_type: str


def read_mapping(text: str) -> list[Mapping]:
    """One mapping per line: name, type read, type wanted; the name is kept."""
    rows = (line.split() for line in text.strip().splitlines())
    return [Mapping(name, have, name, want) for name, have, want in rows]


def target_schema(mappings: Iterable[Mapping | Sequence[str]]) -> StructType:
    """The schema that :func:`apply_mapping` produces."""
    fields = [Mapping(*m) for m in mappings]
    return StructType([StructField(m.target, parsed_type(m.target_type)) for m in fields])


def source_schema(mappings: Iterable[Mapping | Sequence[str]], under: str | None = None) -> StructType:
    """A reading schema with only the mapped fields, every leaf as text.

    Dotted sources become nested structs, and ``under`` names an object around them
    all. Scanning with it parses nothing that the mapping would drop.
    """
    tree: dict = {}
    for mapping in mappings:
        path = Mapping(*mapping).source.split(".")
        if under:
            path.insert(0, under)
        node = tree
        for step in path[:-1]:
            node = node.setdefault(step, {})
        node.setdefault(path[-1], {})

    def struct(node: dict) -> StructType:
        return StructType([StructField(k, struct(v) if v else StringType()) for k, v in node.items()])

    return struct(tree)


def _spelled(schema: DataType, name: str) -> str | None:
    """The name as the schema spells it: exactly, or else the only one that differs in case alone."""
    names = schema.names if isinstance(schema, StructType) else []
    if name in names:
        return name
    alike = [n for n in names if n.lower() == name.lower()]
    return alike[0] if len(alike) == 1 else None


def _locate(schema: StructType, name: str) -> tuple[str, DataType] | None:
    """A column of that name or, failing that, a struct field at that dotted path."""
    column = _spelled(schema, name)
    if column is not None:
        return quoted(column), schema[column].dataType
    path: list[str] = []
    data_type: DataType = schema
    for step in name.split("."):
        field = _spelled(data_type, step)
        if field is None:
            return None
        path.append(quoted(field))
        data_type = data_type[field].dataType
    return ".".join(path), data_type


def apply_mapping(
    df: DataFrame, mappings: Iterable[Mapping | Sequence[str]], strict: bool = False
) -> DataFrame:
    """Choose, rename and cast columns by ``(source, source type, target, target type)``.

    Unmapped columns are dropped. A value that does not cast becomes NULL. A missing
    source gives a typed NULL column, so the result always has the mapped schema. With
    ``strict``, a missing source or one of another type than stated is an error.
    """
    mappings = [Mapping(*m) for m in mappings]
    require_distinct([m.target for m in mappings], "apply_mapping")
    schema, projection = df.schema, []
    for mapping in mappings:
        want = parsed_type(mapping.target_type)
        found = _locate(schema, mapping.source)
        if strict:
            stated = parsed_type(mapping.source_type)
            if found is None:
                raise ValueError(f"apply_mapping: no column {mapping.source!r}")
            if found[1] != stated:
                raise TypeError(
                    f"apply_mapping: {mapping.source!r} is {found[1].simpleString()}, "
                    f"not {stated.simpleString()}"
                )
        value = f"cast(null as {want.simpleString()})" if found is None else cast_or_null(*found, want)
        projection.append(f"{value} as {quoted(mapping.target)}")
    return df.selectExpr(*projection)

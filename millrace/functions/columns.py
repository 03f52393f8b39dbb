"""Column expressions used by several operators. All of them stay inside the JVM.

Wide projections are given as SQL text: one call per column, where the same thing put
together from Column objects takes dozens.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DecimalType,
    MapType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
    VariantType,
)


def quoted(name: str) -> str:
    """The name in backquotes, so that dots in it are not read as struct access."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


@lru_cache(maxsize=None)
def parsed_type(ddl: str) -> DataType:
    return DataType.fromDDL(ddl)


def is_atomic(data_type: DataType) -> bool:
    return not isinstance(data_type, (ArrayType, MapType, StructType, VariantType))


def unquoted_text(sql: str, data_type: DataType) -> str:
    """The value as text without double quotes; only text can contain any."""
    if isinstance(data_type, StringType):
        return f"replace({sql}, '\"', '')"
    return f"cast({sql} as string)"


# Text that can be a number at all, and text with a date in it; the casts take blanks around them.
_NUMBER = r"^[\\s\\p{Cntrl}]*[+-]?(\\p{Nd}+\\.?\\p{Nd}*|\\.\\p{Nd}+)([eE][+-]?\\p{Nd}+)?[\\s\\p{Cntrl}]*$"
_DATE = r"^[\\s\\p{Cntrl}]*[+-]?[0-9]{4}"


def cast_or_null(sql: str, have: DataType, want: DataType) -> str:
    """Cast that turns an unusable value into NULL; no cast at all between equal types.

    Text is looked at before it is cast to a decimal, since a failing cast pays for an
    exception. A time of day without a date is no timestamp, though the cast alone would
    give it that of today.
    """
    if have == want:
        return sql
    cast = f"try_cast({sql} as {want.simpleString()})"
    if isinstance(have, StringType) and isinstance(want, DecimalType):
        return f"if({sql} rlike '{_NUMBER}', {cast}, null)"
    if isinstance(have, StringType) and isinstance(want, (TimestampType, TimestampNTZType)):
        return f"if({sql} rlike '{_DATE}', {cast}, null)"
    return cast

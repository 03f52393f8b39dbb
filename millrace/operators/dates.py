"""Calendar parts of a column that is chosen at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from millrace.functions.columns import named

DATE_PARTS = ("year", "month", "day")


def add_date_parts(df: DataFrame, column: str) -> DataFrame:
    """Append integer ``year``, ``month`` and ``day`` of a date or timestamp column."""
    data_type = df.schema[column].dataType
    if not isinstance(data_type, (DateType, TimestampType, TimestampNTZType)):
        raise TypeError(f"{column} is {data_type.simpleString()}, not a date or timestamp")
    source = named(column)
    parts = (F.year(source), F.month(source), F.dayofmonth(source))
    return df.withColumns(dict(zip(DATE_PARTS, parts)))

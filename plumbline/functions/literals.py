"""Values and names as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, NumericType, TimestampNTZType, TimestampType

from .digest import render


def quote(name: str) -> str:
    """An identifier in backticks."""
    return "`" + name.replace("`", "``") + "`"


def qualify(*parts: str) -> str:
    return ".".join(map(quote, filter(None, parts)))


def literal(value: str | None, kind: DataType) -> str:
    """A value, given as text, as a literal of its column's type."""
    if value is None:
        return "NULL"
    if isinstance(kind, BooleanType):
        return "true" if value in ("1", "true") else "false"
    if isinstance(kind, NumericType):
        return f"CAST('{value}' AS {kind.simpleString()})" if value.lower().strip("-+") in ("nan", "infinity", "inf") else value
    if isinstance(kind, BinaryType):
        return f"X'{value.removeprefix('0x')}'"
    text = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return f"CAST({text} AS {kind.simpleString()})"
    return text


def literal_column(column: Column, kind: DataType) -> Column:
    """literal for every row, as a column."""
    text = render(column, kind)
    if isinstance(kind, BooleanType):
        shown = F.when(text == "1", "true").otherwise("false")
    elif isinstance(kind, NumericType):
        shown = F.when(F.lower(text).isin("nan", "infinity", "-infinity"), F.concat(F.lit("CAST('"), text, F.lit(f"' AS {kind.simpleString()})"))).otherwise(text)
    elif isinstance(kind, BinaryType):
        shown = F.concat(F.lit("X'"), text, F.lit("'"))
    else:
        body = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
        dated = isinstance(kind, (DateType, TimestampType, TimestampNTZType))
        shown = F.concat(F.lit("CAST("), body, F.lit(f" AS {kind.simpleString()})")) if dated else body
    return F.when(column.isNull(), F.lit("NULL")).otherwise(shown)

"""Rows as unambiguous text, and digests of it.

Every column becomes ``|<length>:<text>``, null becomes ``|-:``; so null, the empty text and a
shift of text between columns all differ. Two ways to render a value: ``exact`` keeps any two
different values apart; ``portable`` renders doubles through decimal(38,6), which other engines
print alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DoubleType, FloatType, MapType, StructType, TimestampType

PROFILES = ("exact", "portable")


def render(column: Column, kind: DataType, profile: str = "exact") -> Column:
    """A value as text; null stays null."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    if isinstance(kind, BooleanType):
        return column.cast("int").cast("string")
    if isinstance(kind, BinaryType):
        return F.hex(column)
    if isinstance(kind, DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, TimestampType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, (DoubleType, FloatType)):
        if profile == "portable":
            return F.coalesce(column.try_cast("decimal(38,6)").cast("string"), column.cast("string"))
        return column.cast("string")
    if isinstance(kind, ArrayType):
        items = F.transform(column, lambda x: F.concat(F.lit("|"), _sized(render(x, kind.elementType, profile))))
        return F.when(column.isNotNull(), F.array_join(items, ""))
    if isinstance(kind, (MapType, StructType)):
        return F.to_json(column)
    return column.cast("string")


def _sized(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("-:")).otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text))


def canonical(columns: list[tuple[Column, DataType]], profile: str = "exact") -> Column:
    """Columns, in order, as one unambiguous text; no columns are the empty text."""
    parts = [F.concat(F.lit("|"), _sized(render(c, k, profile))) for c, k in columns]
    return F.concat(*parts) if parts else F.lit("")


def row_text(schema: StructType, names: list[str], profile: str = "exact", alias: str | None = None) -> Column:
    """canonical over named columns of a DataFrame."""
    prefix = f"{alias}." if alias else ""
    return canonical([(F.col(f"{prefix}`{n}`"), schema[n].dataType) for n in names], profile)


def row_hash(text: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a row's text, lower case."""
    return F.md5(text.cast("binary")) if algorithm == "md5" else F.sha2(text.cast("binary"), 256)


def pair_hash(text: Column) -> tuple[Column, Column]:
    """128 bits of a row's text, or of a value, as two whole numbers, which aggregates hold at a fixed width."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def pair_hex(first: Column, second: Column) -> Column:
    """Such a pair as 32 hex digits, lower case."""
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def fingerprint_hash(text: Column, algorithm: str = "xxhash64") -> Column:
    """A number for order-independent sums: 64 bits, or 32 of the MD5 where other engines must agree."""
    if algorithm == "md5":
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.xxhash64(text)


def display(keys: list[Column]) -> Column:
    """A row's label: key values joined by a comma, NULL for null."""
    return F.concat_ws(", ", *[F.coalesce(k.cast("string"), F.lit("NULL")) for k in keys])

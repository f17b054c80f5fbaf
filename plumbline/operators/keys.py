"""Candidate keys: profiles of single columns, checks of chosen keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, VariantType

from ..functions.digest import pair_hash

_NOT_KEYS = (ArrayType, MapType, StructType, BinaryType, VariantType)


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, row_count, distinct_count, null_count, could_be_key of all columns that can be compared.

    A column could be a key if it has no null and as many values as there are rows, of which there are some. One scan,
    however many columns: rows become cells (column, 128 bits of the value), which are counted by cell, in part before the
    shuffle, then by column.
    """
    names = [c for c in columns or df.columns if not isinstance(df.schema[c].dataType, _NOT_KEYS)]
    if not names:
        raise ValueError("no column can be a key")
    cell = lambda i, c: F.struct(F.lit(i).alias("i"), c.isNull().alias("none"), *[h.alias(n) for n, h in zip(("h1", "h2"), pair_hash(c))])
    cells = df.select(F.explode(F.array(*[cell(i, F.col(f"`{c}`")) for i, c in enumerate(names)])).alias("c")).select("c.*")
    by_cell = cells.groupBy("i", "none", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    by_column = by_cell.groupBy("i").agg(F.sum("n").alias("row_count"), F.count_if(~F.col("none")).alias("distinct_count"), F.sum(F.when(F.col("none"), F.col("n")).otherwise(0)).alias("null_count"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "place int, column_name string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = listed.join(by_column, F.col("place") == F.col("i"), "left").select("column_name", *map(zero, ("row_count", "distinct_count", "null_count")))
    return out.withColumn("could_be_key", (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0))


def check_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: row_count, distinct_count of whole keys, null_key_count (rows with a null in the key), is_unique."""
    cols = [F.col(f"`{k}`") for k in keys]
    any_null = cols[0].isNull()
    for c in cols[1:]:
        any_null = any_null | c.isNull()
    by_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__null", any_null)
    sums = by_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_count"), F.coalesce(F.sum(F.when(F.col("__null"), F.col("__n")).otherwise(0)), F.lit(0)).alias("null_key_count"))
    return sums.withColumn("is_unique", (F.col("row_count") == F.col("distinct_count")) & (F.col("null_key_count") == 0))


def verdict(row_count: int, distinct_count: int, null_key_count: int) -> str | None:
    """Why a key is refused; None if it isn't. Nulls are the first reason."""
    if null_key_count:
        return f"{null_key_count} of {row_count} rows have no value in the key"
    if row_count != distinct_count:
        return f"{row_count} rows have {distinct_count} different keys"
    return None


def recommend(declared: list[tuple[str, ...]], profiled: list[tuple[str, bool]]) -> tuple[str, ...]:
    """The shortest declared key, else the first column that could be one, else nothing."""
    if declared:
        return min(declared, key=len)
    return next(((name,) for name, could in profiled if could), ())

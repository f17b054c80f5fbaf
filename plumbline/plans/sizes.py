"""How large a plan will be, before it is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes.
VALUE_OVERHEAD, ROW_OVERHEAD, SCRIPT_OVERHEAD = 4, 8, 64
WIDTH_BAND, STAGED_BYTES, TRANSFER_VALUE = 2, 2048, 24


@dataclass(frozen=True)
class TableSize:
    """What is known of a table that a plan writes."""

    source_rows: int
    target_rows: int
    bytes_per_row: int
    scanned: bool = False
    differs: bool = False
    exact_rows: int | None = None


@dataclass(frozen=True)
class PlanSize:
    schema_bytes: int
    min_bytes: int
    max_bytes: int
    min_rows: int
    max_rows: int
    not_scanned: int
    staged: int
    may_stage: int
    verdict: str


def row_range(table: TableSize) -> tuple[int, int]:
    """Fewest and most rows that a table's part may write."""
    if table.exact_rows is not None:
        return table.exact_rows, table.exact_rows
    most = max(table.source_rows, table.target_rows)
    if not table.scanned:
        return 0, most
    return (max(1, abs(table.source_rows - table.target_rows)), most) if table.differs else (0, 0)


def plan_size(tables: list[TableSize], schema_bytes: int, inline_limit: int, review_limit: int) -> PlanSize:
    """The range of a plan's bytes: fewest rows at the narrowest width to most rows at the widest.

    A table certain to go beyond inline_limit is staged at a fixed cost; one that may is counted up to the limit.
    """
    low_sum = high_sum = low_rows = high_rows = staged = may_stage = 0
    for table in tables:
        low, high = row_range(table)
        width = max(1, table.bytes_per_row)
        least, most = low * max(1, width // WIDTH_BAND), high * width * WIDTH_BAND
        if least > inline_limit:
            staged, least, most = staged + 1, STAGED_BYTES, STAGED_BYTES
        elif most > inline_limit:
            may_stage, most = may_stage + 1, inline_limit
        low_sum, high_sum, low_rows, high_rows = low_sum + least, high_sum + most, low_rows + low, high_rows + high
    fits = "Exceeds" if schema_bytes + low_sum > review_limit else "Possibly" if schema_bytes + high_sum > review_limit else "Within"
    unknown = sum(t.exact_rows is None and not t.scanned for t in tables)
    return PlanSize(schema_bytes, low_sum, high_sum, low_rows, high_rows, unknown, staged, may_stage, fits)


def script_size(change_set: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row, ``bytes``: a change set's size as statements."""
    cost = lambda c: F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + VALUE_OVERHEAD
    total = lambda names: sum((cost(c) for c in names), F.lit(0))
    column_names, key_names = (sum(len(c) + VALUE_OVERHEAD for c in names) for names in (columns, keys))
    row = F.when(F.col("op") == "Delete", total(keys) + key_names).when(F.col("op") == "Update", total(keys + columns) + column_names + key_names).otherwise(total(keys + columns))
    return change_set.agg((F.coalesce(F.sum(row + ROW_OVERHEAD), F.lit(0)) + column_names + SCRIPT_OVERHEAD).cast("bigint").alias("bytes"))


def transfer(inserts: int, updates: int, columns: int) -> int:
    """Bytes of values that a compare's second pass fetches."""
    return (inserts + updates) * columns * TRANSFER_VALUE


def delete_share(deletes: int, target_rows: int, limit: float = 0.05) -> bool:
    """Whether deletes are so large a part of the target that they need a warning."""
    return deletes > 0 and target_rows > 0 and deletes / target_rows > limit

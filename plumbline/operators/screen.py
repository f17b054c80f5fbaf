"""Order-independent fingerprints of tables, and the screening of many tables by them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import fingerprint_hash, row_text

T = TypeVar("T")
#: Of a side ("source" or "target"), the fingerprints of tables by the columns that count.
Fingerprints = Callable[[str, Mapping[str, list[str]]], DataFrame]


def fingerprint(df: DataFrame, columns: list[str], table: str = "", profile: str = "exact", algorithm: str = "xxhash64") -> DataFrame:
    """One row: table_name, row_count, xor_hash, sum_hash; (0, 0, 0) if empty. One scan, partial sums."""
    hashed = df.select(fingerprint_hash(row_text(df.schema, columns, profile), algorithm).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0).cast("bigint")).alias("xor_hash"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("sum_hash"),
    ).select(F.lit(table).alias("table_name"), "*")


def screen(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]], sizes: Mapping[str, int] | None = None, max_bytes: int | None = None, profile: str = "exact", algorithm: str = "xxhash64", fingerprints: Fingerprints | None = None) -> DataFrame:
    """table_name, state (same, differs, not comparable, skipped) and reason of every table of either side.

    All fingerprints of a side are one job. A table that can't be analysed takes only itself down. fingerprints: how a
    side's tables are measured, if not by reading them whole.
    """
    if not (source or target):
        raise ValueError("there are no tables")
    spark = next(iter([*source.values(), *target.values()])).sparkSession
    told: list[tuple[str, str, str]] = []
    measured: dict[str, list[str]] = {}
    for name in sorted({*source, *target}):
        if name not in target:
            told.append((name, "not comparable", "only on source"))
        elif name not in source:
            told.append((name, "not comparable", "only on target"))
        elif max_bytes is not None and (sizes or {}).get(name, 0) > max_bytes:
            told.append((name, "skipped", f"larger than {max_bytes} bytes"))
        elif not keys.get(name):
            told.append((name, "not comparable", "no primary key"))
        else:
            try:
                there = {c.lower() for c in target[name].columns}
                columns = [c for c in source[name].columns if c.lower() in there]
                if not set(columns) - set(keys[name]):
                    told.append((name, "not comparable", "no comparable columns"))
                    continue
                for side in (source, target):
                    row_text(side[name].schema, columns, profile)
                measured[name] = columns
            except Exception as e:  # noqa: BLE001  what can't be read is reported, not fatal
                told.append((name, "not comparable", f"could not be read: {type(e).__name__}"))
    result = spark.createDataFrame(told, "table_name string, state string, reason string")
    if measured:
        whole = lambda side, columns: union([fingerprint({"source": source, "target": target}[side][n], c, n, profile, algorithm) for n, c in columns.items()])
        a, b = ((fingerprints or whole)(side, measured) for side in ("source", "target"))
        same = (F.col("a.row_count") == F.col("b.row_count")) & (F.col("a.xor_hash") == F.col("b.xor_hash")) & (F.col("a.sum_hash") == F.col("b.sum_hash"))
        compared = a.alias("a").join(b.alias("b"), F.col("a.table_name") == F.col("b.table_name"))
        result = result.unionByName(compared.select("a.table_name", F.when(same, "same").otherwise("differs").alias("state"), F.lit("").alias("reason")))
    return result


def union(frames: list[DataFrame]) -> DataFrame:
    """All of them, as a balanced tree: hundreds of tables don't nest hundreds deep."""
    while len(frames) > 1:
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + frames[len(frames) // 2 * 2 :]
    return frames[0]


def spared(names: list[str], run: Callable[[list[str]], T]) -> tuple[list[T], dict[str, str]]:
    """run for all names at once; what fails is halved until only names that fail alone are left out.

    So k bad names among n cost about 2 k log2(n) runs. Returns the results and why each left-out name failed.
    """
    if not names:
        return [], {}
    try:
        return [run(names)], {}
    except Exception as e:  # noqa: BLE001  reported by name
        if len(names) == 1:
            return [], {names[0]: f"could not be read: {type(e).__name__}"}
        half = len(names) // 2
        (a, lost_a), (b, lost_b) = spared(names[:half], run), spared(names[half:], run)
        return a + b, lost_a | lost_b


def screened(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]], sizes: Mapping[str, int] | None = None, max_bytes: int | None = None) -> list[tuple[str, str, str]]:
    """The rows of screen, by name. A table that fails while it is read takes only itself down."""

    def run(names: list[str]) -> list[tuple[str, str, str]]:
        pick = lambda side: {n: side[n] for n in names if n in side}
        return list(map(tuple, screen(pick(source), pick(target), keys, sizes, max_bytes).collect()))  # a row a table

    parts, failed = spared(sorted({*source, *target}), run)
    return sorted([r for p in parts for r in p] + [(n, "not comparable", why) for n, why in failed.items()])


def scan_summary(screened: DataFrame) -> DataFrame:
    """How many tables are comparable, differ, aren't comparable, were skipped."""
    return screened.agg(
        F.count_if(F.col("state").isin("same", "differs")).alias("comparable"),
        F.count_if(F.col("state") == "differs").alias("differing"),
        F.count_if(F.col("state") == "not comparable").alias("not_comparable"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
    )

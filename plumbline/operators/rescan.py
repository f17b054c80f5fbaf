"""Fingerprints kept by file, so that a second scan reads only the files that have changed.

A table's fingerprint is a count, an xor and a sum, so it is that of its files put together. For every file the
three are kept with its path, size and time of change; a scan lists the files of all tables, reads those that it doesn't know
like that, forgets those that are gone, and adds up by table. What is kept is a versioned table of its
own: a scan that fails leaves it as it was, and of two scans at once the later reads again what it must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import fingerprint_hash, row_text
from ..sources.manifest import Conflict, VersionedDatabase
from ..sources.store import materialize
from .screen import spared, union

KEPT = "table_name string, rule string, file_path string, file_size bigint, file_time timestamp, row_count bigint, xor_hash bigint, sum_hash decimal(38,0)"


@dataclass(frozen=True)
class Watched:
    """A table to scan: its name in the store, its files, how to read all or some of them, and what counts."""

    name: str
    files: DataFrame  # file_path, file_size, file_time
    read: Callable[[list[str] | None], DataFrame]
    columns: tuple[str, ...]
    profile: str = "exact"
    algorithm: str = "xxhash64"

    @property
    def rule(self) -> str:
        """Fingerprints by another rule aren't comparable, so they aren't known."""
        return hashlib.md5("\x00".join((self.profile, self.algorithm, *self.columns)).encode()).hexdigest()


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """file_path, file_size, file_time of all data files below a folder; nothing of them is read."""
    listed = spark.read.format("binaryFile").load(folder)
    return listed.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").alias("file_time"))


def watch_folder(spark: SparkSession, name: str, folder: str, columns: Sequence[str] | None = None, profile: str = "exact", algorithm: str = "xxhash64") -> Watched:
    """A folder of Parquet files as a table to scan."""
    whole = spark.read.parquet(folder)

    def read(paths: list[str] | None) -> DataFrame:
        return whole if paths is None else spark.read.schema(whole.schema).option("basePath", folder).parquet(*paths)

    return Watched(name, files_below(spark, folder), read, tuple(columns or whole.columns), profile, algorithm)


def by_file(df: DataFrame, table: Watched) -> DataFrame:
    """file_path, row_count, xor_hash, sum_hash of the files of df that have rows."""
    hashed = df.select(F.col("_metadata.file_path").alias("file_path"), fingerprint_hash(row_text(df.schema, list(table.columns), table.profile), table.algorithm).alias("h"))
    return hashed.groupBy("file_path").agg(F.count(F.lit(1)).alias("row_count"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum_hash"))


class FingerprintStore:
    """Kept fingerprints under a path, and what the last scan read."""

    TABLE = "fingerprints"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.base = spark, VersionedDatabase(spark, path)
        self.files_read: dict[str, int] = {}
        self.failed: dict[str, str] = {}

    def scan(self, tables: Iterable[Watched]) -> DataFrame:
        """table_name, row_count, xor_hash, sum_hash of all tables that can be read; failed tells of the others."""
        tables = {t.name: t for t in tables}
        self.files_read, self.failed = dict.fromkeys(tables, 0), {}
        while True:
            t = self.base.transaction()
            kept = t.read(self.TABLE) if self.TABLE in t.base.versions else self.spark.createDataFrame([], KEPT)
            after = materialize(self._after(tables, kept), "fingerprints")
            others = kept.where(~F.col("table_name").isin(list(tables))) if tables else kept
            t.write(self.TABLE, after.unionByName(others))
            try:
                t.commit()
                break
            except Conflict:
                continue
        added = after.groupBy("table_name").agg(F.sum("row_count").alias("row_count"), F.bit_xor("xor_hash").alias("xor_hash"), F.sum("sum_hash").cast("decimal(38,0)").cast("string").alias("sum_hash"))
        names = self.spark.createDataFrame([(n,) for n in tables if n not in self.failed], "name string")
        found = names.join(added, F.col("name") == F.col("table_name"), "left")
        return found.select(F.col("name").alias("table_name"), F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"), F.coalesce("xor_hash", F.lit(0).cast("bigint")).alias("xor_hash"), F.coalesce("sum_hash", F.lit("0")).alias("sum_hash"))

    def _after(self, tables: dict[str, Watched], kept: DataFrame) -> DataFrame:
        """What is to be kept of these tables after a scan."""
        if not tables:
            return kept.limit(0)
        listed = union([t.files.select(F.lit(n).alias("table_name"), F.lit(t.rule).alias("rule"), "file_path", "file_size", "file_time") for n, t in tables.items()])
        now = materialize(listed, "files")
        same = ["table_name", "rule", "file_path", "file_size", "file_time"]
        changed: dict[str, list[str]] = {}
        for row in now.join(kept, same, "left_anti").select("table_name", "file_path").collect():  # paths of changed files
            changed.setdefault(row["table_name"], []).append(row["file_path"])
        known = {r["table_name"] for r in kept.select("table_name").distinct().collect()}

        def read(names: list[str]) -> DataFrame:
            one = lambda n: by_file(tables[n].read([unquote(p) for p in changed[n]] if n in known else None), tables[n])
            return materialize(union([one(n).select(F.lit(n).alias("t"), F.col("file_path").alias("f"), "row_count", "xor_hash", "sum_hash") for n in names]), "by-file")

        fresh, self.failed = spared(sorted(changed), read)
        self.files_read |= {n: len(p) for n, p in changed.items() if n not in self.failed}
        told = now.join(kept, same, "left_semi").join(kept, same)
        if fresh:
            measured = now.join(kept, same, "left_anti").where(~F.col("table_name").isin(list(self.failed)))
            met = measured.join(union(fresh), (F.col("table_name") == F.col("t")) & (F.col("file_path") == F.col("f")), "left")
            zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)  # noqa: E731  a file without rows is known too
            told = told.select(*same, "row_count", "xor_hash", "sum_hash").unionByName(met.select(*same, zero("row_count", "bigint"), zero("xor_hash", "bigint"), zero("sum_hash", "decimal(38,0)")))
        return told.where(~F.col("table_name").isin(list(self.failed))) if self.failed else told

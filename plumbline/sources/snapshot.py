"""Applying a change set to one table: a new version is written, counted, then pointed to.

Several tables change together in a VersionedDatabase (manifest.py). Readers follow the pointer file, so they see the old version or the new one, never half of one. A
failure leaves the pointer as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import render
from ..operators.compare import apply_changes
from .catalog import _files
from .store import kept

POINTER = "CURRENT"


class SnapshotTable:
    """Versions of a table under one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> str | None:
        fs, where = _files(self.spark, f"{self.path}/{POINTER}")
        return self.spark.read.text(f"{self.path}/{POINTER}").first()[0] if fs.exists(where) else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version()}")

    def write(self, df: DataFrame, expected_rows: int | None = None) -> str:
        """Writes df as the new version; raises, changing nothing, if its rows aren't as many as expected."""
        name = self._written(df, expected_rows)
        self.point_to(name)
        return name

    def _written(self, df: DataFrame, expected_rows: int | None) -> str:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        if expected_rows is not None and (found := self.spark.read.parquet(f"{self.path}/{name}").count()) != expected_rows:
            raise RuntimeError(f"the new version has {found} rows, not {expected_rows}; the old one stays")
        return name

    def point_to(self, name: str) -> None:
        """Writes a new pointer beside the old one and renames it over it."""
        fs, pointer = _files(self.spark, f"{self.path}/{POINTER}")
        jvm = self.spark.sparkContext._jvm
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{POINTER}-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(fresh, pointer, options)

    def prepare(self, change_set: DataFrame, keys: Iterable[str], written: bool = False) -> dict:
        """Writes and counts the version after a change set; readers don't see it before it is pointed to.

        The change set is read three times, so it is written first; written: it already comes from files.
        """
        started = time.time()
        if not written:
            with kept(change_set, "changes") as held:
                return self.prepare(held, keys, written=True)
        by_op = {r["op"]: r["n"] for r in change_set.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
        before = self.read()
        expected = before.count() + by_op.get("Insert", 0) - by_op.get("Delete", 0)
        version = self._written(apply_changes(before, change_set, keys), expected)
        return {"version": version, "rows": expected, "applied": by_op, "seconds": time.time() - started}

    def apply(self, change_set: DataFrame, keys: Iterable[str], written: bool = False) -> dict:
        """Applies inserts, updates and deletes; returns what was done."""
        done = self.prepare(change_set, keys, written)
        self.point_to(done["version"])
        return done

    def rebuild(self, columns: dict[str, str], renamed: dict[str, str] | None = None) -> str:
        """A new version with these columns (name: type, in order), from those of the same or the old name; new ones are null.

        For changes that no statement makes. All rows are copied and counted before the pointer moves; a value that a type
        can't hold fails the rebuild, and the old version stays.
        """
        before = self.read()
        there = {c.lower(): c for c in before.columns}
        old = {new: there.get((renamed or {}).get(new, new).lower()) for new in columns}
        shown = [(F.col(f"`{old[c]}`") if old[c] else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
        return self.write(before.select(*shown), before.count())


def stage(change_set: DataFrame, path: str) -> None:
    """The change set as files by operation, for changes too many to be statements."""
    change_set.withColumnRenamed("op", "_op").write.partitionBy("_op").parquet(path)


def staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed("_op", "op")


def write_csv(df: DataFrame, path: str) -> None:
    """Values are always quoted, quotes are doubled, null is nothing, lines end in a line feed.

    Spark's own writer quotes all or as needed, and with all takes null for the empty text; so lines are put together here
    and written as text.
    """
    quoted = lambda text: F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.coalesce(quoted(render(F.col(f"`{f.name}`"), f.dataType)), F.lit("")) for f in df.schema.fields]
    head = ",".join('"' + n.replace('"', '""') + '"' for n in df.columns)
    # a header in every file, as Spark's writer does
    lines = df.select(F.concat_ws(",", *cells).alias("value"))

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.mapInArrow(headed, "value string").write.option("lineSep", "\n").text(path)


class RunLog:
    """One JSON file a run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, entry: dict) -> str:
        name = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        body = json.dumps({"id": name} | entry)
        self.spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{self.path}/{name}")
        return name

    def latest(self, limit: int = 50) -> list[dict]:
        """Newest first."""
        fs, where = _files(self.spark, self.path)
        if not fs.exists(where):
            return []
        names = sorted((s.getPath().getName() for s in fs.listStatus(where)), reverse=True)[:limit]
        return [json.loads(self.spark.read.text(f"{self.path}/{n}", wholetext=True).first()[0]) for n in names]

"""The shared folder for tables written between steps: the one in spark.checkpoint.dir; without it, on one machine only, our own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "/tmp/checkpoints/plumbline"


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or DEFAULT_DIR).rstrip("/")


@contextmanager
def kept(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df from files in the shared folder, which are there inside the block only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(schema).parquet(path)
    finally:
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; the files go when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(schema).parquet(path)

"""Shared working folder: where operators write tables that later stages read again.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset on one
machine, as in tests, a folder of our own is used; a cluster that names none is refused. Written tables cut lineage, so a lost
executor costs the tasks it ran and no more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DEFAULT_DIR = "/tmp/checkpoints/plumbline"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, else, on one machine, our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (named or DEFAULT_DIR).rstrip("/")


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it again; also returns the path. What isn't discarded goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema: StructType = df.schema
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

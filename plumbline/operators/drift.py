"""What has changed on the target since a plan was reviewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import display, row_hash, row_text


def snapshot(classified: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """table_name, row_id (a digest of the key), row_key (the key to show) and target_hash (null for inserts) of all differences."""
    row_id = row_hash(row_text(classified.schema, keys))
    return classified.where("classification <> 'Same'").select(F.lit(table).alias("table_name"), row_id.alias("row_id"), display([F.col(f"`{k}`") for k in keys]).alias("row_key"), F.col("target_hash"))


def drift(reviewed: DataFrame, now: DataFrame) -> DataFrame:
    """table_name, row_key and kind: moved (other hash), settled (no difference any more), appeared."""
    on = (F.col("r.table_name") == F.col("n.table_name")) & (F.col("r.row_id") == F.col("n.row_id"))
    joined = reviewed.withColumn("here", F.lit(True)).alias("r").join(now.withColumn("here", F.lit(True)).alias("n"), on, "full_outer")
    kind = F.when(F.col("r.here").isNull(), "appeared").when(F.col("n.here").isNull(), "settled").when(~F.col("r.target_hash").eqNullSafe(F.col("n.target_hash")), "moved")
    return joined.select(F.coalesce("r.table_name", "n.table_name").alias("table_name"), F.coalesce("r.row_key", "n.row_key").alias("row_key"), kind.alias("kind")).where("kind is not null")


def drift_counts(found: DataFrame) -> DataFrame:
    """moved, settled and appeared by table."""
    return found.groupBy("table_name").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("moved", "settled", "appeared")])

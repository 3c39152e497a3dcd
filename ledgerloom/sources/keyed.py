"""Keyed tables that a merge rewrites only in the buckets it touches.

A table is a folder of ``bucket=N`` partitions; a row's bucket is a hash of its key. A
merge reads the buckets its batch has keys in, stores the merged rows aside, and replaces
those partitions; the files of all others stay as they are. The merged rows are stored
before anything is replaced, and a replayed merge gives the same table, so a run that is
lost in between is repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import stored

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def write_keyed(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table. One task writes one bucket; ``buckets`` is fixed for the table's life
    and should keep a bucket at a few hundred megabytes."""
    rows.withColumn("bucket", bucket_of(keys, buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def merge_keyed(spark: SparkSession, path: str, batch: DataFrame, keys: list[str],
                merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """``merge(stored rows, batch)`` over the touched buckets only, which are returned:
    at most ``buckets`` numbers. An empty batch touches nothing."""
    batch = stored(batch.withColumn("bucket", bucket_of(keys, buckets)), "merge-batch")
    touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())
    if not touched:
        return []
    table = spark.read.parquet(path)
    old = table.where(F.col("bucket").isin(touched)).drop("bucket")
    merged = merge(old, batch.drop("bucket"))
    merged = stored(merged.select(*old.columns).withColumn("bucket", bucket_of(keys, buckets)), "merge-result")
    (merged.repartition(min(len(touched), buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    return touched

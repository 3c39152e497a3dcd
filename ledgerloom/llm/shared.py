"""Tables and files in the folder all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver ends."""
    folder = f"{shared_folder(spark)}/ledgerloom-{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a table in the shared folder and read back: cuts the
    lineage, survives lost executors, and lets Spark plan with the true size."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(tables: list[DataFrame]) -> None:
    """The files of stored ``tables`` that no later step reads are deleted before the driver ends."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
        if path is not None:
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of tables that nothing refers to any more are removed when the driver
    collects its garbage; an iterative job asks for that now and then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, with a row key: rows that agree in both are one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .withColumn("key", F.xxhash64("doc_id", "text"))


def slots(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def open_target(uri: str):
    """(stream, finish): bytes go to a name of this attempt's own; ``finish`` closes
    the stream and gives the path. A manifest row names the file of the attempt that
    won; files of lost attempts are never read. Any store that Arrow reaches works."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    stream = store.open_output_stream(path, compression=None, buffer_size=1 << 20)

    def finish() -> str:
        stream.close()
        return uri

    return stream, finish


def open_source(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)

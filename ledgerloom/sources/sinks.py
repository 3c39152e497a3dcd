"""Append-only sinks: report history and evaluation snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = ("company_id INT, section STRING, line INT, label STRING, value DOUBLE, display STRING, "
               "period_start DATE, period_end DATE, generated_at TIMESTAMP, type STRING")
SNAPSHOT = "filename STRING, field STRING, status STRING"


def append_report(report: DataFrame, path: str, kind: str, period_start: str, period_end: str, generated_at) -> None:
    """Report rows with period and time, in a folder of the report's own key below its
    type: history of one type reads only its folder. A report that is committed already
    is left as it is, so a rerun or a retried driver cannot double it; the remains of an
    attempt that did not commit are replaced."""
    spark = report.sparkSession
    key = re.sub(r"[^0-9A-Za-z]+", "-", f"{period_start}_{period_end}_{generated_at}")
    folder = f"{path}/type={kind}/report={key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return
    (report.withColumns({"period_start": F.lit(period_start).cast("date"),
                         "period_end": F.lit(period_end).cast("date"),
                         "generated_at": F.lit(generated_at).cast("timestamp")})
     .write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder))


def report_history(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.schema(REPORT_ROWS + ", report STRING").parquet(path).drop("report")
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    return rows.orderBy(F.desc("generated_at"), "company_id", "section", "line", "label")


def save_snapshot(compared: DataFrame, path: str) -> None:
    compared.select("filename", "field", "status").write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path)

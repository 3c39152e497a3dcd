from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(spark, column: Column, values: list) -> list:
    """The column over one text column ``v``, in input order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [r[0] for r in rows.select("i", column.alias("out")).orderBy("i").select("out").collect()]


def rows_of(df: DataFrame, *order: str) -> list[tuple]:
    return [tuple(r) for r in df.orderBy(*order).collect()]


def words(spark, pages: dict, confidence: float = 1.0) -> DataFrame:
    """Words of printed pieces ``{doc_id: [(y, x, "text ...", page=0)]}``: 6 points
    per letter, a 6 point space, 12 points high."""
    out = []
    for doc_id, pieces in pages.items():
        n = 0
        for piece in pieces:
            y, x, body, page = (*piece, 0)[:4]
            at = float(x)
            for word in body.split():
                out.append((doc_id, page, n, word, at, float(y), at + 6.0 * len(word), y + 12.0, confidence))
                at += 6.0 * (len(word) + 1)
                n += 1
    return spark.createDataFrame(out, "doc_id STRING, page INT, word_idx INT, text STRING, x0 DOUBLE, y0 DOUBLE, "
                                      "x1 DOUBLE, y1 DOUBLE, confidence DOUBLE")


def documents(spark, pages: dict, confidence: float = 0.9) -> DataFrame:
    text = {d: "\n".join(w for piece in pieces for w in piece[2].split()) for d, pieces in pages.items()}
    return spark.createDataFrame([(d, t, confidence, "ocr") for d, t in text.items()],
                                 "doc_id STRING, text STRING, confidence DOUBLE, method STRING")


def by_doc(df: DataFrame) -> dict:
    return {r["doc_id"]: r for r in df.withColumn("doc_id", F.col("doc_id").cast("string")).collect()}

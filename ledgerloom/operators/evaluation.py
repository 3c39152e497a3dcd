"""Extraction quality: golden truth against actual output, and run-to-run diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.core import count_if, strip

FIELDS = ("document_type", "transactional", "vendor", "invoice_date", "total", "category")
AMOUNT_TOLERANCE = 0.005
UNVERIFIABLE = "UNVERIFIABLE"


def golden_join(golden: DataFrame, actual: DataFrame) -> DataFrame:
    g = golden.select("filename", F.struct(*[c for c in golden.columns if c != "filename"]).alias("g"))
    a = actual.select("filename", F.struct(*[c for c in actual.columns if c != "filename"]).alias("a"))
    return g.join(a, "filename", "full_outer").withColumn(
        "presence", F.when(F.col("a").isNull(), "missing").when(F.col("g").isNull(), "unexpected")
        .otherwise("matched"))


def _eval_date(text: Column) -> Column:
    """The five date spellings of golden sheets, day first."""
    value = strip(text)
    formats = ("yyyy-MM-dd", "d/M/yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)).cast("date") for f in formats])


def _equal(field: str, expected: Column, actual: Column) -> Column:
    if field == "total":
        return F.abs(expected - actual) <= AMOUNT_TOLERANCE
    if field == "invoice_date":
        return F.coalesce(_eval_date(expected) == _eval_date(actual), F.lit(False))
    if field == "transactional":
        return expected == actual
    return F.lower(strip(expected)) == F.lower(strip(actual))


def field_status(field: str) -> Column:
    kind, expected, actual = F.col(f"g.{field}_kind"), F.col(f"g.{field}"), F.col(f"a.{field}")
    blank = actual.isNull() if field in ("total", "transactional") else (actual.isNull() | (strip(actual) == ""))
    return (F.when(kind == "unknown", UNVERIFIABLE)
            .when(kind == "absent", F.when(blank, "CORRECT").otherwise("FALSE_POSITIVE"))
            .when(blank, "MISSING").when(_equal(field, expected, actual), "CORRECT").otherwise("INCORRECT"))


def compare_fields(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per document and field: (filename, field, status, review_status)."""
    matched = golden_join(golden, actual).where(F.col("presence") == "matched")
    statuses = F.array(*[F.struct(F.lit(f).alias("field"), field_status(f).alias("status")) for f in FIELDS])
    return matched.select("filename", F.col("a.review_status").alias("review_status"),
                          F.explode(statuses).alias("s")).select("filename", "s.field", "s.status", "review_status")


def field_accuracy(compared: DataFrame) -> DataFrame:
    status = F.col("status")
    return compared.groupBy("field").agg(
        count_if(status == "CORRECT").alias("correct"), count_if(status != UNVERIFIABLE).alias("verifiable"),
        count_if(status == "FALSE_POSITIVE").alias("false_positives"),
        *[count_if(F.col("review_status") == s).alias(s)
          for s in ("auto_processed", "needs_review", "needs_review_high_priority")])


def snapshot(compared: DataFrame) -> DataFrame:
    """The compact run record that is saved and compared later."""
    return compared.select("filename", "field", "status")


def diff_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed per (document, field). Rules apply in this order: equal, new
    false positive, left false positive, fixed, newly missing, newly incorrect,
    and anything else is a regression."""
    joined = before.select("filename", "field", F.col("status").alias("b")).join(
        after.select("filename", "field", F.col("status").alias("a")), ["filename", "field"], "full_outer")
    b, a = F.col("b"), F.col("a")
    change = (F.when(b.eqNullSafe(a), "unchanged").when(a == "FALSE_POSITIVE", "false_positives")
              .when(b == "FALSE_POSITIVE", "improvements")
              .when((a == "CORRECT") & b.isin("INCORRECT", "MISSING"), "improvements")
              .when((a == "MISSING") & (b == "CORRECT"), "newly_missing")
              .when((a == "INCORRECT") & (b == "CORRECT"), "newly_incorrect").otherwise("regressions"))
    return joined.select("filename", "field", change.alias("change"))

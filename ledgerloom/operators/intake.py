"""Document intake: filter, categorise, decide, and upsert without undoing people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.classify import attachment_filter, file_category, review_decision
from ledgerloom.operators.joins import sender_verdicts

ATTACHMENT_KEYS = ["account_id", "message_id", "attachment_index"]
MANUAL = "manual_override"
STUCK_HOURS = 1
MAIL_WINDOW_DAYS = 180


def decide(attachments: DataFrame, rules: DataFrame) -> DataFrame:
    """Attachments worth keeping, categorised and with a review status. Size and
    extension drop rows before the rule join sees them."""
    passed = attachments.where(attachment_filter("filename", "size").isNull())
    judged = sender_verdicts(passed, rules).withColumn("m", file_category("filename"))
    judged = judged.withColumn("d", review_decision("verdict", "m.confidence"))
    return judged.where(F.col("d.status").isNotNull()).select(
        *attachments.columns, F.col("m.category").alias("category"),
        F.col("m.confidence").alias("category_confidence"), F.lit("rule_based").alias("category_source"),
        F.col("d.status").alias("review_status"), F.col("d.reason").alias("review_reason"))


def upsert_respecting_overrides(stored: DataFrame, batch: DataFrame, keys: list[str] = ATTACHMENT_KEYS,
                                refreshed: tuple[str, ...] = ("filename", "mimetype", "size",
                                                              "provider_attachment_id")) -> DataFrame:
    """Merge a batch into the keyed table. Metadata is refreshed, a category a
    person set stays, and a stored review status is never recomputed. The key is
    unique on both sides, so a replayed batch gives the same table."""
    old = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("o"))
    new = batch.select(*keys, F.struct(*[c for c in batch.columns if c not in keys]).alias("n"))
    merged = old.join(new, keys, "full_outer")
    is_new, untouched = F.col("o").isNull(), F.col("n").isNull()
    kept_category = untouched | (F.col("o.category_source") == MANUAL)

    def pick(column: str, keep_old: Column) -> Column:
        if column not in batch.columns:
            return F.col(f"o.{column}").alias(column)
        if column not in stored.columns:
            return F.col(f"n.{column}").alias(column)
        return F.when(is_new, F.col(f"n.{column}")).when(keep_old, F.col(f"o.{column}")).otherwise(
            F.col(f"n.{column}")).alias(column)

    columns = []
    for column in [c for c in stored.columns if c not in keys]:
        if column in refreshed:
            columns.append(pick(column, untouched))
        elif column in ("category", "category_confidence", "category_source"):
            columns.append(pick(column, F.coalesce(kept_category, F.lit(False))))
        else:
            columns.append(pick(column, F.lit(True)))
    return merged.select(*keys, *columns)


def window_start(now: Column, window_days: int | None, cursor: Column, full_resync: bool = False) -> Column:
    """Where a walk begins: the later of the date window and the cursor. A full
    resync ignores the cursor but not the window; no limit gives null."""
    limits = []
    if window_days:
        limits.append(now - F.make_dt_interval(F.lit(window_days)))
    if not full_resync:
        limits.append(cursor)
    if not limits:
        return F.lit(None)
    return limits[0] if len(limits) == 1 else F.coalesce(F.greatest(*limits), *limits)


def backfill_start(cursor: Column, cursor_valid: Column, now: Column, days: int = MAIL_WINDOW_DAYS) -> Column:
    """A mailbox resumes at its cursor; one without a cursor, or whose cursor the
    provider no longer accepts, is read again from a bounded time back."""
    return F.coalesce(F.when(cursor_valid, cursor), now - F.make_dt_interval(F.lit(days)))


def incremental_window(files: DataFrame, conversations: DataFrame, now, window_days: int | None,
                       full_resync: bool = False, ts: str = "created_at") -> DataFrame:
    """Rows newer than each conversation's start; the start itself is excluded."""
    begin = window_start(F.lit(str(now)).cast("timestamp_ntz"), window_days, F.col("last_seen"), full_resync)
    starts = conversations.select("conversation_id", begin.alias("begin"))
    return (files.join(starts, "conversation_id").where(F.col("begin").isNull() | (F.col(ts) > F.col("begin")))
            .drop("begin"))


def fail_stuck_jobs(jobs: DataFrame, now, hours: int = STUCK_HOURS) -> DataFrame:
    """Jobs without progress end as failed: the message is added to their ``errors`` and
    ``completed_at`` is set; other jobs stay as they are."""
    cutoff = F.lit(str(now)).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return fail_jobs(jobs, F.col("status").isin("queued", "running") & (F.col("started_at") < cutoff), now, hours)


def fail_jobs(jobs: DataFrame, stuck: Column, now, hours: int = STUCK_HOURS) -> DataFrame:
    message = F.lit(f"No progress for over {hours}h")
    known = F.coalesce("errors", F.array().cast("array<string>"))
    return jobs.withColumns({
        "errors": F.when(stuck, F.array_append(known, message)).otherwise(F.col("errors")),
        "completed_at": F.when(stuck, F.lit(str(now)).cast("timestamp_ntz")).otherwise(F.col("completed_at")),
        "status": F.when(stuck, "failed").otherwise(F.col("status"))})

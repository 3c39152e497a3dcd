"""Structured Streaming jobs.

State lives in append-only logs: a micro-batch writes only its own rows to its own
folder (overwritten when the batch is replayed), and the current table is the log
folded by key. A batch therefore costs what the batch holds, not what the table
holds, and at-least-once delivery cannot count anything twice. The streaming
checkpoint is the cursor: it moves only after a batch has been written.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.predicates import bucket_date, is_scanned_sale
from ledgerloom.operators.changes import latest
from ledgerloom.operators.intake import ATTACHMENT_KEYS, MAIL_WINDOW_DAYS, MANUAL, STUCK_HOURS, backfill_start, decide
from ledgerloom.operators.skew import splittable_join
from ledgerloom.session import shared_folder
from ledgerloom.sources import schemas
from ledgerloom.sources.documents import feed_attachments

METADATA = ("filename", "mimetype", "size", "provider_attachment_id")
DECISION = ("category", "category_confidence", "category_source")
ATTACHMENT_LOG = ("account_id BIGINT, message_id BIGINT, attachment_index INT, filename STRING, mimetype STRING, "
                  "size BIGINT, provider_attachment_id STRING, category STRING, category_confidence DOUBLE, "
                  "category_source STRING, review_status STRING, review_reason STRING, batch BIGINT")
REVENUE_LOG = "company_id INT, bucket_day DATE, cents BIGINT, documents BIGINT, batch BIGINT"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Message feed as a stream of JSON files with a declared schema."""
    return (spark.readStream.schema(schemas.schema(schemas.FEED)).option("maxFilesPerTrigger", files_per_batch)
            .json(path))


def once_per_message(feed: DataFrame, delay: str = "30 days") -> DataFrame:
    """A message delivered again within the delay is seen once."""
    return (feed.withWatermark("received_at", delay)
            .dropDuplicatesWithinWatermark(["account_id", "message_id"]))


JOB_STATE = "job_id ARRAY<BIGINT>, seen_ms ARRAY<BIGINT>, deadline_ms ARRAY<BIGINT>"
OPEN = ("queued", "running")
#: Groups of jobs that share a state row: what a batch costs besides its rows.
JOB_GROUPS = 256


def stuck_jobs(events: DataFrame, hours: int = STUCK_HOURS, delay: str = "10 minutes", groups: int = JOB_GROUPS) -> DataFrame:
    """``(job_id, failed_at)`` of jobs that are still queued or running when event time has
    passed their start by more than ``hours``. ``events``: job_id, status, started_at, at (the
    event's time). A job's newest event sets or stops its timer, and what is kept of an ended
    job goes after the same time, so state is bounded by the jobs of the last hours, not by
    all jobs ever. Jobs are dealt by hash to a fixed number of groups, each with one state row
    and one timer, that of its earliest job: a call serves a group and not a single job."""
    span = hours * 3_600_000

    def millis(stamps: pd.Series) -> np.ndarray:
        return stamps.to_numpy("datetime64[ns]").view("int64") // 1_000_000

    def expiry(kept: pd.DataFrame) -> pd.Series:
        return kept["deadline"].where(kept["deadline"] >= 0, kept["seen"] + span)

    def arrived(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        found = [pd.DataFrame({"job": b["job_id"], "seen": millis(b["at"]), "ended": ~b["status"].isin(OPEN),
                               "deadline": millis(b["started_at"]) + span}) for b in batches]
        rows = pd.concat(found)
        rows["deadline"] = rows["deadline"].where(~rows["ended"], -1)
        return rows[rows["seen"] >= -1]

    def last_of_job(rows: pd.DataFrame) -> pd.DataFrame:
        """Each job's newest row; of equally new ones that which ends it, then the last."""
        return rows.sort_values(["job", "seen", "ended"], kind="stable").drop_duplicates("job", keep="last")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(dict(zip(("job", "seen", "deadline"), state.get if state.exists else ([], [], []), strict=True)), dtype="int64")
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            kept["ended"] = kept["deadline"] < 0
            kept = last_of_job(pd.concat([kept, arrived(batches)[kept.columns]])).drop(columns="ended")
        passed = expiry(kept) < now
        failed = kept[passed & (kept["deadline"] >= 0)]
        kept = kept[~passed]
        if len(kept):
            state.update(tuple(kept[c].tolist() for c in ("job", "seen", "deadline")))
            state.setTimeoutTimestamp(max(int(expiry(kept).min()), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": [None] * len(failed) if key[1] else failed["job"], "failed_at": pd.to_datetime(failed["deadline"], unit="ms")})

    keys = F.pmod(F.xxhash64("job_id"), F.lit(groups)).alias("job_group"), F.col("job_id").isNull().alias("no_id")
    dealt = events.select(*keys, F.coalesce("job_id", F.lit(0).cast("bigint")).alias("job_id"), "status", "started_at", "at")
    return dealt.withWatermark("at", delay).groupBy("job_group", "no_id").applyInPandasWithState(
        step, "job_id BIGINT, failed_at TIMESTAMP", JOB_STATE, "append", "EventTimeTimeout")


def sync_mailboxes(messages: DataFrame, cursors: DataFrame, log: str, cursor_log: str, run: int, now,
                   days: int = MAIL_WINDOW_DAYS) -> DataFrame:
    """One run over all mailboxes: what is newer than each one's committed cursor, or, where
    there is none or it has expired, than a bounded time back. The rows are written
    before the cursors, which move to the newest row written and nowhere if that fails;
    a rerun of the same ``run`` overwrites both. Returns the cursors now committed.

    ``messages``: account_id, received_at, ...; ``cursors``: account_id, cursor, valid."""
    spark = messages.sparkSession
    begin = backfill_start(F.col("cursor"), F.col("valid"), F.lit(str(now)).cast("timestamp_ntz"), days)
    fresh = splittable_join(messages, cursors.select("account_id", begin.alias("begin")), ["account_id"]).where(
        F.col("received_at") > F.col("begin")).drop("begin")
    append_batch(fresh, run, log)
    written = spark.read.parquet(f"{log}/batch={run}")
    moved = written.groupBy("account_id").agg(F.max("received_at").alias("cursor"), F.lit(True).alias("valid"))
    append_batch(moved, run, cursor_log)
    return committed_cursors(spark, cursor_log, cursors)


def committed_cursors(spark: SparkSession, cursor_log: str, initial: DataFrame) -> DataFrame:
    """The newest committed cursor of every mailbox, else the one it started with."""
    newest = spark.read.parquet(cursor_log).groupBy("account_id").agg(F.max("cursor").alias("committed"))
    return initial.join(newest, "account_id", "left").select(
        "account_id", F.coalesce("committed", "cursor").alias("cursor"), (F.col("committed").isNotNull() | F.col("valid")).alias("valid"))


def append_batch(batch: DataFrame, batch_id: int, log: str) -> None:
    batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")


def intake_stream(feed: DataFrame, rules: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Feed to decided attachments in the log. Rules are read again in every
    batch, so a new rule applies to attachments that arrive after it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(decide(batch.dropDuplicates(ATTACHMENT_KEYS), rules).select(
            *ATTACHMENT_KEYS, *METADATA, *DECISION, "review_status", "review_reason"), batch_id, log)

    return (feed_attachments(feed).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_log(spark: SparkSession, log: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(log)


def current_attachments(log: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The log folded by key: newest metadata and category, and the review status
    of the first sighting. Extremes per key combine inside each task, however
    often one message was delivered. ``overrides`` is the log of categories
    people set (keys, ``category, decided_at``); the latest one always wins."""
    def newest(*columns: str):
        return F.struct("batch", *columns)

    folded = log.groupBy(*ATTACHMENT_KEYS).agg(
        F.max(newest(*METADATA)).alias("m"), F.max(newest(*DECISION)).alias("c"),
        F.min(newest("review_status", "review_reason")).alias("r")).select(
        *ATTACHMENT_KEYS, *[F.col(f"m.{c}").alias(c) for c in METADATA],
        *[F.col(f"c.{c}").alias(c) for c in DECISION], "r.review_status", "r.review_reason")
    if overrides is None:
        return folded
    people = latest(overrides, ATTACHMENT_KEYS, ["decided_at", "category"], ["category"]).withColumnRenamed(
        "category", "chosen")
    chosen = F.col("chosen").isNotNull()
    return folded.join(people, ATTACHMENT_KEYS, "left").withColumns({
        "category": F.coalesce("chosen", "category"),
        "category_confidence": F.when(chosen, 1.0).otherwise(F.col("category_confidence")),
        "category_source": F.when(chosen, MANUAL).otherwise(F.col("category_source"))}).drop("chosen")


def compact(spark: SparkSession, log: str, into: str) -> None:
    """Rewrite a grown log as one batch 0 in a new folder."""
    append_batch(current_attachments(read_log(spark, log, ATTACHMENT_LOG)), 0, into)


def revenue_stream(invoices: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Scanned-sales revenue kept current per company and day. A batch writes what it
    adds to each day, and the fold adds up the batches: the stream keeps no state that
    could grow, and a document that arrives years late still counts."""
    cents = F.coalesce(F.round(F.col("total") * 100).cast("bigint"), F.lit(0))

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.groupBy("company_id", "bucket_day").agg(
            F.sum(cents).alias("cents"), F.count("*").alias("documents")), batch_id, log)

    scanned = invoices.where(is_scanned_sale()).withColumn("bucket_day", bucket_date())
    return (scanned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_revenue(log: DataFrame) -> DataFrame:
    return log.groupBy("company_id", "bucket_day").agg(F.sum("cents").alias("cents"), F.sum("documents").alias("documents"))


def revenue_of_day(log: DataFrame, day: str) -> DataFrame:
    """Each company's revenue of one day, today's for instance: other days are filtered
    where the log is read."""
    return daily_revenue(log.where(F.col("bucket_day") == F.lit(day).cast("date"))).select(
        "company_id", (F.col("cents") / F.lit(100.0)).alias("total"), F.col("documents").alias("count"))


def compact_revenue(spark: SparkSession, log: str, into: str) -> None:
    """Rewrite a grown revenue log as one batch 0 in a new folder."""
    append_batch(daily_revenue(read_log(spark, log, REVENUE_LOG)), 0, into)


def monthly_revenue(log: DataFrame) -> DataFrame:
    return daily_revenue(log).groupBy("company_id", F.date_format("bucket_day", "yyyy-MM").alias("month")).agg(
        (F.sum("cents") / F.lit(100.0)).alias("total"), F.sum("documents").alias("count"))

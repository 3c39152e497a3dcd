"""Streaming results equal their batch twins, also under replay and override."""

from __future__ import annotations

import json

from datetime import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import intake
from ledgerloom.streaming import jobs
from tests.helpers import rows_of


def _message(account: int, message: int, sender: str, name: str, size: int, at: str = "2024-01-01T00:00:00Z") -> str:
    return json.dumps({"account_id": account, "message_id": message, "thread_id": "t", "received_at": at,
                       "headers": {"From": sender, "Subject": "s"},
                       "attachments": [{"filename": name, "mimetype": "x", "size": size, "attachment_id": at}]})


def _run(spark, base) -> None:
    rules = spark.createDataFrame([(1, "spam.net", "deny"), (1, "ok@vendor.com", "allow"), (1, "vendor.com", "deny")],
                                  "account_id BIGINT, pattern STRING, action STRING")
    feed = jobs.read_feed(spark, f"{base}/in")
    jobs.intake_stream(feed, rules, f"{base}/log", f"{base}/ckpt").awaitTermination()


def _current(spark, base):
    return jobs.current_attachments(jobs.read_log(spark, f"{base}/log", jobs.ATTACHMENT_LOG))


def test_intake_overrides_and_redelivery(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join([
        _message(1, 1, "A <a@other.org>", "invoice_1.pdf", 50000), _message(1, 2, "b@spam.net", "invoice_2.pdf", 50000),
        _message(1, 3, "ok@vendor.com", "invoice_3.pdf", 50000), _message(1, 4, "c@other.org", "misc.docx", 50000),
        _message(1, 5, "c@other.org", "invoice_5.pdf", 10), _message(2, 6, "b@spam.net", "invoice_6.pdf", 50000)]))
    _run(spark, tmp_path)
    # ok@vendor.com is allowed by address and denied by domain: deny wins.
    assert rows_of(_current(spark, tmp_path).select("message_id", "review_status", "review_reason"), "message_id") == [
        (1, "imported", None), (4, "needs_review", "low_confidence"), (6, "imported", None)]

    overrides = spark.createDataFrame([(1, 1, 0, "Other", 1), (1, 1, 0, "Contracts", 2)],
                                      "account_id BIGINT, message_id BIGINT, attachment_index INT, category STRING, "
                                      "decided_at INT")
    (inbox / "2.json").write_text(_message(1, 1, "A <a@other.org>", "invoice_1_renamed.pdf", 60000,
                                           "2024-01-02T00:00:00Z"))
    _run(spark, tmp_path)
    log = jobs.read_log(spark, f"{tmp_path}/log", jobs.ATTACHMENT_LOG)
    row = jobs.current_attachments(log, overrides).where("message_id = 1").first()
    assert (row["category"], row["category_source"], row["review_status"], row["filename"], row["size"]) == (
        "Contracts", "manual_override", "imported", "invoice_1_renamed.pdf", 60000)

    before = rows_of(_current(spark, tmp_path), "message_id")
    _run(spark, tmp_path)  # nothing new: the checkpoint is the cursor
    assert rows_of(_current(spark, tmp_path), "message_id") == before
    jobs.compact(spark, f"{tmp_path}/log", f"{tmp_path}/log2")
    again = jobs.current_attachments(jobs.read_log(spark, f"{tmp_path}/log2", jobs.ATTACHMENT_LOG))
    assert rows_of(again, "message_id") == before


def test_stream_equals_batch(spark, tables, tmp_path):
    from ledgerloom.plans.stream_queries import _write_feed

    _write_feed(tables, f"{tmp_path}/in")
    feed = jobs.read_feed(spark, f"{tmp_path}/in", files_per_batch=1)
    jobs.intake_stream(feed, tables.v_sender_rule, f"{tmp_path}/log", f"{tmp_path}/ckpt").awaitTermination()
    columns = [*intake.ATTACHMENT_KEYS, "filename", "category", "review_status"]
    streamed = _current(spark, tmp_path).select(*columns)
    batch = intake.decide(tables.v_attachment, tables.v_sender_rule).select(*columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_redelivered_messages_are_seen_once_per_run(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.json").write_text(_message(1, 7, "a@b.org", "invoice.pdf", 50000))
    once = jobs.once_per_message(jobs.read_feed(spark, str(inbox), files_per_batch=1))
    query = once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_replaying_a_revenue_batch_changes_nothing(spark, tables, tmp_path):
    tables.v_sales.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(tables.v_sales.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.revenue_stream(stream, f"{tmp_path}/log", f"{tmp_path}/ckpt").awaitTermination()
    log = jobs.read_log(spark, f"{tmp_path}/log", jobs.REVENUE_LOG)
    assert log.select("batch").distinct().count() > 1
    before = rows_of(jobs.monthly_revenue(log), "company_id", "month")
    last = log.agg(F.max("batch")).first()[0]
    jobs.append_batch(spark.createDataFrame(log.where(F.col("batch") == last).drop("batch").collect(),
                                            log.drop("batch").schema), last, f"{tmp_path}/log")
    after = jobs.monthly_revenue(jobs.read_log(spark, f"{tmp_path}/log", jobs.REVENUE_LOG))
    assert rows_of(after, "company_id", "month") == before


def test_merge_leaves_untouched_files_alone(spark, tmp_path):
    from pathlib import Path

    from ledgerloom.sources import keyed

    row = "account_id BIGINT, message_id BIGINT, attachment_index INT, filename STRING, category STRING, category_source STRING, review_status STRING"
    path = f"{tmp_path}/table"
    old = spark.range(400).select(F.lit(1).cast("long").alias("account_id"), F.col("id").alias("message_id"), F.lit(0).alias("attachment_index"),
                                  F.lit("old").alias("filename"), F.lit("Other").alias("category"),
                                  F.when(F.col("id") % 2 == 0, intake.MANUAL).otherwise("rule_based").alias("category_source"),
                                  F.lit("imported").alias("review_status"))
    keyed.write_keyed(old, path, intake.ATTACHMENT_KEYS, 16)
    files = lambda: {(str(f.relative_to(path)), f.stat().st_mtime_ns) for f in Path(path).rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([(1, 2, 0, "new", "Invoices", "rule_based", "x"), (1, 3, 0, "new", "Invoices", "rule_based", "x"),
                                   (1, 999, 0, "new", "Invoices", "rule_based", "needs_review")], row)
    merge = intake.upsert_respecting_overrides
    touched = keyed.merge_keyed(spark, path, batch, intake.ATTACHMENT_KEYS, merge, 16)
    after = files()
    gone = {int(f.split("/")[0].removeprefix("bucket=")) for f, _ in before - after}
    assert 1 <= len(touched) <= 3 and gone <= set(touched) and len(before & after) >= len(before) - len(touched)
    read = lambda: rows_of(keyed.read_keyed(spark, path, row).where("message_id IN (2, 3, 4, 999)").select(
        "message_id", "filename", "category", "review_status"), "message_id")
    want = [(2, "new", "Other", "imported"), (3, "new", "Invoices", "imported"), (4, "old", "Other", "imported"), (999, "new", "Invoices", "needs_review")]
    assert read() == want and keyed.read_keyed(spark, path, row).count() == 401
    assert keyed.merge_keyed(spark, path, batch, intake.ATTACHMENT_KEYS, merge, 16) == touched and read() == want  # replayed
    assert keyed.merge_keyed(spark, path, batch.limit(0), intake.ATTACHMENT_KEYS, merge, 16) == []


def test_cursors_move_only_after_their_batch(spark, tmp_path, monkeypatch):
    import pytest

    stamp = lambda day: F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")
    messages = spark.range(1, 29).select(F.explode(F.expr("array(1L, 2L, 3L)")).alias("account_id"), "id").select(
        "account_id", F.col("id").alias("message_id"), (stamp(1) + F.make_dt_interval(F.col("id").cast("int") - 1)).alias("received_at"))
    cursors = spark.createDataFrame([(1, True), (2, False), (3, None)], "account_id BIGINT, valid BOOLEAN").select(
        "account_id", F.when(F.col("account_id") < 3, stamp(20)).alias("cursor"), "valid")
    log, cursor_log, write = f"{tmp_path}/log", f"{tmp_path}/cursors", jobs.append_batch

    def fails(batch, batch_id, path):
        if path == log:
            raise OSError("lost")
        write(batch, batch_id, path)

    monkeypatch.setattr(jobs, "append_batch", fails)
    with pytest.raises(OSError):
        jobs.sync_mailboxes(messages, cursors, log, cursor_log, 1, "2024-01-28 00:00:00", days=10)
    assert not (tmp_path / "cursors").exists()
    monkeypatch.setattr(jobs, "append_batch", write)
    moved = jobs.sync_mailboxes(messages, cursors, log, cursor_log, 1, "2024-01-28 00:00:00", days=10)
    got = spark.read.parquet(log).groupBy("account_id").agg(F.min("message_id").alias("first"), F.count("*").alias("n"))
    # the valid cursor excludes itself, expired and missing ones go ten days back
    assert rows_of(got, "account_id") == [(1, 21, 8), (2, 19, 10), (3, 19, 10)]
    assert {str(r["cursor"]) for r in moved.collect()} == {"2024-01-28 00:00:00"} and moved.where("valid").count() == 3
    jobs.sync_mailboxes(messages, moved, log, cursor_log, 2, "2024-01-28 00:00:00", days=10)
    assert spark.read.parquet(log).count() == 28


def test_stuck_jobs_keep_bounded_state(spark, tmp_path):
    """Timers fire for open jobs only, late events of ended jobs change nothing, and ended jobs leave the state."""
    at = lambda h, m=0: f"2024-01-0{1 + h // 24} {h % 24:02d}:{m:02d}:00"
    batches = [[(i, "running", at(0), at(0)) for i in range(50)] + [(100, "queued", at(0), at(0))],
               [(i, "completed", at(0), at(0, 30)) for i in range(0, 50, 2)] + [(100, "running", at(0, 45), at(0, 45))],
               [(200, "running", at(2), at(2))], [(201, "completed", at(9), at(9))], [(202, "completed", at(20), at(20))],
               [(203, "completed", at(30), at(30))]]
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "job_id BIGINT, status STRING, started_at STRING, at STRING").select(
            "job_id", "status", F.col("started_at").cast("timestamp"), F.col("at").cast("timestamp"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = jobs.stuck_jobs(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination()
    failed = {r["job_id"]: str(r["failed_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert failed == {i: "2024-01-01 01:00:00" for i in range(1, 50, 2)} | {100: "2024-01-01 01:45:00", 200: "2024-01-01 03:00:00"}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_many_jobs_share_a_state_row(spark, tmp_path):
    """State rows, and so calls into Python, are bounded by the groups, not by the open jobs; ends, ties and missing ids count as before."""
    schema = "job_id BIGINT, status STRING, started_at TIMESTAMP, at TIMESTAMP"
    stamp = lambda h, m=0: datetime(2024, 1, 1, h, m)
    first = [(i, "running", stamp(0), stamp(0)) for i in range(500)] + [(None, "queued", stamp(0), stamp(0))]
    second = ([(i, "completed", stamp(0), stamp(0, 30)) for i in range(250)] + [(250, "completed", stamp(0), stamp(0)), (251, None, stamp(0), stamp(0, 5))]
              + [(252, "running", stamp(0, 55), stamp(0, 55)), (900, "running", stamp(1), stamp(1))])
    for i, rows in enumerate([first, second, [(901, "failed", stamp(9), stamp(9))], [(902, "failed", stamp(20), stamp(20))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = jobs.stuck_jobs(stream, groups=4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination()
    failed = {r["job_id"]: str(r["failed_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert failed == {i: "2024-01-01 01:00:00" for i in [*range(253, 500), None]} | {252: "2024-01-01 01:55:00", 900: "2024-01-01 02:00:00"}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 5


def test_late_documents_count_and_no_state_is_kept(spark, tables, tmp_path):
    tables.v_sales.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(tables.v_sales.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = jobs.revenue_stream(stream, f"{tmp_path}/log", f"{tmp_path}/ckpt")
    query.awaitTermination()
    assert query.lastProgress["stateOperators"] == []
    log = jobs.read_log(spark, f"{tmp_path}/log", jobs.REVENUE_LOG)
    jobs.compact_revenue(spark, f"{tmp_path}/log", f"{tmp_path}/log2")
    again = jobs.read_log(spark, f"{tmp_path}/log2", jobs.REVENUE_LOG)
    assert rows_of(jobs.daily_revenue(again), "company_id", "bucket_day") == rows_of(jobs.daily_revenue(log), "company_id", "bucket_day")
    assert log.count() > again.count()


def test_a_report_is_saved_once(spark, tmp_path):
    from pathlib import Path

    from ledgerloom.sources import sinks

    report = spark.createDataFrame([(1, "income", 1, "Sales", 5.0, "PKR 5")], "company_id INT, section STRING, line INT, label STRING, value DOUBLE, display STRING")
    save = lambda at: sinks.append_report(report, str(tmp_path), "profit_loss", "2024-01-01", "2024-01-31", at)
    save("2024-02-01 10:00:00")
    save("2024-02-01 10:00:00")
    assert sinks.report_history(spark, str(tmp_path)).count() == 1
    # an attempt that wrote files and did not commit is replaced
    for marker in Path(tmp_path).rglob("*_SUCCESS*"):
        marker.unlink()
    save("2024-02-01 10:00:00")
    save("2024-02-02 10:00:00")
    assert sinks.report_history(spark, str(tmp_path), "profit_loss").count() == 2

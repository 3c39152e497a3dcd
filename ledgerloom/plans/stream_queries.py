"""Streaming jobs run to completion over feeds written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluation, intake
from ledgerloom.plans import reports
from ledgerloom.plans.catalog import BUCKET, SCANNED, cents, query, seconds
from ledgerloom.plans.change_queries import COMPARED_SQL
from ledgerloom.plans.catalog import ORACLES
from ledgerloom.plans.feed_queries import DECIDED_SQL, STUCK_SQL
from ledgerloom.plans.ledger_queries import END, START
from ledgerloom.sources import documents, sinks
from ledgerloom.sources.fixtures import FEED_NOW, VIEWS
from ledgerloom.streaming import jobs

assert ORACLES and VIEWS  # the catalogue modules above are loaded first


def _write_feed(t, path: str, files: int = 4) -> None:
    feed = t.v_attachment.select(
        "account_id", "message_id", F.concat(F.lit("t"), F.col("message_id")).alias("thread_id"),
        F.col("received_at").cast("timestamp").alias("received_at"),
        F.create_map(F.lit("From"), F.concat(F.lit("Sender <"), "from_address", F.lit(">")), F.lit("Subject"),
                     F.col("subject"), F.lit("X-Trace"), F.lit("1")).alias("headers"),
        F.array(F.struct("filename", "mimetype", "size", F.col("provider_attachment_id").alias("attachment_id")))
        .alias("attachments"))
    feed.repartition(files).write.json(path)


@query("S06_document_feed", "SELECT account_id, message_id, attachment_index, lower(from_address) AS from_address, filename, size FROM v_attachment")
def document_feed(t):
    base = jobs.scratch(t.spark, "feed")
    _write_feed(t, f"{base}/in")
    rows = documents.feed_attachments(jobs.read_feed(t.spark, f"{base}/in"))
    rows.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select(
        "account_id", "message_id", "attachment_index", F.lower("from_address").alias("from_address"), "filename",
        "size")


@query("K01_intake_stream", f"SELECT message_id, filename, category, category_confidence, review_status, review_reason FROM ({DECIDED_SQL})")
def intake_stream(t):
    base = jobs.scratch(t.spark, "intake")
    _write_feed(t, f"{base}/in")
    feed = jobs.read_feed(t.spark, f"{base}/in", files_per_batch=2)
    jobs.intake_stream(feed, t.v_sender_rule, f"{base}/log", f"{base}/ckpt").awaitTermination()
    log = jobs.read_log(t.spark, f"{base}/log", jobs.ATTACHMENT_LOG)
    return jobs.current_attachments(log).select("message_id", "filename", "category", "category_confidence",
                                                "review_status", "review_reason")


@query("K05_cursor_commit", f"SELECT COUNT(*) AS attachments, {cents('size')} AS bytes FROM ({DECIDED_SQL})")
def cursor_commit(t):
    """Two runs on one checkpoint, the second after redelivery: nothing counts twice."""
    base = jobs.scratch(t.spark, "cursor")
    _write_feed(t, f"{base}/in/first")
    for step in ("first", "again"):
        if step == "again":
            _write_feed(t, f"{base}/in/again")
        feed = jobs.read_feed(t.spark, f"{base}/in/*", files_per_batch=3)
        jobs.intake_stream(feed, t.v_sender_rule, f"{base}/log", f"{base}/ckpt").awaitTermination()
    current = jobs.current_attachments(jobs.read_log(t.spark, f"{base}/log", jobs.ATTACHMENT_LOG))
    return current.agg(F.count("*").alias("attachments"), (F.sum("size") * 1.0).alias("bytes"))


@query("K07_monthly_revenue_stream", f"SELECT company_id, strftime({BUCKET}, '%Y-%m') AS month, {cents('total')} AS total, COUNT(*) AS count FROM v_sales WHERE {SCANNED} GROUP BY ALL")
def monthly_revenue_stream(t):
    base = jobs.scratch(t.spark, "revenue")
    t.v_sales.repartition(4).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(t.v_sales.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    jobs.revenue_stream(stream, f"{base}/log", f"{base}/ckpt").awaitTermination()
    return jobs.monthly_revenue(jobs.read_log(t.spark, f"{base}/log", jobs.REVENUE_LOG))


@query("K07_day_revenue", f"SELECT company_id, {cents('total')} AS total, COUNT(*) AS count FROM v_sales WHERE {SCANNED} AND {BUCKET} = DATE '{END}' GROUP BY company_id")
def day_revenue(t):
    """One day, after the log of a first run was compacted and late documents came in a second."""
    base = jobs.scratch(t.spark, "day-revenue")
    for step, part in (("first", F.col("invoice_id") % 3 > 0), ("late", F.col("invoice_id") % 3 == 0)):
        t.v_sales.where(part).repartition(2).write.parquet(f"{base}/in/{step}")
        stream = t.spark.readStream.schema(t.v_sales.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/{step}")
        jobs.revenue_stream(stream, f"{base}/{step}", f"{base}/ckpt-{step}").awaitTermination()
    jobs.compact_revenue(t.spark, f"{base}/first", f"{base}/log")
    late = jobs.read_log(t.spark, f"{base}/late", jobs.REVENUE_LOG)
    return jobs.revenue_of_day(jobs.read_log(t.spark, f"{base}/log", jobs.REVENUE_LOG).unionByName(late), END)


@query("K02_dedupe_in_run", f"""
SELECT account_id, message_id, attachment_index, filename, {seconds('received_at')} AS received_at FROM v_attachment""")
def dedupe_in_run(t):
    """A feed that delivers every message again in later files, read as one stream."""
    base = jobs.scratch(t.spark, "redelivery")
    # A file for every part the table is read in, so that no task writes or reads a fixed share of all messages.
    parts = t.v_attachment.rdd.getNumPartitions()
    _write_feed(t, f"{base}/in/first", 3 * parts)
    _write_feed(t, f"{base}/in/second", 2 * parts)
    feed = jobs.read_feed(t.spark, f"{base}/in/*", files_per_batch=2 * parts)
    rows = documents.feed_attachments(jobs.once_per_message(feed, "90 days"))
    rows.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("account_id", "message_id", "attachment_index", "filename", "received_at")


@query("K05_expired_cursor", f"""
SELECT account_id, message_id, filename, {seconds('received_at')} AS received_at FROM v_attachment
WHERE received_at > CASE WHEN account_id % 3 = 0 THEN TIMESTAMP '{FEED_NOW}' - INTERVAL 20 DAY ELSE TIMESTAMP '2024-01-15 00:00:00' + account_id * INTERVAL 1 HOUR END""")
def expired_cursor(t):
    """Mailboxes resume at their cursors, expired ones a bounded time back; a second run
    over the same messages finds nothing new."""
    base = jobs.scratch(t.spark, "cursors")
    account = F.col("account_id")
    start = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=account.cast("int"))
    cursors = t.v_attachment.select("account_id").distinct().select(account, start.alias("cursor"), (account % 3 != 0).alias("valid"))
    messages = t.v_attachment.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    for run in (1, 2):
        cursors = jobs.sync_mailboxes(messages, cursors, f"{base}/log", f"{base}/cursors", run, FEED_NOW, days=20)
    return t.spark.read.parquet(f"{base}/log").select("account_id", "message_id", "filename", "received_at")


@query("K06_stuck_jobs_stream", STUCK_SQL)
def stuck_jobs_stream(t):
    """Job events as a stream in order of time, then a clock tick; a timer per open job."""
    base = jobs.scratch(t.spark, "jobs")
    stamp = lambda c: F.col(c).cast("timestamp")
    begun = t.v_job.select("job_id", F.when(F.col("completed_at").isNull(), F.col("status")).otherwise("running").alias("status"),
                           stamp("started_at").alias("started_at"), stamp("started_at").alias("at"))
    ended = t.v_job.where("completed_at IS NOT NULL").select("job_id", "status", stamp("started_at").alias("started_at"),
                                                             stamp("completed_at").alias("at"))
    now = F.lit(FEED_NOW).cast("timestamp")
    events = begun.unionByName(ended).where(F.col("at") <= now)  # what has happened by now
    tick = t.spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit("tick").alias("status"), now.alias("started_at"),
                                   (now + F.expr("INTERVAL 10 MINUTES")).alias("at"))
    edges = ["1970-01-01", "2024-01-08", "2024-01-16", "2024-01-24", "9999-01-01"]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        events.where((F.col("at") >= a) & (F.col("at") < b)).coalesce(1).write.parquet(f"{base}/in/{i}")
    for i in (8, 9):
        tick.coalesce(1).write.parquet(f"{base}/in/{i}")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    jobs.stuck_jobs(stream).writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    failed = t.spark.read.parquet(f"{base}/out").select("job_id", F.lit(True).alias("timed_out")).distinct()
    marked = t.v_job.join(failed, "job_id", "left")
    return intake.fail_jobs(marked, F.coalesce("timed_out", F.lit(False)), FEED_NOW).select("job_id", "status", "errors", "completed_at")


@query("K08_thread_attachments", """
SELECT conversation_id, message_ts, thread_ts, shared_by, CAST(0 AS INT) AS file_index, filename, size FROM (
  SELECT conversation_id, message_ts, NULL AS thread_ts, concat('u', CAST(installation_id AS VARCHAR)) AS shared_by, filename, size FROM v_chat_file
  UNION ALL SELECT conversation_id, concat(message_ts, '1'), message_ts, 'replier', concat('reply ', filename), size + 1 FROM v_chat_file)""")
def thread_attachments(t):
    files = lambda name, size: F.array(F.struct(name.alias("filename"), size.alias("size")))
    reply = lambda ts, user, fs: F.struct(ts.alias("ts"), user.alias("user"), fs.alias("files"))
    own = files(F.col("filename"), F.col("size"))
    user = F.concat(F.lit("u"), F.col("installation_id").cast("string"))
    messages = t.v_chat_file.select(
        "conversation_id", F.col("message_ts").alias("ts"), user.alias("user"), own.alias("files"),
        F.array(reply(F.col("message_ts"), user, own),
                reply(F.concat("message_ts", F.lit("1")), F.lit("replier"),
                      files(F.concat(F.lit("reply "), "filename"), F.col("size") + 1))).alias("replies"))
    return documents.thread_attachments(messages)


@query("S04_words_source", """
SELECT doc_id, CAST(page - 1 AS INT) AS page, CAST(word_idx - 1 AS INT) AS word_idx, w AS text, CAST(length(w) AS DOUBLE) AS x1 FROM (
  SELECT doc_id, page, unnest(string_split(body, ' ')) AS w, generate_subscripts(string_split(body, ' '), 1) AS word_idx FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents))""")
def words_source(t):
    word = lambda w, p: F.struct(
        w.alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.length(w).cast("double").alias("x1"),
        F.lit(12.0).alias("y1"), p.alias("page"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("double").alias("font_size"))
    results = t.documents.select("doc_id", F.transform(
        F.split("text", "\n"), lambda page, p: F.transform(F.split(page, " "), lambda w: word(w, p)))
        .alias("words_by_page"))
    return documents.words_from_pages(results).select("doc_id", "page", "word_idx", "text", "x1")


_REPORT_SQL = ORACLES["R01_report_profit_loss"]


def _saved_reports(t):
    base = jobs.scratch(t.spark, "reports")
    report = reports.profit_loss(t.v_sales, t.v_expense, START, END)
    sinks.append_report(report, f"{base}/reports", "profit_loss", START, END, "2001-07-31 18:00:00")
    sinks.append_report(reports.cash_position(t.v_sales, t.v_expense, END), f"{base}/reports", "cash_position", END,
                        END, "2001-07-31 19:00:00")
    return f"{base}/reports"


@query("S08_report_sink", f"SELECT company_id, section, line, label, value, display, '{START}' AS period_start, '{END}' AS period_end, 'profit_loss' AS type FROM ({_REPORT_SQL})")
def report_sink(t):
    return sinks.report_history(t.spark, _saved_reports(t), "profit_loss").select(
        "company_id", "section", "line", "label", "value", "display", "period_start", "period_end", "type")


@query("R08_report_history", f"""
SELECT 'profit_loss' AS type, '2001-07-31 18:00:00' AS generated_at, company_id, COUNT(*) AS lines FROM ({_REPORT_SQL}) GROUP BY company_id
UNION ALL SELECT DISTINCT 'cash_position', '2001-07-31 19:00:00', company_id, CAST(1 AS BIGINT) FROM v_sales""")
def report_history(t):
    return sinks.report_history(t.spark, _saved_reports(t)).groupBy("type", "generated_at", "company_id").agg(
        F.count("*").alias("lines"))


@query("S10_eval_snapshot", f"SELECT filename, field, status FROM ({COMPARED_SQL})")
def eval_snapshot(t):
    path = f"{jobs.scratch(t.spark, 'snapshot')}/run"
    sinks.save_snapshot(evaluation.compare_fields(t.v_golden, t.v_actual), path)
    return sinks.load_snapshot(t.spark, path)

"""Document sources and intake, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.classify import review_decision, file_category
from ledgerloom.operators import intake, joins
from ledgerloom.plans.catalog import query, seconds
from ledgerloom.plans.text_queries import FILTER_SQL, file_category_sql
from ledgerloom.sources import documents, keyed
from ledgerloom.sources.fixtures import FEED_NOW
from ledgerloom.streaming import jobs

_CONF = "CAST(json_extract_string(j, '$.{0}.confidence') AS DOUBLE)"
_HAS = "json_extract_string(j, '$.{0}.value') IS NOT NULL"


def _status(field: str) -> str:
    return f"CASE WHEN {_HAS.format(field)} THEN COALESCE(NULLIF(json_extract_string(j, '$.{field}.status'), ''), CASE WHEN COALESCE({_CONF.format(field)}, 0) >= 0.5 THEN 'FOUND' ELSE 'UNCERTAIN' END) END"


@query("S03_extraction_json", f"""
SELECT invoice_id, CASE WHEN {_HAS.format('vendor_name')} THEN {_CONF.format('vendor_name')} END AS vendor_confidence, CASE WHEN {_HAS.format('total')} THEN {_CONF.format('total')} END AS total_confidence,
  CASE WHEN {_HAS.format('total')} THEN CAST(json_extract_string(j, '$.total.page') AS INT) END AS total_page, json_extract_string(j, '$.currency.value') AS currency, {_status('currency')} AS currency_status,
  json_extract_string(j, '$.document_type.value') AS document_type, json_extract_string(j, '$.classification_reason') AS reason FROM (SELECT invoice_id, raw_extraction_json AS j FROM v_extraction)""")
def extraction_json(t):
    get = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return documents.extraction_views(t.v_extraction).select(
        "invoice_id", get("field_confidence", "vendor_name").alias("vendor_confidence"),
        get("field_confidence", "total").alias("total_confidence"),
        get("field_locations", "total")["page"].alias("total_page"),
        get("extracted_fields", "currency")["value"].alias("currency"),
        get("extracted_fields", "currency")["status"].alias("currency_status"),
        F.col("detected_document_type").alias("document_type"), F.col("classification_reason").alias("reason"))


@query("S07_message_headers", """
SELECT message_id, NULLIF(trim(trim(regexp_extract(from_header, '^([^<]*)<[^<>]+>', 1)), '"'), '') AS from_name,
  COALESCE(NULLIF(regexp_extract(from_header, '<\\s*([^<>\\s]+)\\s*>', 1), ''), NULLIF(regexp_extract(from_header, '^\\s*([^<>\\s"]+@[^<>\\s"]+)\\s*$', 1), '')) AS from_address,
  NULLIF(regexp_extract(to_header, '<\\s*([^<>\\s]+)\\s*>', 1), '') AS to_address, subject_header AS subject, CAST(3 + CASE WHEN from_header IS NULL THEN 0 ELSE 1 END AS INT) AS kept FROM v_mail""")
def message_headers(t):
    names = ["From", "Subject", "To", "Date", "X-Mailer"]
    values = [F.col("from_header"), F.col("subject_header"), F.col("to_header"), F.col("date_header"), F.lit("x")]
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v in zip(names, values)]
    mail = t.v_mail.withColumn("headers", F.map_from_entries(F.array_compact(F.array(*pairs))))
    return documents.message_headers(mail).select("message_id", "from_name", "from_address", "to_address", "subject",
                                                  F.size("headers").alias("kept"))


@query("S09_unified_documents", """
SELECT source, document_id, filename, title, mimetype, size, category, conversation_id, category IN ('Invoices', 'Receipts', 'Spreadsheets & Financial') AS scanner_eligible FROM (
  SELECT 'chat' AS source, file_id AS document_id, filename, title, mimetype, size, category, conversation_id FROM v_chat_file
  UNION ALL SELECT 'email', concat(CAST(message_id AS VARCHAR), '/', CAST(attachment_index AS VARCHAR)), filename, subject, mimetype, size, COALESCE({0}, 'uncategorized'), NULL FROM v_attachment
  UNION ALL SELECT 'browser', CAST(upload_id AS VARCHAR), filename, NULL, NULL, size, category, NULL FROM v_upload)""".replace("{0}", file_category_sql("filename", "category")))
def unified_documents(t):
    chat = t.v_chat_file.select(F.col("file_id").alias("document_id"), "filename", "title", "mimetype", "size",
                                "category", "conversation_id")
    mail = t.v_attachment.select(F.concat_ws("/", "message_id", "attachment_index").alias("document_id"), "filename",
                                 F.col("subject").alias("title"), "mimetype", "size",
                                 file_category("filename")["category"].alias("category"))
    uploads = t.v_upload.select(F.col("upload_id").cast("string").alias("document_id"), "filename", "size",
                                "category")
    return documents.unified_documents(chat, mail, uploads)


VERDICT_SQL = """SELECT a.*, CASE WHEN bool_or(r.action = 'deny') THEN 'deny' WHEN bool_or(r.action = 'allow') THEN 'allow' END AS verdict
  FROM v_attachment a LEFT JOIN (SELECT account_id, lower(trim(pattern)) AS pattern, action FROM v_sender_rule) r
    ON r.account_id = a.account_id AND (CASE WHEN contains(r.pattern, '@') THEN lower(trim(a.from_address)) = r.pattern ELSE split_part(lower(trim(a.from_address)), '@', 2) = r.pattern END) GROUP BY ALL"""


@query("J15_sender_verdicts", f"SELECT message_id, verdict FROM ({VERDICT_SQL})")
def sender_verdicts(t):
    return joins.sender_verdicts(t.v_attachment, t.v_sender_rule).select("message_id", "verdict")


JUDGED_SQL = f"""SELECT *, COALESCE({file_category_sql('filename', 'category')}, 'uncategorized') AS category, COALESCE({file_category_sql('filename', 'confidence')}, 0e0) AS category_confidence FROM ({VERDICT_SQL})"""
STATUS_SQL = "CASE WHEN verdict = 'deny' THEN NULL WHEN verdict = 'allow' OR category_confidence >= 0.7 THEN 'imported' ELSE 'needs_review' END"
REASON_SQL = "CASE WHEN verdict = 'deny' THEN 'denied_sender' WHEN verdict = 'allow' THEN 'allowed_sender' WHEN category_confidence >= 0.7 THEN NULL ELSE 'low_confidence' END"


@query("X16_review_decision", f"SELECT message_id, {STATUS_SQL} AS status, {REASON_SQL} AS reason FROM ({JUDGED_SQL})")
def review_decisions(t):
    judged = joins.sender_verdicts(t.v_attachment, t.v_sender_rule).withColumn("m", file_category("filename"))
    return judged.select("message_id", review_decision("verdict", "m.confidence").alias("d")).select("message_id",
                                                                                                     "d.*")


DECIDED_SQL = f"SELECT *, 'rule_based' AS category_source, {STATUS_SQL} AS review_status, {REASON_SQL} AS review_reason FROM ({JUDGED_SQL}) WHERE {FILTER_SQL} IS NULL AND {STATUS_SQL} IS NOT NULL"


@query("K01_intake_batch", f"SELECT message_id, filename, category, category_confidence, review_status, review_reason FROM ({DECIDED_SQL})")
def intake_batch(t):
    return intake.decide(t.v_attachment, t.v_sender_rule).select(
        "message_id", "filename", "category", "category_confidence", "review_status", "review_reason")


UPSERT_SQL = f"""
SELECT account_id, message_id, attachment_index, CASE WHEN n.message_id IS NULL THEN o.filename ELSE n.filename END AS filename, CASE WHEN n.message_id IS NULL THEN o.size ELSE n.size END AS size,
  CASE WHEN n.message_id IS NULL THEN o.provider_attachment_id ELSE n.provider_attachment_id END AS provider_attachment_id,
  CASE WHEN n.message_id IS NULL OR o.category_source = 'manual_override' THEN o.category ELSE n.category END AS category, CASE WHEN n.message_id IS NULL OR o.category_source = 'manual_override' THEN o.category_source ELSE n.category_source END AS category_source,
  CASE WHEN o.message_id IS NULL THEN n.review_status ELSE o.review_status END AS review_status
FROM v_stored_attachment o FULL OUTER JOIN ({DECIDED_SQL}) n USING (account_id, message_id, attachment_index)"""


@query("K03_upsert_respecting_overrides", UPSERT_SQL)
def upsert_respecting_overrides(t):
    return intake.upsert_respecting_overrides(t.v_stored_attachment, intake.decide(t.v_attachment, t.v_sender_rule)) \
        .select("account_id", "message_id", "attachment_index", "filename", "size", "provider_attachment_id",
                "category", "category_source", "review_status")


@query("K03_merge_touched_buckets", UPSERT_SQL)
def merge_touched_buckets(t):
    """The same upsert into a stored table, in two batches and the first once more."""
    path = f"{jobs.scratch(t.spark, 'attachments')}/table"
    keyed.write_keyed(t.v_stored_attachment, path, intake.ATTACHMENT_KEYS)
    decided = intake.decide(t.v_attachment, t.v_sender_rule)
    odd = F.col("message_id") % 2 == 1
    for batch in (decided.where(odd), decided.where(~odd), decided.where(odd)):
        keyed.merge_keyed(t.spark, path, batch, intake.ATTACHMENT_KEYS, intake.upsert_respecting_overrides)
    return t.spark.read.parquet(path).select("account_id", "message_id", "attachment_index", "filename", "size", "provider_attachment_id",
                                             "category", "category_source", "review_status")


@query("K04_incremental_window", f"""
SELECT f.file_id, f.conversation_id, {seconds('f.created_at')} AS created_at FROM v_chat_file f JOIN v_conversation c USING (conversation_id)
WHERE f.created_at > greatest(TIMESTAMP '{FEED_NOW}' - INTERVAL 14 DAY, COALESCE(c.last_seen, TIMESTAMP '1970-01-01 00:00:00'))""")
def incremental_window(t):
    return intake.incremental_window(t.v_chat_file, t.v_conversation, FEED_NOW, 14).select(
        "file_id", "conversation_id", "created_at")


_STUCK = f"status IN ('queued', 'running') AND started_at < TIMESTAMP '{FEED_NOW}' - INTERVAL 1 HOUR"


_ENDED = f"CASE WHEN {_STUCK} THEN TIMESTAMP '{FEED_NOW}' ELSE completed_at END"


STUCK_SQL = f"""
SELECT job_id, CASE WHEN {_STUCK} THEN 'failed' ELSE status END AS status,
  concat_ws('|', array_to_string(errors, '|'), CASE WHEN {_STUCK} THEN 'No progress for over 1h' END) AS errors, {seconds(_ENDED)} AS completed_at FROM v_job"""


@query("K06_stuck_jobs", STUCK_SQL)
def stuck_jobs(t):
    return intake.fail_stuck_jobs(t.v_job, FEED_NOW).select("job_id", "status", "errors", "completed_at")


@query("K09_due_accounts", """
SELECT account_id FROM v_account a WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM v_job j WHERE j.account_id = a.account_id AND j.status IN ('queued', 'running'))""")
def due_accounts(t):
    return joins.due_accounts(t.v_account, t.v_job).select("account_id")

"""Duplicates, decision logs, and extraction quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.predicates import day
from ledgerloom.operators import changes, evaluation, joins
from ledgerloom.plans.catalog import cents, count_if, query
from ledgerloom.plans.ledger_queries import TO_PROCESS_SQL
from ledgerloom.plans.text_queries import _normalize_sql
from ledgerloom.sources.fixtures import AS_OF


@query("D01_exact_duplicates", "SELECT company_id, sha256(content) AS file_hash, min(upload_id) AS kept_id, COUNT(*) AS copies FROM v_upload GROUP BY ALL HAVING COUNT(*) > 1")
def exact_duplicates(t):
    return changes.exact_duplicates(t.v_upload)


@query("D01_duplicate_members", "SELECT company_id, file_hash, upload_id, kept_id FROM (SELECT company_id, sha256(content) AS file_hash, upload_id, min(upload_id) OVER w AS kept_id, COUNT(*) OVER w AS copies FROM v_upload WINDOW w AS (PARTITION BY company_id, sha256(content))) WHERE copies > 1")
def exact_duplicate_members(t):
    return changes.exact_duplicate_members(t.v_upload)


_KEYED = f"SELECT company_id, {_normalize_sql('vendor_name')} AS vendor, lower(trim(invoice_number)) AS number, round(total, 2) AS total, CAST(invoice_date AS VARCHAR) AS day, invoice_id FROM {{0}} WHERE vendor_name IS NOT NULL AND invoice_number IS NOT NULL AND total IS NOT NULL AND invoice_date IS NOT NULL"


@query("D02_likely_duplicates", f"""
SELECT company_id, vendor, number, total, day, COUNT(*) AS copies, min(invoice_id) AS kept_id FROM (
  {_KEYED.format('v_purchase')} UNION ALL {_KEYED.format("(SELECT *  REPLACE (concat('rescan-', invoice_id) AS invoice_id, concat(vendor_name, ' LLC') AS vendor_name) FROM v_purchase WHERE payment_method = 'cash')")})
GROUP BY company_id, vendor, number, total, day HAVING COUNT(*) > 1""")
def likely_duplicates(t):
    """A second scan of every cash purchase under another id and spelling."""
    whole = t.v_purchase
    rescan = whole.where(F.col("payment_method") == "cash").withColumns({
        "invoice_id": F.concat(F.lit("rescan-"), "invoice_id"),
        "vendor_name": F.concat(F.coalesce("vendor_name", F.lit("")), F.lit(" LLC"))})
    return changes.likely_duplicates(whole.unionByName(rescan))


@query("D03_vendor_clusters", f"""
SELECT company_id, normalized, COUNT(*) AS spellings, CAST(SUM(n) AS BIGINT) AS invoices, min(vendor_name) AS example FROM (
  SELECT company_id, {_normalize_sql('vendor_name')} AS normalized, vendor_name, COUNT(*) AS n FROM v_purchase WHERE trim(vendor_name) <> '' GROUP BY ALL) GROUP BY company_id, normalized""")
def vendor_clusters(t):
    return changes.vendor_clusters(t.v_purchase)


_LAST_STATUS = "SELECT invoice_id, arg_max(action, decided_at) AS action FROM v_decision WHERE action IN ('validate', 'reject') GROUP BY invoice_id"


@query("M01_apply_validate_reject", f"""
SELECT i.invoice_id, CASE d.action WHEN 'validate' THEN 'validated' WHEN 'reject' THEN 'rejected' ELSE i.status END AS status FROM v_purchase i LEFT JOIN ({_LAST_STATUS}) d USING (invoice_id)""")
def apply_validate_reject(t):
    return changes.apply_validate_reject(t.v_purchase, t.v_decision).select("invoice_id", "status")


_LAST_TARGET = "SELECT invoice_id, arg_max(target, decided_at) AS target FROM v_decision GROUP BY invoice_id"


@query("M02_apply_reclassify", f"""
SELECT invoice_id, COALESCE(target, transaction_status) AS transaction_status,
  CASE WHEN target = 'transactional' AND transaction_status <> target AND total IS NULL AND amount_mentioned IS NOT NULL THEN amount_mentioned WHEN target = 'non_transactional' AND transaction_status <> target AND amount_mentioned IS NULL THEN NULL ELSE total END AS total,
  CASE WHEN target = 'transactional' AND transaction_status <> target AND total IS NULL AND amount_mentioned IS NOT NULL THEN NULL WHEN target = 'non_transactional' AND transaction_status <> target AND amount_mentioned IS NULL THEN total ELSE amount_mentioned END AS amount_mentioned,
  CASE WHEN target = 'non_transactional' AND transaction_status <> target THEN NULL ELSE category END AS category, CASE WHEN target IS NULL THEN classification_source ELSE 'user_override' END AS classification_source
FROM v_purchase LEFT JOIN ({_LAST_TARGET}) USING (invoice_id)""")
def apply_reclassify(t):
    return changes.apply_reclassify(t.v_purchase, t.v_decision).select(
        "invoice_id", "transaction_status", "total", "amount_mentioned", "category", "classification_source")


@query("M03_apply_send_to_accounting", """
SELECT invoice_id, CASE WHEN status IN ('processed', 'validated') THEN 'sent_to_accounting' ELSE status END AS status, CASE WHEN status IN ('processed', 'validated') THEN 'sent' ELSE 'needs review or validation first' END AS outcome
FROM v_purchase i WHERE EXISTS (SELECT 1 FROM v_decision d WHERE d.invoice_id = i.invoice_id AND d.action = 'send')""")
def apply_send_to_accounting(t):
    return changes.apply_send_to_accounting(t.v_purchase, t.v_decision).select("invoice_id", "status", "outcome")


_PATCHED = "p.payment_method = 'bank'"


@query("M04_apply_corrections", f"""
SELECT invoice_id, CASE WHEN {_PATCHED} THEN CASE WHEN status = 'validated' THEN 'Corrected twice' ELSE 'Corrected' END ELSE vendor_name END AS vendor_name, CASE WHEN {_PATCHED} THEN NULL ELSE category END AS category, CASE WHEN {_PATCHED} THEN 12.5e0 ELSE total END AS total,
  CASE WHEN {_PATCHED} AND status IN ('validated', 'sent_to_accounting') THEN 'validated' ELSE status END AS status, COALESCE({_PATCHED} AND status NOT IN ('validated', 'sent_to_accounting'), FALSE) AS status_refused FROM v_purchase p""")
def apply_corrections(t):
    patch = F.create_map(*[F.lit(x) for x in ("vendor_name", "Corrected", "total", "12.5", "status", "validated")])
    cleared = F.map_from_entries(F.array(F.struct(F.lit("category").alias("key"), F.lit(None).cast("string")
                                                  .alias("value"))))
    patches = t.v_purchase.where(F.col("payment_method") == "bank").select(
        "invoice_id", F.lit("2001-07-01").cast("date").alias("patched_at"), F.map_concat(patch, cleared).alias("fields"))
    again = t.v_purchase.where((F.col("payment_method") == "bank") & (F.col("status") == "validated")).select(
        "invoice_id", F.lit("2001-07-02").cast("date").alias("patched_at"),
        F.create_map(F.lit("vendor_name"), F.lit("Corrected twice")).alias("fields"))
    patches = patches.unionByName(again)
    return changes.apply_corrections(t.v_purchase, patches).select("invoice_id", "vendor_name", "category", "total",
                                                                   "status", "status_refused")


@query("M04_replace_items", """
SELECT invoice_id, position, description, amount FROM v_item i WHERE NOT EXISTS (SELECT 1 FROM v_item j WHERE j.invoice_id = i.invoice_id AND j.tax_rate > 0.07)
UNION ALL SELECT DISTINCT invoice_id, CAST(0 AS INT), 'Replaced', 1e0 FROM v_item WHERE tax_rate > 0.07""")
def replace_items(t):
    items = t.v_item.select("invoice_id", "position", "description", "amount")
    fresh = t.v_item.where(F.col("tax_rate") > 0.07).select("invoice_id").distinct().withColumns({
        "position": F.lit(0), "description": F.lit("Replaced"), "amount": F.lit(1.0)})
    return changes.replace_items(items, fresh).drop("arithmetic_check")


@query("M05_apply_expense_decisions", """
SELECT expense_id, CASE WHEN source = 'invoice' THEN 'approved' WHEN category = 'Rent' THEN 'rejected' ELSE status END AS status FROM v_expense""")
def apply_expense_decisions(t):
    when = F.lit("2001-07-01").cast("timestamp")
    rows = t.v_expense.select("expense_id", "category", "source")
    first = rows.where(F.col("category") == "Rent").select("expense_id", when.alias("decided_at"),
                                                           F.lit("reject").alias("action"))
    later = rows.where(F.col("source") == "invoice").select(
        "expense_id", (when + F.make_dt_interval(F.lit(1))).alias("decided_at"), F.lit("approve").alias("action"))
    return changes.apply_expense_decisions(t.v_expense, first.unionByName(later)).select("expense_id", "status")


@query("M05_apply_request_decisions", """
SELECT request_id, CASE WHEN status = 'pending_approval' AND department = 'MACHINERY' THEN 'approved' ELSE status END AS status, department = 'MACHINERY' AND status <> 'pending_approval' AS refused FROM v_request""")
def apply_request_decisions(t):
    decisions = t.v_request.where(F.col("department") == "MACHINERY").select(
        "request_id", F.col("updated_at").alias("decided_at"), F.lit("approve").alias("action"))
    return changes.apply_request_decisions(t.v_request, decisions).select("request_id", "status", "refused")


@query("M06_book_payroll", f"""
SELECT company_id, 'Salaries' AS category, 'Payroll — 2001-07' AS vendor_name, '{AS_OF}' AS expense_date, {cents('net_salary')} AS amount, 'approved' AS status, 'payroll' AS source, 'PAYROLL-2001-07' AS reference_id FROM ({TO_PROCESS_SQL}) GROUP BY company_id""")
def book_payroll(t):
    run = joins.payroll_to_process(t.v_employee, t.v_payroll, AS_OF)
    return changes.book_payroll(run, t.v_expense.withColumn("reference_id", F.lit(None).cast("string")), day(AS_OF))


@query("M07_create_and_link", """
SELECT p.invoice_id, COALESCE(p.vendor_id, n.vendor_id) AS vendor_id FROM v_purchase p LEFT JOIN (
  SELECT company_id, vendor_name, concat('new-', vendor_name) AS vendor_id FROM (SELECT DISTINCT company_id, vendor_name FROM v_purchase WHERE vendor_id IS NULL AND vendor_name <> '') w
  WHERE NOT EXISTS (SELECT 1 FROM v_vendor v WHERE v.company_id = w.company_id AND v.name = w.vendor_name)) n ON n.company_id = p.company_id AND n.vendor_name = p.vendor_name AND p.vendor_id IS NULL""")
def create_and_link(t):
    wanted = t.v_purchase.where(F.col("vendor_id").isNull() & (F.col("vendor_name") != "")).select(
        "company_id", F.col("vendor_name").alias("name"), F.concat(F.lit("new-"), "vendor_name").alias("vendor_id"))
    return changes.create_and_link(t.v_purchase, wanted, t.v_vendor).select("invoice_id", "vendor_id")


@query("M07_vendor_under_its_own_name", """
SELECT p.invoice_id, COALESCE(p.vendor_id, n.vendor_id) AS vendor_id FROM v_purchase p LEFT JOIN (
  SELECT company_id, vendor_name, min(concat('new-', vendor_name)) OVER (PARTITION BY company_id, replace(upper(vendor_name), '#', 'NO ')) AS vendor_id
  FROM (SELECT DISTINCT company_id, vendor_name FROM v_purchase WHERE vendor_id IS NULL AND vendor_name <> '') w
  WHERE NOT EXISTS (SELECT 1 FROM v_vendor v WHERE v.company_id = w.company_id AND v.name = replace(upper(w.vendor_name), '#', 'NO '))) n
  ON n.company_id = p.company_id AND n.vendor_name = p.vendor_name AND p.vendor_id IS NULL""")
def vendor_under_its_own_name(t):
    """Vendors get a corrected name; purchases are found by the printed one."""
    own = F.replace(F.upper("vendor_name"), F.lit("#"), F.lit("NO "))
    wanted = t.v_purchase.where(F.col("vendor_id").isNull() & (F.col("vendor_name") != "")).select(
        "company_id", own.alias("name"), F.col("vendor_name").alias("raw_name"), F.concat(F.lit("new-"), "vendor_name").alias("vendor_id"))
    return changes.create_and_link(t.v_purchase, wanted, t.v_vendor).select("invoice_id", "vendor_id")


@query("M08_ignore_names", """
SELECT company_id, vendor_name FROM (SELECT company_id, vendor_name FROM v_ignored UNION SELECT company_id, name FROM v_vendor WHERE rating IS NULL)
EXCEPT SELECT company_id, name FROM v_vendor WHERE rating IS NULL AND status = 'inactive'""")
def ignore_names(t):
    added = t.v_vendor.where(F.col("rating").isNull()).select("company_id", F.col("name").alias("vendor_name"))
    removed = t.v_vendor.where(F.col("rating").isNull() & (F.col("status") == "inactive")).select(
        "company_id", F.col("name").alias("vendor_name"))
    return changes.ignore_names(t.v_ignored, added, removed)


@query("M09_soft_delete", """
SELECT account_id, message_id, strftime(COALESCE(deleted_at, CASE WHEN category_source = 'manual_override' THEN TIMESTAMP '2024-01-25 00:00:00' END), '%Y-%m-%d %H:%M:%S') AS deleted_at FROM v_stored_attachment""")
def soft_delete(t):
    keys = ["account_id", "message_id"]
    gone = t.v_stored_attachment.where(F.col("category_source") == "manual_override").select(
        *keys, F.lit("2024-01-25").cast("timestamp_ntz").alias("deleted_at"))
    return changes.soft_delete(t.v_stored_attachment, gone, keys).select(*keys, "deleted_at")


@query("M10_sender_rule_from_review", """
SELECT account_id, pattern, split_part(max(concat(happened, '|', action)), '|', 2) AS action FROM (
  SELECT account_id, pattern, '0' AS happened, action FROM v_sender_rule
  UNION ALL SELECT account_id, CASE WHEN subject = 'click' THEN lower(from_address) ELSE split_part(lower(from_address), '@', 2) END, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') AS happened, CASE WHEN size > 20000 THEN 'allow' ELSE 'deny' END FROM v_attachment WHERE subject IN ('click', 'purchase')) GROUP BY account_id, pattern""")
def sender_rule_from_review(t):
    scope = F.when(F.col("subject") == "click", "address").when(F.col("subject") == "purchase", "domain")
    reviews = t.v_attachment.select("account_id", "from_address", F.col("received_at").alias("reviewed_at"),
                                    scope.alias("scope"),
                                    F.when(F.col("size") > 20000, "allow").otherwise("deny").alias("action"))
    return changes.sender_rules_from_reviews(t.v_sender_rule, reviews)


# ----------------------------------------------------------------------- quality


@query("J13_golden_join", """
SELECT COALESCE(g.filename, a.filename) AS filename, CASE WHEN a.filename IS NULL THEN 'missing' WHEN g.filename IS NULL THEN 'unexpected' ELSE 'matched' END AS presence FROM v_golden g FULL OUTER JOIN v_actual a ON g.filename = a.filename""")
def golden_join(t):
    return evaluation.golden_join(t.v_golden, t.v_actual).select("filename", "presence")


def _text_status(f: str) -> str:
    return f"CASE WHEN g.{f}_kind = 'unknown' THEN 'UNVERIFIABLE' WHEN g.{f}_kind = 'absent' THEN CASE WHEN COALESCE(trim(a.{f}), '') = '' THEN 'CORRECT' ELSE 'FALSE_POSITIVE' END WHEN COALESCE(trim(a.{f}), '') = '' THEN 'MISSING' WHEN lower(trim(g.{f})) = lower(trim(a.{f})) THEN 'CORRECT' ELSE 'INCORRECT' END"


def _date(x: str) -> str:
    return f"CAST(COALESCE({', '.join(f'try_strptime({x}, {chr(39)}{f}{chr(39)})' for f in ('%Y-%m-%d', '%d/%m/%Y', '%d %B %Y', '%d %b %Y', '%m/%d/%Y'))}) AS DATE)"


_STATUSES = {
    "document_type": _text_status("document_type"), "vendor": _text_status("vendor"), "category": _text_status("category"),
    "transactional": "CASE WHEN g.transactional = a.transactional THEN 'CORRECT' ELSE 'INCORRECT' END",
    "invoice_date": _text_status("invoice_date").replace("lower(trim(g.invoice_date)) = lower(trim(a.invoice_date))", f"{_date('g.invoice_date')} = {_date('a.invoice_date')}"),
    "total": "CASE WHEN g.total_kind = 'absent' THEN CASE WHEN a.total IS NULL THEN 'CORRECT' ELSE 'FALSE_POSITIVE' END WHEN a.total IS NULL THEN 'MISSING' WHEN abs(g.total - a.total) <= 0.005e0 THEN 'CORRECT' ELSE 'INCORRECT' END",
}
COMPARED_SQL = " UNION ALL ".join(f"SELECT filename, '{f}' AS field, {s} AS status, a.review_status FROM v_golden g JOIN v_actual a USING (filename)" for f, s in _STATUSES.items())


@query("E01_compare_fields", f"SELECT filename, field, status FROM ({COMPARED_SQL})")
def compare_fields(t):
    return evaluation.compare_fields(t.v_golden, t.v_actual).select("filename", "field", "status")


@query("E02_field_accuracy", f"""
SELECT field, {count_if("status = 'CORRECT'")} AS correct, {count_if("status <> 'UNVERIFIABLE'")} AS verifiable, {count_if("status = 'FALSE_POSITIVE'")} AS false_positives,
  {count_if("review_status = 'auto_processed'")} AS auto_processed, {count_if("review_status = 'needs_review'")} AS needs_review, {count_if("review_status = 'needs_review_high_priority'")} AS needs_review_high_priority FROM ({COMPARED_SQL}) GROUP BY field""")
def field_accuracy(t):
    return evaluation.field_accuracy(evaluation.compare_fields(t.v_golden, t.v_actual))


_AFTER = f"SELECT filename, field, CASE WHEN status = 'MISSING' AND field = 'total' THEN 'CORRECT' WHEN status = 'CORRECT' AND field = 'vendor' AND review_status = 'needs_review' THEN 'MISSING' WHEN status = 'CORRECT' AND field = 'category' AND review_status = 'needs_review' THEN 'INCORRECT' WHEN status = 'FALSE_POSITIVE' THEN 'MISSING' WHEN status = 'MISSING' AND field = 'category' THEN 'FALSE_POSITIVE' WHEN status = 'INCORRECT' AND field = 'document_type' THEN 'MISSING' ELSE status END AS status FROM ({COMPARED_SQL})"


@query("E03_diff_runs", f"""
SELECT filename, field, CASE WHEN b.status IS NOT DISTINCT FROM a.status THEN 'unchanged' WHEN a.status = 'FALSE_POSITIVE' THEN 'false_positives' WHEN b.status = 'FALSE_POSITIVE' THEN 'improvements'
  WHEN a.status = 'CORRECT' AND b.status IN ('INCORRECT', 'MISSING') THEN 'improvements' WHEN a.status = 'MISSING' AND b.status = 'CORRECT' THEN 'newly_missing' WHEN a.status = 'INCORRECT' AND b.status = 'CORRECT' THEN 'newly_incorrect' ELSE 'regressions' END AS change
FROM ({COMPARED_SQL}) b FULL OUTER JOIN ({_AFTER}) a USING (filename, field)""")
def diff_runs(t):
    before = evaluation.compare_fields(t.v_golden, t.v_actual)
    s, f, review = F.col("status"), F.col("field"), F.col("review_status") == "needs_review"
    after = before.withColumn("status", F.when((s == "MISSING") & (f == "total"), "CORRECT")
                              .when((s == "CORRECT") & (f == "vendor") & review, "MISSING")
                              .when((s == "CORRECT") & (f == "category") & review, "INCORRECT")
                              .when(s == "FALSE_POSITIVE", "MISSING")
                              .when((s == "MISSING") & (f == "category"), "FALSE_POSITIVE")
                              .when((s == "INCORRECT") & (f == "document_type"), "MISSING").otherwise(s))
    return evaluation.diff_runs(before, after)

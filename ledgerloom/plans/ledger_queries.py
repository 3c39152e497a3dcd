"""Ledger analytics: listings, aggregates, trends, joins and reports."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import checks, predicates
from ledgerloom.functions.core import money_sum
from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import joins, lists, trends
from ledgerloom.plans import reports
from ledgerloom.plans.catalog import BUCKET, CASHBOOK, SCANNED, cents, count_if, label, query, seconds
from ledgerloom.session import shared_folder
from ledgerloom.sources.fixtures import AS_OF
from ledgerloom.sources.tables import read_entity, write_entity

START, END = "2001-07-01", "2001-07-31"
PERIOD = f"BETWEEN DATE '{START}' AND DATE '{END}'"
HALF_OPEN = f"expense_date >= DATE '{START}' AND expense_date < DATE '{END}'"
AS_OF_SQL = f"DATE '{AS_OF}'"

# ------------------------------------------------------------ scans and predicates


@query("S01_ledger_tables", f"""
SELECT 'invoice' AS entity, COUNT(*) AS row_count, {cents('total')} AS amount, CAST(max(invoice_date) AS VARCHAR) AS latest FROM v_purchase
UNION ALL SELECT 'sale', COUNT(*), {cents('total')}, CAST(max(invoice_date) AS VARCHAR) FROM v_sales
UNION ALL SELECT 'expense', COUNT(*), {cents('amount')}, CAST(max(expense_date) AS VARCHAR) FROM v_expense
UNION ALL SELECT 'employee', COUNT(*), {cents('salary')}, NULL FROM v_employee
UNION ALL SELECT 'vendor', COUNT(*), 0.0, NULL FROM v_vendor""")
def ledger_tables(t):
    def totals(df, name, amount, latest):
        return df.agg(F.lit(name).alias("entity"), F.count("*").alias("row_count"), amount.alias("amount"),
                      latest.cast("string").alias("latest"))

    nothing = F.max(F.lit(None).cast("date"))
    return (totals(t.v_purchase, "invoice", money_sum("total"), F.max("invoice_date"))
            .union(totals(t.v_sales, "sale", money_sum("total"), F.max("invoice_date")))
            .union(totals(t.v_expense, "expense", money_sum("amount"), F.max("expense_date")))
            .union(totals(t.v_employee, "employee", money_sum("salary"), nothing))
            .union(totals(t.v_vendor, "vendor", F.max(F.lit(0.0)), nothing)))


#: company-owned entities and the views that fill them
STORED = {"invoice": "v_purchase", "expense": "v_expense", "vendor": "v_vendor", "ignored_vendor_name": "v_ignored", "employee": "v_employee",
          "payroll_record": "v_payroll", "purchase_request": "v_request", "purchase_order": "v_order", "vendor_quote": "v_quote",
          "tax_settings": "v_tax_settings"}
_MONEY = {"invoice": "total", "expense": "amount", "employee": "salary", "payroll_record": "net_salary", "purchase_request": "amount",
          "purchase_order": "amount", "vendor_quote": "price", "tax_settings": "default_gst_rate"}


def entity_store(t) -> str:
    """The company-owned entities written as tables partitioned by company."""
    root = f"{shared_folder(t.spark)}/entities-{uuid4().hex}"
    for entity, view in STORED.items():
        write_entity(getattr(t, view), root, entity, declared=False)
    return root


def _entity_rows(t, root: str, company_id: str | None = None):
    parts = [read_entity(t.spark, root, entity, company_id).groupBy("company_id").agg(
        F.lit(entity).alias("entity"), F.count("*").alias("row_count"),
        (money_sum(_MONEY[entity]) if entity in _MONEY else F.max(F.lit(0.0))).alias("amount")) for entity in STORED]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _entity_sql(where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(company_id AS VARCHAR) AS company_id, '{e}' AS entity, COUNT(*) AS row_count, {cents(_MONEY[e]) if e in _MONEY else '0.0'} AS amount "
        f"FROM {v} {where} GROUP BY company_id" for e, v in STORED.items())


@query("S01_entity_store", _entity_sql())
def entity_tables(t):
    """Every company-owned entity, written by company and read back with its declared schema."""
    return _entity_rows(t, entity_store(t))


@query("S02_one_company", _entity_sql("WHERE company_id = 3"))
def one_company(t):
    """One company's rows of every entity; the filter prunes to its folder."""
    return _entity_rows(t, entity_store(t), "3")


@query("S02_tenant_scope", f"""
SELECT company_id, COUNT(*) AS invoices, COUNT(DISTINCT vendor_id) AS vendors, {cents('total')} AS total FROM v_purchase GROUP BY company_id""")
def tenant_scope(t):
    return t.v_purchase.groupBy("company_id").agg(F.count("*").alias("invoices"),
                                                  F.countDistinct("vendor_id").alias("vendors"),
                                                  money_sum("total").alias("total"))


@query("P01_invoice_list", f"""
SELECT invoice_id, company_id, status, transaction_status, CAST(invoice_date AS VARCHAR) AS invoice_date, {seconds('created_at')} AS created_at, total
FROM v_purchase WHERE status IN ('processed', 'validated') AND transaction_status = 'transactional'
  AND invoice_date IS NOT NULL AND invoice_date >= DATE '1998-01-01'""")
def invoice_list(t):
    return lists.invoice_list(t.v_purchase, transaction_status="transactional", statuses="processed, validated",
                              start="1998-01-01").select(
        "invoice_id", "company_id", "status", "transaction_status", "invoice_date", "created_at", "total")


@query("P01_invoice_total", "SELECT company_id, COUNT(*) AS total_count FROM v_purchase WHERE status = 'needs_review' GROUP BY company_id")
def invoice_total(t):
    return lists.list_totals(t.v_purchase.where(F.col("status") == "needs_review"), ["company_id"])


@query("P11_scanned_sales_list", f"SELECT invoice_id, company_id, status FROM v_sales WHERE {SCANNED} AND status = 'needs_review'")
def scanned_sales_list(t):
    return lists.sales_list(t.v_sales, status="needs_review").select("invoice_id", "company_id", "status")


@query("P11_generated_sales_list", "SELECT invoice_id, company_id, status FROM v_sales WHERE type = 'sale' AND extraction_source = 'generated'")
def generated_sales_list(t):
    return lists.sales_list(t.v_sales, generated=True).select("invoice_id", "company_id", "status")


@query("P02_expense_list", """
SELECT expense_id, company_id, category, vendor_name, CAST(expense_date AS VARCHAR) AS expense_date, amount
FROM v_expense WHERE status = 'approved' AND expense_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND vendor_name ILIKE '%SUPPLIER%1%'""")
def expense_list(t):
    return lists.expense_list(t.v_expense, status="approved", start="1996-01-01", end="2000-12-31",
                              vendor="SUPPLIER%1").select("expense_id", "company_id", "category", "vendor_name",
                                                          "expense_date", "amount")


SPEND_SQL = f"""SELECT company_id, vendor_id, max(vendor_name) AS vendor_name, {cents('total')} AS total_spend, COUNT(*) AS invoice_count
  FROM v_purchase WHERE vendor_id IS NOT NULL GROUP BY company_id, vendor_id"""
VENDOR_SPEND_SQL = f"""SELECT v.*, COALESCE(s.total_spend, 0) AS total_spend, COALESCE(s.invoice_count, 0) AS invoice_count
  FROM v_vendor v LEFT JOIN ({SPEND_SQL}) s ON v.company_id = s.company_id AND v.vendor_id = s.vendor_id"""


def _vendors_with_spend(t):
    return joins.vendor_with_spend(t.v_vendor, agg.vendor_spend(t.v_purchase))


@query("P03_vendor_list", f"""
SELECT vendor_id, company_id, name, city, total_spend, invoice_count FROM ({VENDOR_SPEND_SQL}) WHERE status = 'active' AND name ILIKE '%supplier%'""")
def vendor_list(t):
    return lists.vendor_list(_vendors_with_spend(t), status="active", search="supplier").select(
        "vendor_id", "company_id", "name", "city", "total_spend", "invoice_count")


PAID_SQL = """SELECT e.*, CASE WHEN p.employee_id IS NOT NULL THEN 'paid' ELSE 'pending' END AS payroll_status
  FROM v_employee e LEFT JOIN (SELECT * FROM v_payroll WHERE period = '2001-07') p ON e.company_id = p.company_id AND e.employee_id = p.employee_id"""


def _employees_with_flag(t):
    return joins.paid_flag(t.v_employee, t.v_payroll, AS_OF)


@query("P04_employee_list", f"""
SELECT employee_id, company_id, name, department, round(salary + bonus - deductions, 2) AS net_salary, payroll_status
FROM ({PAID_SQL}) WHERE active AND name ILIKE '%customer%'""")
def employee_list(t):
    return lists.employee_list(_employees_with_flag(t), active=True, search="customer").select(
        "employee_id", "company_id", "name", "department", "net_salary", "payroll_status")


DELAYED = f"(status = 'in_transit' AND expected_delivery < {AS_OF_SQL})"


@query("P05_order_list", f"""
SELECT order_id, company_id, vendor_name, status, CAST(expected_delivery AS VARCHAR) AS expected_delivery, {DELAYED} AS delayed FROM v_order""")
def order_list(t):
    return lists.order_list(t.v_order, AS_OF).select("order_id", "company_id", "vendor_name", "status",
                                                     "expected_delivery", "delayed")


@query("P06_request_list", """
SELECT request_id, company_id, department, item, status, amount FROM v_request
WHERE status = 'approved' AND (item ILIKE '%urgent%' OR requester_name ILIKE '%urgent%')""")
def request_list(t):
    return lists.request_list(t.v_request, status="approved", search="urgent").select(
        "request_id", "company_id", "department", "item", "status", "amount")


STORED_WITH_MESSAGE = """SELECT a.*, m.from_address, m.subject, m.received_at FROM v_stored_attachment a
  JOIN v_attachment m ON a.account_id = m.account_id AND a.message_id = m.message_id"""


def _attachments_with_messages(t):
    messages = t.v_attachment.select("account_id", "message_id", "from_address", "subject", "received_at")
    return joins.attachment_messages(t.v_stored_attachment, messages)


@query("P07_attachment_list", f"""
SELECT account_id, message_id, filename, category, {seconds('received_at')} AS received_at FROM ({STORED_WITH_MESSAGE})
WHERE deleted_at IS NULL AND review_status = 'imported'""")
def attachment_list(t):
    return lists.attachment_list(_attachments_with_messages(t), category="all").select(
        "account_id", "message_id", "filename", "category", "received_at")


@query("P08_file_list", f"""
SELECT file_id, conversation_id, filename, category, {seconds('created_at')} AS created_at FROM v_chat_file WHERE deleted_at IS NULL AND file_type = 'xlsx'""")
def file_list(t):
    return lists.file_list(t.v_chat_file, category="all", file_type="xlsx").select(
        "file_id", "conversation_id", "filename", "category", "created_at")


@query("P09_upload_list", "SELECT upload_id, company_id, filename, category FROM v_upload WHERE deleted_at IS NULL")
def upload_list(t):
    return lists.upload_list(t.v_upload).select("upload_id", "company_id", "filename", "category")


@query("P10_is_cashbook", f"SELECT company_id, invoice_id FROM v_purchase WHERE {CASHBOOK}")
def is_cashbook(t):
    return t.v_purchase.where(predicates.is_cashbook()).select("company_id", "invoice_id")


@query("P11_is_scanned_sale", f"SELECT company_id, invoice_id FROM v_sales WHERE {SCANNED}")
def is_scanned_sale(t):
    return t.v_sales.where(predicates.is_scanned_sale()).select("company_id", "invoice_id")


@query("P12_date_between", f"SELECT invoice_id, CAST(invoice_date AS VARCHAR) AS invoice_date FROM v_purchase WHERE invoice_date {PERIOD}")
def date_between(t):
    return t.v_purchase.where(predicates.date_between("invoice_date", START, END)).select("invoice_id",
                                                                                         "invoice_date")


@query("P13_bucket_date", f"SELECT invoice_id, CAST({BUCKET} AS VARCHAR) AS bucket_date FROM v_sales")
def bucket_date(t):
    return t.v_sales.select("invoice_id", predicates.bucket_date().alias("bucket_date"))


@query("P14_particulars", """
SELECT invoice_id, COALESCE(NULLIF(vendor_name, ''), NULLIF(invoice_number, ''), NULLIF(filename, ''), '—') AS particulars FROM v_purchase""")
def particulars(t):
    return t.v_purchase.select("invoice_id", predicates.particulars().alias("particulars"))


@query("P15_display_labels", """
SELECT invoice_id, CASE payment_method WHEN 'bank' THEN 'Bank' WHEN 'cash' THEN 'Cash' ELSE 'Not Specified' END AS payment_label,
  CASE document_type WHEN 'minute_sheet' THEN 'Minute Sheet' WHEN 'invoice' THEN 'Invoice' WHEN 'credit_note' THEN 'Credit Note' ELSE 'Unknown' END AS document_type_label
FROM v_purchase""")
def display_labels(t):
    return t.v_purchase.select("invoice_id", predicates.payment_label().alias("payment_label"),
                               predicates.document_type_label().alias("document_type_label"))


@query("P16_sales_line_totals", """
SELECT invoice_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(round(subtotal * rate, 2) AS DOUBLE) AS tax_amount, CAST(subtotal + round(subtotal * rate, 2) AS DOUBLE) AS total
FROM (SELECT invoice_id, SUM(CAST(CAST(quantity AS DECIMAL(18,2)) * CAST(price AS DECIMAL(18,2)) AS DECIMAL(18,2))) AS subtotal, max(CAST(tax_rate AS DECIMAL(5,2))) AS rate FROM v_item GROUP BY invoice_id)""")
def sales_line_totals(t):
    return sales_totals_of_lines(t.v_item)


def sales_totals_of_lines(items):
    """Line, subtotal and tax each rounded to 2 decimals, in decimal arithmetic
    so that ties round the same on every engine."""
    money = lambda name: F.col(name).cast("decimal(18,2)")
    subtotals = items.groupBy("invoice_id").agg(
        F.sum(F.round(money("quantity") * money("price"), 2).cast("decimal(18,2)")).alias("s"),
        F.max(F.col("tax_rate").cast("decimal(5,2)")).alias("r"))
    tax = F.round(F.col("s") * F.col("r"), 2)
    return subtotals.select("invoice_id", F.col("s").cast("double").alias("subtotal"),
                            tax.cast("double").alias("tax_amount"), (F.col("s") + tax).cast("double").alias("total"))


def _hint_sql():
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in predicates.SYNC_ERROR_HINTS.items())
    return f"CASE WHEN NULLIF(last_error, '') IS NULL THEN NULL ELSE CASE last_error {known} ELSE 'Last sync failed for this conversation: ' || last_error END END"


@query("P17_error_hint", f"SELECT conversation_id, {_hint_sql()} AS hint FROM v_conversation")
def error_hint(t):
    return t.v_conversation.select("conversation_id", predicates.error_hint("last_error").alias("hint"))


@query("P18_scanner_eligible", "SELECT file_id, category IN ('Invoices', 'Receipts', 'Spreadsheets & Financial') AS scanner_eligible FROM v_chat_file")
def scanner_eligible(t):
    return t.v_chat_file.select("file_id", predicates.scanner_eligible().alias("scanner_eligible"))


@query("P19_row_checks", """
SELECT 'item' AS entity, item_id AS id, concat_ws('|', CASE WHEN NOT qty > 0 THEN 'qty' END, CASE WHEN NOT rate >= 0 THEN 'rate' END, CASE WHEN NOT (tax_rate >= 0 AND tax_rate <= 1) THEN 'tax_rate' END) AS reasons
FROM (SELECT item_id, qty - 10 AS qty, rate - 1000 AS rate, tax_rate * 20 AS tax_rate FROM v_item)
UNION ALL SELECT 'expense', expense_id, CASE WHEN NOT amount > 0 THEN 'amount' ELSE '' END FROM (SELECT expense_id, amount - 20000 AS amount FROM v_expense)
UNION ALL SELECT 'quote', quote_id, CASE WHEN NOT (score >= 0 AND score <= 100) THEN 'score' ELSE '' END FROM (SELECT quote_id, score * 2 - 20 AS score FROM v_quote)
UNION ALL SELECT 'employee', CAST(employee_id AS VARCHAR), concat_ws('|', CASE WHEN NOT salary > 0 THEN 'salary' END, CASE WHEN NOT bonus >= 0 THEN 'bonus' END, CASE WHEN NOT deductions >= 0 THEN 'deductions' END)
FROM (SELECT employee_id, salary - 5000 AS salary, bonus - 100 AS bonus, deductions - 50 AS deductions FROM v_employee)""")
def row_checks(t):
    """The ledger's rows with values moved so that some break each limit."""
    rows = {
        "item": t.v_item.select(F.col("item_id").alias("id"), (F.col("qty") - 10).alias("qty"), (F.col("rate") - 1000).alias("rate"),
                                (F.col("tax_rate") * 20).alias("tax_rate")),
        "expense": t.v_expense.select(F.col("expense_id").alias("id"), (F.col("amount") - 20000).alias("amount")),
        "quote": t.v_quote.select(F.col("quote_id").alias("id"), (F.col("score") * 2 - 20).alias("score")),
        "employee": t.v_employee.select(F.col("employee_id").cast("string").alias("id"), (F.col("salary") - 5000).alias("salary"),
                                        (F.col("bonus") - 100).alias("bonus"), (F.col("deductions") - 50).alias("deductions")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(entity).alias("entity"), "id", predicates.row_violations(entity).alias("reasons"))
                                          for entity, df in rows.items()])


# ------------------------------------------------------------------------- joins


@query("J01_vendor_with_spend", f"SELECT vendor_id, company_id, name, total_spend, invoice_count FROM ({VENDOR_SPEND_SQL})")
def vendor_with_spend(t):
    return _vendors_with_spend(t).select("vendor_id", "company_id", "name", "total_spend", "invoice_count")


@query("J04_paid_flag", f"SELECT employee_id, company_id, payroll_status FROM ({PAID_SQL})")
def paid_flag(t):
    return _employees_with_flag(t).select("employee_id", "company_id", "payroll_status")


TO_PROCESS_SQL = """SELECT e.company_id, e.employee_id, '2001-07' AS period, e.salary, e.bonus, e.deductions, round(e.salary + e.bonus - e.deductions, 2) AS net_salary
  FROM v_employee e WHERE e.active AND NOT EXISTS (SELECT 1 FROM v_payroll p WHERE p.period = '2001-07' AND p.company_id = e.company_id AND p.employee_id = e.employee_id)"""


@query("J05_payroll_to_process", TO_PROCESS_SQL)
def payroll_to_process(t):
    return joins.payroll_to_process(t.v_employee, t.v_payroll, AS_OF)


BOOKED_SQL = f"""SELECT i.company_id, i.invoice_id, 'Raw Material' AS category, i.vendor_name, i.vendor_id, COALESCE(i.invoice_date, {AS_OF_SQL}) AS expense_date,
  COALESCE(i.total, 0) AS amount, CASE i.payment_method WHEN 'bank' THEN 'bank_transfer' WHEN 'cash' THEN 'cash' END AS payment_method, 'approved' AS status, 'invoice' AS source, i.invoice_number AS reference_id
  FROM v_purchase i WHERE i.status = 'sent_to_accounting' AND NOT EXISTS (SELECT 1 FROM v_expense e WHERE e.invoice_id = i.invoice_id AND e.company_id = i.company_id)"""


@query("J06_book_expenses", f"SELECT company_id, invoice_id, category, vendor_name, vendor_id, CAST(expense_date AS VARCHAR) AS expense_date, amount, payment_method, status, source, reference_id FROM ({BOOKED_SQL})")
def book_expenses(t):
    return joins.book_expenses(t.v_purchase, t.v_expense, AS_OF)


@query("J07_attachment_messages", f"SELECT account_id, message_id, filename, from_address, subject, {seconds('received_at')} AS received_at FROM ({STORED_WITH_MESSAGE})")
def attachment_messages(t):
    return _attachments_with_messages(t).select("account_id", "message_id", "filename", "from_address", "subject",
                                                "received_at")


@query("J08_request_timeline", f"""
SELECT company_id, request_id, CAST(step AS INT) AS step, title, detail, {seconds('step_date')} AS step_date, completed FROM (
  SELECT company_id, request_id, 0 AS step, 'Request submitted' AS title, concat_ws(' · ', department, requester_name) AS detail, created_at AS step_date, TRUE AS completed FROM v_request
  UNION ALL
  SELECT company_id, request_id, 1, 'Approval decision', CASE status WHEN 'approved' THEN 'Approved' WHEN 'rejected' THEN 'Rejected' ELSE 'Awaiting approval' END, CASE WHEN status <> 'pending_approval' THEN updated_at END, status <> 'pending_approval' FROM v_request
  UNION ALL
  SELECT r.company_id, r.request_id, 2, 'Purchase order issued', CASE WHEN o.request_id IS NULL THEN 'Not yet issued' ELSE o.vendor_name END, o.created_at, o.request_id IS NOT NULL
  FROM v_request r LEFT JOIN (SELECT * FROM v_order WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, request_id ORDER BY created_at, order_id) = 1) o ON r.company_id = o.company_id AND r.request_id = o.request_id
  UNION ALL
  SELECT r.company_id, r.request_id, 3, 'Delivered', CASE WHEN o.status = 'delivered' THEN o.vendor_name ELSE 'Not yet delivered' END, CASE WHEN o.status = 'delivered' THEN o.updated_at END, o.status = 'delivered'
  FROM v_request r JOIN (SELECT * FROM v_order WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, request_id ORDER BY created_at, order_id) = 1) o ON r.company_id = o.company_id AND r.request_id = o.request_id)""")
def request_timeline(t):
    return joins.request_timeline(t.v_request, t.v_order)


MONTHS_SQL = f"""SELECT company_id, month, COALESCE(r.total, 0) AS inflow, COALESCE(e.total, 0) AS outflow, round(COALESCE(r.total, 0) - COALESCE(e.total, 0), 2) AS net
  FROM (SELECT company_id, strftime({BUCKET}, '%Y-%m') AS month, {cents('total')} AS total FROM v_sales WHERE {SCANNED} {{sales}} GROUP BY ALL) r
  FULL OUTER JOIN (SELECT company_id, strftime(expense_date, '%Y-%m') AS month, {cents('amount')} AS total FROM v_expense WHERE status = 'approved' {{spend}} GROUP BY ALL) e USING (company_id, month)"""


@query("J09_revenue_vs_expenses_months", MONTHS_SQL.format(sales="", spend=""))
def revenue_vs_expenses_months(t):
    return trends.revenue_vs_expenses_months(t.v_sales, t.v_expense)


@query("J10_file_audit", """
SELECT installation_id, file_id, finding, CASE WHEN finding = 'stale_metadata' THEN fields ELSE '' END AS fields, listed_size, stored_size FROM (
  SELECT COALESCE(r.installation_id, l.installation_id) AS installation_id, COALESCE(r.file_id, l.file_id) AS file_id, r.size AS listed_size, l.size AS stored_size,
    concat_ws('|', CASE WHEN r.size <> 0 AND r.size IS DISTINCT FROM l.size THEN 'size' END, CASE WHEN r.mimetype <> '' AND r.mimetype IS DISTINCT FROM l.mimetype THEN 'mimetype' END, CASE WHEN COALESCE(r.is_external, FALSE) IS DISTINCT FROM l.is_external THEN 'is_external' END) AS fields,
    CASE WHEN l.file_id IS NULL THEN 'list_only' WHEN r.file_id IS NULL THEN 'store_only' WHEN fields <> '' THEN 'stale_metadata' END AS finding
  FROM v_files_listing r FULL OUTER JOIN v_files_stored l ON r.file_id = l.file_id AND r.installation_id = l.installation_id) WHERE finding IS NOT NULL""")
def file_audit(t):
    return joins.file_audit(t.v_files_listing, t.v_files_stored)


@query("J11_scan_outcomes", """
SELECT b.company_id, b.upload_id, s.existing_id, b.kept_id FROM (
  SELECT company_id, upload_id, sha256(content) AS h, min(upload_id) OVER (PARTITION BY company_id, sha256(content)) AS kept_id FROM v_upload WHERE source NOT LIKE 'src1%') b
LEFT JOIN (SELECT company_id, sha256(content) AS h, min(upload_id) AS existing_id FROM v_upload WHERE source LIKE 'src1%' GROUP BY ALL) s ON s.company_id = b.company_id AND s.h = b.h""")
def scan_outcomes(t):
    stored = F.col("source").startswith("src1")
    return joins.scan_outcomes(t.v_upload.where(~stored), t.v_upload.where(stored))


@query("J11_new_scans_only", """
SELECT company_id, sha256(content) AS file_hash, min(upload_id) AS upload_id, COUNT(*) AS copies FROM v_upload b WHERE source NOT LIKE 'src1%'
  AND NOT EXISTS (SELECT 1 FROM v_upload s WHERE s.source LIKE 'src1%' AND s.company_id = b.company_id AND sha256(s.content) = sha256(b.content)) GROUP BY ALL""")
def new_scans_only(t):
    stored = F.col("source").startswith("src1")
    return joins.new_scans_only(t.v_upload.where(~stored), t.v_upload.where(stored))


@query("J12_bulk_link_vendor", """
SELECT i.invoice_id, i.company_id, COALESCE(l.vendor_id, i.vendor_id) AS vendor_id FROM v_purchase i
LEFT JOIN (SELECT p.company_id, p.invoice_id, v.vendor_id FROM v_purchase p JOIN v_vendor v ON p.company_id = v.company_id AND lower(p.vendor_name) = lower(v.name) WHERE p.vendor_id IS NULL) l
  ON i.company_id = l.company_id AND i.invoice_id = l.invoice_id""")
def bulk_link_vendor(t):
    vendors = t.v_vendor.select("company_id", F.lower("name").alias("key"), F.col("vendor_id").alias("linked"))
    links = (t.v_purchase.where(F.col("vendor_id").isNull()).withColumn("key", F.lower("vendor_name"))
             .join(vendors, ["company_id", "key"]).select("company_id", "invoice_id",
                                                          F.col("linked").alias("vendor_id")))
    return joins.bulk_link_vendor(t.v_purchase, links).select("invoice_id", "company_id", "vendor_id")


CONVERSATIONS_SQL = f"""SELECT c.conversation_id, c.name, COALESCE(f.n, 0) AS file_count, c.last_error, c.last_error IS NOT NULL AS needs_attention, {_hint_sql()} AS last_error_hint
  FROM v_conversation c LEFT JOIN (SELECT conversation_id, COUNT(*) AS n FROM v_chat_file GROUP BY conversation_id) f USING (conversation_id)"""


@query("J14_conversation_counts", CONVERSATIONS_SQL)
def conversation_counts(t):
    return joins.conversation_counts(t.v_conversation, t.v_chat_file).select(
        "conversation_id", "name", "file_count", "last_error", "needs_attention", "last_error_hint")


@query("J16_orders_need_approved_request", """
SELECT company_id, order_id, request_id FROM v_order o WHERE request_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM v_request r WHERE r.status = 'approved' AND r.company_id = o.company_id AND r.request_id = o.request_id)""")
def orders_need_approved_request(t):
    return joins.orders_needing_approval(t.v_order, t.v_request).select("company_id", "order_id", "request_id")


@query("J18_employee_delete_guard", """
SELECT company_id, employee_id, name FROM v_employee e WHERE EXISTS (SELECT 1 FROM v_payroll p WHERE p.company_id = e.company_id AND p.employee_id = e.employee_id)""")
def employee_delete_guard(t):
    return joins.undeletable_employees(t.v_employee, t.v_payroll).select("company_id", "employee_id", "name")


# -------------------------------------------------------------------- aggregates


@query("A01_vendor_spend", f"""
SELECT company_id, vendor_id, max(vendor_name) AS vendor_name, {cents('total')} AS total_spend, COUNT(*) AS invoice_count
FROM v_purchase WHERE vendor_id IS NOT NULL AND invoice_date >= DATE '1996-01-01' AND invoice_date <= DATE '2001-12-31' GROUP BY ALL""")
def vendor_spend(t):
    return agg.vendor_spend(t.v_purchase, "1996-01-01", "2001-12-31").drop("latest_name")


@query("A02_unlinked_vendor_groups", f"""
SELECT company_id, vendor_name, COUNT(*) AS invoice_count, {cents('total')} AS total_amount, CAST(max(invoice_date) AS VARCHAR) AS latest_invoice_date,
  CASE WHEN max(invoice_date) IS NULL THEN min(invoice_number) ELSE NULLIF(split_part(max(CASE WHEN invoice_date IS NOT NULL THEN concat(CAST(invoice_date AS VARCHAR), '|', COALESCE(invoice_number, '')) END), '|', 2), '') END AS sample_invoice_number
FROM v_purchase WHERE vendor_id IS NULL AND trim(vendor_name) <> '' GROUP BY company_id, vendor_name""")
def unlinked_vendor_groups(t):
    return agg.unlinked_vendor_groups(t.v_purchase)


@query("A02_unlinked_vendor_members", "SELECT company_id, vendor_name, invoice_id FROM v_purchase WHERE vendor_id IS NULL AND trim(vendor_name) <> ''")
def unlinked_vendor_members(t):
    return agg.unlinked_vendor_members(t.v_purchase)


STATUS_LIST = ", ".join(f"('{s}')" for s in predicates.INVOICE_STATUSES)


@query("A03_status_summary", f"""
SELECT k.company_id, k.status, COALESCE(n, 0) AS count, total FROM (SELECT DISTINCT company_id, s.status FROM v_purchase, (VALUES {STATUS_LIST}) s(status)) k
JOIN (SELECT company_id, COUNT(*) AS total FROM v_purchase GROUP BY ALL) USING (company_id)
LEFT JOIN (SELECT company_id, status, COUNT(*) AS n FROM v_purchase GROUP BY ALL) c ON c.company_id = k.company_id AND c.status = k.status""")
def status_summary(t):
    return agg.status_counts_long(t.v_purchase)


@query("A04_category_summary", f"SELECT company_id, category, COUNT(*) AS count, {cents('total')} AS total FROM v_purchase WHERE {CASHBOOK} GROUP BY ALL")
def category_summary(t):
    return agg.category_summary(t.v_purchase).orderBy("company_id", *agg.category_order())


@query("A05_monthly_payment_summary", f"""
SELECT company_id, strftime(invoice_date, '%Y-%m') AS month, {cents('total')} AS monthly_total, {cents('total', "payment_method = 'cash'")} AS cash_total,
  {cents('total', "payment_method = 'bank'")} AS online_total, {cents('total', "payment_method IS NULL")} AS unspecified_total, COUNT(*) AS transaction_count
FROM v_purchase WHERE {CASHBOOK} AND invoice_date BETWEEN DATE '1998-01-01' AND DATE '2001-07-31' GROUP BY ALL""")
def monthly_payment_summary(t):
    return agg.payment_summary(t.v_purchase, "1998-01-01", "2001-07-31", keys=("month",))


@query("A06_available_months", f"SELECT DISTINCT company_id, strftime(invoice_date, '%Y-%m') AS month FROM v_purchase WHERE {CASHBOOK} AND invoice_date IS NOT NULL")
def available_months(t):
    return agg.available_months(t.v_purchase).orderBy("company_id", F.desc("month"))


@query("A07_sales_monthly", f"SELECT company_id, strftime({BUCKET}, '%Y-%m') AS month, {cents('total')} AS total, COUNT(*) AS count FROM v_sales WHERE {SCANNED} GROUP BY ALL")
def sales_monthly(t):
    return agg.sales_monthly(t.v_sales)


CUSTOMERS_SQL = f"""SELECT company_id, COALESCE(NULLIF(trim(customer_name), ''), 'Unattributed') AS customer_name, {cents('total')} AS total, COUNT(*) AS count FROM v_sales WHERE {SCANNED} {{period}} GROUP BY 1, 2"""


@query("A08_top_customers", f"""
SELECT company_id, customer_name, total, count, CAST(row_number() OVER (PARTITION BY company_id ORDER BY total DESC, customer_name) AS INT) AS position
FROM ({CUSTOMERS_SQL.format(period='')}) QUALIFY position <= 5""")
def top_customers(t):
    return agg.top_customers(t.v_sales, 5)


@query("A09_sales_totals", f"""
SELECT company_id, {cents('total')} AS revenue, COUNT(*) AS document_count, {count_if("status IN ('needs_review', 'needs_review_high_priority')")} AS pending_review, {cents('total', f"{BUCKET} = {AS_OF_SQL}")} AS today_revenue
FROM v_sales WHERE {SCANNED} GROUP BY company_id""")
def sales_totals(t):
    return agg.sales_totals(t.v_sales, AS_OF)


@query("A10_expense_categories", f"SELECT company_id, category, {cents('amount')} AS value FROM v_expense WHERE status = 'approved' AND {HALF_OPEN} GROUP BY ALL")
def expense_categories(t):
    return agg.expense_categories(t.v_expense, START, END)


EXPENSE_SUMMARY_SQL = f"""SELECT company_id, {cents('amount')} AS total, {cents('amount', "status = 'approved'")} AS approved, {cents('amount', "status = 'pending'")} AS pending, {cents('amount', "status = 'rejected'")} AS rejected,
  {count_if("status = 'pending'")} AS pending_count, {count_if("status = 'rejected'")} AS rejected_count FROM v_expense WHERE {{period}} GROUP BY company_id"""


@query("A11_expense_summary", EXPENSE_SUMMARY_SQL.format(period=HALF_OPEN))
def expense_summary(t):
    return agg.expense_summary(t.v_expense, START, END)


@query("A11_expense_summary_inclusive", EXPENSE_SUMMARY_SQL.format(period=f"expense_date {PERIOD}"))
def expense_summary_inclusive(t):
    return agg.expense_summary(t.v_expense, START, END, end_inclusive=True)


@query("A12_expenses_by_month", f"SELECT company_id, strftime(expense_date, '%Y-%m') AS month, {cents('amount')} AS total FROM v_expense WHERE status = 'approved' GROUP BY ALL")
def expenses_by_month(t):
    return agg.expenses_by_month(t.v_expense)


@query("A13_kpis", f"""
SELECT company_id, today_revenue, monthly_revenue, monthly_expenses, round(monthly_revenue - monthly_expenses, 2) AS net_profit, round(all_revenue - all_expenses, 2) AS cash_balance, employee_salaries, pending_invoices, processed_invoices FROM
(SELECT company_id, {cents('total', f"{SCANNED} AND {BUCKET} = {AS_OF_SQL}")} AS today_revenue, {cents('total', f"{SCANNED} AND {BUCKET} >= DATE '2001-07-01' AND {BUCKET} < DATE '2001-08-01'")} AS monthly_revenue, {cents('total', SCANNED)} AS all_revenue,
  {count_if("status IN ('needs_review', 'needs_review_high_priority')")} AS pending_invoices, {count_if("status IN ('processed', 'validated', 'sent_to_accounting')")} AS processed_invoices FROM v_invoice GROUP BY company_id)
JOIN (SELECT company_id, {cents('amount', "expense_date >= DATE '2001-07-01' AND expense_date < DATE '2001-08-01'")} AS monthly_expenses, {cents('amount', "category = 'Salaries' AND expense_date >= DATE '2001-07-01' AND expense_date < DATE '2001-08-01'")} AS employee_salaries, {cents('amount')} AS all_expenses
  FROM v_expense WHERE status = 'approved' GROUP BY company_id) USING (company_id)""")
def kpis(t):
    return agg.kpis(t.v_invoice, t.v_expense, AS_OF)


@query("A14_payroll_summary", f"""
SELECT company_id, {cents('salary')} AS total_salary, {cents('bonus')} AS total_bonus, {cents('deductions')} AS total_deductions, {cents('salary + bonus - deductions')} AS total_net, COUNT(*) AS employee_count,
  {count_if("payroll_status = 'paid'")} AS paid_count, {count_if("payroll_status = 'pending'")} AS pending_count FROM ({PAID_SQL}) WHERE active GROUP BY company_id""")
def payroll_summary(t):
    return agg.payroll_summary(_employees_with_flag(t))


@query("A15_payroll_history", f"SELECT company_id, period, {cents('net_salary')} AS total_net, COUNT(*) AS employee_count, {seconds('max(processed_at)')} AS processed_at FROM v_payroll GROUP BY company_id, period")
def payroll_history(t):
    return agg.payroll_history(t.v_payroll).orderBy("company_id", F.desc("period"))


@query("A16_procurement_stats", f"""
SELECT company_id, pending_count, pending_amount, completed_count, delayed_count, cancelled_count FROM
(SELECT company_id, {count_if("status = 'pending_approval'")} AS pending_count, {cents('amount', "status = 'pending_approval'")} AS pending_amount FROM v_request GROUP BY company_id)
JOIN (SELECT company_id, {count_if("status = 'delivered'")} AS completed_count, {count_if(DELAYED)} AS delayed_count, {count_if("status = 'cancelled'")} AS cancelled_count FROM v_order GROUP BY company_id) USING (company_id)""")
def procurement_stats(t):
    return agg.procurement_stats(t.v_request, t.v_order, AS_OF)


@query("A17_payroll_by_department", f"SELECT company_id, department, {cents('salary + bonus')} AS value FROM v_employee GROUP BY company_id, department")
def payroll_by_department(t):
    return agg.payroll_by_department(t.v_employee)


@query("A18_invoice_status_chart", """
SELECT company_id, CASE WHEN status IN ('processed', 'validated', 'sent_to_accounting') THEN 'Processed' ELSE 'Needs Review' END AS name, COUNT(*) AS value FROM v_invoice WHERE status <> 'rejected' GROUP BY ALL""")
def invoice_status_chart(t):
    return agg.invoice_status_chart(t.v_invoice)


ITEM_CHECK = "CASE WHEN qty IS NULL OR rate IS NULL OR amount IS NULL THEN 'not_checked' WHEN abs(qty * rate - amount) <= 0.02e0 * greatest(abs(amount), 1e0) THEN 'pass' ELSE 'fail' END"


@query("A19_line_items_pass_rate", f"""
SELECT invoice_id, CAST(SUM(CASE c WHEN 'pass' THEN 1 WHEN 'fail' THEN 0 END) AS DOUBLE) / {count_if("c <> 'not_checked'")} AS pass_rate, CASE WHEN COUNT(amount) > 0 THEN {cents('amount')} END AS amount_sum
FROM (SELECT *, {ITEM_CHECK} AS c FROM v_item) GROUP BY invoice_id""")
def line_items_pass_rate(t):
    return agg.line_items_pass_rate(t.v_item.withColumn("arithmetic_check",
                                                        checks.line_item_check("qty", "rate", "amount")))


@query("A20_document_confidence", """
SELECT item_id, CASE WHEN ok IS FALSE THEN base * 0.7e0 ELSE base END AS document_confidence FROM (SELECT item_id, abs(qty * rate - amount) <= 0.02e0 * greatest(abs(amount), 1e0) AS ok,
  (0e0 + COALESCE((0.5e0 + tax_rate) * 3e0, 0e0) + COALESCE((CASE WHEN qty IS NOT NULL THEN 0.9e0 END) * 2e0, 0e0) + COALESCE((CASE WHEN amount IS NOT NULL THEN 0.5e0 + discount_rate END) * 1.5e0, 0e0)) /
  (3e0 + CASE WHEN qty IS NOT NULL THEN 2e0 ELSE 0e0 END + CASE WHEN amount IS NOT NULL THEN 1.5e0 ELSE 0e0 END) AS base FROM v_item)""")
def document_confidence(t):
    fields = {"total": F.lit(0.5) + F.col("tax_rate"), "vendor_name": F.when(F.col("qty").isNotNull(), 0.9),
              "subtotal": F.when(F.col("amount").isNotNull(), F.lit(0.5) + F.col("discount_rate"))}
    ok = checks.close_enough(F.col("qty") * F.col("rate"), F.col("amount"))
    return t.v_item.select("item_id", checks.document_confidence(fields, ok).alias("document_confidence"))


@query("A21_sync_counters", f"""
SELECT run_group, COUNT(*) AS discovered, {count_if("status = 'completed'")} AS downloaded, {count_if("status = 'failed'")} AS failed, {count_if("status IN ('completed', 'failed')")} AS processed FROM v_job GROUP BY run_group""")
def sync_counters(t):
    return agg.sync_counters(t.v_job)


@query("A22_cashbook_grand_total", f"""
SELECT company_id, {cents('total')} AS grand_total, CAST(SUM(n) AS BIGINT) AS entries, {count_if('total > 0')} AS charted_categories FROM (SELECT company_id, category, COUNT(*) AS n, {cents('total')} AS total FROM v_purchase WHERE {CASHBOOK} GROUP BY company_id, category) GROUP BY company_id""")
def cashbook_grand_total(t):
    return agg.cashbook_grand_total(t.v_purchase)


@query("A23_vendor_total_spend", f"SELECT company_id, {cents('total_spend')} AS total_spend, COUNT(*) AS vendors FROM ({VENDOR_SPEND_SQL}) GROUP BY company_id")
def vendor_total_spend(t):
    return agg.vendor_total_spend(_vendors_with_spend(t))


# --------------------------------------------------------- trends, ranks and sorts

SPINE_SQL = f"""SELECT company_id, CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS month_start FROM (SELECT DISTINCT company_id FROM {{source}})"""


@query("W01_month_spine", f"SELECT company_id, CAST(month_start AS VARCHAR) AS month_start, strftime(month_start, '%Y-%m') AS month FROM ({SPINE_SQL.format(source='v_purchase')})")
def month_spine(t):
    return trends.month_spine(t.v_purchase, AS_OF)


TREND_SQL = f"""SELECT s.company_id, s.month, strftime(s.month_start, '%b') AS label, COALESCE(r.total, 0) AS revenue, COALESCE(e.total, 0) AS expenses
  FROM (SELECT *, strftime(month_start, '%Y-%m') AS month FROM ({SPINE_SQL.format(source='(SELECT company_id FROM v_sales UNION SELECT company_id FROM v_expense)')})) s
  LEFT JOIN (SELECT company_id, strftime({BUCKET}, '%Y-%m') AS month, {cents('total')} AS total FROM v_sales WHERE {SCANNED} GROUP BY ALL) r ON r.company_id = s.company_id AND r.month = s.month
  LEFT JOIN (SELECT company_id, strftime(expense_date, '%Y-%m') AS month, {cents('amount')} AS total FROM v_expense WHERE status = 'approved' GROUP BY ALL) e ON e.company_id = s.company_id AND e.month = s.month"""


@query("W02_revenue_vs_expenses", TREND_SQL)
def revenue_vs_expenses(t):
    return trends.revenue_vs_expenses(t.v_sales, t.v_expense, AS_OF)


@query("W03_cash_flow_chart", f"SELECT company_id, month, label, revenue AS inflow, expenses AS outflow FROM ({TREND_SQL})")
def cash_flow_chart(t):
    return trends.cash_flow_chart(t.v_sales, t.v_expense, AS_OF)


def _pct(x: str) -> str:
    before = f"lag({x}) OVER (PARTITION BY company_id ORDER BY month)"
    return f"CASE WHEN {before} = 0 THEN 0 ELSE ({x} - {before}) / abs({before}) * 100 END AS {x}_growth"


@query("W04_growth_mom", f"SELECT company_id, month, {_pct('revenue')}, {_pct('expenses')}, {_pct('net')} FROM (SELECT *, round(revenue - expenses, 2) AS net FROM ({TREND_SQL}))")
def growth_mom(t):
    return trends.growth_mom(trends.revenue_vs_expenses(t.v_sales, t.v_expense, AS_OF))


@query("W05_margin_trend", f"SELECT company_id, month, CASE WHEN revenue = 0 THEN 0 ELSE floor((revenue - expenses) / revenue * 1000e0 + 0.5e0) / 10 END AS margin FROM ({TREND_SQL})")
def margin_trend(t):
    return trends.margin_trend(trends.revenue_vs_expenses(t.v_sales, t.v_expense, AS_OF))


@query("W06_top_vendors", f"""
SELECT company_id, vendor_id, name, total_spend, CAST(row_number() OVER (PARTITION BY company_id ORDER BY total_spend DESC, name, vendor_id) AS INT) AS position FROM ({VENDOR_SPEND_SQL}) QUALIFY position <= 5""")
def top_vendors(t):
    return trends.top_vendors(_vendors_with_spend(t), 5).select("company_id", "vendor_id", "name", "total_spend",
                                                                "position")


CANDIDATES_SQL = """SELECT invoice_id AS doc_id, description AS value, CASE WHEN position % 2 = 0 THEN 'label_anchor+pattern' ELSE 'positional_fallback' END AS method, quantity - discount_rate * 0.3e0 AS score, item_id AS ordinal FROM v_item"""


@query("W07_select_candidate", f"""
SELECT doc_id, value, method, score, score - runner_up AS margin, CASE WHEN runner_up IS NULL OR score - runner_up >= 0.05e0 THEN 'accept' ELSE 'review' END AS status FROM (
  SELECT *, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS runner_up, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS n FROM ({CANDIDATES_SQL})) WHERE n = 1""")
def select_candidate(t):
    method = F.when(F.col("position") % 2 == 0, "label_anchor+pattern").otherwise("positional_fallback")
    candidates = t.v_item.select(F.col("invoice_id").alias("doc_id"), F.col("description").alias("value"),
                                 method.alias("method"),
                                 (F.col("quantity") - F.col("discount_rate") * 0.3).alias("score"),
                                 F.col("item_id").alias("ordinal"))
    return trends.select_candidate(candidates, ["doc_id"], 0.05)


@query("W08_first_key_per_document", """
SELECT doc_id, key, label, value FROM (SELECT invoice_id AS doc_id, concat('key_', CAST(position % 3 AS VARCHAR)) AS key, CAST(position AS INT) AS line_idx, item_id AS cell_idx, concat('Key ', CAST(position % 3 AS VARCHAR), CASE WHEN position > 3 THEN ':' ELSE '' END) AS label, description AS value FROM v_item)
QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY line_idx, cell_idx) = 1""")
def first_key_per_document(t):
    number = (F.col("position") % 3).cast("string")
    rows = t.v_item.select(F.col("invoice_id").alias("doc_id"), F.concat(F.lit("key_"), number).alias("key"),
                           F.col("position").alias("line_idx"), F.col("item_id").alias("cell_idx"),
                           F.concat(F.lit("Key "), number, F.when(F.col("position") > 3, ":").otherwise(""))
                           .alias("label"), F.col("description").alias("value"))
    return trends.first_key_per_document(rows)


@query("W09_latest_by_group", """
SELECT company_id, vendor_id, split_part(max(CASE WHEN vendor_name IS NOT NULL THEN concat(COALESCE(CAST(invoice_date AS VARCHAR), ' '), '|', vendor_name) END), '|', 2) AS latest_name FROM v_purchase WHERE vendor_id IS NOT NULL GROUP BY ALL""")
def latest_by_group(t):
    return agg.vendor_spend(t.v_purchase).select("company_id", "vendor_id", "latest_name")


@query("W10_conversation_cursor", """
SELECT c.conversation_id, CASE WHEN c.last_error IS NULL THEN greatest(n.newest, epoch_us(c.last_seen) / 1000000e0) ELSE epoch_us(c.last_seen) / 1000000e0 END AS cursor_ts
FROM v_conversation c LEFT JOIN (SELECT conversation_id, max(CAST(message_ts AS DOUBLE)) AS newest FROM v_chat_file GROUP BY ALL) n USING (conversation_id)""")
def conversation_cursor(t):
    return trends.conversation_cursor(t.v_chat_file, t.v_conversation)


@query("T01_quote_ranking", """
SELECT request_id, quote_id, vendor_name, score, price, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, price, quote_id) AS INT) AS position FROM v_quote""")
def quote_ranking(t):
    return lists.quote_ranking(t.v_quote).select("request_id", "quote_id", "vendor_name", "score", "price", "position")


@query("T02_conversation_order", f"SELECT conversation_id, file_count, last_error FROM ({CONVERSATIONS_SQL})")
def conversation_order(t):
    return lists.conversation_order(joins.conversation_counts(t.v_conversation, t.v_chat_file)).select(
        "conversation_id", "file_count", "last_error")


@query("T03_page", f"""
SELECT invoice_id, {seconds('created_at')} AS created_at, total FROM v_purchase ORDER BY v_purchase.created_at DESC, invoice_id LIMIT 20 OFFSET 40""")
def page(t):
    return lists.page(lists.invoice_list(t.v_purchase), 40, 20).select("invoice_id", "created_at", "total")


@query("T03_page_by_index", f"""
SELECT invoice_id, {seconds('created_at')} AS created_at, total FROM v_purchase ORDER BY v_purchase.created_at DESC, invoice_id LIMIT 20 OFFSET 700""")
def page_by_index(t):
    index = lists.page_index(t.v_purchase)
    return lists.page_by_index(t.v_purchase, index, "invoice_id", 700, 20).select("invoice_id", "created_at", "total")


@query("T03_page_after", f"""
SELECT invoice_id, {seconds('created_at')} AS created_at, total FROM v_purchase ORDER BY v_purchase.created_at DESC, invoice_id LIMIT 20 OFFSET 60""")
def page_after(t):
    """The fourth page, from the last row of the third."""
    last = lists.page(lists.invoice_list(t.v_purchase), 59, 1).first()
    return lists.page_after(t.v_purchase, "invoice_id", last["created_at"], last["invoice_id"], 20).select("invoice_id", "created_at", "total")


ENTRIES = "type = 'purchase' AND status IN ('validated', 'sent_to_accounting')"


@query("T04_category_entries", f"""
SELECT invoice_id, company_id, CAST(invoice_date AS VARCHAR) AS invoice_date, total, transaction_status = 'transactional' AS counts_in_total FROM v_purchase WHERE {ENTRIES} AND category IS NULL""")
def category_entries(t):
    return lists.category_entries(t.v_purchase, uncategorized=True).select(
        "invoice_id", "company_id", "invoice_date", "total", "counts_in_total")


@query("U01_all_outflows", f"""
SELECT company_id, source, COUNT(*) AS row_count, {cents('amount')} AS amount FROM (
  SELECT company_id, source, amount FROM v_expense WHERE status = 'approved' UNION ALL SELECT company_id, source, amount FROM ({BOOKED_SQL})
  UNION ALL SELECT company_id, 'payroll', {cents('net_salary')} FROM ({TO_PROCESS_SQL}) GROUP BY company_id) GROUP BY company_id, source""")
def all_outflows(t):
    from ledgerloom.operators.changes import all_outflows as union_outflows, book_payroll

    run = book_payroll(joins.payroll_to_process(t.v_employee, t.v_payroll, AS_OF),
                       t.v_expense.withColumn("reference_id", F.lit(None).cast("string")), predicates.day(AS_OF))
    booked = joins.book_expenses(t.v_purchase, t.v_expense, AS_OF)
    return union_outflows(t.v_expense, booked, run).groupBy("company_id", "source").agg(
        F.count("*").alias("row_count"), money_sum("amount").alias("amount"))


@query("U02_month_union", f"SELECT company_id, month FROM ({MONTHS_SQL.format(sales='', spend='')})")
def month_union(t):
    return trends.month_union(t.v_sales, t.v_expense)


@query("U03_known_vendors", "SELECT DISTINCT company_id, vendor_name FROM v_purchase WHERE vendor_name IS NOT NULL")
def known_vendors(t):
    return joins.known_vendors(t.v_purchase)


# ----------------------------------------------------------------------- reports

REVENUE_SQL = f"SELECT company_id, {cents('total')} AS revenue FROM v_sales WHERE {SCANNED} AND {BUCKET} BETWEEN DATE '{{start}}' AND DATE '{{end}}' GROUP BY company_id"
BOTH_SQL = f"""SELECT company_id, COALESCE(revenue, 0) AS revenue, COALESCE(approved, 0) AS approved FROM ({REVENUE_SQL})
  FULL OUTER JOIN (SELECT company_id, {cents('amount', "status = 'approved'")} AS approved FROM v_expense WHERE expense_date >= DATE '{{start}}' AND expense_date < DATE '{{end}}' GROUP BY company_id) USING (company_id)"""


def _report_sql(summary_source: str, lines: dict[str, str], table: str | None = None) -> str:
    parts = [f"SELECT company_id, 'summary' AS section, {i} AS line, '{name}' AS label, {value} AS value FROM ({summary_source})"
             for i, (name, value) in enumerate(lines.items())]
    if table:
        parts.append(f"SELECT company_id, 'table', 0, label, value FROM ({table})")
    return f"SELECT company_id, section, line, label, CAST(value AS DOUBLE) AS value, {label('CAST(value AS DOUBLE)')} AS display FROM ({' UNION ALL '.join(parts)})"


PL_LINES = {"Revenue": "revenue", "Expenses (approved)": "approved", "Net Profit": "round(revenue - approved, 2)"}


@query("R01_report_profit_loss", _report_sql(
    BOTH_SQL.format(start=START, end=END), PL_LINES,
    f"SELECT company_id, category AS label, {cents('amount')} AS value FROM v_expense WHERE status = 'approved' AND {HALF_OPEN} GROUP BY company_id, category"))
def report_profit_loss(t):
    return reports.profit_loss(t.v_sales, t.v_expense, START, END)


FLOW_SQL = MONTHS_SQL.format(sales=f"AND {BUCKET} BETWEEN DATE '2001-01-01' AND DATE '{END}'", spend=f"AND expense_date BETWEEN DATE '2001-01-01' AND DATE '{END}'")


@query("R02_report_cash_flow", _report_sql(
    f"SELECT company_id, {cents('inflow')} AS inflow, {cents('outflow')} AS outflow FROM ({FLOW_SQL}) GROUP BY company_id",
    {"Total Inflow": "inflow", "Total Outflow": "outflow", "Net Cash Flow": "round(inflow - outflow, 2)"},
    " UNION ALL ".join(f"SELECT company_id, concat(month, ' {x}') AS label, {x} AS value FROM ({FLOW_SQL})" for x in ("inflow", "outflow", "net"))))
def report_cash_flow(t):
    return reports.cash_flow(t.v_sales, t.v_expense, "2001-01-01", END)


@query("R03_report_tax_summary", f"""
SELECT company_id, CASE WHEN filer_status = 'filer' THEN 'Filer' ELSE 'Non-Filer' END AS filer_label, revenue AS gross_revenue, revenue * (default_gst_rate / 100) AS output_gst, approved * (withholding_tax_rate / 100) AS withholding_tax,
  revenue * (default_gst_rate / 100) - approved * (withholding_tax_rate / 100) AS net_tax, {label('revenue * (default_gst_rate / 100) - approved * (withholding_tax_rate / 100)')} AS display
FROM (SELECT b.*, COALESCE(default_gst_rate, 18e0) AS default_gst_rate, COALESCE(withholding_tax_rate, 0e0) AS withholding_tax_rate, COALESCE(filer_status, 'filer') AS filer_status
  FROM ({BOTH_SQL.format(start=START, end=END)}) b LEFT JOIN v_tax_settings USING (company_id))""")
def report_tax_summary(t):
    return reports.tax_summary(t.v_sales, t.v_expense, t.v_tax_settings, START, END)


PENDING = "status IN ('needs_review', 'needs_review_high_priority')"
SALES_PERIOD = f"AND {BUCKET} BETWEEN DATE '2001-01-01' AND DATE '{END}'"


@query("R04_report_sales", _report_sql(
    f"SELECT company_id, {cents('total')} AS revenue, COUNT(*) AS documents, {count_if(PENDING)} AS pending FROM v_sales WHERE {SCANNED} {SALES_PERIOD} GROUP BY company_id",
    {"Total Revenue": "revenue", "Documents Scanned": "documents", "Pending Review": "pending"},
    f"SELECT company_id, customer_name AS label, total AS value FROM ({CUSTOMERS_SQL.format(period=SALES_PERIOD)})"))
def report_sales(t):
    return reports.sales(t.v_sales, "2001-01-01", END)


PERIOD_SPEND = f"SELECT company_id, vendor_id, max(vendor_name) AS vendor_name, {cents('total')} AS total_spend FROM v_purchase WHERE vendor_id IS NOT NULL AND invoice_date {PERIOD} GROUP BY company_id, vendor_id"


@query("R05_report_purchases", _report_sql(
    f"SELECT company_id, {cents('total_spend')} AS spend, COUNT(*) AS vendors FROM ({PERIOD_SPEND}) GROUP BY company_id",
    {"Total Spend": "spend", "Vendors": "vendors"},
    f"SELECT company_id, concat_ws(' ', COALESCE(vendor_name, '—'), vendor_id) AS label, total_spend AS value FROM ({PERIOD_SPEND})"))
def report_purchases(t):
    return reports.purchases(t.v_purchase, START, END)


@query("R06_report_cash_position", _report_sql(
    BOTH_SQL.format(start=reports.ALL_TIME_START, end=AS_OF), {"Cash Balance (approx.)": "round(revenue - approved, 2)"}))
def report_cash_position(t):
    return reports.cash_position(t.v_sales, t.v_expense, AS_OF)


@query("R07_report_category", f"""
SELECT e.invoice_id, e.company_id, e.category, e.transaction_status = 'transactional' AS counts_in_total, COALESCE(s.total, 0) AS category_total FROM v_purchase e
LEFT JOIN (SELECT company_id, category, {cents('total')} AS total FROM v_purchase WHERE {CASHBOOK} GROUP BY ALL) s ON s.company_id = e.company_id AND s.category IS NOT DISTINCT FROM e.category WHERE {ENTRIES.replace('type', 'e.type').replace('status IN', 'e.status IN')}""")
def report_category(t):
    return reports.category_report(t.v_purchase).select("invoice_id", "company_id", "category", "counts_in_total",
                                                        "category_total")

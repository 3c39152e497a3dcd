"""Fuzzy vendor matching and layout extraction."""

from __future__ import annotations

from pyspark.sql import functions as F



from ledgerloom.operators import layout, matching
from ledgerloom.operators.build import build_invoices, build_items
from ledgerloom.plans.catalog import query
from ledgerloom.sources.fixtures import AS_OF
from ledgerloom.sources.page_words import page_documents, page_words


# What the rendered pages print, straight from the source columns: the checking
# SQL states the truth of a page and knows nothing of how it is read back.
PAGE_SQL = """SELECT o_orderkey AS doc_id, c_name, concat('Acme ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)), ' Traders') AS vendor,
  strftime(o_orderdate, '%d/%m/%Y') AS day, COALESCE(l.n, 0) AS n, l.s, CAST(l.s * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS tax,
  COALESCE(l.s + CAST(l.s * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(18,2)), CAST(o_totalprice AS DECIMAL(18,2))) AS grand,
  7 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END AS header_row
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""
BOUNDARY_SQL = "CAST(header_row + 1 + n + floor((n + 1) / 3) AS INT)"


@query("J02_reconciliation_queue")
def reconciliation_queue(t):
    return matching.reconciliation_queue(t.v_purchase, t.v_ignored, t.v_vendor)


@query("J03_vendor_suggestions")
def vendor_suggestions(t):
    names = t.v_purchase.where(F.col("vendor_id").isNull() & (F.trim(F.col("vendor_name")) != ""))
    return matching.vendor_suggestions(names, t.v_vendor)


@query("J17_known_vendor_resolution")
def known_vendor_resolution(t):
    named = t.v_purchase.where(F.trim(F.col("vendor_name")) != "")
    known = t.v_vendor.select("company_id", F.col("name").alias("vendor_name"))
    return matching.known_vendor_resolution(named.select("company_id", "vendor_name"), known)


@query("L01_group_lines")
def group_lines(t):
    return layout.group_lines(page_words(t)).select(
        "doc_id", "page", "line_idx", F.transform("words", lambda w: w["text"]).alias("words"))


@query("L02_label_values", f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN vendor END AS vendor_label, c_name AS customer_label, concat('INV-', CAST(doc_id AS VARCHAR)) AS invoice_number, CASE WHEN doc_id % 6 <> 0 THEN '1234567-8' END AS ntn,
  CAST(s AS VARCHAR) AS subtotal, CASE WHEN n > 0 THEN CAST(tax AS VARCHAR) WHEN doc_id % 7 = 2 THEN 'BillTotal' END AS tax, CAST(NULL AS VARCHAR) AS discount FROM ({PAGE_SQL})""")
def label_values(t):
    lines = layout.with_label_values(layout.with_table_region(layout.group_lines(page_words(t))))
    fields = ("vendor_label", "customer_label", "invoice_number", "ntn", "subtotal", "tax", "discount")
    return lines.where(F.col("line_idx") == 0).select("doc_id", *[F.col(f"d_{f}.text").alias(f) for f in fields])


@query("L03_vendor_candidates")
def vendor_candidates(t):
    return layout.choose(layout.line_candidates(page_words(t)), "vendor")


@query("L04_name_continuation", f"""
SELECT doc_id, CASE WHEN doc_id % 5 <> 1 AND doc_id % 3 = 0 AND doc_id % 12 <> 0 THEN concat(vendor, ' Hardware Store') ELSE vendor END AS vendor_name, CASE WHEN doc_id % 5 = 1 THEN 'label_anchor+pattern' ELSE 'positional_fallback' END AS method FROM ({PAGE_SQL})""")
def name_continuation(t):
    fields = layout.document_fields(layout.line_candidates(page_words(t)))
    return fields.select("doc_id", F.col("vendor.value").alias("vendor_name"),
                         F.col("vendor.method").alias("method"))


@query("L05_date_candidates", f"SELECT doc_id, day AS value, 'label_anchor+pattern' AS method, 'accept' AS status FROM ({PAGE_SQL})")
def date_candidates(t):
    return layout.choose(layout.line_candidates(page_words(t)), "date").select("doc_id", "value", "method", "status")


_TOTALS_SQL = f"""SELECT *, CASE WHEN doc_id % 9 = 0 THEN 15 END AS second_page, CASE doc_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 15 WHEN 2 THEN NULL ELSE 20 END + CASE WHEN n > 0 THEN 3 ELSE 0 END AS last_line FROM ({PAGE_SQL})"""


@query("L06_total_candidates", f"""
SELECT doc_id, CAST(CASE WHEN last_line >= COALESCE(second_page, 0) THEN grand WHEN second_page IS NOT NULL THEN 99.00 ELSE s END AS DOUBLE) AS value, 'label_anchor+pattern' AS method,
  CASE WHEN last_line = second_page THEN 'review' ELSE 'accept' END AS status FROM ({_TOTALS_SQL}) WHERE last_line IS NOT NULL OR second_page IS NOT NULL OR s IS NOT NULL""")
def total_candidates(t):
    return layout.choose(layout.line_candidates(page_words(t)), "total").select(
        "doc_id", F.col("value").cast("double").alias("value"), "method", "status")


@query("L07_total_positional", f"""
SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN 0 ELSE 2 + 2 * n + CASE WHEN n > 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END END AS specific_count, CAST(NULL AS VARCHAR) AS total_text FROM ({PAGE_SQL})""")
def total_positional(t):
    lines = layout.with_label_values(layout.with_table_region(layout.group_lines(page_words(t))))
    only = F.when(F.col("specific_count") == 1, F.col("specific_first.w.text"))
    return lines.where(F.col("line_idx") == 0).select("doc_id", "specific_count", only.alias("total_text"))


@query("L07_lone_amount", f"""
SELECT doc_id, CAST(CASE WHEN doc_id % 12 = 0 THEN 0 ELSE 1 END AS BIGINT) AS specific_count, CASE WHEN doc_id % 12 <> 0 THEN 10e0 END AS total,
  CASE WHEN doc_id % 12 <> 0 THEN 'positional_fallback' END AS method FROM ({PAGE_SQL})""")
def lone_amount(t):
    """Pages cut down to the one line that holds a single amount and no total's label."""
    region = layout.with_table_region(layout.group_lines(page_words(t).where("y0 = 140")))
    candidates = layout.candidates_of(region)
    counted = candidates.where("line_idx = 0").select("doc_id", "specific_count")
    chosen = layout.document_fields(candidates).select("doc_id", F.col("total.value").alias("total"), F.col("total.method").alias("method"))
    return counted.join(chosen, "doc_id")


@query("L08_item_header_row", f"SELECT doc_id, CAST(header_row AS INT) AS header_row FROM ({PAGE_SQL})")
def item_header_row(t):
    lines = layout.with_table_region(layout.group_lines(page_words(t)))
    return lines.where(F.col("line_idx") == 0).select("doc_id", "header_row")


@query("L09_item_columns", f"""
SELECT doc_id, 'description' AS field, 5e0 AS x0, 300e0 AS x1 FROM ({PAGE_SQL}) UNION ALL SELECT doc_id, 'qty', 295e0, 360e0 FROM ({PAGE_SQL}) UNION ALL SELECT doc_id, 'rate', 355e0, 480e0 FROM ({PAGE_SQL})
UNION ALL SELECT doc_id, 'amount', 475e0, CASE WHEN doc_id % 4 = 0 THEN 522e0 ELSE 530e0 END FROM ({PAGE_SQL})""")
def item_columns(t):
    lines = layout.with_table_region(layout.group_lines(page_words(t)))
    return lines.where(F.col("line_idx") == 0).select("doc_id", F.explode("bands").alias("b")).select("doc_id", "b.*")


@query("L10_totals_boundary", f"SELECT doc_id, {BOUNDARY_SQL} AS boundary FROM ({PAGE_SQL})")
def totals_boundary(t):
    lines = layout.with_table_region(layout.group_lines(page_words(t)))
    return lines.where(F.col("line_idx") == 0).select("doc_id", "boundary")


@query("L11_item_rows", """
SELECT doc_id, position, description, qty, rate, amount, CASE WHEN abs(qty * rate - amount) <= 0.02e0 * greatest(abs(amount), 1e0) THEN 'pass' ELSE 'fail' END AS arithmetic_check, '' AS review_flags FROM (
  SELECT l_orderkey AS doc_id, CAST(p AS INT) AS position, concat('Part SKU-', CAST(l_partkey AS VARCHAR), CASE WHEN p % 3 = 1 THEN ' with steel handle' ELSE '' END) AS description,
    l_quantity AS qty, floor(l_extendedprice * 100 / l_quantity) / 100 AS rate, l_extendedprice AS amount
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_extendedprice, l_shipdate) - 1 AS p FROM lineitem))""")
def item_rows(t):
    return layout.item_rows(page_words(t))


@query("L12_discover_fields", f"""
SELECT doc_id, 'shipping' AS key, 'SHIPPING' AS label, '10.00' AS value, CAST(header_row - 3 AS INT) AS line_idx FROM ({PAGE_SQL})
UNION ALL SELECT doc_id, 'payment_method', 'PAYMENT METHOD', 'Money order', CAST(header_row - 2 AS INT) FROM ({PAGE_SQL})
UNION ALL SELECT doc_id, 'billtotal', 'BillTotal', CAST(grand AS VARCHAR), {BOUNDARY_SQL} + 2 FROM ({PAGE_SQL}) WHERE doc_id % 7 = 2""")
def discover_fields(t):
    return layout.discovered_fields(page_words(t))


FIELDS_SQL = f"""SELECT *, CASE WHEN internal THEN NULL WHEN doc_id % 5 <> 1 AND doc_id % 3 = 0 AND doc_id % 12 <> 0 THEN concat(vendor, ' Hardware Store') ELSE vendor END AS vendor_name,
  CASE WHEN doc_id % 6 = 3 THEN 'minute_sheet' WHEN doc_id % 7 = 2 THEN 'approval_request' WHEN doc_id % 6 = 2 THEN 'quotation' WHEN doc_id % 6 = 4 THEN 'purchase_order' WHEN doc_id % 6 = 0 THEN 'invoice' WHEN doc_id % 6 = 1 OR n > 0 THEN 'receipt' END AS document_type,
  CASE WHEN internal THEN NULL ELSE chosen END AS total, CASE WHEN doc_id % 7 = 2 THEN 22875e0 WHEN internal THEN chosen END AS amount_mentioned, NOT internal AND doc_id % 6 NOT IN (2, 4) AS transactional
  FROM (SELECT *, doc_id % 6 = 3 OR doc_id % 7 = 2 AS internal, CAST(CASE WHEN last_line >= COALESCE(second_page, 0) THEN grand WHEN second_page IS NOT NULL THEN 99.00 ELSE s END AS DOUBLE) AS chosen FROM ({_TOTALS_SQL}))"""


@query("L13_extract_fields", f"""
SELECT doc_id, document_type, transactional, vendor_name, c_name AS customer_name, concat('INV-', CAST(doc_id AS VARCHAR)) AS invoice_number, CAST(strptime(day, '%d/%m/%Y') AS DATE)::VARCHAR AS invoice_date,
  CASE WHEN doc_id % 6 <> 0 THEN '1234567-8' END AS ntn, CASE WHEN NOT internal THEN CAST(s AS DOUBLE) END AS subtotal, CASE WHEN NOT internal AND n > 0 THEN CAST(tax AS DOUBLE) END AS tax_amount, total, amount_mentioned FROM ({FIELDS_SQL})""")
def extract_fields(t):
    return layout.extract_fields(page_documents(t), page_words(t), AS_OF).select(
        "doc_id", "document_type", "transactional", "vendor_name", "customer_name", "invoice_number", "invoice_date",
        "ntn", "subtotal", "tax_amount", "total", "amount_mentioned")


@query("L13_known_vendors", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR vendor_name IS NULL OR 2e0 * length(vendor) / (length(vendor) + length(vendor_name)) < 0.75 THEN vendor_name ELSE upper(vendor) END AS vendor_name,
  total, transactional FROM ({FIELDS_SQL})""")
def known_vendors(t):
    """Three of four companies know every vendor under a spelling of their own. A printed name
    takes it where the two are similar enough, counted over the letters they share."""
    name = F.upper(F.concat(F.lit("Acme "), "c_mktsegment", F.lit(" Traders")))
    known = t.customer.select("c_mktsegment").distinct().select(
        F.explode(F.expr("array(0L, 1L, 2L)")).alias("company_id"), name.alias("vendor_name"))
    pages = page_documents(t).withColumn("company_id", (F.col("doc_id") % 4).cast("long"))
    return layout.extract_with_known_vendors(pages, page_words(t), known, AS_OF).select("doc_id", "vendor_name", "total", "transactional")


@query("L13_confidence_and_routing")
def confidence_and_routing(t):
    return layout.extract_fields(page_documents(t), page_words(t), AS_OF).select(
        "doc_id", "vendor_method", "vendor_confidence", "date_confidence", "total_confidence", "items_sum", "pass_rate",
        "totals_pass", "tax_rate_ok", "date_ok", "magnitude_ok", "arithmetic_ok", "currency", "city", "country",
        "payment_status", "document_confidence", "review_flags", "review_status")


@query("L14_build_items", """
SELECT doc_id AS invoice_id, position, description, qty, rate, amount, CASE WHEN abs(qty * rate - amount) <= 0.02e0 * greatest(abs(amount), 1e0) THEN 'pass' ELSE 'fail' END AS arithmetic_check, '' AS review_flags FROM (
  SELECT l_orderkey AS doc_id, CAST(p AS INT) AS position, concat('Part SKU-', CAST(l_partkey AS VARCHAR), CASE WHEN p % 3 = 1 THEN ' with steel handle' ELSE '' END) AS description,
    l_quantity AS qty, floor(l_extendedprice * 100 / l_quantity) / 100 AS rate, l_extendedprice AS amount
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_extendedprice, l_shipdate) - 1 AS p FROM lineitem))""")
def built_items(t):
    return build_items(layout.item_rows(page_words(t)))


@query("L14_build_invoice", f"""
SELECT doc_id, 'purchase' AS type, CASE WHEN transactional THEN 'transactional' ELSE 'non_transactional' END AS transaction_status, vendor_name, concat('scan_', CAST(doc_id AS VARCHAR), '.pdf') AS filename, total, amount_mentioned,
  CASE WHEN NOT transactional THEN NULL WHEN vendor_name LIKE '%Hardware Store' THEN 'Office Repair & Maintenance' WHEN doc_id % 5 = 0 THEN 'Employee Care' WHEN doc_id % 5 = 1 THEN 'Vehicle Running & Maintenance' END AS category FROM ({FIELDS_SQL})""")
def build_invoice(t):
    pages = page_documents(t)
    region = layout.with_table_region(layout.group_lines(page_words(t)))
    fields = layout.assemble_documents(pages, layout.document_fields(layout.candidates_of(region)), AS_OF)
    files = pages.select("doc_id", F.concat(F.lit("scan_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
                         .alias("filename"))
    return build_invoices(fields, layout.items_of(region), files, "purchase").select(
        "doc_id", "type", "transaction_status", "vendor_name", "filename", "total", "amount_mentioned", "category")

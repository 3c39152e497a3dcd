"""Derived views: realistic ledger entities computed from the raw tables.

Each view is one SQL text that runs unchanged in Spark and in the checking
engine, so both sides of every comparison start from the same rows. Attributes
vary by key arithmetic; no view drops rows by key arithmetic.
"""

from __future__ import annotations

#: Reports and "today" are evaluated at this date on the fixture tables.
AS_OF = "2001-07-15"
#: The event tables cover January 2024; feeds are evaluated at this moment.
FEED_NOW = "2024-01-30 00:00:00"

VIEWS: dict[str, str] = {
    "v_sales": """
SELECT CAST(o_orderkey AS STRING) AS invoice_id, c_nationkey % 5 AS company_id, 'sale' AS type,
  CASE WHEN o_orderstatus = 'F' THEN 'validated' WHEN o_orderstatus = 'P' THEN 'processed'
       WHEN o_orderpriority = '1-URGENT' THEN 'needs_review_high_priority'
       WHEN o_orderpriority = '5-LOW' THEN 'rejected' ELSE 'needs_review' END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN 'generated' WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'ocr' END AS extraction_source,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS invoice_date,
  o_orderdate + INTERVAL '3' DAY AS created_at,
  CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_name END AS customer_name,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END AS total
FROM orders JOIN customer ON o_custkey = c_custkey""",

    "v_purchase": """
SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) AS invoice_id,
  s_nationkey % 5 AS company_id, 'purchase' AS type,
  CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'processed' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'needs_review_high_priority' WHEN 3 THEN 'validated' WHEN 4 THEN 'sent_to_accounting' ELSE 'rejected' END AS status,
  CASE WHEN l_partkey % 10 = 0 THEN 'non_transactional' ELSE 'transactional' END AS transaction_status,
  CASE WHEN l_partkey % 7 = 0 THEN 'user_override' ELSE 'rule' END AS classification_source,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS vendor_id,
  CASE l_linenumber WHEN 1 THEN upper(s_name) WHEN 2 THEN concat(s_name, ' Pvt Ltd') WHEN 3 THEN replace(s_name, '#', ' ') WHEN 6 THEN NULL WHEN 7 THEN '' ELSE s_name END AS vendor_name,
  CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_type = 'ECONOMY' THEN 'Office / Misc Supplies' WHEN p_type = 'SMALL' THEN 'Stationary / Others' WHEN p_type = 'MEDIUM' THEN 'Utilities' WHEN p_type = 'PROMO' THEN 'Marketing' WHEN p_type = 'LARGE' THEN 'Rent' ELSE 'Raw Material' END AS category,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'bank' ELSE 'cash' END AS payment_method,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE concat('INV-', CAST(l_orderkey AS STRING)) END AS invoice_number,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS invoice_date,
  l_shipdate + INTERVAL '2' DAY AS created_at,
  concat('scan_', CAST(l_orderkey AS STRING), CASE l_linenumber % 2 WHEN 0 THEN '.pdf' ELSE '.jpg' END) AS filename,
  CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE l_extendedprice END AS total,
  CASE WHEN l_partkey % 40 = 0 THEN l_extendedprice ELSE NULL END AS amount_mentioned,
  CASE l_linenumber % 4 WHEN 0 THEN 'minute_sheet' WHEN 1 THEN 'invoice' WHEN 2 THEN 'credit_note' ELSE NULL END AS document_type
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",

    "v_invoice": """
SELECT invoice_id, company_id, type, status, 'transactional' AS transaction_status, extraction_source, CAST(NULL AS STRING) AS vendor_name, customer_name, invoice_date, created_at, total FROM v_sales
UNION ALL
SELECT invoice_id, company_id, type, status, transaction_status, 'ocr' AS extraction_source, vendor_name, CAST(NULL AS STRING) AS customer_name, invoice_date, created_at, total FROM v_purchase""",

    "v_expense": """
SELECT md5(concat_ws('|', 'E', CAST(l_orderkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) AS expense_id,
  s_nationkey % 5 AS company_id,
  CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status,
  CASE WHEN p_type = 'ECONOMY' THEN 'Salaries' WHEN p_type = 'SMALL' THEN 'Office' WHEN p_type = 'MEDIUM' THEN 'Utilities' WHEN p_type = 'PROMO' THEN 'Marketing' WHEN p_type = 'LARGE' THEN 'Rent' ELSE 'Raw Material' END AS category,
  s_name AS vendor_name, CAST(l_shipdate AS DATE) AS expense_date, l_shipdate + INTERVAL '1' DAY AS created_at,
  l_extendedprice AS amount,
  CASE WHEN l_linenumber = 1 THEN md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) ELSE NULL END AS invoice_id,
  CASE WHEN l_linenumber = 1 THEN 'invoice' ELSE 'manual' END AS source
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",

    "v_vendor": """
SELECT CAST(s_suppkey AS STRING) AS vendor_id, s_nationkey % 5 AS company_id, s_name AS name,
  CASE s_suppkey % 3 WHEN 0 THEN 'Raw Material' WHEN 1 THEN 'Services' ELSE 'Utilities' END AS category,
  n_name AS city, CASE WHEN s_acctbal < 500 THEN 'inactive' ELSE 'active' END AS status,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey % 5 + 1 AS DOUBLE) END AS rating
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",

    "v_ignored": """
SELECT s_nationkey % 5 AS company_id, replace(s_name, '#', ' ') AS vendor_name FROM supplier WHERE s_acctbal < 2000""",

    "v_employee": """
SELECT c_custkey AS employee_id, c_nationkey % 5 AS company_id, c_name AS name, c_mktsegment AS department,
  abs(c_acctbal) + 1000 AS salary, (c_custkey % 4) * 100 AS bonus, (c_custkey % 3) * 50 AS deductions, c_custkey % 10 <> 0 AS active
FROM customer""",

    "v_payroll": """
SELECT employee_id, company_id, '2001-05' AS period, salary + bonus - deductions AS net_salary, TIMESTAMP '2001-05-28 10:00:00' AS processed_at FROM v_employee
UNION ALL
SELECT employee_id, company_id, '2001-06' AS period, salary + bonus - deductions AS net_salary, TIMESTAMP '2001-06-28 10:00:00' AS processed_at FROM v_employee WHERE active
UNION ALL
SELECT employee_id, company_id, '2001-07' AS period, salary + bonus - deductions AS net_salary, TIMESTAMP '2001-07-10 10:00:00' AS processed_at FROM v_employee WHERE department <> 'BUILDING'""",

    "v_request": """
SELECT concat('R', CAST(o_orderkey AS STRING)) AS request_id, CAST(floor(o_orderkey / 2) AS BIGINT) % 5 AS company_id,
  c_mktsegment AS department, c_name AS requester_name, concat('Item for ', o_orderpriority) AS item,
  CASE o_orderkey % 9 WHEN 0 THEN 'pending_approval' WHEN 4 THEN 'rejected' ELSE 'approved' END AS status,
  o_totalprice AS amount, o_orderdate AS created_at, o_orderdate + INTERVAL '2' DAY AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey""",

    "v_order": """
SELECT concat('PO', CAST(o_orderkey AS STRING)) AS order_id, CAST(floor(o_orderkey / 2) AS BIGINT) % 5 AS company_id,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE concat('R', CAST(o_orderkey - o_orderkey % 2 AS STRING)) END AS request_id,
  c_name AS vendor_name, o_totalprice AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'cancelled' ELSE 'in_transit' END AS status,
  CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS expected_delivery,
  o_orderdate AS created_at, o_orderdate + INTERVAL '20' DAY AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey""",

    "v_quote": """
SELECT md5(concat_ws('|', 'Q', CAST(l_orderkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) AS quote_id,
  concat('R', CAST(l_orderkey AS STRING)) AS request_id, CAST(floor(l_orderkey / 2) AS BIGINT) % 5 AS company_id,
  s_name AS vendor_name, l_extendedprice AS price,
  CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_quantity * 2 END AS score
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",

    "v_tax_settings": """
SELECT n_nationkey % 5 AS company_id, 18.0e0 AS default_gst_rate, CAST(max(n_regionkey) AS DOUBLE) AS withholding_tax_rate,
  CASE WHEN n_nationkey % 5 = 0 THEN 'non_filer' ELSE 'filer' END AS filer_status
FROM nation WHERE n_nationkey % 5 <> 4 GROUP BY n_nationkey % 5""",

    "v_item": """
SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) AS item_id,
  l_orderkey AS invoice_id, l_linenumber AS position, concat('Part ', CAST(l_partkey AS STRING)) AS description,
  CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE l_quantity END AS qty, l_extendedprice / l_quantity AS rate,
  CASE WHEN l_orderkey % 9 = 0 THEN l_extendedprice * 1.1e0 WHEN l_orderkey % 29 = 0 THEN NULL ELSE l_extendedprice END AS amount,
  l_tax AS tax_rate, l_discount AS discount_rate, l_extendedprice AS price, l_quantity AS quantity
FROM lineitem""",

    "v_invoice_text": """
SELECT o_orderkey AS doc_id, o_totalprice AS true_total, CAST(o_orderdate AS DATE) AS true_date, concat_ws(chr(10),
  CASE o_orderkey % 6 WHEN 0 THEN 'INVOICE' WHEN 1 THEN 'Cash Receipt' WHEN 2 THEN 'Quotation' WHEN 3 THEN 'MINUTE SHEET' WHEN 4 THEN 'Purchase Order' ELSE 'Express Mart' END,
  CASE o_orderkey % 5 WHEN 0 THEN 'farewell cake' WHEN 1 THEN 'petrol' WHEN 2 THEN 'restaurant bakery' WHEN 3 THEN 'toner and repair' ELSE 'sundries' END,
  concat('Date: ', CASE o_orderkey % 3 WHEN 0 THEN dmy ELSE iso END),
  concat('Grand Total: ', CASE o_orderkey % 4 WHEN 0 THEN 'Rs. ' WHEN 1 THEN '$' WHEN 2 THEN 'EUR ' ELSE '' END, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)),
  CASE o_orderkey % 7 WHEN 0 THEN 'paid in full' WHEN 1 THEN 'balance due' WHEN 2 THEN 'For approval of Rs. 22,875/-' ELSE '' END,
  CASE o_orderkey % 8 WHEN 0 THEN 'Lahore' WHEN 1 THEN '+44 20 7946' ELSE '' END) AS text
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso,
  concat_ws('/', CAST(day(o_orderdate) AS STRING), CAST(month(o_orderdate) AS STRING), CAST(year(o_orderdate) AS STRING)) AS dmy FROM orders) o""",

    # Short printed values in many spellings, for the value parsers.
    "v_snippet": """
SELECT md5(concat_ws('|', 'S', CAST(l_orderkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), iso)) AS snippet_id,
  CASE l_linenumber % 7 WHEN 0 THEN concat('Rs. ', price) WHEN 1 THEN concat('(', price, ')') WHEN 2 THEN concat('Advance -', price)
    WHEN 3 THEN concat('PKR ', substr(price, 1, 1), ',', substr(price, 2)) WHEN 4 THEN 'n/a' WHEN 5 THEN concat(price, ' USD') ELSE concat('Rs.', substr(price, 1, 3), '_cleaning') END AS money_text,
  CASE l_partkey % 12 WHEN 0 THEN concat(dd, '/', mm, '/', yyyy) WHEN 1 THEN concat(dd, '-', mm, '-', yyyy) WHEN 2 THEN iso
    WHEN 3 THEN concat(dd, ' ', mon, ' ', yyyy) WHEN 4 THEN concat(mon, ' ', dd, ', ', yyyy, ', 4:18:34 PM') WHEN 5 THEN concat(dd, 'th ', mon, ' ', yyyy)
    WHEN 6 THEN concat(dd, mon, yyyy) WHEN 7 THEN concat(dd, '/', mm, '/', substr(yyyy, 3, 2)) WHEN 8 THEN concat(dd, '/', mm, '/', yyyy, '4:30:13PM')
    WHEN 9 THEN concat('Date:', dd, '/', mm, '/', yyyy) WHEN 10 THEN concat(mm, '/', dd, '/', yyyy) ELSE concat('Ref ', CAST(l_partkey AS STRING)) END AS date_text,
  CASE l_suppkey % 5 WHEN 0 THEN concat('INV-', CAST(l_orderkey AS STRING)) WHEN 1 THEN CAST(l_linenumber AS STRING) WHEN 2 THEN concat('No ', CAST(l_orderkey AS STRING))
    WHEN 3 THEN concat('39', CAST(10000 + l_partkey % 80000 AS STRING), '-', CAST(l_linenumber % 10 AS STRING)) ELSE CAST(1000000 + l_orderkey AS STRING) END AS number_text,
  CASE l_quantity WHEN 1 THEN concat('Invoice# ', CAST(l_orderkey AS STRING)) WHEN 2 THEN iso WHEN 3 THEN 'Powered by Acme POS' WHEN 4 THEN 'Thank you, visit again!' WHEN 5 THEN 'Dear customer'
    WHEN 6 THEN 'billing@vendor.com' WHEN 7 THEN concat('Plaza ', CAST(l_linenumber AS STRING), ', Main Road') WHEN 8 THEN 'Account Holder Name' WHEN 9 THEN 'Home Delivery' WHEN 10 THEN 'Cash Receipt'
    WHEN 11 THEN concat('B0-', CAST(l_linenumber AS STRING)) WHEN 12 THEN '---' ELSE concat(s_name, CASE l_linenumber % 4 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' (Pvt) Ltd' ELSE '  Traders' END) END AS line_text,
  CASE l_partkey % 4 WHEN 0 THEN 'SHIPPING & HANDLING' WHEN 1 THEN 'Order Number:' WHEN 2 THEN 'PO #' ELSE concat('Sales Tax / GST - ', p_brand) END AS label_text
FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price, CAST(CAST(l_shipdate AS DATE) AS STRING) AS iso,
    CAST(day(l_shipdate) AS STRING) AS dd, CAST(month(l_shipdate) AS STRING) AS mm, CAST(year(l_shipdate) AS STRING) AS yyyy,
    CASE month(l_shipdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'February' WHEN 3 THEN 'MARCH' WHEN 4 THEN 'apr' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'August' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'November' ELSE 'Dec' END AS mon
  FROM lineitem) l JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",

    "v_attachment": """
SELECT event_id AS message_id, 0 AS attachment_index, user_id % 20 AS account_id, ts AS received_at,
  concat('user', CAST(user_id AS STRING), CASE user_id % 3 WHEN 0 THEN '@vendor.com' WHEN 1 THEN '@spam.net' ELSE '@Other.org' END) AS from_address,
  concat(CASE event_type WHEN 'purchase' THEN 'invoice_' WHEN 'click' THEN 'scan ' WHEN 'view' THEN 'report ' WHEN 'signup' THEN 'contract_' ELSE 'misc_' END, CAST(event_id AS STRING),
    CASE event_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.ics' WHEN 2 THEN '.csv' WHEN 3 THEN '.PDF' WHEN 4 THEN '.exe' ELSE '.png' END) AS filename,
  CASE event_id % 6 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'application/pdf' WHEN 5 THEN 'image/png' ELSE 'application/octet-stream' END AS mimetype,
  CAST(round(value * 1000, 0) AS BIGINT) AS size, concat('pa-', CAST(event_id AS STRING)) AS provider_attachment_id,
  event_type AS subject
FROM events""",

    # Attachments as an earlier sync stored them, some corrected by people.
    "v_stored_attachment": """
SELECT account_id, message_id, attachment_index, concat('old_', filename) AS filename, mimetype, size - 1 AS size,
  concat('expired-', CAST(message_id AS STRING)) AS provider_attachment_id,
  CASE WHEN message_id % 4 = 0 THEN 'Contracts' ELSE 'uncategorized' END AS category,
  CASE WHEN message_id % 4 = 0 THEN 1.0e0 ELSE 0.0e0 END AS category_confidence,
  CASE WHEN message_id % 4 = 0 THEN 'manual_override' ELSE 'rule_based' END AS category_source,
  CASE message_id % 3 WHEN 0 THEN 'imported' WHEN 1 THEN 'needs_review' ELSE 'rejected' END AS review_status,
  CASE WHEN message_id % 9 = 0 THEN received_at ELSE NULL END AS deleted_at
FROM v_attachment WHERE received_at < TIMESTAMP '2024-01-20 00:00:00'""",

    "v_sender_rule": """
SELECT DISTINCT user_id % 20 AS account_id, concat('User', CAST(user_id AS STRING), CASE user_id % 3 WHEN 0 THEN '@vendor.com' WHEN 1 THEN '@spam.net' ELSE '@other.org' END) AS pattern,
  CASE WHEN user_id % 7 = 0 THEN 'deny' ELSE 'allow' END AS action
FROM events WHERE value > 200
UNION ALL
SELECT DISTINCT user_id % 20 AS account_id, ' Spam.NET ' AS pattern, 'deny' AS action FROM events WHERE value > 330
UNION ALL
SELECT DISTINCT user_id % 20 AS account_id, concat(' user', CAST(user_id AS STRING), CASE user_id % 3 WHEN 0 THEN '@VENDOR.com' WHEN 1 THEN '@spam.net' ELSE '@other.org' END) AS pattern, 'deny' AS action FROM events WHERE value > 200 AND user_id % 7 = 1""",

    "v_mail": """
SELECT user_id % 20 AS account_id, event_id AS message_id, ts AS received_at,
  CASE event_id % 5 WHEN 0 THEN concat('"User ', CAST(user_id AS STRING), '" <u', CAST(user_id AS STRING), '@vendor.com>') WHEN 1 THEN concat('User ', CAST(user_id AS STRING), ' <u', CAST(user_id AS STRING), '@vendor.com>')
    WHEN 2 THEN concat('u', CAST(user_id AS STRING), '@vendor.com') WHEN 3 THEN '' ELSE NULL END AS from_header,
  concat('Re: ', event_type) AS subject_header, concat('Books <books', CAST(user_id % 20 AS STRING), '@company.com>') AS to_header, CAST(CAST(ts AS DATE) AS STRING) AS date_header
FROM events""",

    "v_job": """
SELECT event_id AS job_id, user_id AS account_id, user_id % 50 AS run_group,
  CASE event_type WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
  ts AS started_at, CASE WHEN event_type IN ('click', 'signup') THEN NULL ELSE ts + INTERVAL '1' HOUR END AS completed_at,
  CASE WHEN event_type = 'error' THEN split('first,boom', ',') ELSE NULL END AS errors, value AS work
FROM events""",

    "v_account": """
SELECT user_id AS account_id, CASE WHEN user_id % 6 = 0 THEN 'revoked' ELSE 'active' END AS status FROM events GROUP BY user_id
UNION ALL
SELECT user_id + 1000000 AS account_id, CASE WHEN user_id % 6 = 1 THEN 'revoked' ELSE 'active' END AS status FROM events GROUP BY user_id""",

    "v_chat_file": """
SELECT concat('F', CAST(event_id AS STRING)) AS file_id, user_id AS conversation_id, user_id % 5 AS installation_id,
  concat(CAST(1704067200 + event_id * 250 AS STRING), '.000100') AS message_ts, ts AS created_at,
  concat(CASE event_type WHEN 'purchase' THEN 'receipt ' WHEN 'view' THEN 'budget_' ELSE 'photo' END, CAST(event_id AS STRING), CASE event_id % 3 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.png' ELSE '.txt' END) AS filename,
  CASE event_id % 4 WHEN 0 THEN NULL ELSE concat('Shared ', event_type) END AS title,
  CASE event_id % 3 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'png' ELSE 'text' END AS file_type,
  CASE event_id % 3 WHEN 0 THEN 'application/vnd.ms-excel' WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS mimetype,
  CAST(round(value * 1000, 0) AS BIGINT) AS size, event_id % 11 = 0 AS is_external,
  CASE event_type WHEN 'purchase' THEN 'Receipts' WHEN 'view' THEN 'Spreadsheets & Financial' ELSE 'uncategorized' END AS category,
  CASE WHEN event_id % 13 = 0 THEN ts ELSE NULL END AS deleted_at
FROM events""",

    "v_conversation": """
SELECT user_id AS conversation_id, concat('channel-', CAST(user_id AS STRING)) AS name,
  CASE user_id % 6 WHEN 0 THEN 'not_in_channel' WHEN 1 THEN 'ratelimited' WHEN 2 THEN 'odd_code' ELSE NULL END AS last_error,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE min(ts) + INTERVAL '12' DAY END AS last_seen
FROM events GROUP BY user_id""",

    # One listing of remote files and one of stored files; neither side is complete.
    "v_files_listing": """
SELECT installation_id, file_id, filename, CASE WHEN file_type = 'png' THEN size + 1 ELSE size END AS size, CASE WHEN file_type = 'text' THEN NULL ELSE mimetype END AS mimetype, is_external
FROM v_chat_file WHERE category <> 'Receipts' OR is_external""",
    "v_files_stored": """
SELECT CASE WHEN size % 17 = 0 THEN installation_id + 1 ELSE installation_id END AS installation_id, file_id, filename, size, mimetype, CASE WHEN size < 3000 THEN NOT is_external ELSE is_external END AS is_external
FROM v_chat_file WHERE category <> 'Spreadsheets & Financial' OR size > 20000""",

    "v_upload": """
SELECT doc_id AS upload_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS company_id,
  text AS content, concat('upload_', CAST(doc_id AS STRING), '.txt') AS filename, n_chars AS size, source,
  CASE WHEN source LIKE 'src1%' THEN 'Invoices' WHEN source LIKE 'src2%' THEN 'Other' ELSE 'uncategorized' END AS category,
  CASE WHEN doc_id % 17 = 0 THEN DATE '2024-01-05' ELSE NULL END AS deleted_at
FROM documents""",

    "v_extraction": """
SELECT CAST(o_orderkey AS STRING) AS invoice_id, CASE WHEN o_orderkey % 16 = 5 THEN NULL ELSE concat(
  '{"vendor_name":{"value":', CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE concat('"', c_name, '"') END, ',"confidence":', CASE o_orderkey % 3 WHEN 0 THEN '0.9' WHEN 1 THEN '0.5' ELSE '0.35' END, ',"method":"positional_fallback","page":0,"bbox":[10.0,20.0,110.0,32.0]},',
  '"total":{"value":', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ',"confidence":0.95,"method":"label_anchor+pattern","page":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '1' END, ',"bbox":[1.0,2.0,3.0,4.0]},',
  '"currency":{"value":', CASE o_orderkey % 4 WHEN 0 THEN '"PKR"' WHEN 1 THEN '"USD"' ELSE 'null' END, ',"confidence":', CASE o_orderkey % 4 WHEN 0 THEN '1.0' ELSE '0.45' END, CASE WHEN o_orderkey % 8 = 0 THEN ',"status":"UNCERTAIN"' ELSE '' END, '},',
  '"document_type":{"value":"', CASE o_orderkey % 2 WHEN 0 THEN 'invoice' ELSE 'minute_sheet' END, '","confidence":1.0},"classification_reason":"seen on page"}') END AS raw_extraction_json
FROM orders JOIN customer ON o_custkey = c_custkey""",

    # Decision log: what reviewers did to purchases, possibly several times.
    "v_decision": """
SELECT invoice_id, created_at + INTERVAL '1' DAY AS decided_at,
  CASE status WHEN 'processed' THEN 'send' WHEN 'needs_review' THEN 'validate' WHEN 'needs_review_high_priority' THEN 'reject' WHEN 'validated' THEN 'send' WHEN 'rejected' THEN 'reject' ELSE 'validate' END AS action,
  CASE WHEN transaction_status = 'transactional' AND payment_method IS NULL THEN 'non_transactional' ELSE 'transactional' END AS target
FROM v_purchase WHERE vendor_id IS NOT NULL
UNION ALL
SELECT invoice_id, created_at + INTERVAL '2' DAY AS decided_at, 'validate' AS action, 'transactional' AS target
FROM v_purchase WHERE payment_method = 'cash'
UNION ALL
SELECT invoice_id, created_at + INTERVAL '3' DAY AS decided_at, 'send' AS action, 'transactional' AS target
FROM v_purchase WHERE payment_method = 'bank' AND vendor_id IS NOT NULL""",

    "v_golden": """
SELECT concat('doc', CAST(o_orderkey AS STRING), '.pdf') AS filename,
  CASE WHEN o_orderkey % 20 = 7 THEN 'unknown' ELSE 'known' END AS document_type_kind, CASE o_orderkey % 3 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'receipt' ELSE 'bill' END AS document_type,
  'known' AS transactional_kind, o_orderkey % 6 <> 3 AS transactional,
  CASE WHEN o_orderkey % 20 = 3 THEN 'absent' WHEN o_orderkey % 25 = 1 THEN 'unknown' ELSE 'known' END AS vendor_kind, c_name AS vendor,
  CASE WHEN o_orderkey % 30 = 2 THEN 'absent' ELSE 'known' END AS invoice_date_kind, CAST(CAST(o_orderdate AS DATE) AS STRING) AS invoice_date,
  CASE WHEN o_orderkey % 20 = 0 THEN 'absent' ELSE 'known' END AS total_kind, o_totalprice AS total,
  'known' AS category_kind, c_mktsegment AS category
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'""",

    "v_actual": """
SELECT concat('doc', CAST(o_orderkey AS STRING), '.pdf') AS filename,
  CASE o_orderkey % 3 WHEN 0 THEN ' invoice' WHEN 1 THEN 'Receipt' ELSE 'invoice' END AS document_type,
  o_orderkey % 5 <> 3 AS transactional,
  CASE WHEN o_orderkey % 10 = 0 THEN '  ' WHEN o_orderkey % 15 = 0 THEN 'Someone Else' WHEN o_orderkey % 40 = 3 THEN NULL ELSE upper(c_name) END AS vendor,
  CASE WHEN o_orderkey % 10 = 1 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat_ws('/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), CAST(year(o_orderdate) AS STRING)) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS invoice_date,
  CASE WHEN o_orderkey % 10 = 2 THEN NULL WHEN o_orderkey % 15 = 4 THEN o_totalprice + 0.01e0 WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_totalprice + 0.001e0 END AS total,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE lower(c_mktsegment) END AS category,
  CASE o_orderstatus WHEN 'F' THEN 'auto_processed' WHEN 'P' THEN 'needs_review' ELSE 'needs_review_high_priority' END AS review_status
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '1-URGENT'""",
}

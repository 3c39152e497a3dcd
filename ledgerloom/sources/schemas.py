"""Declared schemas. Nothing in the engine infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


#: The raw star-schema tables the fixtures are derived from.
RAW: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

#: Ledger entities, for installations that store them as their own tables.
ENTITIES: dict[str, str] = {
    "invoice": "invoice_id STRING, company_id STRING, type STRING, status STRING, transaction_status STRING, "
               "classification_source STRING, vendor_name STRING, vendor_id STRING, customer_name STRING, "
               "category STRING, amount_mentioned DOUBLE, invoice_number STRING, invoice_date DATE, ntn STRING, "
               "subtotal DOUBLE, tax_rate DOUBLE, tax_amount DOUBLE, total DOUBLE, payment_method STRING, "
               "document_confidence DOUBLE, extraction_source STRING, review_flags ARRAY<STRING>, "
               "raw_extraction_json STRING, filename STRING, mimetype STRING, size BIGINT, s3_key STRING, "
               "file_hash STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "invoice_item": "invoice_id STRING, position INT, description STRING, qty DOUBLE, rate DOUBLE, amount DOUBLE, "
                    "arithmetic_check STRING, review_flags ARRAY<STRING>",
    "expense": "expense_id STRING, company_id STRING, category STRING, vendor_name STRING, vendor_id STRING, "
               "invoice_id STRING, expense_date DATE, amount DOUBLE, payment_method STRING, status STRING, "
               "source STRING, reference_id STRING, created_at TIMESTAMP",
    "vendor": "vendor_id STRING, company_id STRING, name STRING, category STRING, city STRING, ntn STRING, "
              "payment_terms STRING, rating DOUBLE, status STRING",
    "ignored_vendor_name": "company_id STRING, vendor_name STRING",
    "employee": "employee_id STRING, company_id STRING, name STRING, department STRING, salary DOUBLE, "
                "bonus DOUBLE, deductions DOUBLE, joining_date DATE, active BOOLEAN",
    "payroll_record": "employee_id STRING, company_id STRING, period STRING, salary DOUBLE, bonus DOUBLE, "
                      "deductions DOUBLE, net_salary DOUBLE, processed_at TIMESTAMP",
    "purchase_request": "request_id STRING, company_id STRING, department STRING, requester_name STRING, "
                        "item STRING, amount DOUBLE, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "purchase_order": "order_id STRING, company_id STRING, request_id STRING, vendor_name STRING, amount DOUBLE, "
                      "status STRING, expected_delivery DATE, created_at TIMESTAMP, updated_at TIMESTAMP",
    "vendor_quote": "quote_id STRING, request_id STRING, company_id STRING, vendor_name STRING, price DOUBLE, "
                    "score DOUBLE",
    "tax_settings": "company_id STRING, default_gst_rate DOUBLE, withholding_tax_rate DOUBLE, filer_status STRING",
    "email_message": "account_id BIGINT, message_id BIGINT, thread_id STRING, subject STRING, from_name STRING, "
                     "from_address STRING, to_address STRING, received_at TIMESTAMP, snippet STRING",
    "email_attachment": "account_id BIGINT, message_id BIGINT, attachment_index INT, filename STRING, "
                        "mimetype STRING, size BIGINT, provider_attachment_id STRING, category STRING, "
                        "category_confidence DOUBLE, category_source STRING, review_status STRING, "
                        "review_reason STRING, deleted_at TIMESTAMP",
    "sender_rule": "account_id BIGINT, pattern STRING, action STRING",
    "sync_job": "job_id STRING, account_id BIGINT, status STRING, started_at TIMESTAMP, completed_at TIMESTAMP, "
                "errors ARRAY<STRING>",
    "words": "doc_id STRING, page INT, word_idx INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, "
             "confidence DOUBLE, font_size DOUBLE",
}

_FIELD = ("STRUCT<value: STRING, confidence: DOUBLE, method: STRING, page: INT, bbox: ARRAY<DOUBLE>, "
          "status: STRING>")

#: The scalar fields an extraction carries, by how reviewers see them.
CONFIDENCE_FIELDS = ("vendor_name", "invoice_number", "invoice_date", "ntn", "subtotal", "tax_rate",
                     "tax_amount", "total")
EXTRACTED_FIELDS = ("customer_name", "currency", "document_type", "payment_status", "city", "country")

#: The audit blob ``raw_extraction_json``.
EXTRACTION_JSON = ", ".join(f"{name}: {_FIELD}" for name in CONFIDENCE_FIELDS + EXTRACTED_FIELDS)
EXTRACTION_JSON = (f"STRUCT<{EXTRACTION_JSON}, classification_reason: STRING, "
                   "page_dimensions: ARRAY<ARRAY<DOUBLE>>, "
                   "dynamic_fields: ARRAY<STRUCT<key: STRING, label: STRING, value: STRING, confidence: DOUBLE, "
                   "page: INT, bbox: ARRAY<DOUBLE>>>>")

_WORD = ("STRUCT<text: STRING, x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE, page: INT, confidence: DOUBLE, "
         "font_size: DOUBLE>")

#: One extraction as delivered: pages of positioned words.
OCR_RESULT = (f"doc_id BIGINT, text STRING, confidence DOUBLE, method STRING, pages INT, "
              f"words_by_page ARRAY<ARRAY<{_WORD}>>")

#: Message feed as JSON lines.
FEED = ("account_id BIGINT, message_id BIGINT, thread_id STRING, received_at TIMESTAMP, "
        "headers MAP<STRING, STRING>, attachments ARRAY<STRUCT<filename: STRING, mimetype: STRING, size: BIGINT, "
        "attachment_id: STRING>>")


def schema(ddl: str) -> T.StructType:
    return _struct(ddl)

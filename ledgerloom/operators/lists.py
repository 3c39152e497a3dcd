"""Filtered, ordered listings. Filters are plain predicates, so they reach the
scan; a page is ``offset``/``limit`` on an ordered listing. Deep offsets cost a
sort of everything before them: ``page_after`` goes on from a row, and ``page_by_index``
finds any page through counts per unit of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import CASHBOOK_STATUSES, INVOICE_STATUSES, date_between, is_delayed, is_scanned_sale

TRANSACTION_STATUSES = ("transactional", "non_transactional")


def _search(text: str, *columns: str) -> Column:
    test = F.lit(False)
    for column in columns:
        test = test | F.col(column).ilike(f"%{text}%")
    return test


def _equals(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def invoice_list(invoices: DataFrame, kind: str = "purchase", vendor_id=None, transaction_status=None,
                 statuses: str | None = None, start=None, end=None) -> DataFrame:
    df = invoices if kind == "all" else invoices.where(F.col("type") == kind)
    if transaction_status is not None and transaction_status not in TRANSACTION_STATUSES:
        raise ValueError(f"unknown transaction status {transaction_status!r}")
    df = _equals(df, vendor_id=vendor_id, transaction_status=transaction_status)
    if statuses:
        wanted = [s.strip() for s in statuses.split(",") if s.strip()]
        unknown = set(wanted) - set(INVOICE_STATUSES)
        if unknown:
            raise ValueError(f"unknown status {sorted(unknown)}")
        df = df.where(F.col("status").isin(*wanted))
    return (df.where(date_between("invoice_date", start, end))
            .orderBy(F.desc("created_at"), F.asc("invoice_id")))


def page(listing: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    return listing.offset(offset).limit(limit)


def page_index(rows: DataFrame, unit: str = "day", at: str = "created_at") -> DataFrame:
    """``(bucket, n, before)``: rows per unit of time, newest first and rows without a time
    last, with the rows before each. A narrow table, kept for as long as the listing is."""
    counted = rows.groupBy(F.date_trunc(unit, F.col(at)).cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)  # one row per unit
    return counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def rows_of_page(rows: DataFrame, index: DataFrame, offset: int, limit: int, unit: str = "day", at: str = "created_at") -> tuple[DataFrame, int]:
    """The rows of the units that a page lies in, and how many of them come before it. The
    bounds are literals, so the scan reads no other unit's row groups."""
    span = index.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).agg(
        F.min("bucket").cast("string").alias("low"), (F.max("bucket") + F.expr(f"INTERVAL 1 {unit}")).cast("string").alias("high"),
        F.max(F.col("bucket").isNull()).alias("untimed"), F.min("before").alias("before")).first()
    if span["before"] is None:
        return rows.limit(0), 0
    stamp = lambda v: F.lit(v).cast("timestamp_ntz")
    wanted = F.lit(False) if span["low"] is None else (F.col(at) >= stamp(span["low"])) & (F.col(at) < stamp(span["high"]))
    return rows.where(wanted | F.col(at).isNull() if span["untimed"] else wanted), offset - span["before"]


def page_by_index(rows: DataFrame, index: DataFrame, key: str, offset: int, limit: int, unit: str = "day", at: str = "created_at") -> DataFrame:
    """Any page of the listing by (``at`` descending, ``key``): page 10,000 sorts and reads
    the units of time it lies in, as page 1 does, not all rows before it."""
    part, skip = rows_of_page(rows, index, offset, limit, unit, at)
    return part.orderBy(F.desc(at), key).offset(skip).limit(limit)


def page_after(rows: DataFrame, key: str, last_at, last_key, limit: int, at: str = "created_at") -> DataFrame:
    """The page that follows the row (``last_at``, ``last_key``): rows before it are filtered
    at the scan, and each task keeps ``limit`` rows."""
    if last_at is None:
        later = F.col(at).isNull() & (F.col(key) > F.lit(last_key))
    else:
        moment = F.lit(str(last_at)).cast("timestamp_ntz")
        later = (F.col(at) < moment) | ((F.col(at) == moment) & (F.col(key) > F.lit(last_key))) | F.col(at).isNull()
    return rows.where(later).orderBy(F.desc(at), key).limit(limit)


def expense_list(expenses: DataFrame, category=None, status=None, start=None, end=None, vendor=None) -> DataFrame:
    df = _equals(expenses, category=category, status=status).where(date_between("expense_date", start, end))
    if vendor:
        df = df.where(_search(vendor, "vendor_name"))
    return df.orderBy(F.desc("expense_date"), F.desc("created_at"), F.asc("expense_id"))


def vendor_list(vendors_with_spend: DataFrame, status=None, category=None, city=None, search=None) -> DataFrame:
    df = _equals(vendors_with_spend, status=status, category=category)
    if city:
        df = df.where(_search(city, "city"))
    if search:
        df = df.where(_search(search, "name"))
    return df.orderBy("name", "vendor_id")


def employee_list(employees_with_flag: DataFrame, department=None, active=None, search=None) -> DataFrame:
    df = _equals(employees_with_flag, department=department, active=active)
    if search:
        df = df.where(_search(search, "name"))
    return df.withColumn("net_salary", F.round(F.col("salary") + F.col("bonus") - F.col("deductions"), 2)) \
             .orderBy("name", "employee_id")


def order_list(orders: DataFrame, as_of, status=None, vendor=None) -> DataFrame:
    df = _equals(orders, status=status)
    if vendor:
        df = df.where(_search(vendor, "vendor_name"))
    return df.withColumn("delayed", is_delayed(as_of)).orderBy(F.desc("created_at"), F.asc("order_id"))


def request_list(requests: DataFrame, status=None, department=None, search=None) -> DataFrame:
    df = _equals(requests, status=status, department=department)
    if search:
        df = df.where(_search(search, "item", "requester_name"))
    return df.orderBy(F.desc("created_at"), F.asc("request_id"))


def attachment_list(attachments: DataFrame, category: str | None = None,
                    review_status: str | None = "imported") -> DataFrame:
    df = attachments.where(F.col("deleted_at").isNull())
    df = _equals(df, category=None if category == "all" else category, review_status=review_status)
    return df.orderBy(F.desc("received_at"), F.asc("message_id"), F.asc("attachment_index"))


def file_list(files: DataFrame, category=None, file_type=None, conversation_id=None) -> DataFrame:
    df = _equals(files.where(F.col("deleted_at").isNull()), category=None if category == "all" else category,
                 file_type=file_type, conversation_id=conversation_id)
    return df.orderBy(F.desc("created_at"), F.asc("file_id"))


def upload_list(uploads: DataFrame, category=None) -> DataFrame:
    df = _equals(uploads.where(F.col("deleted_at").isNull()), category=None if category == "all" else category)
    return df.orderBy(F.desc("upload_id"))


def category_rows(invoices: DataFrame, category: str | None = None, uncategorized: bool = False, start=None,
                  end=None) -> DataFrame:
    """Saved purchases of one category. Non-transactional rows are listed
    although the category total leaves them out; ``counts_in_total`` tells them
    apart."""
    df = invoices.where((F.col("type") == "purchase") & F.col("status").isin(*CASHBOOK_STATUSES)
                        & date_between("invoice_date", start, end))
    if uncategorized:
        df = df.where(F.col("category").isNull())
    elif category is not None:
        df = df.where(F.col("category") == category)
    return df.withColumn("counts_in_total", F.col("transaction_status") == "transactional")


def category_entries(invoices: DataFrame, **scope) -> DataFrame:
    return category_rows(invoices, **scope).orderBy("invoice_date", "created_at", "invoice_id")


def quote_ranking(quotes: DataFrame, request_id=None) -> DataFrame:
    """Every quote with its place within its request, best score first."""
    order = [F.desc_nulls_last("score"), F.asc("price"), F.asc("quote_id")]
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return _equals(quotes, request_id=request_id).withColumn("position", place).orderBy(*order)


def sales_list(invoices: DataFrame, generated: bool = False, status: str | None = None) -> DataFrame:
    """Scanned (or generated) sales, newest first."""
    made = F.col("extraction_source") == "generated"
    df = invoices.where((F.col("type") == "sale") & (made if generated else is_scanned_sale()))
    return _equals(df, status=status).orderBy(F.desc("created_at"), F.asc("invoice_id"))


def list_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows a listing has per key, whatever page of it is shown."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total_count"))


def conversation_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.col("last_error").isNotNull().desc(), F.desc("file_count"), F.asc("conversation_id"))

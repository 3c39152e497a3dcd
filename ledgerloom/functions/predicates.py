"""Row predicates and display columns over ledger entities."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.core import ColumnLike, c, collapse_spaces, lookup, present, strip

# Fixed values.
INVOICE_STATUSES = ("processed", "needs_review", "needs_review_high_priority", "validated", "sent_to_accounting",
                    "rejected")
CASHBOOK_STATUSES = ("validated", "sent_to_accounting")
PENDING_STATUSES = ("needs_review", "needs_review_high_priority")
SCANNER_CATEGORIES = ("Invoices", "Receipts", "Spreadsheets & Financial")
PAYMENT_METHOD_MAP = {"bank": "bank_transfer", "cash": "cash"}
SYNC_ERROR_HINTS = {
    "not_in_channel": "Add the connector as a member so that its files can be read.",
    "channel_not_found": "Nothing was found under this name any more.",
    "missing_scope": "Grant reading rights for it and try again.",
    "is_archived": "Archived: only files that were there before are kept.",
    "account_inactive": "Sign in again with an account that is in use.",
    "ratelimited": "Too many requests at once. The walk goes on at the next run.",
}


def day(value: date | str | ColumnLike | None) -> Column | None:
    if value is None or isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def date_between(column: ColumnLike, start=None, end=None, end_inclusive: bool = True) -> Column:
    """Optional bounds. A row without a date passes only when no bound is set."""
    test = F.lit(True)
    if start is not None or end is not None:
        test = c(column).isNotNull()
    if start is not None:
        test = test & (c(column) >= day(start))
    if end is not None:
        test = test & ((c(column) <= day(end)) if end_inclusive else (c(column) < day(end)))
    return test


def is_cashbook() -> Column:
    return ((F.col("type") == "purchase") & F.col("status").isin(*CASHBOOK_STATUSES)
            & (F.col("transaction_status") == "transactional"))


def is_scanned_sale() -> Column:
    return ((F.col("type") == "sale") & F.col("extraction_source").isNotNull()
            & (F.col("extraction_source") != "generated"))


def bucket_date() -> Column:
    """The document's own date, else the day it was scanned."""
    return F.coalesce(F.col("invoice_date"), F.col("created_at").cast("date"))


def customer_label(column: ColumnLike = "customer_name") -> Column:
    return F.coalesce(present(strip(column)), F.lit("Unattributed"))


def particulars() -> Column:
    return F.coalesce(present("vendor_name"), present("invoice_number"), present("filename"), F.lit("—"))


def payment_label() -> Column:
    return F.coalesce(F.initcap(F.col("payment_method")), F.lit("Not Specified"))


def document_type_label() -> Column:
    return F.coalesce(F.initcap(F.replace(present("document_type"), F.lit("_"), F.lit(" "))), F.lit("Unknown"))


def error_hint(code: ColumnLike) -> Column:
    code = present(code)
    unknown = F.concat(F.lit("Last sync failed for this conversation: "), code)
    return F.when(code.isNotNull(), F.coalesce(lookup(code, SYNC_ERROR_HINTS), unknown))


def scanner_eligible(category: ColumnLike = "category") -> Column:
    return F.coalesce(c(category).isin(*SCANNER_CATEGORIES), F.lit(False))


def is_delayed(as_of) -> Column:
    return F.coalesce((F.col("status") == "in_transit") & (F.col("expected_delivery") < day(as_of)), F.lit(False))


# Least and greatest allowed, and whether the least itself is allowed.
ROW_LIMITS = {
    "expense": {"amount": (0, None, False)},
    "employee": {"salary": (0, None, False), "bonus": (0, None, True), "deductions": (0, None, True)},
    "quote": {"score": (0, 100, True)},
    "item": {"qty": (0, None, False), "rate": (0, None, True), "tax_rate": (0, 1, True)},
}


def row_violations(entity: str) -> Column:
    """Names of the columns of a row that are outside their limits."""
    def inside(name: str, least: int, most: int | None, closed: bool) -> Column:
        low = F.col(name) >= least if closed else F.col(name) > least
        return low if most is None else low & (F.col(name) <= most)

    return violations(**{name: inside(name, *limit) for name, limit in ROW_LIMITS[entity].items()})


def violations(**rules: Column) -> Column:
    """Names of the rules a row breaks. A null operand breaks nothing."""
    return F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))


def same_name(left: ColumnLike, right: ColumnLike) -> Column:
    return collapse_spaces(F.lower(c(left))) == collapse_spaces(F.lower(c(right)))

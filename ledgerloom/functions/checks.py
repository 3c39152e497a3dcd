"""Arithmetic checks, confidence and routing. Checks are three-valued: null
means "not checkable" and is kept apart from false all the way to routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.core import ColumnLike, c, lookup
from ledgerloom.functions.predicates import day

# Fixed values.
TOLERANCE = 0.02
KNOWN_TAX_RATES = (0.0, 0.05, 0.08, 0.10, 0.13, 0.15, 0.16, 0.17, 0.18)
MAGNITUDE_RANGE = (0.2, 5.0)
MAX_AGE_DAYS = 730
METHOD_TIERS = {"label_anchor+pattern": 1.0, "label_anchor": 0.7, "positional_fallback": 0.5, "not_found": 0.0}
FIELD_WEIGHTS = {"total": 3.0, "tax_amount": 2.0, "vendor_name": 2.0, "invoice_number": 2.0, "subtotal": 1.5,
                 "invoice_date": 1.0, "ntn": 1.0}
AUTO_THRESHOLD, REVIEW_THRESHOLD, UNCERTAIN_BELOW, ARITHMETIC_DISCOUNT = 0.75, 0.4, 0.5, 0.7


def close_enough(expected: Column, actual: Column) -> Column:
    return F.abs(expected - actual) <= TOLERANCE * F.greatest(F.abs(actual), F.lit(1.0))


def line_item_check(qty: ColumnLike, rate: ColumnLike, amount: ColumnLike) -> Column:
    passed = close_enough(c(qty) * c(rate), c(amount))
    return F.coalesce(F.when(passed, "pass").when(~passed, "fail"), F.lit("not_checked"))


def totals_check(subtotal: ColumnLike, tax: ColumnLike, discount: ColumnLike, total: ColumnLike) -> Column:
    zero = F.lit(0.0)
    return close_enough(c(subtotal) + F.coalesce(c(tax), zero) - F.coalesce(c(discount), zero), c(total))


def tax_rate_plausible(subtotal: ColumnLike, tax: ColumnLike) -> Column:
    implied = c(tax) / F.nullif(c(subtotal), F.lit(0.0))
    known = F.array(*[F.lit(r) for r in KNOWN_TAX_RATES])
    return F.when(implied.isNotNull(), F.exists(known, lambda rate: F.abs(implied - rate) <= 0.01))


def date_plausible(value: ColumnLike, as_of) -> Column:
    return (c(value) <= day(as_of)) & (c(value) >= F.date_sub(day(as_of), MAX_AGE_DAYS))


def reference_amount(subtotal: ColumnLike, tax: ColumnLike, discount: ColumnLike, items_sum: ColumnLike) -> Column:
    zero = F.lit(0.0)
    return (F.coalesce(c(subtotal), c(items_sum)) + F.coalesce(c(tax), zero) - F.coalesce(c(discount), zero))


def magnitude_plausible(total: ColumnLike, reference: ColumnLike) -> Column:
    low, high = MAGNITUDE_RANGE
    return F.when(c(reference) > 0, (c(total) / c(reference)).between(low, high))


def same_source(page_a: ColumnLike, box_a: ColumnLike, page_b: ColumnLike, box_b: ColumnLike) -> Column:
    return F.coalesce((c(page_a) == c(page_b)) & (c(box_a) == c(box_b)), F.lit(False))


def field_confidence(ocr_confidence: ColumnLike, method: ColumnLike) -> Column:
    """Mean of the reading's own confidence and how strong the method was."""
    return (c(ocr_confidence) + F.coalesce(lookup(c(method), METHOD_TIERS), F.lit(0.0))) / 2


def field_status(value_present: Column, confidence: ColumnLike) -> Column:
    return (F.when(~value_present, "NOT_FOUND").when(c(confidence) < UNCERTAIN_BELOW, "UNCERTAIN")
            .otherwise("FOUND"))


def document_confidence(confidences: dict[str, Column], arithmetic_ok: Column) -> Column:
    """Weighted mean over the fields that are present (a null confidence is an
    absent field), discounted when arithmetic is known to be wrong."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, value in confidences.items():
        weight = FIELD_WEIGHTS.get(name, 1.0)
        top = top + F.coalesce(value * weight, F.lit(0.0))
        bottom = bottom + F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0)
    base = F.when(bottom > 0, top / bottom).otherwise(0.0)
    return F.when(F.coalesce(~arithmetic_ok, F.lit(False)), base * ARITHMETIC_DISCOUNT).otherwise(base)


def route(score: ColumnLike, critical_present: ColumnLike, arithmetic_ok: ColumnLike) -> Column:
    wrong = F.coalesce(~c(arithmetic_ok), F.lit(False))
    return (F.when(~c(critical_present) | (c(score) < REVIEW_THRESHOLD), "needs_review_high_priority")
            .when((c(score) < AUTO_THRESHOLD) | wrong, "needs_review").otherwise("auto_processed"))

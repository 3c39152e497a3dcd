"""Parsers for printed values, as native Column expressions.

Every function takes a text column and gives a column; none leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.core import (ColumnLike, any_of, c, collapse_spaces, first_match, let, lookup, present, strip,
                                        strip_chars)

# ---------------------------------------------------------------- fixed values

MONEY_PATTERN = r"(-?[\d,]+(?:\.\d{1,2})?)"
PARENTHESISED_PATTERN = r"(?i)\(\s*(?:rs\.?|pkr|\$|usd|sgd|gbp|eur)?\s*[\d,]+(?:\.\d{1,2})?\s*\)"

TRAILING_TIME_PATTERN = r",?\s*\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?\.?$"
ORDINAL_NOISE_PATTERN = r"^(\d{1,2})[stndrhSTNDRH\"'′″]{1,2}(?=\s|[A-Za-z])"
DATE_SUBSTRING_PATTERNS = (
    r"\d{1,2}[/-]\d{1,2}[/-]\d{4}",
    r"\d{1,2}(?:[stndrhSTNDRH\"'′″]{1,2})?\s*[A-Za-z]{3,9}[,.]?\s*\d{4}",
    r"[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}",
    r"\d{4}-\d{1,2}-\d{1,2}",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2}(?!\d)",
)
#: Every readable date has two digit separators or a month name; lines without either are not parsed.
DATE_EVIDENCE_PATTERN = r"(?i)\d[/-]\d{1,2}[/-]\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
AMBIGUOUS_DATE_PATTERN = (r"\b(\d{1,2})[/-](\d{1,2})[/-]\d{4}|\b(\d{1,2})[/-](\d{1,2})[/-]\d{2}(?!\d)")
INVOICE_NUMBER_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9/_-]{1,29}$"
NTN_PATTERN = r"^\d{6,7}-?\d?$"
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december")

CURRENCY_WORDS = (
    (r"\bpkr\b", "PKR"), (r"(?<![A-Za-z])rs\.?(?![A-Za-z])", "PKR"), (r"\brupees?\b", "PKR"),
    (r"\beuros?\b", "EUR"), (r"\beur\b", "EUR"), (r"\bgbp\b", "GBP"), (r"\bpounds?\b", "GBP"),
    (r"us\$", "USD"), (r"\busd\b", "USD"), (r"\bus\s*dollars?\b", "USD"),
)
CURRENCY_SYMBOLS = ((r"₨\s?\d", "PKR"), (r"€\s?\d", "EUR"), (r"£\s?\d", "GBP"), (r"\$\s?\d", "USD"))
CURRENCY_SYMBOL_CONFIDENCE = 0.45

CITY_COUNTRY = {
    "islamabad": "Pakistan", "lahore": "Pakistan", "karachi": "Pakistan", "rawalpindi": "Pakistan",
    "faisalabad": "Pakistan", "multan": "Pakistan", "peshawar": "Pakistan", "quetta": "Pakistan",
    "gujranwala": "Pakistan", "sialkot": "Pakistan", "hyderabad": "Pakistan",
    "mumbai": "India", "delhi": "India", "bangalore": "India", "chennai": "India", "kolkata": "India",
}
PHONE_COUNTRY = ((r"\+92\b", "Pakistan"), (r"\+91\b", "India"), (r"\+44\b", "United Kingdom"),
                 (r"\+1\b", "United States"))

DOCUMENT_TYPE_RULES = (
    (r"\bminute\s*sheet\b", "minute_sheet"),
    (r"\bfor\s+approval\s+of\b", "approval_request"),
    (r"\bsubmitted\s+for\s+approval\b", "approval_request"),
    (r"\bkindly\s+approve\b", "approval_request"),
    (r"\brequest\s+for\s+approval\b", "approval_request"),
    (r"\bcredit\s*note\b", "credit_note"),
    (r"\bdebit\s*note\b", "credit_note"),
    (r"\bpurchase\s*order\b", "purchase_order"),
    (r"\bquotation\b", "quotation"),
    (r"\binvoice\b", "invoice"),
    (r"\breceipt\b", "receipt"),
    (r"\bbill\b", "bill"),
)
INTERNAL_TYPES = ("minute_sheet", "approval_request")
EXTERNAL_NON_TRANSACTIONAL_TYPES = ("quotation", "purchase_order")
APPROVAL_AMOUNT_PATTERN = (r"(?i)\b(?:for\s+approval\s+of|submitted\s+for\s+approval\s+of|kindly\s+approve)\s*"
                           r"(?:rs\.?|pkr|/-)?\s*(-?[\d,]+(?:\.\d{1,2})?)")
PAYMENT_STATUS_RULES = (
    (r"\bpartially\s*paid\b", "PARTIALLY_PAID"), (r"\bpaid\s*in\s*full\b", "PAID"), (r"\bfully\s*paid\b", "PAID"),
    (r"\bunpaid\b", "UNPAID"), (r"\bbalance\s*due\b", "DUE"), (r"\bamount\s*due\b", "DUE"),
    (r"\bpending\b", "PENDING"), (r"\bpaid\b", "PAID"),
)
CORPORATE_SUFFIXES = ("pvt ltd", "private limited", "(pvt) ltd", "pvt. ltd.", "ltd.", "ltd", "llc", "inc.", "inc")

SPECIFIC_AMOUNT_PATTERN = (r"(?i)(?:rs\.?|pkr|\$|usd)\s*-?\d[\d,]*(?:\.\d{1,2})?"
                           r"|-?\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|-?\d+\.\d{1,2}")
LEADING_CURRENCY_PATTERN = r"(?i)^\s*(?:rs\.?|pkr|usd|\$)\s*"

REFERENCE_PREFIXES = ("fbrinvoice", "fbr invoice", "invoice#", "invoice #", "bill#", "bill #", "receipt#",
                      "receipt #", "pos invoice")
DOCUMENT_TITLES = ("tax invoice", "invoice", "cash receipt", "cash memo", "voucher")
PROVIDER_CREDITS = ("powered by", "software by", "solution provided by", "system by", "developed by")
FULFILMENT_PHRASES = ("pickup", "delivery", "pickup/delivery", "dine in", "takeaway", "take away", "walk in",
                      "eat in", "home delivery")
HOLDER_PREFIXES = ("account holder", "account title", "a/c title", "customer name", "bill to", "ship to")
ADDRESS_WORDS = ("floor", "plaza", "street", "road", "avenue", "block", "phase", "square", "building", "colony",
                 "sector")

# --------------------------------------------------------------------- amounts


def parse_money(text: ColumnLike) -> Column:
    """First amount in the text; a leading minus is kept and ``(1,000)`` is negative."""
    def value(digits: Column) -> Column:
        amount = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
        return F.when((amount > 0) & c(text).rlike(PARENTHESISED_PATTERN), -amount).otherwise(amount)

    return let(F.regexp_extract(c(text), MONEY_PATTERN, 1), value)


def looks_like_amount(text: ColumnLike) -> Column:
    """Someone wrote a specific amount: grouping comma, decimals or a currency
    mark, and no letters left once a leading currency word is taken off."""
    bare = F.regexp_replace(strip(text), LEADING_CURRENCY_PATTERN, "")
    return c(text).rlike(SPECIFIC_AMOUNT_PATTERN) & ~bare.rlike(r"\p{L}")


# ----------------------------------------------------------------------- dates

_MONTHS = {name[:width]: number for number, name in enumerate(MONTH_NAMES, 1) for width in (3, len(name))}


def _date(year: Column, month: Column, day: Column) -> Column:
    pad = lambda part: F.lpad(part.cast("string"), 2, "0")
    iso = F.concat(year.cast("string"), F.lit("-"), pad(month), F.lit("-"), pad(day))
    return F.when(year.cast("string") != "0000", iso.try_cast("date"))


def _groups(text: Column, pattern: str, *order: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, group) for group in order]


def _numeric_date(text: Column) -> Column:
    slash4, any4, any2 = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", \
        r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    short_year = F.regexp_extract(text, any2, 4)
    century = F.when(short_year >= "69", F.concat(F.lit("19"), short_year)).otherwise(
        F.concat(F.lit("20"), short_year))
    return (F.when(text.rlike(slash4), F.coalesce(_date(*_groups(text, slash4, 3, 2, 1)),
                                                  _date(*_groups(text, slash4, 3, 1, 2))))
            .when(text.rlike(any4), _date(*_groups(text, any4, 4, 3, 1)))
            .when(text.rlike(iso), _date(*_groups(text, iso, 1, 2, 3)))
            .when(text.rlike(any2), _date(century, *_groups(text, any2, 3, 1))))


def _named_month_date(text: Column) -> Column:
    day_first, month_first = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$"
    month = lambda pattern, group: lookup(F.lower(F.regexp_extract(text, pattern, group)), _MONTHS)
    return (F.when(text.rlike(day_first), _date(F.regexp_extract(text, day_first, 3), month(day_first, 2),
                                                F.regexp_extract(text, day_first, 1)))
            .when(text.rlike(month_first), _date(F.regexp_extract(text, month_first, 3), month(month_first, 1),
                                                 F.regexp_extract(text, month_first, 2))))


def clean_date_text(text: ColumnLike) -> Column:
    out = strip_chars(strip(text), ".,")
    out = strip_chars(strip(F.regexp_replace(out, TRAILING_TIME_PATTERN, "")), ".,")
    out = F.regexp_replace(out, ORDINAL_NOISE_PATTERN, "$1")
    out = F.regexp_replace(out, r"(\d)([A-Za-z])", "$1 $2")
    return F.regexp_replace(out, r"([A-Za-z])(\d)", "$1 $2")


def parse_date(text: ColumnLike) -> Column:
    """The whole text as a date, day first; a 4-digit year is tried before a
    2-digit one and two-digit years pivot at 68/69."""
    return let(clean_date_text(text), lambda t: F.coalesce(_numeric_date(t), _named_month_date(t)))


def find_date_in_text(text: ColumnLike) -> Column:
    """The whole text as a date, else the first date-shaped part that parses."""
    shapes = F.array(c(text), *[F.regexp_extract(c(text), pattern, 0) for pattern in DATE_SUBSTRING_PATTERNS])
    first = F.aggregate(shapes, F.lit(None).cast("date"), lambda found, part: F.coalesce(found, parse_date(part)))
    return F.when(c(text).rlike(DATE_EVIDENCE_PATTERN), first)


def day_month_ambiguous(text: ColumnLike) -> Column:
    a = F.coalesce(*[present(F.regexp_extract(c(text), AMBIGUOUS_DATE_PATTERN, g)) for g in (1, 3)]).cast("int")
    b = F.coalesce(*[present(F.regexp_extract(c(text), AMBIGUOUS_DATE_PATTERN, g)) for g in (2, 4)]).cast("int")
    return F.coalesce(a.between(1, 12) & b.between(1, 12), F.lit(False))


# ----------------------------------------------------------- numbers and names


def invoice_number_ok(text: ColumnLike) -> Column:
    value = strip(text)
    return value.rlike(INVOICE_NUMBER_PATTERN) & ~value.rlike(r"^\d{1,2}$")


def ntn_ok(text: ColumnLike) -> Column:
    return strip(text).rlike(NTN_PATTERN)


def _suffix_pattern(suffix: str) -> str:
    return rf"[\s,]*{re.escape(suffix)}$"


def normalize_vendor(name: ColumnLike) -> Column:
    """Lower case, single spaces, and one corporate suffix taken off. One test
    for any suffix comes first: most names end in none."""
    def body(text: Column) -> Column:
        return F.when(any_of(text, CORPORATE_SUFFIXES, "", "$"), without_suffix(text)).otherwise(text)

    def without_suffix(text: Column) -> Column:
        out = text
        for suffix in reversed(CORPORATE_SUFFIXES):
            pattern = _suffix_pattern(suffix)
            out = F.when(text.rlike(pattern), strip(F.regexp_replace(text, pattern, ""))).otherwise(out)
        return out

    return let(F.regexp_replace(strip(F.lower(c(name))), r"\s+", " "), body)


def spaced_lower(name: ColumnLike) -> Column:
    return collapse_spaces(F.lower(c(name)))


def duplicate_key(vendor: ColumnLike, number: ColumnLike, total: ColumnLike, day: ColumnLike) -> Column:
    return F.struct(normalize_vendor(vendor).alias("vendor"), F.lower(strip(number)).alias("number"),
                    F.round(c(total), 2).alias("total"), c(day).cast("string").alias("day"))


def key_for_label(label: ColumnLike) -> Column:
    """Printed label to snake_case key."""
    out = F.lower(strip_chars(label, " :#-.\t"))
    return strip_chars(F.regexp_replace(F.regexp_replace(out, "[&/]", " "), "[^a-z0-9]+", "_"), "_")


# ------------------------------------------------------- document-wide detection


def detect_currency(text: ColumnLike) -> Column:
    """Currency evidence actually printed: a word or code, else a symbol next to
    a digit at lower confidence. No evidence gives nulls, never a default."""
    word = first_match(text, CURRENCY_WORDS)
    symbol = first_match(text, CURRENCY_SYMBOLS, flags="")
    return let(F.struct(word.alias("w"), symbol.alias("s")), lambda m: F.struct(
        F.coalesce(m["w"], m["s"]).alias("value"),
        F.when(m["w"].isNotNull(), F.lit(1.0)).when(m["s"].isNotNull(), F.lit(CURRENCY_SYMBOL_CONFIDENCE))
        .alias("confidence")))


def detect_city(text: ColumnLike) -> Column:
    return first_match(F.lower(c(text)), [(rf"\b{city}\b", city.title()) for city in CITY_COUNTRY], flags="")


def detect_country(text: ColumnLike, city: Column | None = None) -> Column:
    city = detect_city(text) if city is None else city
    return F.coalesce(lookup(F.lower(city), CITY_COUNTRY), first_match(text, PHONE_COUNTRY, flags=""))


def detect_document_type(text: ColumnLike, has_items: ColumnLike, has_total: ColumnLike) -> Column:
    """(type, confidence, reason). The reason quotes the page from the matched wording on."""
    rules = []
    for pattern, kind in DOCUMENT_TYPE_RULES:
        quote = F.substring(c(text), F.regexp_instr(c(text), F.lit("(?i)" + pattern)), F.lit(60))
        rules.append(F.when(c(text).rlike("(?i)" + pattern), F.struct(
            F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"), collapse_spaces(quote).alias("reason"))))
    weak = F.when(c(has_items) & c(has_total), F.struct(
        F.lit("receipt").alias("type"), F.lit(0.4).alias("confidence"),
        F.lit("No document-type wording found; has a line-item table and a total").alias("reason")))
    unknown = F.struct(F.lit(None).cast("string").alias("type"), F.lit(0.0).alias("confidence"),
                       F.lit(None).cast("string").alias("reason"))
    return F.coalesce(*rules, weak, unknown)


def is_transactional(document_type: ColumnLike) -> Column:
    """An unknown type stays on the normal path."""
    kinds = INTERNAL_TYPES + EXTERNAL_NON_TRANSACTIONAL_TYPES
    return F.coalesce(~c(document_type).isin(*kinds), F.lit(True))


def approval_amount(text: ColumnLike) -> Column:
    return parse_money(F.regexp_extract(c(text), APPROVAL_AMOUNT_PATTERN, 1))


def payment_status(text: ColumnLike) -> Column:
    return first_match(text, PAYMENT_STATUS_RULES)


# ------------------------------------------------------------ vendor line noise


def _digit_share(text: Column) -> Column:
    """Digits among letters and digits; null when there are neither."""
    return let(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), lambda marks: F.when(
        marks > 0, F.length(F.regexp_replace(text, r"[^\p{Nd}]", "")) / marks))


def looks_like_reference(text: ColumnLike) -> Column:
    return let(F.lower(strip(text)), lambda lower: _reference(c(text), lower))


def _reference(text: Column, lower: Column) -> Column:
    return (any_of(lower, REFERENCE_PREFIXES, "^") | F.coalesce(_digit_share(lower) > 0.5, F.lit(True))
            | find_date_in_text(text).isNotNull())


def looks_decorative(text: ColumnLike) -> Column:
    return let(F.regexp_replace(F.lower(strip(text)), "[.!]+$", ""), _decorative)


def _decorative(cleaned: Column) -> Column:
    thanks = cleaned.contains("thank you") & (cleaned.contains("visit again") | cleaned.contains("come again"))
    return any_of(cleaned, PROVIDER_CREDITS, "^") | cleaned.isin(*FULFILMENT_PHRASES) | thanks


def vendor_line_noise(text: ColumnLike) -> Column:
    """A top-of-page line that cannot be the issuing business."""
    def noise(stripped: Column, lower: Column) -> Column:
        address = lower.contains(",") & any_of(lower, ADDRESS_WORDS, "(?<![a-z])", "(?![a-z])")
        wording = let(F.regexp_replace(lower, "[.!]+$", ""), lambda cleaned: _decorative(cleaned) | cleaned.isin(*DOCUMENT_TITLES))
        return (wording | any_of(lower, HOLDER_PREFIXES, "^") | stripped.rlike(r"^\S+@\S+\.\S+$") | address
                | lower.rlike(r"^(?:dear|hi|hello)\b") | _reference(c(text), lower))

    return let(strip(text), lambda stripped: let(F.lower(stripped), lambda lower: noise(stripped, lower)))

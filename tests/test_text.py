"""Hand-written expectations for printed-value parsers and classifiers."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import checks, classify, text
from tests.helpers import evaluate

DATES = {
    "24/10/2025": date(2025, 10, 24), "06-05-2025": date(2025, 5, 6), "2026-08-04": date(2026, 8, 4),
    "06 May 2025": date(2025, 5, 6), "Jul 28, 2026": date(2026, 7, 28), "not a date": None, "": None,
    "20/8/26": date(2026, 8, 20), "1/2/75": date(1975, 2, 1), "1-2-68": date(2068, 2, 1),
    "Dec 14, 2020, 4:18:34 PM": date(2020, 12, 14), "24/10/2025, 09:05:00": date(2025, 10, 24),
    "12/25/2020": date(2020, 12, 25), "12-25-2020": None, "3t April 2026": date(2026, 4, 3),
    '21" November 2026': date(2026, 11, 21), "9tOctober 2026": date(2026, 10, 9), "14Aug2026": date(2026, 8, 14),
    # The ordinal set holds D and N, so a glued December or November loses its first letter.
    "12Dec2026": None, "12 Dec 2026": date(2026, 12, 12), "31/02/2026": None, "Invoice2026": None,
}
FOUND = {
    "18/06/20264:30:13PM": date(2026, 6, 18), "Date:29/06/2026.16:29:41": date(2026, 6, 29),
    "0345-5575555,0301-5892562": None, "Chief Executive Officer   3t April 2026": date(2026, 4, 3),
    "14Aug 2026      10:43:05AM cashier:JOHN": date(2026, 8, 14), "due 5/6/26.": date(2026, 6, 5),
}
MONEY = {
    "183254": 183254.0, "1,234.56": 1234.56, "Rs 6,000": 6000.0, "$1.00 USD": 1.0, "N/A": None, "": None,
    "-1,000": -1000.0, "PKR -500.25": -500.25, "(1,000)": -1000.0, "-": None, "Hello, 5": None,
}


def test_parse_date(spark):
    assert dict(zip(DATES, evaluate(spark, text.parse_date("v"), list(DATES)))) == DATES


def test_find_date_in_text(spark):
    assert dict(zip(FOUND, evaluate(spark, text.find_date_in_text("v"), list(FOUND)))) == FOUND


def test_parse_money(spark):
    assert dict(zip(MONEY, evaluate(spark, text.parse_money("v"), list(MONEY)))) == MONEY


@pytest.mark.parametrize("value,expected", [
    ("06/02/2026", True), ("30/06/2026", False), ("06/02/26", True), ("10 June 2026", False), ("2026-02-06", False),
    ("Order #12/34", False), ("Booked At 06/02/202613.05:15", True), ("", False)])
def test_day_month_ambiguous(spark, value, expected):
    assert evaluate(spark, text.day_month_ambiguous("v"), [value]) == [expected]


def test_number_shapes(spark):
    values = ["INV-2025/01", "5", "12", "", "123", "3947261", "3947261-8", "ABC1234"]
    assert evaluate(spark, text.invoice_number_ok("v"), values) == [True, False, False, False, True, True, True, True]
    assert evaluate(spark, text.ntn_ok("v"), values)[-3:] == [True, True, False]


def test_normalize_vendor(spark):
    values = ["  ABC   Traders  ", "ABC Traders Pvt Ltd", "ABC Traders Private Limited", "ABC Traders (Pvt) Ltd",
              "ABC Traders, Inc.", "Ltd Ltd", "Harbour Commerce"]
    assert evaluate(spark, text.normalize_vendor("v"), values) == [
        "abc traders", "abc traders", "abc traders", "abc traders", "abc traders", "ltd", "harbour commerce"]


def test_currency(spark):
    values = ["Rs. 500", "total 5 rupees", "12 EUR", "£ 9", "$9", "wars 7", "nothing", "US$ 5"]
    got = evaluate(spark, text.detect_currency("v"), values)
    assert [(m["value"], m["confidence"]) for m in got] == [
        ("PKR", 1.0), ("PKR", 1.0), ("EUR", 1.0), ("GBP", 0.45), ("USD", 0.45), (None, None), (None, None),
        ("USD", 1.0)]


def test_city_and_country(spark):
    values = ["Shop 4, LAHORE cantt", "call +44 20 79", "Karachi +1 555", "nowhere"]
    assert evaluate(spark, text.detect_city("v"), values) == ["Lahore", None, "Karachi", None]
    assert evaluate(spark, text.detect_country("v"), values) == ["Pakistan", "United Kingdom", "Pakistan", None]


def test_document_type(spark):
    values = ["MINUTE SHEET with Bill-1(Legal)", "For approval of Rs. 22,875/- by the CEO", "Tax Invoice", "plain"]
    got = evaluate(spark, text.detect_document_type("v", F.lit(False), F.lit(True)), values)
    assert [g["type"] for g in got] == ["minute_sheet", "approval_request", "invoice", None]
    assert got[1]["reason"] == "For approval of Rs. 22,875/- by the CEO"
    weak = evaluate(spark, text.detect_document_type("v", F.lit(True), F.lit(True)), ["plain"])[0]
    assert (weak["type"], weak["confidence"]) == ("receipt", 0.4)
    assert evaluate(spark, text.is_transactional("v"), ["invoice", None, "quotation", "minute_sheet"]) == [
        True, True, False, False]


def test_looks_like_amount(spark):
    values = ["6,000", "2200.00", "Rs2200", "37405", "0819531-5", "Rs.5_cleaning", "road,"]
    assert evaluate(spark, text.looks_like_amount("v"), values) == [True, True, True, False, False, False, False]


def test_vendor_line_noise(spark):
    noise = ["Rs 400", "B0-9", "Invoice# 55", "16 Jun 2026", "Powered by Acme", "Home Delivery!", "Dear customer",
             "a@b.com", "Plaza 5, Main Road", "Cash Receipt", "Account Holder", "***"]
    names = ["Express Mart", "Noor Electric & Hardware Store", "Smith, Jones & Co."]
    assert evaluate(spark, text.vendor_line_noise("v"), noise) == [True] * len(noise)
    assert evaluate(spark, text.vendor_line_noise("v"), names) == [False] * len(names)


CATEGORIES = [
    ("Fried Chicken KFC", None, "Office Entertainment"), ("Papa John's", None, "Office Entertainment"),
    ("Unrelated Traders Pvt Ltd", None, None), ("Smart Watch Store", None, None),
    ("ABC Stationery Mart", None, "Stationary / Others"), ("City Hardware Store", None, "Office Repair & Maintenance"),
    ("Falcon Cash & Carry Sprite Mirinda Pepsi", None, "Office Entertainment"),
    ("Riverside Bakeshop Chocolate Cake", None, "Employee Care"), ("petrol toner", None, None),
    ("Acme", "received as Salary/ Stipend", "Salary"), ("Acme", "a small cafe", None),
    ("Acme Petrol", "salary", "Vehicle Running & Maintenance"), ("", "rent", "Rent"),
]


def test_category_classifier(spark):
    rows = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(CATEGORIES)], "i INT, s STRING, r STRING")
    got = rows.select("i", classify.classify_category("s", "r").alias("c")).orderBy("i").collect()
    assert [g["c"] for g in got] == [e for *_, e in CATEGORIES]


def test_file_category(spark):
    values = ["invoice_5.pdf", "x.XLSX", "x.xlsx", "Quarterly plan", "holiday.png", "misc"]
    got = evaluate(spark, classify.file_category("v"), values)
    # The extension rules are case-sensitive; the strongest rule wins, ties by table order.
    assert [g["category"] for g in got] == ["Invoices", "uncategorized", "Spreadsheets & Financial", "Project Plans",
                                            "Images & Screenshots", "uncategorized"]


def test_attachment_filter(spark):
    rows = spark.createDataFrame([("a.pdf", 5), ("a.ics", 5), ("a.ics", 99999), ("a", 99999), ("a.PDF", 20480)],
                                 "f STRING, s INT")
    assert [r[0] for r in rows.select(classify.attachment_filter("f", "s")).collect()] == [
        "too_small", "too_small", "denied_extension", "extension_not_allowed", None]


def test_checks_are_three_valued(spark):
    row = spark.range(1).select(
        checks.line_item_check(F.lit(12.0), F.lit(9800.0), F.lit(117600.0)),
        checks.line_item_check(F.lit(12.0), F.lit(9800.0), F.lit(98000.0)),
        checks.line_item_check(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)),
        checks.totals_check(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)),
        checks.totals_check(F.lit(100.0), F.lit(18.0), F.lit(None).cast("double"), F.lit(118.0)),
        checks.tax_rate_plausible(F.lit(100.0), F.lit(45.0)), checks.tax_rate_plausible(F.lit(0.0), F.lit(45.0)),
        checks.date_plausible(F.lit("2001-07-16").cast("date"), "2001-07-15"),
        checks.magnitude_plausible(F.lit(10.0), F.lit(1.0)), checks.magnitude_plausible(F.lit(10.0), F.lit(0.0)),
    ).first()
    assert list(row) == ["pass", "fail", "not_checked", None, True, False, None, False, False, None]


def test_route(spark):
    rows = spark.createDataFrame([(0.9, True, None), (0.9, True, False), (0.74, True, True), (0.39, True, True),
                                  (0.9, False, True)], "s DOUBLE, c BOOLEAN, a BOOLEAN")
    assert [r[0] for r in rows.select(checks.route("s", "c", "a")).collect()] == [
        "auto_processed", "needs_review", "needs_review", "needs_review_high_priority", "needs_review_high_priority"]


def test_phrases_found_are_those_whose_pattern_matches(spark):
    words = ["rent", "car", "car wash", "wash", "k-electric", "electric & hardware", "hardware store", "papa john's", "7up", "gas"]
    texts = ["car wash", "carwash", "a car, wash it", "electric & hardware store", "k-electric bill", "papa john's 7up", "7uppers rent", "", "gas gas gas",
             "rental", "wash car wash car", "\u00e9rent rent\u00e9", "rent_a car-wash"]
    frame = spark.createDataFrame([(t,) for t in texts], "text STRING").select("text", classify.phrases_found(
        F.col("text"), [(w, 0, True) for w in words]).alias("found"))
    assert {r["text"]: {p["phrase"] for p in r["found"]} for r in frame.collect()} == {
        t: {w for w in words if re.search(classify.word_pattern(w), t)} for t in texts}

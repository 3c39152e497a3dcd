"""Ledger facts, invariants and idempotence."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import day
from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import changes, evaluation, intake, joins, lists, trends
from ledgerloom.plans import reports
from ledgerloom.sources.tables import dealt_by_company
from tests.helpers import rows_of

INVOICE = ("invoice_id STRING, company_id INT, type STRING, status STRING, transaction_status STRING, category STRING, "
           "payment_method STRING, invoice_date DATE, total DOUBLE, vendor_id STRING, vendor_name STRING, "
           "invoice_number STRING, amount_mentioned DOUBLE, classification_source STRING")
EXPENSE = "expense_id STRING, company_id INT, status STRING, category STRING, expense_date DATE, amount DOUBLE"


def invoices(spark, rows):
    base = {"company_id": 1, "type": "purchase", "status": "validated", "transaction_status": "transactional",
            "classification_source": "rule"}
    full = [{**base, "invoice_id": str(i), **row} for i, row in enumerate(rows)]
    names = [f.split()[0] for f in INVOICE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], INVOICE)


def test_cashbook_counts_only_saved_transactions(spark):
    july, august = date(2026, 7, 5), date(2026, 8, 5)
    df = invoices(spark, [
        {"category": "Rent", "total": 10.0, "invoice_date": july, "payment_method": "cash"},
        {"category": "Rent", "total": 5.5, "invoice_date": july, "payment_method": "bank"},
        {"category": None, "total": None, "invoice_date": july},
        {"category": "Rent", "total": 99.0, "invoice_date": august},
        {"category": "Rent", "total": 77.0},
        {"category": "Rent", "total": 50.0, "invoice_date": july, "status": "processed"},
        {"category": "Rent", "total": 50.0, "invoice_date": july, "transaction_status": "non_transactional"},
        {"category": "Rent", "total": 50.0, "invoice_date": july, "type": "sale"},
    ])
    got = agg.category_summary(df, "2026-07-01", "2026-07-31").orderBy(*agg.category_order())
    assert [(r["category"], r["count"], r["total"]) for r in got.collect()] == [("Rent", 2, 15.5), (None, 1, 0.0)]
    pay = agg.payment_summary(df, "2026-07-01", "2026-07-31").first()
    assert (pay["monthly_total"], pay["cash_total"], pay["online_total"], pay["unspecified_total"],
            pay["transaction_count"]) == (15.5, 10.0, 5.5, 0.0, 3)
    # Without bounds an undated row counts; with one it cannot be placed.
    assert agg.category_summary(df).where("category = 'Rent'").first()["total"] == 191.5
    assert rows_of(agg.available_months(df), "month") == [(1, "2026-07"), (1, "2026-08")]


def test_payment_split_adds_up_to_the_category_total(tables):
    pay = agg.payment_summary(tables.v_purchase).select("company_id", F.round(
        F.col("cash_total") + F.col("online_total") + F.col("unspecified_total"), 2).alias("t"), "monthly_total")
    assert pay.where("t <> monthly_total").count() == 0
    both = pay.join(agg.cashbook_grand_total(tables.v_purchase), "company_id")
    assert both.where("grand_total <> monthly_total").count() == 0 and both.count() == 5


def test_expense_period_is_half_open_by_default(spark):
    df = spark.createDataFrame([("a", 1, "approved", "Rent", date(2026, 7, 1), 10.0),
                                ("b", 1, "approved", "Rent", date(2026, 7, 31), 7.0),
                                ("c", 1, "pending", "Rent", date(2026, 7, 2), 3.0)], EXPENSE)
    first = agg.expense_summary(df, "2026-07-01", "2026-07-31").first()
    assert (first["total"], first["approved"], first["pending_count"]) == (13.0, 10.0, 1)
    assert agg.expense_summary(df, "2026-07-01", "2026-07-31", end_inclusive=True).first()["approved"] == 17.0
    assert agg.expenses_by_month(df).first()["total"] == 17.0


def test_profit_loss_and_tax(spark):
    sales = spark.createDataFrame([(1, "sale", "ocr", date(2026, 7, 3), datetime(2026, 7, 4), 500000.0, "validated")],
                                  "company_id INT, type STRING, extraction_source STRING, invoice_date DATE, "
                                  "created_at TIMESTAMP_NTZ, total DOUBLE, status STRING")
    spend = spark.createDataFrame([("a", 1, "approved", "Rent", date(2026, 7, 3), 200000.0),
                                   ("b", 1, "pending", "Rent", date(2026, 7, 3), 20000.0)], EXPENSE)
    lines = {r["label"]: (r["value"], r["display"])
             for r in reports.profit_loss(sales, spend, "2026-07-01", "2026-07-31").collect()}
    assert lines["Net Profit"] == (300000.0, "PKR 300,000") and lines["Rent"] == (200000.0, "PKR 200,000")
    settings = spark.createDataFrame([(1, 18.0, 4.0, "filer")],
                                     "company_id INT, default_gst_rate DOUBLE, withholding_tax_rate DOUBLE, "
                                     "filer_status STRING")
    tax = reports.tax_summary(sales, spend, settings, "2026-07-01", "2026-07-31").first()
    assert (tax["filer_label"], tax["output_gst"], tax["withholding_tax"], tax["net_tax"]) == (
        "Filer", 90000.0, 8000.0, 82000.0)


def test_payroll_runs_once(spark):
    staff = spark.createDataFrame([(1, 1, 100000.0, 10000.0, 5000.0, True), (2, 1, 50000.0, 0.0, 2000.0, True),
                                   (3, 1, 9.0, 0.0, 0.0, False)],
                                  "employee_id INT, company_id INT, salary DOUBLE, bonus DOUBLE, deductions DOUBLE, "
                                  "active BOOLEAN")
    nothing = spark.createDataFrame([], "employee_id INT, company_id INT, period STRING, net_salary DOUBLE")
    summary = agg.payroll_summary(joins.paid_flag(staff, nothing, "2026-07-15")).first()
    assert (summary["total_net"], summary["pending_count"], summary["paid_count"]) == (153000.0, 2, 0)
    run = joins.payroll_to_process(staff, nothing, "2026-07-15")
    assert run.count() == 2
    assert joins.payroll_to_process(staff, run, "2026-07-15").count() == 0
    booked = changes.book_payroll(run, spark.createDataFrame([], "company_id INT, source STRING, reference_id STRING"),
                                  day("2026-07-15"))
    assert booked.first()["amount"] == 153000.0
    assert changes.book_payroll(run, booked, day("2026-07-15")).count() == 0


def test_booking_is_idempotent(tables):
    booked = joins.book_expenses(tables.v_purchase, tables.v_expense, "2001-07-15")
    again = tables.v_expense.select("company_id", "invoice_id").unionByName(booked.select("company_id", "invoice_id"))
    assert booked.count() > 0 and joins.book_expenses(tables.v_purchase, again, "2001-07-15").count() == 0


def test_reclassify_moves_amounts_only_on_a_change(spark):
    df = invoices(spark, [
        {"transaction_status": "non_transactional", "amount_mentioned": 5.0},
        {"total": 9.0, "category": "Rent"},
        {"transaction_status": "non_transactional", "amount_mentioned": 5.0, "category": "x"},
        {"total": 3.0, "category": "Rent"},
    ])
    log = spark.createDataFrame([("0", datetime(2026, 1, 1), "transactional"), ("1", datetime(2026, 1, 1),
                                 "transactional"), ("1", datetime(2026, 1, 2), "non_transactional"),
                                 ("2", datetime(2026, 1, 1), "non_transactional")],
                                "invoice_id STRING, decided_at TIMESTAMP, target STRING")
    got = changes.apply_reclassify(df, log).select("invoice_id", "transaction_status", "total", "amount_mentioned",
                                                   "category", "classification_source")
    assert rows_of(got, "invoice_id") == [
        ("0", "transactional", 5.0, None, None, "user_override"),
        ("1", "non_transactional", None, 9.0, None, "user_override"),
        ("2", "non_transactional", None, 5.0, "x", "user_override"),
        ("3", "transactional", 3.0, None, "Rent", "rule")]


def test_vendor_spend_quirks_and_options(spark):
    df = invoices(spark, [
        {"vendor_id": "v", "vendor_name": "Zeta", "total": 1.0, "invoice_date": date(2026, 1, 1)},
        {"vendor_id": "v", "vendor_name": "Alpha", "total": 2.0, "invoice_date": date(2026, 2, 1), "status": "rejected"},
    ])
    row = agg.vendor_spend(df).first()
    assert (row["vendor_name"], row["latest_name"], row["total_spend"], row["invoice_count"]) == ("Zeta", "Alpha", 3.0, 2)
    assert agg.vendor_spend(df, confirmed_only=True).first()["total_spend"] == 1.0
    assert agg.vendor_spend(df, start="2026-02-01").first()["total_spend"] == 2.0


def test_unknown_filter_values_are_errors(tables):
    with pytest.raises(ValueError):
        lists.invoice_list(tables.v_purchase, statuses="validated,bogus")


def test_quotes_without_a_score_come_last(spark):
    df = spark.createDataFrame([("a", None, 1.0, "r"), ("b", 50.0, 9.0, "r"), ("c", 50.0, 8.0, "r")],
                               "quote_id STRING, score DOUBLE, price DOUBLE, request_id STRING")
    assert [(r["quote_id"], r["position"]) for r in lists.quote_ranking(df).collect()] == [("c", 1), ("b", 2), ("a", 3)]


def test_a_company_without_tax_settings_gets_the_defaults(spark):
    sales = spark.createDataFrame([(1, "sale", "ocr", date(2026, 7, 3), datetime(2026, 7, 4), 1000.0, "validated")],
                                  "company_id INT, type STRING, extraction_source STRING, invoice_date DATE, "
                                  "created_at TIMESTAMP_NTZ, total DOUBLE, status STRING")
    spend = spark.createDataFrame([("a", 1, "approved", "Rent", date(2026, 7, 3), 100.0)], EXPENSE)
    none = spark.createDataFrame([], "company_id INT, default_gst_rate DOUBLE, withholding_tax_rate DOUBLE, filer_status STRING")
    tax = reports.tax_summary(sales, spend, none, "2026-07-01", "2026-07-31").first()
    assert (tax["filer_label"], tax["output_gst"], tax["withholding_tax"]) == ("Filer", 180.0, 0.0)


def test_spellings_of_one_sender_rule_are_one_rule(spark):
    mail = spark.createDataFrame([(1, 1, "a@x.com"), (2, 1, "b@y.org")], "message_id INT, account_id INT, from_address STRING")
    rules = spark.createDataFrame([(1, "a@x.com", "allow"), (1, "A@x.com ", "deny"), (1, "Y.org", "allow"), (1, " y.ORG", "allow")],
                                  "account_id INT, pattern STRING, action STRING")
    got = joins.sender_verdicts(mail, rules).select("message_id", "verdict")
    assert rows_of(got, "message_id") == [(1, "deny"), (2, "allow")]


def test_an_override_of_an_earlier_batch_stays(spark):
    df = invoices(spark, [{"classification_source": "user_override"}, {}])
    log = spark.createDataFrame([], "invoice_id STRING, decided_at TIMESTAMP, target STRING")
    got = changes.apply_reclassify(df, log).select("invoice_id", "classification_source")
    assert rows_of(got, "invoice_id") == [("0", "user_override"), ("1", "rule")]


def test_patches_of_one_invoice_are_merged_by_time(spark):
    df = invoices(spark, [{"vendor_name": "Old", "category": "Rent", "total": 1.0, "status": "validated"}])
    patches = spark.createDataFrame([("0", 2, {"vendor_name": "New"}), ("0", 1, {"vendor_name": "Mid", "total": "7"}), ("0", 3, {"category": None})],
                                    "invoice_id STRING, patched_at INT, fields MAP<STRING, STRING>")
    got = changes.apply_corrections(df, patches).select("vendor_name", "category", "total", "status")
    assert rows_of(got, "status") == [("New", None, 7.0, "validated")]


def test_only_stuck_jobs_get_an_error(spark):
    jobs = spark.createDataFrame([(1, "failed", datetime(2026, 1, 1), datetime(2026, 1, 2), ["boom"]),
                                  (2, "running", datetime(2026, 1, 1), None, ["slow"]), (3, "queued", datetime(2026, 1, 1), None, None)],
                                 "job_id INT, status STRING, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, errors ARRAY<STRING>")
    got = intake.fail_stuck_jobs(jobs, "2026-01-05 00:00:00").select("job_id", "status", "completed_at", "errors")
    told, now = "No progress for over 1h", datetime(2026, 1, 5)
    assert rows_of(got, "job_id") == [(1, "failed", datetime(2026, 1, 2), ["boom"]), (2, "failed", now, ["slow", told]), (3, "failed", now, [told])]


def test_growth_and_margin(spark):
    trend = spark.createDataFrame([(1, "2026-06", 0.0, 10.0), (1, "2026-07", 200.0, 15.0), (1, "2026-08", 100.0, 15.0)],
                                  "company_id INT, month STRING, revenue DOUBLE, expenses DOUBLE")
    growth = [(r["revenue_growth"], r["expenses_growth"]) for r in trends.growth_mom(trend).orderBy("month").collect()]
    assert growth == [(None, None), (0.0, 50.0), (-50.0, 0.0)]
    assert [r["margin"] for r in trends.margin_trend(trend).orderBy("month").collect()] == [0.0, 92.5, 85.0]


def test_golden_examples(spark):
    golden = spark.createDataFrame([("a", "known", 500.0), ("b", "known", 500.0), ("c", "absent", None),
                                    ("d", "unknown", None), ("e", "known", 500.0)],
                                   "filename STRING, total_kind STRING, total DOUBLE")
    actual = spark.createDataFrame([("a", None), ("b", 50.0), ("c", 1.0), ("d", 1.0), ("e", 500.004), ("f", 1.0)],
                                   "filename STRING, total DOUBLE")
    joined = evaluation.golden_join(golden, actual)
    got = {r["filename"]: r["s"] for r in joined.where("presence = 'matched'").select(
        "filename", evaluation.field_status("total").alias("s")).collect()}
    assert got == {"a": "MISSING", "b": "INCORRECT", "c": "FALSE_POSITIVE", "d": "UNVERIFIABLE", "e": "CORRECT"}
    assert joined.where("presence = 'unexpected'").count() == 1


def test_upsert_keeps_human_decisions_and_replays_to_the_same_table(tables):
    batch = intake.decide(tables.v_attachment, tables.v_sender_rule)
    once = intake.upsert_respecting_overrides(tables.v_stored_attachment, batch)
    twice = intake.upsert_respecting_overrides(once, batch)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    old = tables.v_stored_attachment.select(*intake.ATTACHMENT_KEYS, F.col("review_status").alias("old"))
    assert once.join(old, intake.ATTACHMENT_KEYS).where("old <> review_status").count() == 0
    assert once.where("category_source = 'manual_override' AND category <> 'Contracts'").count() == 0


def test_window_start(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 10),), (datetime(2024, 1, 29),), (None,)],
                                 "cursor TIMESTAMP_NTZ")
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    start = lambda **kw: [r[0] for r in rows.select(intake.window_start(now, cursor=F.col("cursor"), **kw)).collect()]
    window = datetime(2024, 1, 16)
    assert start(window_days=14) == [window, datetime(2024, 1, 29), window]
    assert start(window_days=14, full_resync=True) == [window] * 3
    assert start(window_days=None) == [datetime(2024, 1, 10), datetime(2024, 1, 29), None]
    assert start(window_days=None, full_resync=True) == [None] * 3


def test_an_expired_cursor_means_a_bounded_backfill(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 10), True), (datetime(2024, 1, 10), False), (None, True)],
                                 "cursor TIMESTAMP_NTZ, valid BOOLEAN")
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    got = [r[0] for r in rows.select(intake.backfill_start(F.col("cursor"), F.col("valid"), now)).collect()]
    assert got == [datetime(2024, 1, 10), datetime(2023, 8, 3), datetime(2023, 8, 3)]


def test_a_hot_company_needs_no_large_shuffle(spark, tables, capsys):
    """Top-k ships k rows per task (group limit below the shuffle) and aggregates
    combine before it; no plan holds a cross join."""
    agg.top_customers(tables.v_sales, 5).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and "partial_sum" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path, capsys):
    from ledgerloom.sources.tables import read_entity, write_entity

    rows = invoices(spark, [{"total": 1.0, "company_id": i % 3} for i in range(9)])
    stored = rows.withColumn("company_id", F.col("company_id").cast("string"))
    write_entity(stored, str(tmp_path), "invoice")
    one = read_entity(spark, str(tmp_path), "invoice", "1").where("status = 'validated'").select("total")
    one.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(company_id" in plan and "EqualTo(status,validated)" in plan
    assert "ReadSchema: struct<status:string,total:double>" in plan
    assert one.count() == 3


def test_a_deep_page_reads_its_own_days_only(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("invoice_id"), F.when(F.col("id") < 19_900, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.floor(F.col("id") / 100).cast("int"), (F.col("id") % 24).cast("int"))).alias("created_at"))
    rows.repartitionByRange(8, "created_at").write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    index = lists.page_index(stored)
    whole = [r["invoice_id"] for r in stored.orderBy(F.desc("created_at"), "invoice_id").collect()]
    for offset, limit in ((0, 20), (90, 40), (10_000, 20), (19_880, 40), (19_990, 20), (20_000, 20)):
        page = [r["invoice_id"] for r in lists.page_by_index(stored, index, "invoice_id", offset, limit).collect()]
        assert page == whole[offset:offset + limit], offset
        assert lists.rows_of_page(stored, index, offset, limit)[0].count() <= 200
    first, page = lists.page(stored.orderBy(F.desc("created_at"), "invoice_id"), 0, 7).collect(), []
    while first:
        page += [r["invoice_id"] for r in first]
        first = lists.page_after(stored, "invoice_id", first[-1]["created_at"], first[-1]["invoice_id"], 2500).collect()
    assert page == whole


def test_rows_dealt_by_company_travel_packed(spark, tmp_path):
    """A store's rows come back as they were, nulls, times and amounts too, and a row is not a shuffled row."""
    rows = spark.range(3000).selectExpr(
        "IF(id % 7 = 0, NULL, CAST(id % 3 AS STRING)) AS company_id", "id", "IF(id % 5 = 0, NULL, id * 1.5D) AS amount",
        "CAST(id AS DECIMAL(12, 2)) AS price", "IF(id % 4 = 0, NULL, DATE '2026-08-01' + CAST(id % 90 AS INT)) AS day",
        "TIMESTAMP '2026-08-01 10:00:00' + MAKE_INTERVAL(0, 0, 0, 0, 0, id) AS at", "id % 2 = 0 AS even", "CONCAT('n', id % 11) AS name")
    dealt = dealt_by_company(rows)
    assert dealt.schema == rows.schema or [f.dataType for f in dealt.schema] == [f.dataType for f in rows.schema]
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
    shuffles = [p for p in dealt._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Rebalance" in p or "MapInArrow" in p]
    assert ["Rebalance" in p for p in shuffles] == [False, True, False]  # packed, dealt, unpacked

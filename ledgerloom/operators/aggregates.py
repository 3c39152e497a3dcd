"""Ledger aggregates, for all companies at once.

Every aggregate groups by ``company_id`` plus a small key, so Spark combines
inside each task first and a company holding a third of the rows costs one
partial row per task and key, not a third of the shuffle. Amounts are added as
integer cents (``money_sum``): exact and independent of merge order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.core import count_if, money_sum, month_key
from ledgerloom.functions.predicates import (INVOICE_STATUSES, PENDING_STATUSES, bucket_date, customer_label,
                                              date_between, day, is_cashbook, is_delayed, is_scanned_sale)

COMPANY = "company_id"


def top_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """Best ``limit`` rows per group. The row_number filter is pushed below the
    shuffle as a group limit, so each task ships at most ``limit`` rows per
    group whatever the group's size."""
    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("position") <= limit)


# ------------------------------------------------------------------- purchases


def vendor_spend(invoices: DataFrame, start=None, end=None, confirmed_only: bool = False) -> DataFrame:
    """Linked purchases per vendor. By default rejected rows and quotations
    count too, as in the system being replaced; ``confirmed_only`` keeps
    cashbook rows. ``vendor_name`` is the alphabetically last spelling and
    ``latest_name`` the most recent one."""
    rows = invoices.where((F.col("type") == "purchase") & F.col("vendor_id").isNotNull()
                          & date_between("invoice_date", start, end))
    if confirmed_only:
        rows = rows.where(is_cashbook())
    return rows.groupBy(COMPANY, "vendor_id").agg(
        F.max("vendor_name").alias("vendor_name"), money_sum("total").alias("total_spend"),
        F.count("*").alias("invoice_count"),
        F.max(F.when(F.col("vendor_name").isNotNull(), F.struct("invoice_date", "vendor_name")))["vendor_name"]
        .alias("latest_name"))


def unlinked_purchases(invoices: DataFrame) -> DataFrame:
    return invoices.where((F.col("type") == "purchase") & F.col("vendor_id").isNull()
                          & (F.trim(F.col("vendor_name")) != ""))


def unlinked_vendor_groups(invoices: DataFrame) -> DataFrame:
    """Purchases without a vendor, one row per exact spelling. The member ids
    stay in long form (``unlinked_vendor_members``): one spelling can cover any
    number of invoices, so they are never gathered into one array."""
    dated = F.when(F.col("invoice_date").isNotNull(),
                   F.struct("invoice_date", F.coalesce("invoice_number", F.lit("")).alias("n"), "invoice_number"))
    return unlinked_purchases(invoices).groupBy(COMPANY, "vendor_name").agg(
        F.count("*").alias("invoice_count"), money_sum("total").alias("total_amount"),
        F.max("invoice_date").alias("latest_invoice_date"),
        F.when(F.max(dated).isNotNull(), F.max(dated)["invoice_number"]).otherwise(F.min("invoice_number"))
        .alias("sample_invoice_number"))


def unlinked_vendor_members(invoices: DataFrame) -> DataFrame:
    return unlinked_purchases(invoices).select(COMPANY, "vendor_name", "invoice_id")


def status_summary(invoices: DataFrame) -> DataFrame:
    """Count per status in one row per company; a status nobody has counts 0."""
    counts = [count_if(F.col("status") == s).alias(s) for s in INVOICE_STATUSES]
    return invoices.groupBy(COMPANY).agg(*counts, F.count("*").alias("total"))


def status_counts_long(invoices: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{s}', `{s}`" for s in INVOICE_STATUSES)
    return status_summary(invoices).selectExpr(
        COMPANY, f"stack({len(INVOICE_STATUSES)}, {pairs}) AS (status, count)", "total")


def invoice_status_chart(invoices: DataFrame) -> DataFrame:
    """Two slices; an empty slice is left out."""
    name = (F.when(F.col("status").isin("processed", "validated", "sent_to_accounting"), "Processed")
            .when(F.col("status").isin(*PENDING_STATUSES), "Needs Review"))
    return (invoices.withColumn("name", name).where(F.col("name").isNotNull())
            .groupBy(COMPANY, "name").agg(F.count("*").alias("value")))


# -------------------------------------------------------------------- cashbook


def category_summary(invoices: DataFrame, start=None, end=None) -> DataFrame:
    """The one aggregate behind every category and grand total."""
    rows = invoices.where(is_cashbook() & date_between("invoice_date", start, end))
    return rows.groupBy(COMPANY, "category").agg(F.count("*").alias("count"), money_sum("total").alias("total"))


def category_order() -> list[Column]:
    return [F.col("category").isNull(), F.lower("category"), F.col("category")]


def cashbook_grand_total(invoices: DataFrame, start=None, end=None) -> DataFrame:
    return category_summary(invoices, start, end).groupBy(COMPANY).agg(
        money_sum("total").alias("grand_total"), F.sum("count").alias("entries"),
        count_if(F.col("total") > 0).alias("charted_categories"))


def payment_summary(invoices: DataFrame, start=None, end=None, keys: tuple[str, ...] = ()) -> DataFrame:
    rows = invoices.where(is_cashbook() & date_between("invoice_date", start, end))
    if "month" in keys:
        rows = rows.withColumn("month", month_key("invoice_date"))
    method = F.col("payment_method")
    return rows.groupBy(COMPANY, *keys).agg(
        money_sum("total").alias("monthly_total"), money_sum("total", method == "cash").alias("cash_total"),
        money_sum("total", method == "bank").alias("online_total"),
        money_sum("total", method.isNull() | ~method.isin("cash", "bank")).alias("unspecified_total"),
        F.count("*").alias("transaction_count"))


def available_months(invoices: DataFrame) -> DataFrame:
    return (invoices.where(is_cashbook() & F.col("invoice_date").isNotNull())
            .select(COMPANY, month_key("invoice_date").alias("month")).distinct())


# ----------------------------------------------------------------------- sales


def scanned_sales(invoices: DataFrame, start=None, end=None) -> DataFrame:
    return (invoices.where(is_scanned_sale()).withColumn("bucket_date", bucket_date())
            .where(date_between("bucket_date", start, end)))


def sales_monthly(invoices: DataFrame, start=None, end=None) -> DataFrame:
    return (scanned_sales(invoices, start, end).where(F.col("bucket_date").isNotNull())
            .groupBy(COMPANY, month_key("bucket_date").alias("month"))
            .agg(money_sum("total").alias("total"), F.count("*").alias("count")))


def customer_totals(invoices: DataFrame, start=None, end=None) -> DataFrame:
    return (scanned_sales(invoices, start, end).groupBy(COMPANY, customer_label().alias("customer_name"))
            .agg(money_sum("total").alias("total"), F.count("*").alias("count")))


def top_customers(invoices: DataFrame, limit: int = 5, start=None, end=None) -> DataFrame:
    return top_per_group(customer_totals(invoices, start, end), [COMPANY],
                         [F.desc("total"), F.asc("customer_name")], limit)


def sales_totals(invoices: DataFrame, as_of, start=None, end=None) -> DataFrame:
    return scanned_sales(invoices, start, end).groupBy(COMPANY).agg(
        money_sum("total").alias("revenue"), F.count("*").alias("document_count"),
        count_if(F.col("status").isin(*PENDING_STATUSES)).alias("pending_review"),
        money_sum("total", F.col("bucket_date") == day(as_of)).alias("today_revenue"))


# -------------------------------------------------------------------- expenses


def expense_categories(expenses: DataFrame, start, end, end_inclusive: bool = False) -> DataFrame:
    """Approved spend per category in [start, end); the open end reproduces the
    period rule of the summary cards."""
    rows = expenses.where((F.col("status") == "approved")
                          & date_between("expense_date", start, end, end_inclusive=end_inclusive))
    return rows.groupBy(COMPANY, "category").agg(money_sum("amount").alias("value"))


def expense_summary(expenses: DataFrame, start, end, end_inclusive: bool = False) -> DataFrame:
    status = F.col("status")
    return (expenses.where(date_between("expense_date", start, end, end_inclusive=end_inclusive)).groupBy(COMPANY)
            .agg(money_sum("amount").alias("total"),
                 *[money_sum("amount", status == s).alias(s) for s in ("approved", "pending", "rejected")],
                 count_if(status == "pending").alias("pending_count"),
                 count_if(status == "rejected").alias("rejected_count")))


def expenses_by_month(expenses: DataFrame, start=None, end=None) -> DataFrame:
    return (expenses.where((F.col("status") == "approved") & date_between("expense_date", start, end))
            .groupBy(COMPANY, month_key("expense_date").alias("month")).agg(money_sum("amount").alias("total")))


def month_bounds(as_of) -> tuple[Column, Column]:
    start = F.trunc(day(as_of), "MM")
    return start, F.add_months(start, 1)


def kpis(invoices_all: DataFrame, expenses: DataFrame, as_of) -> DataFrame:
    """Dashboard figures. Two conditional aggregates, one pass over each table,
    joined on company; a missing input table fails the job."""
    start, end = month_bounds(as_of)
    sale, bucket = is_scanned_sale(), F.col("bucket_date")
    revenue = invoices_all.withColumn("bucket_date", bucket_date()).groupBy(COMPANY).agg(
        money_sum("total", sale & (bucket == day(as_of))).alias("today_revenue"),
        money_sum("total", sale & (bucket >= start) & (bucket < end)).alias("monthly_revenue"),
        money_sum("total", sale).alias("all_time_revenue"),
        count_if(F.col("status").isin(*PENDING_STATUSES)).alias("pending_invoices"),
        count_if(F.col("status").isin("processed", "validated", "sent_to_accounting")).alias("processed_invoices"))
    this_month = (F.col("expense_date") >= start) & (F.col("expense_date") < end)
    spend = expenses.where(F.col("status") == "approved").groupBy(COMPANY).agg(
        money_sum("amount", this_month).alias("monthly_expenses"),
        money_sum("amount", this_month & (F.col("category") == "Salaries")).alias("employee_salaries"),
        money_sum("amount").alias("all_time_expenses"))
    zero = ["today_revenue", "monthly_revenue", "all_time_revenue", "monthly_expenses", "employee_salaries",
            "all_time_expenses", "pending_invoices", "processed_invoices"]
    both = revenue.join(spend, COMPANY, "full_outer").na.fill(0, zero)
    return both.select(COMPANY, "today_revenue", "monthly_revenue", "monthly_expenses",
                       F.round(F.col("monthly_revenue") - F.col("monthly_expenses"), 2).alias("net_profit"),
                       F.round(F.col("all_time_revenue") - F.col("all_time_expenses"), 2).alias("cash_balance"),
                       "employee_salaries", "pending_invoices", "processed_invoices")


# --------------------------------------------------------------------- payroll


def payroll_summary(employees_with_flag: DataFrame) -> DataFrame:
    """Active employees with their paid flag (see ``joins.paid_flag``)."""
    return employees_with_flag.where("active").groupBy(COMPANY).agg(
        money_sum("salary").alias("total_salary"), money_sum("bonus").alias("total_bonus"),
        money_sum("deductions").alias("total_deductions"),
        money_sum(F.col("salary") + F.col("bonus") - F.col("deductions")).alias("total_net"),
        F.count("*").alias("employee_count"), count_if(F.col("payroll_status") == "paid").alias("paid_count"),
        count_if(F.col("payroll_status") == "pending").alias("pending_count"))


def payroll_history(payroll: DataFrame) -> DataFrame:
    return payroll.groupBy(COMPANY, "period").agg(
        money_sum("net_salary").alias("total_net"), F.count("*").alias("employee_count"),
        F.max("processed_at").alias("processed_at"))


def payroll_by_department(employees: DataFrame) -> DataFrame:
    return employees.groupBy(COMPANY, "department").agg(
        money_sum(F.col("salary") + F.col("bonus")).alias("value"))


# ----------------------------------------------------------------- procurement


def procurement_stats(requests: DataFrame, orders: DataFrame, as_of) -> DataFrame:
    waiting = requests.groupBy(COMPANY).agg(
        count_if(F.col("status") == "pending_approval").alias("pending_count"),
        money_sum("amount", F.col("status") == "pending_approval").alias("pending_amount"))
    placed = orders.groupBy(COMPANY).agg(
        count_if(F.col("status") == "delivered").alias("completed_count"),
        count_if(is_delayed(as_of)).alias("delayed_count"),
        count_if(F.col("status") == "cancelled").alias("cancelled_count"))
    columns = ["pending_count", "pending_amount", "completed_count", "delayed_count", "cancelled_count"]
    return waiting.join(placed, COMPANY, "full_outer").na.fill(0, columns).select(COMPANY, *columns)


# ------------------------------------------------------------ items, syncs, totals


def line_items_pass_rate(items: DataFrame) -> DataFrame:
    """Share of checkable items that pass (null when none is) and the amount sum."""
    passed = F.when(F.col("arithmetic_check") == "pass", 1.0).when(F.col("arithmetic_check") == "fail", 0.0)
    return items.groupBy("invoice_id").agg(
        F.avg(passed).alias("pass_rate"),
        F.when(F.count("amount") > 0, money_sum("amount")).alias("amount_sum"))


def sync_counters(jobs: DataFrame) -> DataFrame:
    status = F.col("status")
    return jobs.groupBy("run_group").agg(
        F.count("*").alias("discovered"), count_if(status == "completed").alias("downloaded"),
        count_if(status == "failed").alias("failed"),
        count_if(status.isin("completed", "failed")).alias("processed"))


def vendor_total_spend(vendors_with_spend: DataFrame) -> DataFrame:
    return vendors_with_spend.groupBy(COMPANY).agg(
        money_sum("total_spend").alias("total_spend"), F.count("*").alias("vendors"))

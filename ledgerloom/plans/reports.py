"""Financial reports for every company at once.

A report is a long table: company, section (summary or table), label, numeric
value and the display text. Each builds on the same aggregates the dashboard
reads, so a report total can never differ from the figure on screen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.core import count_if, money_label, money_sum
from ledgerloom.functions.predicates import PENDING_STATUSES, customer_label, date_between
from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import lists, trends
from ledgerloom.operators.aggregates import COMPANY

ALL_TIME_START = "2000-01-01"
#: what a company without a settings row is taxed by
TAX_DEFAULTS = {"default_gst_rate": 18.0, "withholding_tax_rate": 0.0, "filer_status": "filer"}


def _round(value: Column) -> Column:
    return F.round(value, 2)


def summary_lines(row_per_company: DataFrame, lines: dict[str, Column]) -> DataFrame:
    """Unpivot one wide row per company into labelled lines."""
    entries = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), value.alias("value"))
                        for i, (label, value) in enumerate(lines.items())])
    return (row_per_company.select(COMPANY, F.explode(entries).alias("e"))
            .select(COMPANY, F.lit("summary").alias("section"), "e.line", "e.label", "e.value"))


def _table(df: DataFrame, label: str, value: str) -> DataFrame:
    return df.select(COMPANY, F.lit("table").alias("section"), F.lit(0).alias("line"), F.col(label).alias("label"),
                     F.col(value).alias("value"))


def _report(*parts: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("display", money_label("value"))


def _revenue_and_spend(invoices: DataFrame, spend: DataFrame, start, end) -> DataFrame:
    revenue = agg.scanned_sales(invoices, start, end).groupBy(COMPANY).agg(money_sum("total").alias("revenue"))
    return revenue.join(spend, COMPANY, "full_outer").na.fill(0.0, ["revenue", "approved"])


def _approved(expenses: DataFrame, start, end, end_inclusive: bool) -> DataFrame:
    return agg.expense_summary(expenses, start, end, end_inclusive).select(COMPANY, "approved")


def profit_loss(invoices: DataFrame, expenses: DataFrame, start, end, end_inclusive: bool = False) -> DataFrame:
    """The company line rolls up the category aggregate of the table below it.
    Both branches read the same columns of it, so its exchange is computed once
    and the ledger is scanned once."""
    categories = expenses.where(date_between("expense_date", start, end, end_inclusive=end_inclusive)).groupBy(
        COMPANY, "category").agg(money_sum("amount", F.col("status") == "approved").alias("value"),
                                 count_if(F.col("status") == "approved").alias("entries"))
    spend = categories.where(F.col("entries") >= 0).groupBy(COMPANY).agg(money_sum("value").alias("approved"))
    lines = {"Revenue": F.col("revenue"), "Expenses (approved)": F.col("approved"),
             "Net Profit": _round(F.col("revenue") - F.col("approved"))}
    return _report(summary_lines(_revenue_and_spend(invoices, spend, start, end), lines),
                   _table(categories.where(F.col("entries") > 0), "category", "value"))


def cash_flow(invoices: DataFrame, expenses: DataFrame, start, end) -> DataFrame:
    """Month rows and their totals; both ends of the period count here."""
    months = trends.revenue_vs_expenses_months(invoices, expenses, start, end)
    totals = months.groupBy(COMPANY).agg(money_sum("inflow").alias("inflow"), money_sum("outflow").alias("outflow"))
    lines = {"Total Inflow": F.col("inflow"), "Total Outflow": F.col("outflow"),
             "Net Cash Flow": _round(F.col("inflow") - F.col("outflow"))}
    body = months.select(COMPANY, F.explode(F.array(
        *[F.struct(F.concat_ws(" ", "month", F.lit(name)).alias("label"), F.col(name).alias("value"))
          for name in ("inflow", "outflow", "net")])).alias("e")).select(COMPANY, "e.label", "e.value")
    return _report(summary_lines(totals, lines), _table(body, "label", "value"))


def tax_summary(invoices: DataFrame, expenses: DataFrame, settings: DataFrame, start, end,
                end_inclusive: bool = False) -> DataFrame:
    """A company without a settings row is taxed by ``TAX_DEFAULTS``."""
    both = _revenue_and_spend(invoices, _approved(expenses, start, end, end_inclusive), start, end)
    gst = F.col("revenue") * (F.col("default_gst_rate") / 100)
    withheld = F.col("approved") * (F.col("withholding_tax_rate") / 100)
    return both.join(settings, COMPANY, "left").na.fill(TAX_DEFAULTS).select(
        COMPANY, F.when(F.col("filer_status") == "filer", "Filer").otherwise("Non-Filer").alias("filer_label"),
        F.col("revenue").alias("gross_revenue"), gst.alias("output_gst"), withheld.alias("withholding_tax"),
        (gst - withheld).alias("net_tax"), money_label(gst - withheld).alias("display"))


def sales(invoices: DataFrame, start, end, customer_limit: int | None = None) -> DataFrame:
    """Totals roll up the customer aggregate, so the sales are scanned once. All
    customers are listed unless ``customer_limit`` asks for the largest only."""
    customers = agg.scanned_sales(invoices, start, end).groupBy(COMPANY, customer_label().alias("customer_name")).agg(
        money_sum("total").alias("total"), F.count("*").alias("documents"),
        count_if(F.col("status").isin(*PENDING_STATUSES)).alias("pending"))
    totals = customers.groupBy(COMPANY).agg(money_sum("total").alias("revenue"), F.sum("documents").alias("documents"),
                                            F.sum("pending").alias("pending"))
    lines = {"Total Revenue": F.col("revenue"), "Documents Scanned": F.col("documents").cast("double"),
             "Pending Review": F.col("pending").cast("double")}
    # Same columns as the totals branch, so the customer exchange is reused.
    ranked = customers.where((F.col("documents") >= 0) & (F.col("pending") >= 0))
    if customer_limit is not None:
        ranked = agg.top_per_group(ranked, [COMPANY], [F.desc("total"), F.asc("customer_name")], customer_limit)
    return _report(summary_lines(totals, lines), _table(ranked, "customer_name", "total"))


def purchases(invoices: DataFrame, start, end) -> DataFrame:
    spend = agg.vendor_spend(invoices, start, end)
    totals = spend.groupBy(COMPANY).agg(money_sum("total_spend").alias("spend"), F.count("*").alias("vendors"))
    lines = {"Total Spend": F.col("spend"), "Vendors": F.col("vendors").cast("double")}
    body = spend.withColumn("label", F.concat_ws(" ", F.coalesce("vendor_name", F.lit("—")), "vendor_id"))
    return _report(summary_lines(totals, lines), _table(body, "label", "total_spend"))


def cash_position(invoices: DataFrame, expenses: DataFrame, as_of, floor: str = ALL_TIME_START,
                  end_inclusive: bool = False) -> DataFrame:
    both = _revenue_and_spend(invoices, _approved(expenses, floor, as_of, end_inclusive), floor, as_of)
    return _report(summary_lines(both, {"Cash Balance (approx.)": _round(F.col("revenue") - F.col("approved"))}))


def category_report(invoices: DataFrame, start=None, end=None) -> DataFrame:
    """Entries of every category beside the category total of the one aggregate
    (``category_summary``), never a sum over the listed entries."""
    entries = lists.category_rows(invoices, start=start, end=end)
    totals = agg.category_summary(invoices, start, end).select(
        F.col(COMPANY).alias("total_company"), F.col("category").alias("total_category"),
        F.col("total").alias("category_total"))
    same = entries[COMPANY].eqNullSafe(F.col("total_company")) & entries["category"].eqNullSafe(
        F.col("total_category"))
    return (entries.join(totals, same, "left").drop("total_company", "total_category")
            .withColumn("category_total", F.coalesce("category_total", F.lit(0.0))))

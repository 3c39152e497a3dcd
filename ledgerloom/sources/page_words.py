"""Positioned words for the layout jobs, rendered from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import Tables


def _tokens(printed: DataFrame) -> DataFrame:
    """Printed fragments ``(doc_id, page, y, x, body)`` to one row per word."""
    words = printed.select("doc_id", "page", "y", "x", F.posexplode(F.split("body", " ")).alias("p", "text"))
    x0 = F.col("x") + F.col("p") * 45.0
    return words.where(F.col("text") != "").select(
        "doc_id", "page", (F.col("y") * 10000 + F.col("x") + F.col("p")).cast("int").alias("word_idx"), "text",
        x0.alias("x0"), F.col("y").cast("double").alias("y0"), (x0 + 40.0).alias("x1"),
        (F.col("y") + 12.0).alias("y1"),
        F.when(F.col("doc_id") % 12 == 0, 0.6).otherwise(0.95).alias("confidence"),
        F.lit(None).cast("double").alias("font_size"))


def _piece(y, x: float, body, page: int = 0):
    y = y if not isinstance(y, (int, float)) else F.lit(float(y))
    return F.struct(F.lit(page).alias("page"), y.cast("double").alias("y"), F.lit(float(x)).alias("x"),
                    body.alias("body"))


def page_words(t: Tables) -> DataFrame:
    """Every word printed on the pages of all orders. A row per customer or order is merged: the
    compressed file it is read from may pass as small enough to broadcast, whatever its rows hold."""
    key = F.col("o_orderkey")
    by_order = Window.partitionBy("l_orderkey").orderBy("l_suppkey", "l_extendedprice", "l_shipdate")
    items = t.lineitem.withColumn("n", F.row_number().over(by_order) - 1)
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    top = F.lit(320.0) + F.col("n") * 40.0
    item_parts = F.array(
        _piece(top, 10, F.concat(F.lit("Part SKU-"), F.col("l_partkey").cast("string"))),
        _piece(top, 300, F.col("l_quantity").cast("int").cast("string")),
        _piece(top, 362, money(F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100)),
        _piece(top, 482, money(F.col("l_extendedprice"))),
        _piece(top + 16.0, 10, F.when(F.col("n") % 3 == 1, F.lit("with steel handle")).otherwise("")))
    item_words = items.select(F.col("l_orderkey").alias("doc_id"), F.explode(item_parts).alias("e")).select(
        "doc_id", "e.*")

    sums = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"),
                                                F.count("*").alias("lines"))
    docs = t.orders.join(t.customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).join(
        sums.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    name = F.concat(F.lit("Acme "), F.initcap("c_mktsegment"), F.lit(" Traders"))
    first = (F.when(key % 5 == 0, F.concat(F.lit("Cash Receipt "), name))
             .when(key % 5 == 1, F.concat(F.lit("Bill From: "), name))
             .when(key % 5 == 2, F.concat(F.lit("Rs1100 "), name)).otherwise(name))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    foot = F.lit(340.0) + F.coalesce(F.col("lines"), F.lit(0)) * 40.0
    tax = (F.col("s") * F.lit("0.05").cast("decimal(3,2)")).cast("decimal(18,2)")
    grand = F.coalesce(F.col("s") + tax, F.col("o_totalprice").cast("decimal(18,2)"))
    pieces = F.array(
        _piece(20, 10, first),
        _piece(40, 10, F.when(key % 3 == 0, "Hardware Store").otherwise("Plaza 5, Main Road")),
        _piece(60, 10, F.concat(F.lit("Invoice No. INV-"), key.cast("string"))),
        _piece(60, 400, F.when(key % 4 == 0, F.concat(F.lit("Date: "), day))
               .otherwise(F.concat(F.lit("Invoice Date: "), day))),
        _piece(80, 10, F.when(key % 2 == 0, F.concat(F.lit("Due Date: "), F.date_format(
            F.col("o_orderdate") + F.make_dt_interval(F.lit(30)), "dd/MM/yyyy"))).otherwise("")),
        _piece(100, 10, F.concat(F.lit("Bill To: "), F.col("c_name"))),
        _piece(120, 10, F.when(key % 6 == 0, F.lit("")).otherwise("NTN: 1234567-8")),
        _piece(140, 10, F.lit("SHIPPING:")), _piece(140, 200, F.lit("10.00")),
        _piece(160, 10, F.lit("ORDER NUMBER")), _piece(160, 300, F.lit("PAYMENT METHOD")),
        _piece(180, 10, F.concat(F.lit("A-"), key.cast("string"))), _piece(180, 300, F.lit("Money order")),
        _piece(300, 10, F.lit("Description")), _piece(300, 300, F.lit("Qty")), _piece(300, 360, F.lit("Unit Price")),
        _piece(300, 480, F.lit("Amount")),
        _piece(foot, 360, F.lit("Sub Total")), _piece(foot, 482, F.coalesce(money(F.col("s")), F.lit(""))),
        _piece(foot + 20, 360, F.lit("Sales Tax")), _piece(foot + 20, 482, F.coalesce(money(tax), F.lit(""))),
        _piece(foot + 40, 360, F.when(key % 7 == 0, "Amount Due").when(key % 7 == 1, "Total")
               .when(key % 7 == 2, "BillTotal:").otherwise("Grand Total")), _piece(foot + 40, 482, money(grand)),
        _piece(40, 10, F.when(key % 9 == 0, "Total 99.00").otherwise(""), page=1))
    return _tokens(docs.select(key.alias("doc_id"), F.explode(pieces).alias("e")).select("doc_id", "e.*")
                   .unionByName(item_words))


def page_documents(t: Tables) -> DataFrame:
    """The documents the words belong to: full text and reading confidence."""
    return t.v_invoice_text.select("doc_id", "text", F.when(F.col("doc_id") % 12 == 0, 0.6).otherwise(0.95)
                                   .alias("confidence"), F.lit("ocr").alias("method"))

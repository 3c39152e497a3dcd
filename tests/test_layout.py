"""Layout extraction on small hand-made pages."""

from __future__ import annotations

from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import layout
from ledgerloom.operators.build import build_invoices
from ledgerloom.sources import schemas
from ledgerloom.sources.page_words import page_words
from ledgerloom.sources.tables import Tables
from tests.helpers import by_doc, documents, words

AS_OF = "2026-09-01"

TABLE = [
    (100, 50, "Description"), (100, 250, "Qty"), (100, 320, "Rate"), (100, 420, "Amount"),
    (120, 50, "Steel Sheet"), (120, 250, "12"), (120, 320, "9800"), (120, 420, "117600"),
    (140, 50, "Welding Rods"), (140, 250, "6"), (140, 320, "3200"), (140, 420, "19200"), (160, 50, "(box of 50)"),
    (180, 50, "Transport"), (180, 250, "1"), (180, 320, "8500"), (180, 420, "8500"),
    (200, 320, "Subtotal"), (200, 420, "145300"), (220, 320, "Tax"), (220, 420, "26154"),
    (240, 320, "Total"), (240, 420, "171454"),
]


def _fold(boxes: list[tuple], batch_rows: int) -> list[tuple]:
    """Fold ``(doc, page, text, x0, y0, y1)`` boxes, cut into batches, page by page."""
    rows = sorted((d, p, y0, x0, i, t, y1) for i, (d, p, t, x0, y0, y1) in enumerate(boxes))
    table = pa.table({
        "doc_id": [r[0] for r in rows], "page": pa.array([r[1] for r in rows], pa.int32()),
        "word_idx": pa.array([r[4] for r in rows], pa.int32()), "text": [r[5] for r in rows],
        "x0": [float(r[3]) for r in rows], "y0": [float(r[2]) for r in rows],
        "x1": [float(r[3]) + 6 * len(r[5]) for r in rows], "y1": [float(r[6]) for r in rows],
        "confidence": [1.0] * len(rows), "font_size": pa.array([None] * len(rows), pa.float64())})
    text = lambda ws: None if ws is None else [w["text"] for w in ws]
    return [(r["doc_id"], r["page"], r["row"], text(r["words"]), text(r["next_words"]))
            for batch in layout.fold_lines(iter(table.to_batches(max_chunksize=batch_rows))) for r in batch.to_pylist()]


BOXES = [
    ("a", 0, "Dec 14, 2020", 751, 315, 342), ("a", 0, "ORDER DATE", 544, 327, 348), ("a", 0, "TAX", 600, 985, 1016),
    ("a", 0, "$7.67", 855, 984, 1017), ("a", 1, "SKU: 24", 79, 845, 872), ("a", 1, "SUBTOTAL", 539, 889, 920),
    ("a", 1, "$93.00", 843, 888, 921), ("b", 0, "Label", 50, 100, 100), ("b", 0, "Value", 300, 102, 102),
    ("c", 0, "only", 1, 2, 14),
]


def _frame(spark, boxes: list[tuple]):
    return spark.createDataFrame(
        [(d, p, i, t, float(x0), float(y0), x0 + 6.0 * len(t), float(y1), 1.0) for i, (d, p, t, x0, y0, y1) in enumerate(boxes)],
        "doc_id STRING, page INT, word_idx INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, confidence DOUBLE")


def test_fold_rows_and_neighbours(spark):
    text = lambda ws: None if ws is None else [w["text"] for w in ws]
    lines = layout.group_lines(_frame(spark, BOXES)).orderBy("doc_id", "line_idx").collect()
    assert [(r["doc_id"], r["line_idx"], r["page"], text(r["words"]), r["next_page"], text(r["next_words"])) for r in lines] == [
        ("a", 0, 0, ["ORDER DATE", "Dec 14, 2020"], 0, ["TAX", "$7.67"]),
        ("a", 1, 0, ["TAX", "$7.67"], 1, ["SKU: 24"]),
        ("a", 2, 1, ["SKU: 24"], 1, ["SUBTOTAL", "$93.00"]),
        ("a", 3, 1, ["SUBTOTAL", "$93.00"], None, None),
        ("b", 0, 0, ["Label", "Value"], None, None),
        ("c", 0, 0, ["only"], None, None)]


def test_fold_stays_inside_pages():
    assert [r[:3] for r in _fold(BOXES, 1000)] == [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("b", 0, 0), ("c", 0, 0)]
    assert _fold(BOXES, 1000)[1][4] is None


@pytest.mark.parametrize("batch_rows", [1, 2, 3, 5])
def test_fold_does_not_depend_on_batches(batch_rows):
    assert _fold(BOXES, batch_rows) == _fold(BOXES, 1000)


def test_words_travel_packed_and_come_back_sorted():
    """Parts come back one after the other, each sorted by place with nulls first, at a fraction of the bytes."""
    n = 6000
    rows = [(i % 40 // 2 % 2, f"d{i % 40 // 2}" if i % 40 > 1 else None, i % 3, i, f"w{i % 7}", None if i % 50 == 0 else float(-i % 600),
             float(i * 7 % 800)) for i in range(n)]
    names = ["part", "doc_id", "page", "word_idx", "text", "x0", "y0"]
    table = pa.table({k: [r[j] for r in rows] for j, k in enumerate(names)}, pa.schema([
        ("part", pa.int64()), ("doc_id", pa.string()), ("page", pa.int32()), ("word_idx", pa.int32()), ("text", pa.string()),
        ("x0", pa.float64()), ("y0", pa.float64())]))
    sent = [r for b in layout.pack_rows(iter(table.to_batches(max_chunksize=700))) for r in b.to_pylist()]
    assert [r["part"] for r in sent] == [0, 1] and sum(len(r["rows"]) for r in sent) < table.nbytes / 3
    again = [*sent, *(r for b in layout.pack_rows(iter(table.to_batches())) for r in b.to_pylist())]
    packed = pa.RecordBatch.from_pylist(sorted(again, key=lambda r: r["part"]), pa.schema([("part", pa.int64()), ("rows", pa.binary())]))
    unpack = layout.unpack_words(pa.schema([f for f in table.schema if f.name != "part"]))
    got = [tuple(r.values()) for b in unpack(iter([packed.slice(0, 1), packed.slice(1)])) for r in b.to_pylist()]
    key = lambda r: (r[0] or "", r[1], r[5], r[4] is not None, r[4] or 0.0, r[2])
    assert sorted(got, key=key) == sorted([r[1:] for r in rows] * 2, key=key)
    per_page = {}
    for r in got:
        per_page.setdefault(r[:2], []).append(key(r))
    assert all(v == sorted(v) for v in per_page.values())
    assert len([1 for a, b in zip(got, got[1:]) if a[:2] != b[:2]]) == len(per_page) - 1  # a page is in one piece


def test_a_document_of_a_million_words_is_spread_over_tasks(spark):
    """1,000 pages of 50 lines of 20 words: no task gets more than a few hundredths of them."""
    words_ = spark.range(1_000_000).select(
        F.lit("long").alias("doc_id"), (F.col("id") / 1000).cast("int").alias("page"), (F.col("id") % 1000).cast("int").alias("word_idx"),
        F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), ((F.col("id") % 20) * 45.0).alias("x0"),
        (F.floor(F.col("id") % 1000 / 20) * 20.0).alias("y0"), ((F.col("id") % 20) * 45.0 + 40).alias("x1"),
        (F.floor(F.col("id") % 1000 / 20) * 20.0 + 12).alias("y1"), F.lit(0.9).alias("confidence"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = layout.group_lines(words_)
        per_file = [r["n"] for r in lines.sparkSession.read.parquet(*sorted({f.rpartition("/")[0] for f in lines.inputFiles() if "/lines-" in f}))
                    .groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert sum(per_file) == 50_000 and max(per_file) < 0.05 * 50_000
        region = layout.with_table_region(lines)
        tasks = region.select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
        assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 0.3 * 50_000  # small files share a task
        numbered = lines.agg(F.min("line_idx"), F.max("line_idx"), F.count_distinct("line_idx"), F.count("next_words")).first()
        assert tuple(numbered) == (0, 49_999, 50_000, 49_999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_table_region_and_items(spark):
    pages = {"t": TABLE}
    region = by_doc(layout.with_table_region(layout.group_lines(words(spark, pages))).where("line_idx = 0"))["t"]
    assert (region["header_row"], region["boundary"]) == (0, 5)
    assert [b["field"] for b in region["bands"]] == ["description", "qty", "rate", "amount"]
    items = layout.item_rows(words(spark, pages)).orderBy("position").collect()
    assert [(i["description"], i["qty"], i["rate"], i["amount"], i["arithmetic_check"]) for i in items] == [
        ("Steel Sheet", 12.0, 9800.0, 117600.0, "pass"), ("Welding Rods (box of 50)", 6.0, 3200.0, 19200.0, "pass"),
        ("Transport", 1.0, 8500.0, 8500.0, "pass")]


@pytest.mark.parametrize("header,fields", [
    ([(50, "Qty."), (250, "Particulars"), (420, "Rate"), (500, "Amount(Rs)")], ["qty", "description", "rate", "amount"]),
    ([(50, "ITEMS"), (250, "QTY"), (400, "SUBTOTAL")], ["description", "qty", "amount"]),
    ([(50, "Item"), (250, "Hours"), (320, "Hourly rate"), (480, "Line Total")], ["description", "qty", "rate", "amount"]),
])
def test_header_spellings(spark, header, fields):
    pages = {"h": [(100, x, t) for x, t in header] + [(120, 50, "thing")]}
    row = by_doc(layout.with_table_region(layout.group_lines(words(spark, pages))).where("line_idx = 0"))["h"]
    assert [b["field"] for b in row["bands"]] == fields


def test_items_belong_to_the_nearest_numbered_row(spark):
    pages = {"n": [(100, 50, "Item"), (100, 250, "Qty"), (100, 420, "Amount"),
                   (118, 50, "Blue Bag"), (132, 250, "2"), (132, 420, "50.00"), (146, 50, "SKU: A"),
                   (176, 50, "Red Bag"), (190, 250, "1"), (190, 420, "30.00"), (204, 50, "SKU: B")]}
    items = layout.item_rows(words(spark, pages)).orderBy("position").collect()
    assert [(i["description"], i["qty"], i["amount"]) for i in items] == [
        ("Blue Bag SKU: A", 2.0, 50.0), ("Red Bag SKU: B", 1.0, 30.0)]


def test_totals_word_inside_a_description_does_not_end_the_table(spark):
    pages = {"p": [(100, 50, "Particulars"), (100, 420, "Amount"), (120, 50, "Total Booking Amount"),
                   (120, 420, "4,000"), (140, 50, "Advance Paid"), (140, 420, "-1,000"), (160, 420, "Total 3,000")]}
    items = layout.item_rows(words(spark, pages)).orderBy("position").collect()
    assert [(i["description"], i["amount"]) for i in items] == [("Total Booking Amount", 4000.0),
                                                               ("Advance Paid", -1000.0)]


def _chosen(spark, pages: dict, field: str, confidence: float = 1.0) -> dict:
    return by_doc(layout.choose(layout.line_candidates(words(spark, pages, confidence)), field))


def test_total_choice(spark):
    pages = {
        "grand": [(50, 50, "Sub Total: 900.00"), (90, 50, "Grand Total: 1000.00")],
        "tax": [(50, 50, "Total Tax: 50.00"), (90, 50, "Grand Total: 1000.00")],
        "inc": [(50, 50, "Amount Inc. Sales Tax 270.00")],
        "only": [(50, 50, "Sub Total: 900.00")],
        "right": [(50, 50, "Total"), (50, 500, "77.00")],
        "below": [(50, 50, "Total Due"), (70, 52, "88.00")],
        "tie": [(50, 50, "Total: 3"), (70, 50, "Total: 4")],
        "none": [(50, 50, "nothing here")],
    }
    got = _chosen(spark, pages, "total")
    assert {d: float(r["value"]) for d, r in got.items()} == {
        "grand": 1000.0, "tax": 1000.0, "inc": 270.0, "only": 900.0, "right": 77.0, "below": 88.0, "tie": 3.0}
    assert (got["tie"]["status"], got["grand"]["status"]) == ("review", "accept")


def test_date_choice(spark):
    pages = {
        "due": [(50, 50, "Due Date: 01/09/2026"), (90, 50, "Invoice Date: 15/08/2026")],
        "bare": [(50, 50, "Date: 16/08/2026"), (90, 50, "17/08/2026")],
        "glued": [(50, 50, "Date:29/06/2026.16:29:41")],
        "ambiguous": [(50, 50, "06/02/2026"), (90, 50, "25/02/2026")],
        "below": [(50, 300, "Date"), (70, 302, "18 Aug 2026")],
        "cut": [(50, 50, "Date: 19/08/2026 Currency PKR")],
    }
    fields = by_doc(layout.document_fields(layout.line_candidates(words(spark, pages))))
    assert {d: r["date"]["value"] for d, r in fields.items()} == {
        "due": date(2026, 8, 15), "bare": date(2026, 8, 16), "glued": date(2026, 6, 29),
        "ambiguous": date(2026, 2, 25), "below": date(2026, 8, 18), "cut": date(2026, 8, 19)}
    assert fields["ambiguous"]["date"]["doubtful"] is False


def test_vendor_choice(spark):
    foot = (400, 50, "end")
    pages = {
        "label": [(20, 50, "INVOICE"), (40, 50, "Sold By: Acme Corp"), foot],
        "first": [(20, 50, "Cash Receipt"), (40, 50, "Express Mart Date:"), foot],
        "stamp": [(20, 50, "Rs1100 Noor Electric"), (36, 50, "Hardware Store"), foot],
        "address": [(20, 50, "Blue Sky Foods"), (36, 50, "Hotel view square, Bahria"), foot],
        "title": [(20, 50, "Tax Invoice Zed Traders NTN# 123"), foot],
        "late": [(20, 50, "16 Jun 2026"), (40, 50, "Moon Bakers"), foot],
    }
    got = by_doc(layout.document_fields(layout.line_candidates(words(spark, pages))))
    assert {d: r["vendor"]["value"] for d, r in got.items()} == {
        "label": "Acme Corp", "first": "Express Mart", "stamp": "Noor Electric Hardware Store",
        "address": "Blue Sky Foods", "title": "Zed Traders", "late": "Moon Bakers"}
    weak = by_doc(layout.document_fields(layout.line_candidates(words(spark, {"w": [(20, 50, "BiQ x"), foot]}, 0.5))))
    assert weak["w"]["vendor"]["doubtful"] is True


def test_known_vendor_breaks_a_tie(spark):
    pages = {"k": [(20, 50, "Some Heading"), (40, 50, "Moon Bakers"), (400, 50, "end")]}
    w = words(spark, pages)
    known = spark.createDataFrame([("k", 1)], "doc_id STRING, line_idx INT")
    got = by_doc(layout.document_fields(layout.line_candidates(w, known)))
    assert got["k"]["vendor"]["value"] == "Moon Bakers"


def test_discovered_fields(spark):
    pages = {"d": [(20, 50, "SHIPPING & HANDLING"), (20, 300, "$10.00"), (40, 50, "NAME"), (40, 300, "PAYMENT METHOD"),
                   (60, 50, "Veronica Costello"), (60, 302, "Money order"), (80, 50, "Phone:"), (80, 200, "555"),
                   (100, 50, "PHONE"), (100, 200, "777")]}
    got = {(r["key"], r["value"]) for r in layout.discovered_fields(words(spark, pages)).collect()}
    assert got == {("shipping_handling", "$10.00"), ("payment_method", "Money order"), ("phone", "555")}


def test_extract_and_route(spark):
    pages = {
        "receipt": [(50, 50, "Express Mart"), (90, 50, "receipt"), (200, 50, "Total"), (200, 200, "270.00")],
        "invoice": [(50, 50, "Acme Corp"), (90, 50, "invoice"), (200, 50, "Total"), (200, 200, "270.00")],
        "memo": [(50, 50, "Minute Sheet"), (90, 50, "For approval of Rs. 22,875/- only"), (200, 50, "Total 5.00")],
        "quote": [(50, 50, "Acme Corp"), (90, 50, "quotation"), (200, 50, "Total 270.00")],
        "table": [(20, 50, "Acme Steel Works"), (40, 50, "bill no B-77"), (60, 50, "Date: 15/08/2026")] + TABLE,
    }
    got = by_doc(layout.extract_fields(documents(spark, pages), words(spark, pages), AS_OF))
    assert got["receipt"]["review_status"] == "auto_processed"
    assert got["invoice"]["review_status"] == "needs_review_high_priority"
    assert got["invoice"]["review_flags"] == ["invoice_number_required_but_missing"]
    memo = got["memo"]
    assert (memo["document_type"], memo["total"], memo["vendor_name"], memo["amount_mentioned"]) == (
        "minute_sheet", None, None, 22875.0)
    assert memo["review_status"] == "needs_review" and memo["review_flags"] == ["non_transactional_document"]
    assert (got["quote"]["total"], got["quote"]["transactional"]) == (270.0, False)
    table = got["table"]
    assert (table["vendor_name"], table["invoice_number"], table["invoice_date"]) == (
        "Acme Steel Works", "B-77", date(2026, 8, 15))
    assert (table["subtotal"], table["tax_amount"], table["total"], table["tax_rate"]) == (145300.0, 26154.0,
                                                                                         171454.0, 0.18)
    assert (table["totals_pass"], table["pass_rate"], table["review_status"]) == (True, 1.0, "auto_processed")


def test_known_vendors_rename_and_lose_the_method_tier(spark):
    pages = {"r": [(50, 50, "Expres Mart"), (90, 50, "receipt"), (200, 50, "Total 270.00")],
             "s": [(50, 50, "Unheard Of"), (90, 50, "receipt"), (200, 50, "Total 270.00")]}
    docs = documents(spark, pages).withColumn("company_id", F.lit(1))
    known = spark.createDataFrame([(1, "Express Mart"), (2, "Unheard Of")], "company_id INT, vendor_name STRING")
    got = by_doc(layout.extract_with_known_vendors(docs, words(spark, pages), known, AS_OF))
    assert (got["r"]["vendor_name"], got["r"]["vendor_method"]) == ("Express Mart", "positional_fallback+vendor_match")
    assert got["r"]["vendor_confidence"] == pytest.approx(1.0)
    # The renamed method has no tier of its own, so the document scores lower.
    assert got["r"]["document_confidence"] < got["s"]["document_confidence"]
    assert (got["s"]["vendor_name"], got["s"]["vendor_method"]) == ("Unheard Of", "positional_fallback")


def test_extraction_folds_once_and_joins_narrow_rows(spark, capsys):
    region = layout.with_table_region(layout.group_lines(words(spark, {"t": TABLE})))
    fields = layout.assemble_documents(documents(spark, {"t": TABLE}), layout.document_fields(layout.candidates_of(region)), AS_OF)
    fields.join(layout.items_of(region), "doc_id").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "CartesianProduct" not in plan  # lines are read from their table


def test_fields_spread_over_pages(spark):
    """Facts and rival candidates of later pages reach the document's row."""
    pages = {"m": [(20, 50, "Acme Corp"), (50, 50, "Invoice Date: 15/08/2026"), (90, 50, "Total: 3.00")]}
    first = words(spark, pages)
    second = first.withColumn("page", F.lit(1)).withColumn("text", F.when(F.col("text") == "3.00", "4.00").otherwise(F.col("text")))
    row = by_doc(layout.document_fields(layout.line_candidates(first.unionByName(second))))["m"]
    assert (row["line_count"], row["total"]["value"], row["total"]["doubtful"]) == (6, 3.0, True)
    assert row["vendor"]["value"] == "Acme Corp" and row["date"]["value"] == date(2026, 8, 15)


def test_pages_are_not_broadcast_and_lines_are_not_shuffled_again(spark):
    """What a line learns of its document comes by page: a row per page must not go through the
    driver, and the wide lines stay where they were folded."""
    pages = {f"d{i}": TABLE for i in range(20)}
    known = spark.createDataFrame([("d1", 0, 1)], "doc_id STRING, page INT, line_idx INT")
    lines = layout.line_candidates(words(spark, pages), known)
    assert [r["doc_id"] for r in lines.where("known").collect()] == ["d1"]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("SortMergeJoin")  # the pages' side of each join


def test_pages_are_rendered_without_a_broadcast(spark, tmp_path):
    """A customer's or an order's row stays off the driver, however small the file it is read from."""
    rows = {"customer": [(1, "Ann", 0, 0.0, "BUILDING"), (2, "Bob", 0, 0.0, "MACHINERY")],
            "orders": [(7, 1, "O", 30.0, datetime(2026, 8, 15), "1"), (8, 2, "O", 9.0, datetime(2026, 8, 16), "1"),
                       (9, None, "O", 9.0, datetime(2026, 8, 16), "1")],
            "lineitem": [(7, 5, 1, 1, 2.0, 30.0, 0.0, 0.0, "N", "O", datetime(2026, 8, 17))]}
    for name, values in rows.items():
        spark.createDataFrame(values, schemas.RAW[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = page_words(Tables(spark, str(tmp_path)))
    bodies = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert {(7, "Ann"), (7, "SKU-5"), (7, "31.50"), (8, "Bob"), (8, "9.00")} <= bodies and not {d for d, _ in bodies} - {7, 8}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2


def test_invoices_are_built_without_a_broadcast(spark):
    """Documents, file names and item texts have a row per document each: all are merged."""
    pages = {"t": TABLE, "u": [(50, 50, "Express Mart"), (90, 50, "receipt"), (200, 50, "Total 270.00")]}
    region = layout.with_table_region(layout.group_lines(words(spark, pages)))
    fields = layout.assemble_documents(documents(spark, pages), layout.document_fields(layout.candidates_of(region)), AS_OF)
    files = spark.sql("SELECT * FROM VALUES ('t', 't.pdf'), ('u', 'u.pdf') AS f(doc_id, filename)")
    built = build_invoices(fields, layout.items_of(region), files).select("filename", "total")
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert {tuple(r) for r in built.collect()} == {("t.pdf", 171454.0), ("u.pdf", 270.0)}


def _stored_plans(monkeypatch, build) -> dict[str, str]:
    """The plans of what ``build`` stores, by name."""
    plans, store = {}, layout.stored
    monkeypatch.setattr(layout, "stored", lambda df, name: (
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), store(df, name))[1])
    build()
    return plans


def test_vendor_names_are_read_once(spark, monkeypatch):
    """Candidates are worked out for the names once; the matching reads them from their table."""
    pages = {"r": [(50, 50, "Expres Mart"), (90, 50, "receipt"), (200, 50, "Total 270.00")]}
    docs = documents(spark, pages).withColumn("company_id", F.lit(1))
    known = spark.createDataFrame([(1, "Express Mart")], "company_id INT, vendor_name STRING")
    plans = _stored_plans(monkeypatch, lambda: layout.extract_with_known_vendors(docs, words(spark, pages), known, AS_OF))
    assert {"named", "fields"} <= set(plans)
    assert plans["named"].count("/lines-") + plans["named"].count(".lines_") >= 1
    reads = [p for p in plans["fields"].split("\n") if "FileScan" in p and ".lines_" in p]
    assert len(reads) == 1


def test_a_line_is_judged_once(spark):
    """A filter on what was found must not have it found again below a join."""
    pages = {"d": [(20, 50, "Acme Corp"), (60, 50, "Date: 15/08/2026"), (80, 50, "Phone:"), (80, 200, "555")] + TABLE}
    candidates = layout.line_candidates(words(spark, pages))
    text_ = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    shape = layout.text.DATE_SUBSTRING_PATTERNS[0]
    once, chosen = (text_(df).count(shape) for df in (candidates.select("doc_id", "c_date"), layout.choose(candidates, "date")))
    assert once and once == chosen
    region = layout.with_table_region(layout.group_lines(words(spark, pages)))
    pattern = "^[^\\d]*[A-Za-z][^\\d]*$"
    assert text_(region.select("cells")).count(pattern) == text_(layout.items_of(region)).count(pattern) > 0


def test_bands_and_amounts_of_a_document_are_not_worked_out_on_every_line(spark, monkeypatch):
    plans = _stored_plans(monkeypatch, lambda: layout.with_label_values(layout.with_table_region(
        layout.group_lines(words(spark, {"t": TABLE})))))
    assert "array_distinct" in plans["headers"] and "array_distinct" not in plans["boundaries"] + plans["labels"]


def test_labels_and_cells_that_only_look_alike(spark):
    """A label inside a longer word, one cell with a colon, and values only below the last cell."""
    pages = {"x": [(20, 50, "Subtotals 5.00"), (40, 50, "Phone:"), (60, 50, "555"), (80, 50, "NAME"), (80, 300, "CODE:"),
                   (100, 50, "abc"), (100, 302, "77"), (120, 50, "Sub Total: 9.00")]}
    lines = layout.with_label_values(layout.with_table_region(layout.group_lines(words(spark, pages)))).orderBy("line_idx").collect()
    assert [None if r["v_subtotal"] is None else r["v_subtotal"]["text"] for r in lines] == [None] * 5 + ["9.00"]
    assert [[(e["key"], e["value"], e["below"]) for e in r["discovered"]] for r in lines] == [
        [], [], [], [("code", "77", True)], [], []]

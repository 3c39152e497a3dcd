"""Positioned words to document fields.

    words --pack--> shuffle(doc, page) --unpack, sort--> line fold --> stored lines
    lines --aggregate(doc, page)--> facts per page --> facts of the document, again a
    narrow row per page --join(doc, page)--> lines

The fold and the packing before it are the only Python. A word's row is mostly numbers its
neighbours repeat, so slices of words travel as compressed columns, by group of pages. The
words of a page arrive sorted at the fold, which keeps one open line.
Pages are folded by themselves, so a document of many pages is spread over tasks; lines
are numbered through the document by adding up the pages before. What a line must know
of its document (header row, table end, amounts found elsewhere) is aggregated inside
pages first and combined over one narrow row per page, and comes back to the lines by
(document, page). Those small tables are stored, so each step's plan stays short and a
lost executor repeats one step at most; wide lines never meet in one task. Lines are
stored in buckets of (document, page) and are not shuffled for any of it; the pages'
rows are, and never broadcast: there is one for every page, however small its file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.functions import checks, text
from ledgerloom.functions import layout_rules as rules
from ledgerloom.functions.core import let, once, present
from ledgerloom.operators.aggregates import COMPANY
from ledgerloom.operators.matching import known_vendor_resolution
from ledgerloom.operators.skew import splittable_join
from ledgerloom.operators.trends import select_candidate
from ledgerloom.packed import PACKED, PART, pack_rows, unpacked
from ledgerloom.session import shuffle_partitions, stored, stored_by

# Share of overlap and distance in points that make one row.
MIN_OVERLAP, FLAT_TOLERANCE = 0.6, 4.0
WORD_FIELDS = ("text", "x0", "y0", "x1", "y1", "confidence", "font_size")
_WORD_TYPE = T.StructType([T.StructField("text", T.StringType())]
                          + [T.StructField(n, T.DoubleType()) for n in WORD_FIELDS[1:]])
_ARROW_WORD = pa.struct([("text", pa.string())] + [(n, pa.float64()) for n in WORD_FIELDS[1:]])

# ------------------------------------------------------------------------- lines


def same_row(band: tuple[float, float], y0: float, y1: float) -> bool:
    """Whether a box belongs to the row whose running band is given."""
    top, bottom = band
    if bottom <= top or y1 <= y0:
        return abs(y0 - top) <= FLAT_TOLERANCE
    overlap = min(bottom, y1) - max(top, y0)
    return overlap > 0 and overlap / min(bottom - top, y1 - y0) >= MIN_OVERLAP and top <= (y0 + y1) / 2 <= bottom


def _line_starts(new_page: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> list[int]:
    # A word as high as the one before it is on that one's line and leaves the band as it is.
    alike = np.concatenate([[False], (y0[1:] == y0[:-1]) & (y1[1:] == y1[:-1])]) & ~new_page
    at = np.flatnonzero(~alike)
    starts, band = [], (0.0, 0.0)
    for i, fresh, top, bottom in zip(at.tolist(), new_page[at].tolist(), y0[at].tolist(), y1[at].tolist()):
        if not fresh and same_row(band, top, bottom):
            band = (min(band[0], top), max(band[1], bottom))
        else:
            starts.append(i)
            band = (top, bottom)
    return starts


def _changes(column: pa.Array) -> np.ndarray:
    codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _fold(batch: pa.RecordBatch, first_row: int, last: bool):
    """Lines of the sorted rows, except that the final two wait for more rows:
    the last may still grow and the one before needs it as its next line."""
    new_page = _changes(batch.column("doc_id")) | _changes(batch.column("page"))
    starts = np.array(_line_starts(new_page, batch.column("y0").to_numpy(), batch.column("y1").to_numpy()))
    total, emitted = len(starts), len(starts) if last else max(0, len(starts) - 2)
    opens = new_page[starts]  # lines that open a page
    opens[0] = first_row == 0
    index = np.arange(total)
    row = index - np.maximum.accumulate(np.where(opens, index, -first_row))
    line_of = np.cumsum(np.bincount(starts, minlength=batch.num_rows)) - 1
    order = np.lexsort((batch.column("x0").to_numpy(), line_of))
    words = pa.StructArray.from_arrays([batch.column(n).take(pa.array(order)) for n in WORD_FIELDS],
                                       fields=list(_ARROW_WORD))
    bounds = np.concatenate([starts, [batch.num_rows]]).astype(np.int32)
    follows = np.concatenate([~opens[1:], [False]])[:emitted]
    next_bounds = bounds[np.minimum(np.arange(1, emitted + 2), total)]
    head = pa.array(starts[:emitted])
    lines = pa.RecordBatch.from_arrays([
        batch.column("doc_id").take(head), batch.column("page").take(head).cast(pa.int32()), pa.array(row[:emitted].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(bounds[:emitted + 1]), words),
        pa.ListArray.from_arrays(pa.array(next_bounds), words, mask=pa.array(~follows))],
        names=["doc_id", "page", "row", "words", "next_words"])
    if last:
        return lines, None, 0
    return lines, batch.slice(int(starts[emitted]) if total else 0), int(row[emitted]) if total else 0


def fold_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words sorted by document, page and place to the lines of each page."""
    waiting, row = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        lines, waiting, row = _fold(rows, row, last=False)
        if lines.num_rows:
            yield lines
    if waiting is not None and waiting.num_rows:
        yield _fold(waiting, row, last=True)[0]


PAGE = ["doc_id", "page"]
#: Groups of pages per partition (one is sorted at a time), words folded at a time.
GROUPS, FOLD_ROWS = 8, 20_000


def _sort_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Keys for ``np.lexsort``, least significant first: nulls stand before values, as Spark has them."""
    if not column.null_count:
        return [column.to_numpy()]
    return [column.fill_null(0).to_numpy(), column.is_valid().to_numpy()]


def unpack_words(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows in the order of their parts to the words of one part after the other, each
    sorted by document, page and place. A page is whole in its part."""
    def sorted_words(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([unpacked(h, schema) for h in held]).combine_chunks()
        document = rows.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        keys = [k for c in ("word_idx", "x0", "y0", "page") for k in _sort_keys(rows.column(c))]
        order = np.lexsort([*keys, document])
        for start in range(0, len(order), FOLD_ROWS):
            yield from rows.take(pa.array(order[start:start + FOLD_ROWS])).combine_chunks().to_batches()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            for part, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and part != current:
                    yield from sorted_words(held)
                    held = []
                current = part
                held.append(words)
        if held:
            yield from sorted_words(held)

    return unpack


def by_page(lines: DataFrame, pages: DataFrame, how: str = "inner") -> DataFrame:
    """Lines with what ``pages`` knows of their page. A row per page is as many rows as there
    are pages: merged, for its compressed file may pass as small enough to broadcast."""
    return lines.join(pages.hint("merge"), PAGE, how)


def group_lines(words: DataFrame) -> DataFrame:
    """Words to printed lines: ``doc_id, page, line_idx, words, next_page, next_words``,
    numbered through the document, words left to right. Lines and one row per page
    (lines before it, first line of the next page) are stored."""
    columns = [*PAGE, "word_idx", *WORD_FIELDS]
    for optional in {"font_size"} - set(words.columns):
        words = words.withColumn(optional, F.lit(None).cast("double"))
    words = words.select(*columns).withColumn("page", F.col("page").cast("int"))
    # The partition is the bucket the lines are written to; groups cut it into what one sort holds.
    partitions = shuffle_partitions(words.sparkSession)
    part = F.pmod(F.hash(*PAGE), F.lit(partitions)).cast("long") * GROUPS + F.pmod(F.xxhash64(*PAGE), F.lit(GROUPS))
    packed = words.withColumn(PART, part).mapInArrow(pack_rows, PACKED)
    ordered = packed.repartitionById(partitions, F.floor(F.col(PART) / GROUPS).cast("int")).sortWithinPartitions(PART)
    unpack = unpack_words(to_arrow_schema(words.schema))
    schema = T.StructType([T.StructField("doc_id", words.schema["doc_id"].dataType), T.StructField("page", T.IntegerType()),
                           T.StructField("row", T.IntegerType()), T.StructField("words", T.ArrayType(_WORD_TYPE)),
                           T.StructField("next_words", T.ArrayType(_WORD_TYPE))])
    lines = stored_by(ordered.mapInArrow(lambda batches: fold_lines(unpack(batches)), schema), "lines", PAGE)
    pages = lines.groupBy(*PAGE).agg((F.max("row") + 1).alias("n"), F.max(F.when(F.col("row") == 0, F.col("words"))).alias("first"))
    after = Window.partitionBy("doc_id").orderBy("page")
    numbered = stored(pages.select(
        *PAGE, F.coalesce(F.sum("n").over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("base"),
        F.lead("page").over(after).alias("page_after"), F.lead("first").over(after).alias("first_after")), "pages")
    inside = F.col("next_words").isNotNull()
    return by_page(lines, numbered).select(
        *PAGE, (F.col("base") + F.col("row")).alias("line_idx"), "words",
        F.when(inside, F.col("page")).otherwise(F.col("page_after")).alias("next_page"),
        F.when(inside, F.col("next_words")).otherwise(F.col("first_after")).alias("next_words"))


# ----------------------------------------------------------------- document facts


def with_facts(lines: DataFrame, name: str, derive: Callable[[DataFrame], DataFrame] = lambda pages: pages, **facts: tuple) -> DataFrame:
    """Lines with facts of their whole document. A fact is ``(aggregate, combine)``: what a
    page contributes and how the pages' values become the document's. What follows from them
    alone is worked out by ``derive``, once for a page and not on each of its lines."""
    pages = lines.groupBy(*PAGE).agg(*[value.alias(k) for k, (value, _) in facts.items()])
    document = Window.partitionBy("doc_id")
    combined = pages.select(*PAGE, *[combine(k).over(document).alias(k) for k, (_, combine) in facts.items()])
    return by_page(lines, stored(derive(combined), name))


def with_table_region(lines: DataFrame) -> DataFrame:
    """Line basics plus where the item table is: header row, column bands and the
    first totals row after it."""
    out = lines.withColumns({"key": rules.key_string(F.col("words")), "text": rules.line_text(F.col("words"))})
    header = F.when(rules.is_item_header(F.col("text")), F.struct("line_idx", rules.header_matches(F.col("words")).alias("header_matches")))
    side = lambda name: F.array_max(F.transform("words", lambda w: w[name]))
    def header_facts(pages: DataFrame) -> DataFrame:
        return pages.withColumns({"header_row": F.col("header.line_idx"), "bands": rules.column_bands(
            F.col("header.header_matches"), F.col("right_edge"))}).drop("header", "right_edge")

    out = with_facts(out, "headers", header_facts, header=(F.min(header), F.min), right_edge=(F.max(side("x1")), F.max),
                     line_count=(F.max("line_idx") + 1, F.max), page0_bottom=(F.max(F.when(F.col("page") == 0, side("y1"))), F.max))
    after = F.col("line_idx") > F.col("header_row")
    totals = F.when(after, F.when(rules.names_totals(F.col("words"), F.col("bands")), F.col("line_idx")))
    out = with_facts(out, "boundaries", totals_row=(F.min(totals), F.min))
    out = out.withColumn("boundary", F.coalesce("totals_row", "line_count"))
    inside = F.coalesce((F.col("line_idx") >= F.col("header_row")) & (F.col("line_idx") < F.col("boundary")),
                        F.lit(False))
    return out.withColumns({
        "is_header_row": F.coalesce(F.col("line_idx") == F.col("header_row"), F.lit(False)), "in_body": inside,
        "cells": F.when(inside & (F.col("line_idx") > F.col("header_row")) & (F.size("bands") > 0),
                        rules.item_cells(F.col("words"), F.col("bands")))}
    ).drop("totals_row")


def _has_numeric() -> Column:
    return (F.col("cells.qty") != "") | (F.col("cells.rate") != "") | (F.col("cells.amount") != "")


FOUND_LABELS = ("vendor_label", "customer_label", "invoice_number", "ntn", "subtotal", "tax", "discount")
MONEY_LABELS = ("subtotal", "tax", "discount")


def with_label_values(lines: DataFrame) -> DataFrame:
    """Label-anchored values per line and, from the first line that yields one, per document."""
    out = lines.withColumn("labelled", rules.label_values(FOUND_LABELS))
    out = out.withColumns({f"v_{f}": F.get("labelled", F.lit(i)) for i, f in enumerate(FOUND_LABELS)}).drop("labelled")
    numbers = {f: F.when(present(f"cells.{f}").isNotNull(), text.parse_money(f"cells.{f}"))
               for f in ("qty", "rate", "amount")}
    out = out.withColumns({"item_amount": numbers["amount"], "item_check": F.when(_has_numeric(), checks.line_item_check(
        numbers["qty"], numbers["rate"], numbers["amount"]))})
    checked = F.when(F.col("item_check") == "pass", 1.0).when(F.col("item_check") == "fail", 0.0)
    next_outside = ~((F.col("line_idx") + 1 >= F.coalesce("header_row", "line_count"))
                     & (F.col("line_idx") + 1 < F.col("boundary")) & F.col("header_row").isNotNull())
    found = F.when(~F.col("in_body"), rules.discovered(F.col("words"), F.col("next_words"), next_outside))
    out = out.withColumn("discovered", found)
    out = out.withColumn("total_like", F.transform(
        F.filter("discovered", lambda e: rules.is_total_key(e["key"])),
        lambda e: F.struct(F.col("line_idx").alias("line_idx"), e["cell_idx"].alias("cell_idx"), e["key"].alias("key"),
                           e["value"].alias("value"), F.when(e["below"], F.col("next_page")).otherwise(F.col("page"))
                           .alias("page"), e["box"].alias("box"))))
    keys = F.transform("total_like", lambda e: e["key"])
    specific = F.filter("words", lambda w: (w["confidence"] >= rules.TRUSTED_CONFIDENCE)
                        & text.looks_like_amount(w["text"]) & text.parse_money(w["text"]).isNotNull())
    out = out.withColumns({"total_keys_min": F.array_min(keys), "total_keys_max": F.array_max(keys),
                           "specific": specific})

    def first_value(field: str) -> tuple:
        value = F.col(f"v_{field}")
        keep = value.isNotNull() & ~F.col("is_header_row") if field in MONEY_LABELS else value.isNotNull()
        return F.min(F.when(keep, F.struct("line_idx", value.alias("v")))), F.min

    def label_facts(pages: DataFrame) -> DataFrame:
        known = pages.withColumns({
            **{f"d_{f}": F.col(f"f_{f}.v") for f in FOUND_LABELS}, "pass_rate": F.col("passed") / F.nullif("checked", F.lit(0)),
            "one_total_key": F.col("least_total_key") == F.col("last_total_key")})
        known = known.withColumns({f"n_{f}": text.parse_money(F.col(f"d_{f}.text")) for f in MONEY_LABELS})
        return known.withColumn("reference", checks.reference_amount("n_subtotal", "n_tax", "n_discount", "items_sum")).drop(
            *[f"f_{f}" for f in FOUND_LABELS], "passed", "checked", "least_total_key", "last_total_key")

    return with_facts(
        out, "labels", label_facts, **{f"f_{f}": first_value(f) for f in FOUND_LABELS},
        items_sum=(F.sum("item_amount"), F.sum), passed=(F.sum(checked), F.sum), checked=(F.count(checked), F.sum),
        item_count=(F.count("item_check"), F.sum), described=(F.max(F.col("cells.description") != ""), F.max),
        first_total_like=(F.min(F.array_min("total_like")), F.min), least_total_key=(F.min("total_keys_min"), F.min),
        last_total_key=(F.max("total_keys_max"), F.max), specific_count=(F.sum(F.size("specific")), F.sum),
        specific_first=(F.min(F.when(F.size("specific") > 0, F.struct(
            "line_idx", "page", F.get("specific", F.lit(0)).alias("w")))), F.min))


def with_candidates(lines: DataFrame) -> DataFrame:
    """Each line's own candidate for vendor, date and total, scored."""
    index, words, key = F.col("line_idx"), F.col("words"), F.col("key")
    order = index * -rules.ORDER_STEP
    none = F.lit(None)

    near_top = ((F.col("page") == 0) & (F.get("words", F.lit(0))["y0"] <= F.col("page0_bottom") * 0.25)
                & (F.trim("text") != ""))
    vendor = F.when(near_top, let(rules.vendor_text(words), lambda name: F.when(name != "", F.struct(
        rules.vendor_score(index, words, name, F.col("known")).alias("s"), name.alias("name")))))

    has_date = lambda t: text.find_date_in_text(t).isNotNull()
    labelled = rules.label_value("invoice_date", has_date)
    confidence = rules.line_confidence(words)
    tier = F.when(confidence >= rules.TRUSTED_CONFIDENCE, rules.FLOOR_SCORE).otherwise(confidence * rules.FLOOR_SCORE)
    positional = F.when(has_date(F.trim("text")), F.struct(
        F.trim("text").alias("text"), F.col("page").alias("page"), rules.line_box(words).alias("box"),
        none.cast("string").alias("variant")))
    other_date = F.when(rules.has_phrase(key, rules.OTHER_DATE_LABELS), rules.REJECTED).otherwise(0.0)

    def date_candidate(v: Column) -> Column:
        base = (F.when(v["variant"].isNull(), tier).when(v["variant"] == "date", rules.DATE_BARE_LABEL_SCORE)
                .otherwise(rules.DATE_LABEL_SCORE))
        ambiguous = text.day_month_ambiguous(v["text"])
        return F.when(v.isNotNull(), F.struct(
            (base + order + other_date + F.when(ambiguous, rules.DATE_AMBIGUOUS_PENALTY).otherwise(0.0))
            .alias("score"), (-index).alias("order"), v["text"].alias("text"), v["page"].alias("page"),
            v["box"].alias("box"),
            F.when(v["variant"].isNull(), "positional_fallback").otherwise("label_anchor+pattern").alias("method"),
            ambiguous.alias("ambiguous"), (v["variant"].isNotNull() | (base >= rules.FLOOR_SCORE)).alias("trusted")))

    has_amount = lambda t: text.parse_money(t).isNotNull()

    def total_candidate(v: Column) -> Column:
        amount = text.parse_money(v["text"])
        base = (F.when(v["variant"].isin(*rules.CONTEXTUAL_TOTAL_LABELS), rules.TOTAL_CONTEXTUAL)
                .when(v["variant"] == "total", rules.TOTAL_BARE).otherwise(rules.TOTAL_STRONG))
        other = F.when((v["variant"] == "total") & rules.has_phrase(key, rules.NON_TOTAL_LABELS), rules.REJECTED)
        body = F.when(F.col("in_body"), rules.REJECTED)
        fits = reconciles(amount, F.col("reference"))
        return F.when(v.isNotNull(), F.struct(
            (base + order + F.coalesce(other, F.lit(0.0)) + F.coalesce(body, F.lit(0.0))
             + F.when(fits, rules.TOTAL_RECONCILES).otherwise(0.0)).alias("score"),
            (-index).alias("order"), amount.alias("amount"), v["page"].alias("page"), v["box"].alias("box"),
            F.lit("label_anchor+pattern").alias("method"), ((base >= rules.TOTAL_BARE) | fits).alias("trusted")))

    return lines.withColumns({
        "c_vendor": let(vendor, lambda v: F.when(v.isNotNull(), F.struct(
            v["s"]["score"].alias("score"), (-index).alias("order"), v["name"].alias("name"),
            v["s"]["trusted"].alias("trusted"), words.alias("words"), F.col("next_words").alias("next_words")))),
        "c_date": let(F.coalesce(labelled, positional), date_candidate),
        "c_total": F.when(~F.col("is_header_row"), let(rules.label_value("total", has_amount), total_candidate)),
    })


def reconciles(amount: Column, reference: Column) -> Column:
    return F.coalesce(F.abs(amount - reference) <= F.greatest(F.lit(1.0), F.abs(reference) * 0.01), F.lit(False))


def line_candidates(words: DataFrame, known_lines: DataFrame | None = None) -> DataFrame:
    """Every line with its label values and candidates."""
    return candidates_of(with_table_region(group_lines(words)), known_lines)


def candidates_of(region: DataFrame, known_lines: DataFrame | None = None) -> DataFrame:
    """``line_candidates`` over lines whose table region is known already."""
    return with_candidates(with_known(with_label_values(region), known_lines))


def with_known(lines: DataFrame, known_lines: DataFrame | None) -> DataFrame:
    """Marks the lines ``(doc_id, line_idx)`` that name a known vendor. Where ``page`` is
    given too, a page's marks meet its lines, which stay where they are."""
    if known_lines is None:
        return lines.withColumn("known", F.lit(False))
    if "page" in known_lines.columns:
        pages = known_lines.groupBy(*PAGE).agg(F.collect_set("line_idx").alias("marked"))
        known = F.coalesce(F.array_contains("marked", F.col("line_idx")), F.lit(False))
        return by_page(lines, pages, "left").withColumn("known", known).drop("marked")
    marks = known_lines.select("doc_id", "line_idx", F.lit(True).alias("known"))
    return lines.join(marks, ["doc_id", "line_idx"], "left").na.fill(False, ["known"])


def vendor_lines(candidates: DataFrame) -> DataFrame:
    """Candidate vendor names near the top of each document."""
    return candidates.withColumn("c_vendor", once(F.col("c_vendor"))).where(F.col("c_vendor").isNotNull()).select(
        *PAGE, "line_idx", F.col("c_vendor.name").alias("vendor_name"))


# ------------------------------------------------------------------ field choice


def _ranked(best: Column, second: Column, extra: list[Column] | None = None) -> Column:
    """``{first, gap}`` of the best candidate and its lead over the runner-up."""
    ranked = F.sort_array(F.array_compact(F.array(best, *(extra or []))), asc=False)
    rivals = F.array_max(F.array_compact(F.array(second, F.get(ranked, F.lit(1))["score"])))
    return F.struct(F.get(ranked, F.lit(0)).alias("first"), (F.get(ranked, F.lit(0))["score"] - rivals).alias("gap"))


def _doubt(gap: Column) -> Column:
    return F.coalesce(gap < rules.AMBIGUITY_MARGIN, F.lit(False))


DOCUMENT_FACTS = ("reference", "specific_first", "specific_count", "first_total_like", "one_total_key", "line_count", "n_subtotal", "n_tax",
                  "n_discount", "items_sum", "pass_rate", "item_count", "described", *[f"d_{f}" for f in FOUND_LABELS], "header_row", "boundary",
                  "bands")


def document_fields(candidates: DataFrame) -> DataFrame:
    """One row per document with every chosen value, before confidences."""
    fields, document = ("vendor", "date", "total"), Window.partitionBy("doc_id")
    # per page the best candidate and the two best scores; then over the pages
    scores = lambda f: F.sort_array(F.collect_list(F.when(F.col(f"c_{f}").isNotNull(), F.col(f"c_{f}.score"))), asc=False)
    # what is known of the document travels with its first line only
    known = F.when(F.col("line_idx") == 0, F.struct(*DOCUMENT_FACTS))
    narrow = candidates.select(*PAGE, "line_idx", once(known).alias("known"), *[f"c_{f}" for f in fields])
    pages = narrow.groupBy(*PAGE).agg(
        F.min("line_idx").alias("first_line"), F.first("known", ignorenulls=True).alias("known"), *[F.max(f"c_{f}").alias(f"p_{f}") for f in fields],
        *[F.get(scores(f), F.lit(1)).alias(f"r_{f}") for f in fields])
    best = pages.withColumns({f"b_{f}": F.max(f"p_{f}").over(document) for f in fields})
    rival = lambda f: F.when(F.col(f"p_{f}.order") == F.col(f"b_{f}.order"), F.col(f"r_{f}")).otherwise(F.col(f"p_{f}.score"))
    out = best.withColumns({f"s_{f}": F.max(rival(f)).over(document) for f in fields}).where(F.col("first_line") == 0)
    out = out.select("*", "known.*")

    def weak_total(base: float, position: Column, amount: Column, page: Column, box: Column, exists: Column) -> Column:
        fits = reconciles(amount, F.col("reference"))
        return F.when(exists & amount.isNotNull(), F.struct(
            (F.lit(base) + position * -rules.ORDER_STEP + F.when(fits, rules.TOTAL_RECONCILES).otherwise(0.0))
            .alias("score"), (-position).cast("int").alias("order"), amount.alias("amount"), page.alias("page"),
            box.alias("box"), F.lit("positional_fallback").alias("method"), fits.alias("trusted")))

    word = F.col("specific_first.w")
    lone = weak_total(rules.TOTAL_POSITIONAL, F.col("line_count"), text.parse_money(word["text"]),
                      F.col("specific_first.page"), F.array(word["x0"], word["y0"], word["x1"], word["y1"]),
                      F.coalesce(F.col("specific_count") == 1, F.lit(False)))
    dynamic = weak_total(rules.TOTAL_DYNAMIC, F.lit(0), text.parse_money(F.col("first_total_like.value")),
                         F.col("first_total_like.page"), F.col("first_total_like.box"),
                         F.coalesce("one_total_key", F.lit(False)))
    chosen = out.select(
        "doc_id", "n_subtotal", "n_tax", "n_discount", "items_sum", "pass_rate", "line_count",
        # Description rows without any number merge into one item.
        F.when(F.col("item_count") > 0, F.col("item_count")).otherwise(
            F.coalesce(F.col("described").cast("int"), F.lit(0))).alias("item_count"), "d_subtotal", "d_tax", "d_discount",
        "d_vendor_label", "d_customer_label", "d_invoice_number", "d_ntn", "header_row", "boundary", "bands",
        _ranked(F.col("b_vendor"), F.col("s_vendor")).alias("v"), _ranked(F.col("b_date"), F.col("s_date")).alias("d"),
        _ranked(F.col("b_total"), F.col("s_total"), [lone, dynamic]).alias("t"))

    labelled, first = F.col("d_vendor_label"), F.col("v.first")
    wraps = rules.continues_name(first["words"], first["next_words"])
    name = F.when(wraps, F.concat_ws(" ", first["name"], F.trim(rules.line_text(first["next_words"])))).otherwise(
        first["name"])
    return chosen.select(
        "doc_id", "line_count", "header_row", "boundary", F.size("bands").alias("band_count"), "items_sum",
        "item_count", "pass_rate",
        F.struct(F.coalesce(labelled["text"], name).alias("value"),
                 F.when(labelled.isNotNull(), "label_anchor+pattern").when(first.isNotNull(), "positional_fallback")
                 .otherwise("not_found").alias("method"),
                 (labelled.isNull() & (_doubt(F.col("v.gap")) | ~first["trusted"])).alias("doubtful")).alias("vendor"),
        F.struct(F.col("d_customer_label.text").alias("value")).alias("customer"),
        F.struct(F.when(text.invoice_number_ok("d_invoice_number.text"), F.trim("d_invoice_number.text"))
                 .alias("value")).alias("number"),
        F.struct(F.when(text.ntn_ok("d_ntn.text"), F.trim("d_ntn.text")).alias("value")).alias("ntn"),
        F.struct(text.find_date_in_text("d.first.text").alias("value"), F.col("d.first.method").alias("method"),
                 (_doubt(F.col("d.gap")) | ~F.col("d.first.trusted") | F.col("d.first.ambiguous")).alias("doubtful"),
                 F.col("d.first.score").alias("score")).alias("date"),
        F.struct(F.col("t.first.amount").alias("value"), F.col("t.first.method").alias("method"),
                 (_doubt(F.col("t.gap")) | ~F.col("t.first.trusted")).alias("doubtful"),
                 F.col("t.first.page").alias("page"), F.col("t.first.box").alias("box"),
                 F.col("t.first.score").alias("score")).alias("total"),
        *[F.struct(F.col(f"n_{f}").alias("value"), F.col(f"d_{f}.page").alias("page"),
                   F.col(f"d_{f}.box").alias("box")).alias(f) for f in ("subtotal", "tax", "discount")])


# -------------------------------------------------------------------- item rows


def item_rows(words: DataFrame) -> DataFrame:
    """Line items. A row without numbers belongs to the nearest numbered row by
    height, found with two ordered windows, so no row meets every other row."""
    return items_of(with_table_region(group_lines(words)))


def items_of(region: DataFrame) -> DataFrame:
    """``item_rows`` of lines whose table region is known already."""
    body = (region.withColumn("cells", once(F.col("cells"))).where(F.col("cells").isNotNull())
            .select("doc_id", "line_idx", F.get("words", F.lit(0))["y0"].alias("y"), "cells", "bands"))
    numbered = body.withColumn("numeric", _has_numeric())
    down = Window.partitionBy("doc_id").orderBy("y", "line_idx").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("doc_id").orderBy(F.desc("y"), F.desc("line_idx")).rowsBetween(
        Window.unboundedPreceding, 0)
    above = F.max(F.when(F.col("numeric"), F.struct("y", (-F.col("line_idx")).alias("i")))).over(down)
    below = F.min(F.when(F.col("numeric"), F.struct("y", F.col("line_idx").alias("i")))).over(up)
    near = numbered.withColumns({"above": above, "below": below})
    choice = F.array_min(F.array_compact(F.array(
        F.when(F.col("above").isNotNull(), F.struct((F.col("y") - F.col("above.y")).alias("d"),
                                                    (-F.col("above.i")).alias("i"))),
        F.when(F.col("below").isNotNull(), F.struct((F.col("below.y") - F.col("y")).alias("d"),
                                                    F.col("below.i").alias("i"))))))
    owner = F.when(F.col("numeric"), F.col("line_idx")).otherwise(F.coalesce(choice["i"], F.lit(-1)))
    rows = near.withColumn("owner", owner).where(F.col("numeric") | (F.col("cells.description") != ""))
    # One table row and its wrapped lines, whose joined text is the item itself. A
    # table without any number is a single item made of its body lines.
    parts = F.sort_array(F.collect_list(F.when(F.col("cells.description") != "", F.struct(
        (~F.col("numeric")).alias("wrapped"), "line_idx", F.col("cells.description").alias("d")))))
    merged = rows.groupBy("doc_id", "owner").agg(
        F.array_join(F.transform(parts, lambda p: p["d"]), " ").alias("description"),
        *[F.max(F.when(F.col("numeric"), F.col(f"cells.{f}"))).alias(f"{f}_text") for f in ("qty", "rate", "amount")],
        F.first("bands").alias("bands"))
    filled = sum([F.exists("bands", lambda b: b["field"] == "description").cast("int")
                  * (F.col("description") != "").cast("int")]
                 + [F.coalesce((F.col(f"{f}_text") != "").cast("int"), F.lit(0)) for f in ("qty", "rate", "amount")],
                 F.lit(0))
    sparse = filled < F.size("bands") - 1
    value = {f: F.when(present(f"{f}_text").isNotNull(), text.parse_money(f"{f}_text"))
             for f in ("qty", "rate", "amount")}
    out = merged.withColumns({**value, "sparse": sparse})
    out = out.withColumn("arithmetic_check", checks.line_item_check("qty", "rate", "amount"))
    flags = F.array_compact(F.array(F.when(F.col("sparse"), "sparse_row_possible_merged_cell"),
                                    F.when(F.col("arithmetic_check") == "fail", "qty_rate_amount_mismatch")))
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("owner")) - 1
    return out.select("doc_id", position.alias("position"), present("description").alias("description"), "qty", "rate",
                      "amount", "arithmetic_check", flags.alias("review_flags"))


def discovered_fields(words: DataFrame) -> DataFrame:
    """Every labelled value on a document; the first occurrence of a key wins."""
    rows = with_label_values(with_table_region(group_lines(words))).select(
        "doc_id", "line_idx", once(F.col("discovered")).alias("discovered")).select("doc_id", "line_idx", F.explode("discovered").alias("e"))
    first = F.min(F.struct("line_idx", F.col("e.cell_idx").alias("cell_idx"), F.col("e.label").alias("label"),
                           F.col("e.value").alias("value"))).alias("f")
    return rows.groupBy("doc_id", F.col("e.key").alias("key")).agg(first).select(
        "doc_id", "key", "f.label", "f.value", "f.line_idx")


def choose(candidates: DataFrame, field: str) -> DataFrame:
    """Candidate choice for one field as rows, through the shared selection."""
    column = f"c_{field}"
    value = {"vendor": f"{column}.name", "date": f"{column}.text", "total": f"{column}.amount"}[field]
    method = F.lit("positional_fallback") if field == "vendor" else F.col(f"{column}.method")
    rows = candidates.withColumn(column, once(F.col(column))).where(F.col(column).isNotNull()).select(
        "doc_id", F.col(value).cast("string").alias("value"), method.alias("method"),
        F.col(f"{column}.score").alias("score"), F.col("line_idx").alias("ordinal"))
    return select_candidate(rows, ["doc_id"], rules.AMBIGUITY_MARGIN)


# ---------------------------------------------------------------------- assembly

def extract_fields(documents: DataFrame, words: DataFrame, as_of) -> DataFrame:
    """Documents (``doc_id, text, confidence, method``) and their words to one
    validated, routed row each."""
    return assemble_documents(documents, document_fields(line_candidates(words)), as_of)


def assemble_documents(documents: DataFrame, fields: DataFrame, as_of, resolved: DataFrame | None = None) -> DataFrame:
    """``resolved`` (``doc_id, matched_vendor``) renames vendors to known spellings. Rows per
    document are merged, not broadcast."""
    out = documents.join(fields.hint("merge"), "doc_id", "left")
    out = out.join(resolved.hint("merge"), "doc_id", "left") if resolved is not None else out.withColumn(
        "matched_vendor", F.lit(None).cast("string"))
    return assemble(out, as_of)


def extract_with_known_vendors(documents: DataFrame, words: DataFrame, known: DataFrame, as_of) -> DataFrame:
    """Extraction that also uses each company's own vendor names: a line close to
    one scores higher, and the chosen name takes the known spelling. ``documents``
    carries ``company_id``; ``known`` is ``(company_id, vendor_name)``. The grouped
    lines are stored once; candidate names and chosen fields are read several times and stored too."""
    labelled = with_label_values(with_table_region(group_lines(words)))
    company = documents.select("doc_id", COMPANY)
    named = stored(vendor_lines(with_candidates(with_known(labelled, None))).join(company.hint("merge"), "doc_id"), "named")
    close = known_vendor_resolution(named, known).select(COMPANY, "vendor_name")
    known_lines = splittable_join(named, close.hint("merge"), [COMPANY, "vendor_name"]).select(*PAGE, "line_idx")
    fields = stored(document_fields(with_candidates(with_known(labelled, known_lines))), "fields")
    chosen = fields.where(F.col("vendor.value").isNotNull()).select(
        "doc_id", F.trim("vendor.value").alias("vendor_name")).join(company.hint("merge"), "doc_id")
    spelled = known_vendor_resolution(chosen, known).select(COMPANY, "vendor_name", "matched_vendor")
    resolved = splittable_join(chosen, spelled.hint("merge"), [COMPANY, "vendor_name"]).select("doc_id", "matched_vendor")
    return assemble_documents(documents, fields, as_of, resolved)


def assemble(rows: DataFrame, as_of) -> DataFrame:
    base = F.col("confidence")
    discounted = lambda doubt: base * F.when(F.coalesce(doubt, F.lit(False)), 0.7).otherwise(1.0)
    kind = text.detect_document_type("text", F.coalesce(F.col("item_count") > 0, F.lit(False)),
                                     F.col("total.value").isNotNull())
    out = rows.withColumn("kind", kind).withColumns({
        "transactional": text.is_transactional("kind.type"),
        "internal": F.coalesce(F.col("kind.type").isin(*text.INTERNAL_TYPES), F.lit(False))})
    keep = ~F.col("internal")
    out = out.withColumns({
        "amount_mentioned": F.when(F.col("internal"), F.coalesce(text.approval_amount("text"), F.col("total.value"),
                                                                 F.col("subtotal.value"))),
        "vendor_raw": F.when(keep, F.trim("vendor.value")),
        "total_value": F.when(keep, F.col("total.value")), "subtotal_value": F.when(keep, F.col("subtotal.value")),
        "tax_value": F.when(keep, F.col("tax.value")), "discount_value": F.when(keep, F.col("discount.value"))})
    nonzero = F.nullif(F.col("subtotal_value"), F.lit(0.0))
    shared = F.lit(False)
    for other in ("subtotal", "tax", "discount"):
        shared = shared | checks.same_source("total.page", "total.box", f"{other}.page", f"{other}.box")
    out = out.withColumns({
        "tax_rate": F.round(F.col("tax_value") / nonzero, 4),
        "totals_pass": checks.totals_check("subtotal_value", "tax_value", "discount_value", "total_value"),
        "tax_rate_ok": checks.tax_rate_plausible("subtotal_value", "tax_value"),
        "date_ok": checks.date_plausible("date.value", as_of),
        "magnitude_ok": checks.magnitude_plausible("total_value", checks.reference_amount(
            "subtotal_value", "tax_value", "discount_value", "items_sum")),
        "shared_source": F.col("total_value").isNotNull() & shared})
    no = lambda name: F.coalesce(~F.col(name), F.lit(False))
    bad = no("date_ok") | no("tax_rate_ok") | no("magnitude_ok") | F.col("shared_source")
    out = out.withColumn("arithmetic_ok", F.when(bad, False).otherwise(
        F.coalesce(F.col("totals_pass"), F.col("pass_rate") >= 0.9)))
    is_invoice = F.coalesce(F.col("kind.type") == "invoice", F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.col("total_value").isNull() & F.col("transactional"), "no_total_found"),
        F.when(~F.col("transactional"), "non_transactional_document"),
        F.when(~F.col("totals_pass"), "totals_arithmetic_mismatch"),
        F.when(~F.col("tax_rate_ok"), "tax_rate_implausible"),
        F.when(~F.col("date_ok"), "invoice_date_implausible"),
        F.when(~F.col("magnitude_ok"), "total_magnitude_implausible"),
        F.when(F.col("shared_source"), "total_shares_source_with_another_field"),
        F.when(is_invoice & F.col("number.value").isNull(), "invoice_number_required_but_missing")))
    matched = F.when(F.col("vendor_raw").isNotNull(), F.col("matched_vendor"))
    vendor_method = F.when(matched.isNotNull(), F.concat("vendor.method", F.lit("+vendor_match"))).otherwise(
        F.col("vendor.method"))
    vendor_conf = discounted(F.col("vendor.doubtful"))
    found = lambda value, method: F.when(value.isNotNull(), checks.field_confidence(base, method))
    anchored = F.lit("label_anchor+pattern")
    out = out.withColumns({"vendor_name": F.coalesce(matched, "vendor_raw"), "vendor_method": vendor_method})
    score = checks.document_confidence({
        "vendor_name": found(F.col("vendor_name"), "vendor_method"),
        "invoice_number": found(F.col("number.value"), anchored),
        "invoice_date": found(F.col("date.value"), "date.method"), "ntn": found(F.col("ntn.value"), anchored),
        "subtotal": found(F.col("subtotal_value"), anchored), "tax_amount": found(F.col("tax_value"), anchored),
        "total": found(F.col("total_value"), "total.method")}, F.col("arithmetic_ok"))
    critical = F.col("total_value").isNotNull() & F.col("vendor_name").isNotNull() & (
        ~is_invoice | F.col("number.value").isNotNull())
    out = out.withColumn("document_confidence", score)
    suspicious = no("magnitude_ok") | F.col("shared_source")
    currency = text.detect_currency("text")
    return out.select(
        "doc_id", F.col("kind.type").alias("document_type"), F.col("kind.confidence").alias("document_type_confidence"),
        F.col("kind.reason").alias("classification_reason"), "transactional", "vendor_name", "vendor_method",
        F.when(F.col("vendor_name").isNotNull(), F.when(matched.isNotNull(), F.least(F.lit(1.0), vendor_conf + 0.1))
               .otherwise(vendor_conf)).alias("vendor_confidence"),
        F.trim("customer.value").alias("customer_name"), F.col("number.value").alias("invoice_number"),
        F.col("date.value").alias("invoice_date"),
        F.when(F.col("date.value").isNotNull(), discounted(F.col("date.doubtful"))).alias("date_confidence"),
        F.col("ntn.value").alias("ntn"), F.col("subtotal_value").alias("subtotal"), "tax_rate",
        F.col("tax_value").alias("tax_amount"), F.col("discount_value").alias("discount"),
        F.col("total_value").alias("total"),
        F.when(F.col("total_value").isNotNull(), discounted(F.col("total.doubtful"))
               * F.when(suspicious, 0.5).otherwise(1.0)).alias("total_confidence"),
        "amount_mentioned", "items_sum", "pass_rate", "totals_pass", "tax_rate_ok", "date_ok", "magnitude_ok",
        "arithmetic_ok", let(currency, lambda m: m["value"]).alias("currency"), text.detect_city("text").alias("city"),
        text.detect_country("text").alias("country"), text.payment_status("text").alias("payment_status"),
        "document_confidence", flags.alias("review_flags"),
        F.when(F.col("transactional"), checks.route("document_confidence", critical, "arithmetic_ok"))
        .otherwise("needs_review").alias("review_status"), F.col("method").alias("extraction_source"),
        F.col("text").alias("raw_text"))

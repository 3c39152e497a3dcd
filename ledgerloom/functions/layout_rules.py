"""Column expressions over one printed line: an array of word structs
``{text, x0, y0, x1, y1, confidence, font_size}`` sorted left to right.

A label is found on the line's *key string*: every word lower-cased, trimmed of
punctuation and joined by a separator no word contains. A whole-word phrase test
is then a substring test, and cutting a value at the next label is one regex.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.core import any_of, constant, let, lookup, strip, strip_chars

# ---------------------------------------------------------------- fixed values

LABELS: dict[str, tuple[str, ...]] = {
    "invoice_number": ("invoice number", "invoice no", "invoice #", "invoice#", "bill no", "bill #", "bill#", "inv#",
                       "ref no"),
    "invoice_date": ("date issued", "invoice date", "invoice dt", "bill date", "bill dt", "date of invoice", "dated",
                     "date"),
    "due_date": ("due date",),
    "total": ("grand total", "total due", "amount due", "balance due", "net payable", "net amount", "total amount",
              "total booking amount", "bill total", "amount inc sales tax", "total"),
    "subtotal": ("sub total", "subtotal"),
    "tax": ("sales tax", "gst", "vat", "tax"),
    "discount": ("discount",),
    "ntn": ("national tax number", "sales tax registration no", "tax registration no", "ntn no", "strn", "ntn"),
    "vendor_label": ("bill from", "sold by", "billed by", "from", "vendor", "supplier", "merchant"),
    "customer_label": ("billed to", "customer name", "bill to", "ship to", "to", "customer"),
}
ITEM_HEADERS: dict[str, tuple[str, ...]] = {
    "description": ("description", "item", "items", "particulars"),
    "qty": ("qty", "quantity", "hours"),
    "rate": ("rate", "unit price", "hourly rate", "price"),
    "amount": ("amount", "line total", "total", "subtotal", "sub total"),
}
TOTALS_WORDS = ("subtotal", "sub total", "tax", "gst", "sales tax", "discount", "total", "grand total", "amount due")
OTHER_DATE_LABELS = ("due date", "payment due", "pay by", "order date", "delivery date", "payment date",
                     "statement date", "transaction date")
NON_TOTAL_LABELS = ("sub total", "subtotal", "sales tax", "gst", "vat", "tax", "discount", "cash", "change",
                    "amount paid", "payment received", "tip")
CONTEXTUAL_TOTAL_LABELS = ("amount due", "balance due")
NON_VALUE_WORDS = ("currency", "status", "reference", "page", "payment", "shipping", "billed", "billing", "address",
                   "contact", "details")
TOTAL_KEY_MARKS = ("total", "amountdue", "amount_due", "balancedue", "balance_due", "payable")
NOT_TOTAL_KEY_MARKS = ("subtotal", "sub_total", "tax", "discount")

COLUMN_GAP, CELL_GAP, COLUMN_TOLERANCE, LABEL_ALIGN = 50.0, 28.0, 5.0, 5.0
TRUSTED_CONFIDENCE, CONTINUATION_CONFIDENCE, CONTINUATION_GAP = 0.85, 0.90, 1.75
REJECTED, ORDER_STEP, FLOOR_SCORE, AMBIGUITY_MARGIN = -1000.0, 0.001, 10.0, 0.05
FONT_BONUS_CAP, KNOWN_VENDOR_BONUS = 0.5, 0.3
DATE_LABEL_SCORE, DATE_BARE_LABEL_SCORE, DATE_AMBIGUOUS_PENALTY = 20.0, 15.0, -3.0
TOTAL_STRONG, TOTAL_BARE, TOTAL_CONTEXTUAL, TOTAL_DYNAMIC, TOTAL_POSITIONAL, TOTAL_RECONCILES = (
    20.0, 15.0, 10.0, 8.0, 5.0, 3.0)
MAX_LABEL_WORDS = 4
BARE_NUMBER_PATTERN, ALPHABETIC_PATTERN = r"^-?[\d,]+(?:\.\d{1,2})?$", r"^[^\d]*[A-Za-z][^\d]*$"

SEP = "\u0001"
_STOP = (SEP + "(?:" + "|".join(
    [SEP.join(re.escape(w) for w in v.split()) for variants in LABELS.values() for v in variants]
    + list(NON_VALUE_WORDS)) + ")" + SEP)

# ------------------------------------------------------------------ line basics


def clean_word(word: Column) -> Column:
    return strip_chars(F.lower(word), ":-.\t")


def key_string(words: Column) -> Column:
    return F.concat(F.lit(SEP), F.array_join(F.transform(words, lambda w: clean_word(w["text"])), SEP), F.lit(SEP))


def line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def line_box(words: Column) -> Column:
    side = lambda name: F.transform(words, lambda w: w[name])
    return F.array(F.array_min(side("x0")), F.array_min(side("y0")), F.array_max(side("x1")),
                   F.array_max(side("y1")))


def line_confidence(words: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.size(words)


def _phrase(phrase: str) -> str:
    return SEP + SEP.join(phrase.split()) + SEP


def has_phrase(key: Column, phrases) -> Column:
    return any_of(key, [SEP.join(p.split()) for p in phrases], SEP, SEP)


def _words_before(key: Column, position: Column) -> Column:
    """Number of words that start before the separator at ``position``."""
    head = F.substring(key, F.lit(1), position)
    return F.length(head) - F.length(F.replace(head, F.lit(SEP), F.lit(""))) - 1


def _cut_at_label(words: Column, key: Column) -> Column:
    """Words up to the next field label or bare header noun."""
    stop = F.regexp_instr(key, F.lit(_STOP))
    return F.slice(words, F.lit(1), F.when(stop > 0, _words_before(key, stop)).otherwise(F.size(words)))


def value_text(words: Column) -> Column:
    return strip_chars(line_text(words), " :#-\t")


# -------------------------------------------------------------------- label values


_VARIANTS = "array<struct<needle: string, width: int, words: int, variant: string>>"


def _variants(field: str) -> list[dict]:
    """A field's label spellings, longest first."""
    return [{"needle": _phrase(v), "width": len(_phrase(v)), "words": len(v.split()), "variant": v}
            for v in sorted(LABELS[field], key=lambda v: -len(v.split()))]


def label_hit(key: Column, variants: Column) -> Column:
    """Where the label stands: longest variants first, the first hit counts."""
    first = F.get(F.filter(variants, lambda v: key.contains(v["needle"])), F.lit(0))
    return let(first, lambda v: F.when(v.isNotNull(), F.struct(
        F.instr(key, v["needle"]).alias("at"), v["width"].alias("width"), v["words"].alias("words"),
        v["variant"].alias("variant"))))


def _value(words: Column, page: Column, variant: Column, accept) -> Column:
    found = let(words, lambda ws: F.struct(value_text(ws).alias("text"), page.alias("page"),
                                           line_box(ws).alias("box"), variant.alias("variant")))
    return let(found, lambda v: F.when((v["text"] != "") & accept(v["text"]), v))


def _same_line(words: Column, key: Column, page: Column, hit: Column, accept) -> Column:
    rest_key = F.substring(key, hit["at"] + hit["width"] - 1, F.length(key))
    first = _words_before(key, hit["at"]) + hit["words"]
    rest = F.slice(words, first + 1, F.size(words))
    return _value(let(F.struct(rest.alias("w"), rest_key.alias("k")), lambda r: _cut_at_label(r["w"], r["k"])),
                  page, hit["variant"], accept)


def _cut_at_gap(words: Column) -> Column:
    gaps = F.transform(words, lambda w, i: F.when(
        (i > 0) & (w["x0"] - F.get(words, i - 1)["x1"] > COLUMN_GAP), i))
    return F.slice(words, F.lit(1), F.coalesce(F.array_min(gaps), F.size(words)))


def _next_line(words: Column, key: Column, next_words: Column, next_page: Column, hit: Column, accept) -> Column:
    label_x = F.get(words, _words_before(key, hit["at"]))["x0"]
    aligned = F.filter(next_words, lambda w: w["x0"] >= label_x - LABEL_ALIGN)
    cut = let(let(aligned, _cut_at_gap), lambda ws: _cut_at_label(ws, key_string(ws)))
    return _value(cut, next_page, hit["variant"], accept)


def _label_value(variants: Column, accept) -> Column:
    words, key = F.col("words"), F.col("key")
    return let(label_hit(key, variants), lambda hit: F.when(hit.isNotNull(), F.coalesce(
        _same_line(words, key, F.col("page"), hit, accept),
        F.when(F.col("next_words").isNotNull(), _next_line(words, key, F.col("next_words"), F.col("next_page"), hit,
                                                           accept)))))


def label_value(field: str, accept=lambda _: F.lit(True)) -> Column:
    """Value printed beside the field's label, else aligned below it: a struct
    ``{text, page, box, variant}`` or null. Reads the line columns ``words``,
    ``key``, ``page``, ``next_words`` and ``next_page``."""
    return F.when(has_phrase(F.col("key"), LABELS[field]), _label_value(constant(_variants(field), _VARIANTS), accept))


def label_values(fields: tuple[str, ...]) -> Column:
    """The values of several fields, in order, by one pass over the line; null where none is named."""
    return F.when(has_phrase(F.col("key"), [v for f in fields for v in LABELS[f]]), F.transform(
        constant([_variants(f) for f in fields], f"array<{_VARIANTS}>"),
        lambda variants: _label_value(variants, lambda _: F.lit(True))))


# ------------------------------------------------------------- vendor candidates


def _drop_first(words: Column, n: int) -> Column:
    return F.slice(words, F.lit(n + 1), F.size(words))


def strip_document_title(words: Column) -> Column:
    titles = sorted(T.DOCUMENT_TITLES, key=len, reverse=True)

    def stripped(key: Column) -> Column:
        out = words
        for title in reversed(titles):
            n = len(title.split())
            out = F.when((F.size(words) > n) & key.startswith(_phrase(title)), _drop_first(words, n)).otherwise(out)
        return out

    return let(key_string(words), stripped)


def strip_reference_stamp(words: Column) -> Column:
    first = F.get(words, F.lit(0))["text"]
    stamp = first.rlike(r"(?i)^(?:rs\.?|pkr|usd|\$)") | F.coalesce(T._digit_share(first) > 0.5, F.lit(False))
    return F.when((F.size(words) >= 2) & stamp, _drop_first(words, 1)).otherwise(words)


def strip_trailing_label(words: Column) -> Column:
    last = F.get(words, F.size(words) - 1)["text"]
    return F.when((F.size(words) > 1) & last.rlike(r":\s*$"),
                  F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)


def vendor_text(words: Column) -> Column:
    """The line as a business name: titles, stamps, trailing labels and a
    registration number printed on the same row are taken off."""
    stripped = let(let(words, strip_document_title), lambda w: let(strip_reference_stamp(w), strip_trailing_label))
    return strip(F.regexp_replace(strip(line_text(stripped)), r"(?is)\bNTN\s*#?\s*\d.*$", ""))


def vendor_score(index: Column, words: Column, name: Column, known: Column) -> Column:
    """Score and whether the line alone would be trusted."""
    order = index * -ORDER_STEP
    sizes = F.filter(F.transform(words, lambda w: w["font_size"]), lambda s: s.isNotNull())
    font = F.when(F.size(sizes) > 0, F.least(F.lit(FONT_BONUS_CAP), F.aggregate(
        sizes, F.lit(0.0), lambda a, s: a + s) / F.size(sizes) / 100.0)).otherwise(0.0)

    def scored(confidence: Column) -> Column:
        tier = F.when(confidence >= TRUSTED_CONFIDENCE, FLOOR_SCORE).otherwise(confidence * FLOOR_SCORE)
        good = tier + order + font + F.when(known, KNOWN_VENDOR_BONUS).otherwise(0.0)
        noise = T.vendor_line_noise(name)
        return let(noise, lambda bad: F.struct(
            F.when(bad, F.lit(REJECTED) + order).otherwise(good).alias("score"),
            (~bad & (confidence >= TRUSTED_CONFIDENCE)).alias("trusted")))

    return let(line_confidence(words), scored)


def continues_name(words: Column, next_words: Column) -> Column:
    """The next line reads as the same business name wrapped onto a second row."""
    name = strip(line_text(next_words))
    top = F.array_min(F.transform(words, lambda w: w["y0"]))
    bottom = F.array_max(F.transform(words, lambda w: w["y1"]))
    gap = F.greatest(F.lit(0.0), F.get(next_words, F.lit(0))["y0"] - bottom)
    return F.coalesce(
        (name != "") & ~name.rlike(r"[\p{Nd},]") & ~name.endswith(":") & ~T.looks_like_reference(name)
        & ~T.looks_decorative(name) & (line_confidence(next_words) >= CONTINUATION_CONFIDENCE) & (bottom > top)
        & (gap <= (bottom - top) * CONTINUATION_GAP), F.lit(False))


# -------------------------------------------------------------------- item table


def is_item_header(line: Column) -> Column:
    """At least two of the four column groups are named on the line."""
    lowered = F.lower(line)
    groups = [any_of(lowered, words).cast("int") for words in ITEM_HEADERS.values()]
    return sum(groups[1:], groups[0]) >= 2


_HEADER_FIELD = {word: field for field, words in ITEM_HEADERS.items() for word in words}


def _header_field(word: Column) -> Column:
    return lookup(F.regexp_replace(F.regexp_replace(word, r"\([^)]*\)\s*$", ""), r"[.:]+$", ""), _HEADER_FIELD)


def header_matches(words: Column) -> Column:
    """Column starts on a header row, two-word headers before one-word ones:
    ``[{x0, ord, field}]`` left to right."""
    empty = F.array().cast("array<struct<x0:double,ord:int,field:string>>")
    initial = F.struct(F.lit(0).alias("free"), empty.alias("found"))
    indexed = F.transform(words, lambda w, i: F.struct(
        i.alias("i"), w["x0"].alias("x0"), F.lower(w["text"]).alias("one"),
        F.concat(F.lower(w["text"]), F.lit(" "), F.lower(F.get(words, i + 1)["text"])).alias("two")))

    def add(state: Column, w: Column, field: Column, used: int) -> Column:
        new = F.struct(w["x0"].alias("x0"), w["i"].alias("ord"), field.alias("field"))
        return F.struct((w["i"] + used).alias("free"), F.concat(state["found"], F.array(new)).alias("found"))

    def step(state: Column, w: Column) -> Column:
        two, one = _header_field(w["two"]), _header_field(w["one"])
        return (F.when(w["i"] < state["free"], state).when(two.isNotNull(), add(state, w, two, 2))
                .when(one.isNotNull(), add(state, w, one, 1)).otherwise(state))

    return F.array_sort(F.aggregate(indexed, initial, step)["found"])


def column_bands(matches: Column, right_edge: Column) -> Column:
    """``[{field, x0, x1}]``: each band runs to the next column's start. A field
    named twice keeps its first place and its last band."""
    bands = F.transform(matches, lambda m, i: F.struct(
        m["field"].alias("field"), (m["x0"] - COLUMN_TOLERANCE).alias("x0"),
        F.coalesce(F.get(matches, i + 1)["x0"], right_edge).alias("x1")))
    return let(bands, lambda bs: F.transform(
        F.array_distinct(F.transform(bs, lambda b: b["field"])),
        lambda f: F.element_at(F.filter(bs, lambda b: b["field"] == f), -1)))


def band_of(bands: Column, field: str) -> Column:
    return F.get(F.filter(bands, lambda b: b["field"] == field), F.lit(0))


def names_totals(words: Column, bands: Column) -> Column:
    """A totals word outside the description column."""
    outside = let(band_of(bands, "description"), lambda d: F.filter(
        words, lambda w: d.isNull() | ~((w["x0"] >= d["x0"]) & (w["x0"] < d["x1"]))))
    return any_of(F.lower(line_text(outside)), TOTALS_WORDS)


def cell_field(word: Column, bands: Column) -> Column:
    """Column a word belongs to: bare numbers go to the nearest numeric header,
    everything else to the band it stands in, and prose never to a numeric one."""
    numeric = F.filter(bands, lambda b: b["field"] != "description")
    nearest = F.array_min(F.transform(numeric, lambda b, i: F.struct(
        F.abs(word["x0"] - (b["x0"] + COLUMN_TOLERANCE)).alias("d"), i.alias("i"), b["field"].alias("f"))))["f"]
    inside = F.get(F.filter(bands, lambda b: (word["x0"] >= b["x0"]) & (word["x0"] < b["x1"])), F.lit(0))["field"]
    prose = (word["text"].rlike(ALPHABETIC_PATTERN) & (inside != "description")
             & F.exists(bands, lambda b: b["field"] == "description"))
    return (F.when((F.size(numeric) > 0) & word["text"].rlike(BARE_NUMBER_PATTERN), nearest)
            .when(prose, F.lit("description")).otherwise(inside))


def item_cells(words: Column, bands: Column) -> Column:
    """Texts of one table row: ``{description, qty, rate, amount}``."""
    placed = F.transform(words, lambda w: F.struct(w["text"].alias("text"), cell_field(w, bands).alias("field")))

    def cell(ps: Column, field: str) -> Column:
        return line_text(F.filter(ps, lambda p: p["field"] == field)).alias(field)

    return let(placed, lambda ps: F.struct(*[cell(ps, field) for field in ITEM_HEADERS]))


# --------------------------------------------------------------- discovered fields


def cells(words: Column) -> Column:
    """Words split at column-sized gaps."""
    starts = F.array_compact(F.transform(words, lambda w, i: F.when(
        (i == 0) | (w["x0"] - F.get(words, i - 1)["x1"] > CELL_GAP), i)))
    return let(starts, lambda ss: F.transform(ss, lambda s, k: F.slice(
        words, s + 1, F.coalesce(F.get(ss, k + 1), F.size(words)) - s)))


def is_label_cell(cell: Column) -> Column:
    def labels(m: Column) -> Column:
        letters = F.regexp_replace(m["core"], r"[^\p{L}]", "")
        return ((letters != "") & ~m["core"].rlike(r"\p{Nd}")
                & (m["text"].endswith(":") | letters.rlike(r"^\p{Lu}+$")))

    both = let(strip(line_text(cell)), lambda t: F.struct(t.alias("text"), strip_chars(t, " :#-.\t").alias("core")))
    return (F.size(cell) <= MAX_LABEL_WORDS) & let(both, labels)


def is_value_cell(cell: Column) -> Column:
    return strip_chars(strip(line_text(cell)), " :\t").rlike(r"[0-9a-z$€£₨%]")


_DISCOVERED = ("array<struct<cell_idx:int,key:string,label:string,value:string,box:array<double>,below:boolean>>")


def discovered(words: Column, next_words: Column, next_allowed: Column) -> Column:
    """Label/value pairs of one line: ``[{cell_idx, key, label, value, box, below}]``."""
    def entry(cs: Column, cell: Column, i: Column) -> Column:
        def under() -> Column:
            return F.get(F.filter(cells(next_words), lambda b: (F.abs(F.get(b, F.lit(0))["x0"] - F.get(cell, F.lit(0))["x0"])
                                                                <= CELL_GAP) & is_value_cell(b)), F.lit(0))

        def valued(v: Column) -> Column:
            return F.when(v["value"].isNotNull(), let(strip_chars(strip(line_text(cell)), " :#-.\t"), lambda label: F.struct(
                i.alias("cell_idx"), T.key_for_label(label).alias("key"), label.alias("label"),
                strip_chars(strip(line_text(v["value"])), " :\t").alias("value"), line_box(v["value"]).alias("box"),
                (~v["right"]).alias("below"))))

        right = F.get(cs, i + 1)
        last = (i == F.size(cs) - 1) & (F.size(cs) > 1) & next_allowed & next_words.isNotNull()
        found = let(F.coalesce(is_value_cell(right), F.lit(False)), lambda use: F.struct(
            use.alias("right"), F.when(use, right).when(last, under()).alias("value")))
        return F.when(is_label_cell(cell), let(found, valued))

    def pairs(cs: Column) -> Column:
        return F.filter(F.transform(cs, lambda cell, i: entry(cs, cell, i)), lambda e: e["key"] != "")

    # a label and its value are two cells, or the value stands below the last of several
    none = F.array().cast(_DISCOVERED)
    return let(cells(words), lambda cs: F.when(F.size(cs) <= 1, none).otherwise(pairs(cs)))


def is_total_key(key: Column) -> Column:
    return any_of(key, TOTAL_KEY_MARKS) & ~any_of(key, NOT_TOTAL_KEY_MARKS)

"""Printed-value parsers and classifiers over whole text columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.functions import checks, classify, text
from ledgerloom.plans.catalog import query
from ledgerloom.sources.fixtures import AS_OF

# ----------------------------------------------------- shared checking SQL pieces


def _parse_money_sql(x: str) -> str:
    digits = f"replace(regexp_extract({x}, '(-?[0-9,]+(?:\\.[0-9]{{1,2}})?)', 1), ',', '')"
    amount = f"TRY_CAST(NULLIF({digits}, '') AS DOUBLE)"
    paren = f"regexp_matches({x}, '(?i)\\(\\s*(?:rs\\.?|pkr|\\$|usd|sgd|gbp|eur)?\\s*[0-9,]+(?:\\.[0-9]{{1,2}})?\\s*\\)')"
    return f"CASE WHEN {amount} > 0 AND {paren} THEN -{amount} ELSE {amount} END"


_FORMATS = ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d %B %Y", "%B %d, %Y", "%d %b %Y", "%b %d, %Y")


def _clean_date_sql(x: str) -> str:
    out = f"trim(trim({x}), '.,')"
    out = f"trim(trim(regexp_replace({out}, ',?\\s*[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?\\s*(?:[AaPp]\\.?[Mm]\\.?)?\\.?$', '')), '.,')"
    # No lookahead in this engine: the character after the ordinal is captured and put back.
    out = f"regexp_replace({out}, '^([0-9]{{1,2}})[stndrhSTNDRH\"]{{1,2}}([\\sA-Za-z])', '\\1\\2')"
    out = f"regexp_replace({out}, '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return f"regexp_replace({out}, '([A-Za-z])([0-9])', '\\1 \\2', 'g')"


def _parse_date_sql(x: str) -> str:
    v = _clean_date_sql(x)
    four = [f"try_strptime({v}, '{f}')" for f in _FORMATS]
    gate = f"CASE WHEN regexp_matches({v}, '[0-9]{{4}}') THEN COALESCE({', '.join(four)}) END"
    two = f"CASE WHEN regexp_matches({v}, '^[0-9]{{1,2}}([/-])[0-9]{{1,2}}[/-][0-9]{{2}}$') THEN COALESCE(try_strptime({v}, '%d/%m/%y'), try_strptime({v}, '%d-%m-%y')) END"
    us = f"CASE WHEN regexp_matches({v}, '[0-9]{{4}}') THEN try_strptime({v}, '%m/%d/%Y') END"
    return f"CAST(COALESCE({gate}, {two}, {us}) AS DATE)"


_SUBSTRINGS = ("[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}",
               "[0-9]{1,2}(?:[stndrhSTNDRH]{1,2})?\\s*[A-Za-z]{3,9}[,.]?\\s*[0-9]{4}",
               "[A-Za-z]{3,9}\\s+[0-9]{1,2},?\\s+[0-9]{4}", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")


def _find_date_sql(x: str) -> str:
    parts = [_parse_date_sql(f"regexp_extract({x}, '{p}', 0)") for p in _SUBSTRINGS]
    short = _parse_date_sql(f"regexp_extract({x}, '([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2}})(?:[^0-9]|$)', 1)")
    return f"COALESCE({_parse_date_sql(x)}, {', '.join(parts)}, {short})"


def _ladder_sql(x: str, rules, flags: str = "(?i)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{flags}{p}') THEN '{v}'" for p, v in rules) + " END"


# ------------------------------------------------------------------ printed values


@query("X01_parse_money", f"SELECT snippet_id, {_parse_money_sql('money_text')} AS amount FROM v_snippet")
def parse_money(t):
    return t.v_snippet.select("snippet_id", text.parse_money("money_text").alias("amount"))


@query("X02_parse_date", f"SELECT snippet_id, CAST({_parse_date_sql('date_text')} AS VARCHAR) AS parsed FROM v_snippet")
def parse_date(t):
    return t.v_snippet.select("snippet_id", text.parse_date("date_text").alias("parsed"))


@query("X03_find_date_in_text", f"SELECT snippet_id, CAST({_find_date_sql('date_text')} AS VARCHAR) AS found FROM v_snippet")
def find_date(t):
    return t.v_snippet.select("snippet_id", text.find_date_in_text("date_text").alias("found"))


_AMB = "(?:^|[^A-Za-z0-9_])([0-9]{1,2})[/-]([0-9]{1,2})[/-](?:[0-9]{4}|[0-9]{2}(?:[^0-9]|$))"


@query("X04_day_month_ambiguous", f"""
SELECT snippet_id, COALESCE(TRY_CAST(NULLIF(regexp_extract(date_text, '{_AMB}', 1), '') AS INT) BETWEEN 1 AND 12 AND TRY_CAST(NULLIF(regexp_extract(date_text, '{_AMB}', 2), '') AS INT) BETWEEN 1 AND 12, FALSE) AS ambiguous FROM v_snippet""")
def day_month_ambiguous(t):
    return t.v_snippet.select("snippet_id", text.day_month_ambiguous("date_text").alias("ambiguous"))


@query("X05_number_shapes", """
SELECT snippet_id, regexp_matches(trim(number_text), '^[A-Za-z0-9][A-Za-z0-9/_-]{1,29}$') AND NOT regexp_matches(trim(number_text), '^[0-9]{1,2}$') AS invoice_number_ok,
  regexp_matches(trim(number_text), '^[0-9]{6,7}-?[0-9]?$') AS ntn_ok FROM v_snippet""")
def number_shapes(t):
    return t.v_snippet.select("snippet_id", text.invoice_number_ok("number_text").alias("invoice_number_ok"),
                              text.ntn_ok("number_text").alias("ntn_ok"))


_WORDS_SQL = [(p.replace("(?<![A-Za-z])rs\\.?(?![A-Za-z])", "(?:^|[^A-Za-z])rs(?:[^A-Za-z]|$)"), v)
              for p, v in text.CURRENCY_WORDS]
_SYMBOLS_SQL = list(text.CURRENCY_SYMBOLS)


@query("X06_detect_currency", f"""
SELECT doc_id, COALESCE(w, s) AS currency, CASE WHEN w IS NOT NULL THEN 1e0 WHEN s IS NOT NULL THEN 0.45e0 END AS confidence
FROM (SELECT doc_id, {_ladder_sql('text', _WORDS_SQL)} AS w, {_ladder_sql('text', _SYMBOLS_SQL, '')} AS s FROM v_invoice_text)""")
def detect_currency(t):
    return t.v_invoice_text.select("doc_id", text.detect_currency("text").alias("m")).select(
        "doc_id", F.col("m.value").alias("currency"), "m.confidence")


_CITY_SQL = _ladder_sql("lower(text)", [(rf"\b{c}\b", c.title()) for c in text.CITY_COUNTRY], "")
_CITY_COUNTRY_SQL = "CASE city " + " ".join(f"WHEN '{c.title()}' THEN '{v}'" for c, v in text.CITY_COUNTRY.items()) + " END"


@query("X07_detect_city_country", f"""
SELECT doc_id, city, COALESCE({_CITY_COUNTRY_SQL}, {_ladder_sql('text', text.PHONE_COUNTRY, '')}) AS country FROM (SELECT doc_id, text, {_CITY_SQL} AS city FROM v_invoice_text)""")
def detect_city_country(t):
    return t.v_invoice_text.select("doc_id", text.detect_city("text").alias("city"),
                                           text.detect_country("text").alias("country"))


def _quote_sql(pattern: str) -> str:
    before = f"length(regexp_extract(text, '(?si)^(.*?){pattern}', 1))"
    return f"trim(regexp_replace(substr(text, {before} + 1, 60), '\\s+', ' ', 'g'))"


_TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{v}'" for p, v in text.DOCUMENT_TYPE_RULES) + " WHEN has_items THEN 'receipt' END"
_REASON_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN {_quote_sql(p)}" for p, v in text.DOCUMENT_TYPE_RULES) + " WHEN has_items THEN 'No document-type wording found; has a line-item table and a total' END"
_ANY_TYPE = "|".join(p for p, _ in text.DOCUMENT_TYPE_RULES)


@query("X08_detect_document_type", f"""
SELECT doc_id, {_TYPE_SQL} AS document_type, CASE WHEN regexp_matches(text, '(?i){_ANY_TYPE}') THEN 1e0 WHEN has_items THEN 0.4e0 ELSE 0e0 END AS confidence, {_REASON_SQL} AS reason
FROM (SELECT *, true_total > 200000 AS has_items FROM v_invoice_text)""")
def detect_document_type(t):
    kind = text.detect_document_type("text", F.col("true_total") > 200000, F.lit(True))
    return t.v_invoice_text.select("doc_id", kind.alias("k")).select(
        "doc_id", F.col("k.type").alias("document_type"), "k.confidence", "k.reason")


@query("X09_is_transactional", "SELECT invoice_id, document_type IS NULL OR document_type NOT IN ('minute_sheet', 'approval_request', 'quotation', 'purchase_order') AS transactional FROM v_purchase")
def is_transactional(t):
    return t.v_purchase.select("invoice_id", text.is_transactional("document_type").alias("transactional"))


@query("X10_approval_amount", f"""
SELECT doc_id, {_parse_money_sql("regexp_extract(text, '(?i)\\b(?:for\\s+approval\\s+of|submitted\\s+for\\s+approval\\s+of|kindly\\s+approve)\\s*(?:rs\\.?|pkr|/-)?\\s*(-?[0-9,]+(?:\\.[0-9]{1,2})?)', 1)")} AS amount FROM v_invoice_text""")
def approval_amount(t):
    return t.v_invoice_text.select("doc_id", text.approval_amount("text").alias("amount"))


@query("X11_payment_status", f"SELECT doc_id, {_ladder_sql('text', text.PAYMENT_STATUS_RULES)} AS payment_status FROM v_invoice_text")
def payment_status(t):
    return t.v_invoice_text.select("doc_id", text.payment_status("text").alias("payment_status"))


def _normalize_sql(x: str) -> str:
    v = f"regexp_replace(trim(lower({x})), '\\s+', ' ', 'g')"
    cases = " ".join(f"WHEN regexp_matches({v}, '[\\s,]*{re.escape(s)}$') THEN trim(regexp_replace({v}, '[\\s,]*{re.escape(s)}$', ''))"
                     for s in text.CORPORATE_SUFFIXES)
    return f"CASE {cases} ELSE {v} END"


@query("X12_normalize_vendor", f"SELECT snippet_id, {_normalize_sql('line_text')} AS vendor FROM v_snippet")
def normalize_vendor(t):
    return t.v_snippet.select("snippet_id", text.normalize_vendor("line_text").alias("vendor"))


def _category_sql(x: str) -> str:
    """Scores per category as rows, ranked and tested for a clear lead."""
    rows = []
    for position, (name, (strong, weak)) in enumerate(classify.CATEGORY_WORDS.items()):
        def hits(words):
            tests = [f"CASE WHEN regexp_matches({x}, '\\b{re.escape(w).replace(chr(39), chr(39) * 2)}\\b') THEN 1 ELSE 0 END" for w in words]
            return "(" + (" + ".join(tests) or "0") + ")"
        score = (f"(CASE WHEN {hits(strong)} > 0 THEN 12e0 * {hits(strong)} - 2 ELSE 0e0 END + "
                 f"CASE WHEN {hits(weak)} > 0 THEN 5 + 4 * (1 - power(0.5e0, {hits(weak)} - 1)) ELSE 0e0 END)")
        rows.append(f"struct_pack(score := {score}, ord := {-position}, category := '{name}', strong := {hits(strong)} > 0)")
    ranked = f"list_reverse_sort(list_filter([{', '.join(rows)}], lambda e: e.score > 0))"
    return ranked


def _clear(ranked: str, column: str) -> str:
    return f"CASE WHEN len({ranked}) = 1 OR {ranked}[1].score - {ranked}[2].score >= 1 THEN {ranked}[1].{column} END"


@query("X13_category_classifier", f"""
SELECT doc_id, CASE WHEN len(s) > 0 THEN {_clear('s', 'category')} WHEN {_clear('r', 'strong')} THEN {_clear('r', 'category')} END AS category
FROM (SELECT doc_id, {_category_sql('structured')} AS s, {_category_sql('raw')} AS r FROM (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS structured, lower(text) AS raw FROM v_invoice_text))""")
def category_classifier(t):
    return t.v_invoice_text.select(
        "doc_id", classify.classify_category(F.substring_index("text", "\n", 1), "text").alias("category"))


def file_category_sql(x: str, column: str) -> str:
    cases = []
    for rule in classify.rules_by_confidence():
        tests = list(rule.patterns) + [rf"(?i)\b{re.escape(k)}\b" for k in rule.keywords]
        value = f"'{rule.category}'" if column == "category" else f"{rule.confidence}e0"
        cases.append(f"WHEN {' OR '.join(f'regexp_matches({x}, {chr(39)}{p}{chr(39)})' for p in tests)} THEN {value}")
    return f"CASE {' '.join(cases)} END"


@query("X14_file_category", f"""
SELECT file_id, COALESCE({file_category_sql('filename', 'category')}, {file_category_sql('title', 'category')}, 'uncategorized') AS category,
  COALESCE({file_category_sql('filename', 'confidence')}, {file_category_sql('title', 'confidence')}, 0e0) AS confidence FROM v_chat_file""")
def file_category(t):
    return t.v_chat_file.select("file_id", classify.file_category("filename", "title").alias("m")).select(
        "file_id", "m.category", "m.confidence")


@query("S05_rules_table", f"""
SELECT category, confidence, COUNT(*) AS attachments FROM (SELECT COALESCE({file_category_sql('filename', 'category')}, 'uncategorized') AS category, COALESCE({file_category_sql('filename', 'confidence')}, 0e0) AS confidence FROM v_attachment) GROUP BY ALL""")
def rules_table(t):
    return t.v_attachment.select(classify.file_category("filename").alias("m")).groupBy(
        F.col("m.category").alias("category"), F.col("m.confidence").alias("confidence")).agg(
        F.count("*").alias("attachments"))


_EXT = "lower(regexp_extract(filename, '(?s)\\.([^.]*)$', 1))"
FILTER_SQL = f"""CASE WHEN size < 20480 THEN 'too_small' WHEN {_EXT} IN ('ics', 'vcf', 'p7s', 'asc', 'gif') THEN 'denied_extension'
  WHEN {_EXT} NOT IN ('pdf', 'jpg', 'jpeg', 'png', 'xlsx', 'xls', 'csv', 'docx', 'doc') THEN 'extension_not_allowed' END"""


@query("X15_attachment_filter", f"SELECT message_id, {FILTER_SQL} AS skipped FROM v_attachment")
def attachment_filter(t):
    return t.v_attachment.select("message_id", classify.attachment_filter("filename", "size").alias("skipped"))


@query("X17_arithmetic_checks", """
SELECT item_id, CASE WHEN qty IS NULL OR rate IS NULL OR amount IS NULL THEN 'not_checked' WHEN abs(qty * rate - amount) <= 0.02e0 * greatest(abs(amount), 1e0) THEN 'pass' ELSE 'fail' END AS line_check,
  CASE WHEN amount IS NULL THEN NULL ELSE abs(price + price * tax_rate - COALESCE(discount, 0e0) - amount) <= 0.02e0 * greatest(abs(amount), 1e0) END AS totals_pass,
  list_min([abs(price * tax_rate / price - r) for r in [0e0, 0.05e0, 0.08e0, 0.10e0, 0.13e0, 0.15e0, 0.16e0, 0.17e0, 0.18e0]]) <= 0.01e0 AS tax_rate_plausible,
  amount / (price - price * discount_rate) BETWEEN 0.2e0 AND 5e0 AS magnitude_plausible
FROM (SELECT *, CASE WHEN position % 2 = 0 THEN price * tax_rate END AS discount FROM v_item)""")
def arithmetic_checks(t):
    rows = t.v_item.withColumn("discount", F.when(F.col("position") % 2 == 0, F.col("price") * F.col("tax_rate")))
    tax = F.col("price") * F.col("tax_rate")
    reference = checks.reference_amount("price", F.lit(None).cast("double"), F.col("price") * F.col("discount_rate"),
                                        F.lit(None).cast("double"))
    return rows.select("item_id", checks.line_item_check("qty", "rate", "amount").alias("line_check"),
                       checks.totals_check("price", tax, "discount", "amount").alias("totals_pass"),
                       checks.tax_rate_plausible("price", tax).alias("tax_rate_plausible"),
                       checks.magnitude_plausible("amount", reference).alias("magnitude_plausible"))


@query("X17_date_plausible", f"SELECT invoice_id, invoice_date <= DATE '{AS_OF}' AND invoice_date >= DATE '{AS_OF}' - INTERVAL 730 DAY AS date_plausible FROM v_purchase")
def date_plausible(t):
    return t.v_purchase.select("invoice_id", checks.date_plausible("invoice_date", AS_OF).alias("date_plausible"))


_METHODS = """CASE position % 5 WHEN 0 THEN 'label_anchor+pattern' WHEN 1 THEN 'label_anchor' WHEN 2 THEN 'positional_fallback' WHEN 3 THEN 'computed' ELSE 'not_found' END"""


@query("X18_field_confidence_status", f"""
SELECT item_id, confidence, CASE WHEN amount IS NULL THEN 'NOT_FOUND' WHEN confidence < 0.5 THEN 'UNCERTAIN' ELSE 'FOUND' END AS status FROM (
  SELECT item_id, amount, (tax_rate * 10e0 + CASE {_METHODS} WHEN 'label_anchor+pattern' THEN 1e0 WHEN 'label_anchor' THEN 0.7e0 WHEN 'positional_fallback' THEN 0.5e0 ELSE 0e0 END) / 2 AS confidence FROM v_item)""")
def field_confidence_status(t):
    rows = t.v_item.withColumn("method", F.expr(_METHODS))
    confidence = checks.field_confidence(F.col("tax_rate") * 10.0, "method")
    return rows.select("item_id", confidence.alias("confidence"),
                       checks.field_status(F.col("amount").isNotNull(), confidence).alias("status"))


@query("X19_route", """
SELECT item_id, CASE WHEN amount IS NULL OR score < 0.4 THEN 'needs_review_high_priority' WHEN score < 0.75 OR ok IS FALSE THEN 'needs_review' ELSE 'auto_processed' END AS route FROM (
  SELECT item_id, amount, quantity / 50e0 AS score, abs(qty * rate - amount) <= 0.02e0 * greatest(abs(amount), 1e0) AS ok FROM v_item)""")
def route(t):
    ok = checks.close_enough(F.col("qty") * F.col("rate"), F.col("amount"))
    return t.v_item.select("item_id", checks.route(F.col("quantity") / 50.0, F.col("amount").isNotNull(), ok)
                           .alias("route"))


@query("X20_duplicate_key", f"""
SELECT invoice_id, {_normalize_sql('vendor_name')} AS vendor, lower(trim(invoice_number)) AS number, round(total, 2) AS total, CAST(invoice_date AS VARCHAR) AS day FROM v_purchase""")
def duplicate_key(t):
    return t.v_purchase.select("invoice_id", text.duplicate_key("vendor_name", "invoice_number", "total",
                                                                "invoice_date").alias("k")).select("invoice_id", "k.*")


@query("X21_key_for_label", """
SELECT snippet_id, trim(regexp_replace(regexp_replace(lower(trim(label_text, ' :#-.' || chr(9))), '[&/]', ' ', 'g'), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM v_snippet""")
def key_for_label(t):
    return t.v_snippet.select("snippet_id", text.key_for_label("label_text").alias("key"))


@query("X22_looks_like_amount", """
SELECT snippet_id, regexp_matches(money_text, '(?i)(?:rs\\.?|pkr|\\$|usd)\\s*-?[0-9][0-9,]*(?:\\.[0-9]{1,2})?|-?[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]{1,2})?|-?[0-9]+\\.[0-9]{1,2}')
  AND NOT regexp_matches(regexp_replace(trim(money_text), '(?i)^\\s*(?:rs\\.?|pkr|usd|\\$)\\s*', ''), '\\pL') AS specific FROM v_snippet""")
def looks_like_amount(t):
    return t.v_snippet.select("snippet_id", text.looks_like_amount("money_text").alias("specific"))


def _starts_sql(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


_LOW = "lower(trim(line_text))"
_BARE = f"rtrim({_LOW}, '.!')"
_REFERENCE_SQL = f"""({_starts_sql(_LOW, text.REFERENCE_PREFIXES)} OR {_find_date_sql('line_text')} IS NOT NULL
  OR COALESCE(length(regexp_replace({_LOW}, '[^0-9]', '', 'g')) / NULLIF(length(regexp_replace({_LOW}, '[^\\pL\\pN]', '', 'g')), 0) > 0.5, TRUE))"""
_DECOR_SQL = f"""({_starts_sql(_BARE, text.PROVIDER_CREDITS)} OR {_BARE} IN ({', '.join(repr(p) for p in text.FULFILMENT_PHRASES)})
  OR (contains({_BARE}, 'thank you') AND (contains({_BARE}, 'visit again') OR contains({_BARE}, 'come again'))))"""
_NOISE_SQL = f"""({_DECOR_SQL} OR {_starts_sql(_LOW, text.HOLDER_PREFIXES)} OR regexp_matches(trim(line_text), '^\\S+@\\S+\\.\\S+$')
  OR (contains({_LOW}, ',') AND regexp_matches({_LOW}, '(?:^|[^a-z])(?:{'|'.join(text.ADDRESS_WORDS)})(?:[^a-z]|$)'))
  OR {_BARE} IN ({', '.join(repr(p) for p in text.DOCUMENT_TITLES)}) OR regexp_matches({_LOW}, '^(?:dear|hi|hello)\\b') OR {_REFERENCE_SQL})"""


@query("X23_vendor_line_noise", f"SELECT snippet_id, {_NOISE_SQL} AS noise FROM v_snippet")
def vendor_line_noise(t):
    return t.v_snippet.select("snippet_id", text.vendor_line_noise("line_text").alias("noise"))

"""Duplicates, and decision logs applied to ledger tables.

A reviewer's single-row edits become a log; a batch run reduces the log to the
decision that counts per row (a maximum per id, combined inside tasks) and
left-joins it to the ledger once. Ids are unique on both sides, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.core import money_sum
from ledgerloom.functions.text import duplicate_key, normalize_vendor
from ledgerloom.operators.aggregates import COMPANY
from ledgerloom.operators.joins import bulk_link_vendor
from ledgerloom.operators.skew import splittable_join


def latest(log: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last entry per key by ``order``; later columns of ``order`` break ties."""
    return (log.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("last"))
            .select(*keys, *[F.col(f"last.{v}").alias(v) for v in values]))


# ------------------------------------------------------------------- duplicates


def exact_duplicates(uploads: DataFrame) -> DataFrame:
    """Same company and content hash. One row per group with the row that stays
    and how many copies there are: a group of copies is only ever counted."""
    return (uploads.withColumn("file_hash", F.sha2(F.col("content"), 256)).groupBy(COMPANY, "file_hash")
            .agg(F.min("upload_id").alias("kept_id"), F.count("*").alias("copies")).where(F.col("copies") > 1))


def exact_duplicate_members(uploads: DataFrame) -> DataFrame:
    """Every upload of a group of copies with the one that stays, as long rows."""
    hashed = uploads.select(COMPANY, "upload_id", F.sha2(F.col("content"), 256).alias("file_hash"))
    groups = exact_duplicates(uploads).select(COMPANY, "file_hash", "kept_id")
    return splittable_join(hashed, groups, [COMPANY, "file_hash"])


def likely_duplicates(invoices: DataFrame) -> DataFrame:
    """Same vendor (normalised), number, total and date under different ids."""
    keyed = invoices.withColumn("k", duplicate_key("vendor_name", "invoice_number", "total", "invoice_date"))
    complete = keyed.where(F.col("vendor_name").isNotNull() & F.col("invoice_number").isNotNull()
                           & F.col("total").isNotNull() & F.col("invoice_date").isNotNull())
    return (complete.groupBy(COMPANY, "k.vendor", "k.number", "k.total", "k.day")
            .agg(F.count("*").alias("copies"), F.min("invoice_id").alias("kept_id")).where(F.col("copies") > 1))


def vendor_clusters(invoices: DataFrame) -> DataFrame:
    """Raw spellings grouped by normalised name. Distinct spellings are reduced
    first, so a name on a third of all invoices reaches the shuffle once per task."""
    spellings = (invoices.where(F.trim(F.col("vendor_name")) != "")
                 .groupBy(COMPANY, normalize_vendor("vendor_name").alias("normalized"), "vendor_name")
                 .agg(F.count("*").alias("n")))
    return spellings.groupBy(COMPANY, "normalized").agg(
        F.count("*").alias("spellings"), F.sum("n").alias("invoices"), F.min("vendor_name").alias("example"))


# ---------------------------------------------------------------- decision logs


def apply_validate_reject(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    log = decisions.where(F.col("action").isin("validate", "reject"))
    last = latest(log, ["invoice_id"], ["decided_at", "action"], ["action"])
    status = F.when(F.col("action") == "validate", "validated").when(F.col("action") == "reject", "rejected")
    return (invoices.join(last, "invoice_id", "left").withColumn("status", F.coalesce(status, F.col("status")))
            .drop("action"))


def apply_reclassify(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    """Move rows between transactional and not. The amount moves with the row
    only when its status really changes; the audit JSON is never touched."""
    last = latest(decisions, ["invoice_id"], ["decided_at", "target"], ["target"])
    joined = invoices.join(last, "invoice_id", "left")
    changed = F.col("target") != F.col("transaction_status")
    promoted = changed & (F.col("target") == "transactional") & F.col("total").isNull() \
        & F.col("amount_mentioned").isNotNull()
    demoted = changed & (F.col("target") == "non_transactional")
    moved_out = demoted & F.col("amount_mentioned").isNull() & F.col("total").isNotNull()
    none = F.lit(None)
    return joined.withColumns({
        "total": F.when(promoted, F.col("amount_mentioned")).when(moved_out, none).otherwise(F.col("total")),
        "amount_mentioned": F.when(promoted, none).when(moved_out, F.col("total"))
        .otherwise(F.col("amount_mentioned")),
        "category": F.when(demoted, none).otherwise(F.col("category")),
        "transaction_status": F.coalesce("target", "transaction_status"),
        "classification_source": F.when(F.col("target").isNotNull(), "user_override").otherwise(
            F.col("classification_source")),
    }).drop("target")


def apply_send_to_accounting(invoices: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each requested row with its outcome: ``sent`` or a violation of the guard."""
    wanted = decisions.where(F.col("action") == "send").select("invoice_id").distinct()
    allowed = F.col("status").isin("processed", "validated")
    return invoices.join(wanted, "invoice_id", "left_semi").withColumns({
        "outcome": F.when(allowed, "sent").otherwise("needs review or validation first"),
        "status": F.when(allowed, "sent_to_accounting").otherwise(F.col("status"))})


def apply_corrections(invoices: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply only supplied fields. ``patches`` carries ``fields`` maps with the time
    ``patched_at``; of several patches of an invoice the last that names a field counts
    for it. An absent key leaves the column alone, a present key with a null value
    clears it. Status moves only between the two saved states."""
    fields = patches.select("invoice_id", "patched_at", F.explode("fields").alias("field", "value"))
    last = fields.groupBy("invoice_id", "field").agg(F.max(F.struct("patched_at", "value")).alias("last"))
    merged = last.groupBy("invoice_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "last.value"))).alias("fields"))
    joined = invoices.join(merged, "invoice_id", "left")
    saved = F.col("status").isin("validated", "sent_to_accounting")

    def patched(column: str, kind: str, guard: Column | None = None) -> Column:
        supplied = F.coalesce(F.map_contains_key("fields", F.lit(column)), F.lit(False))
        if guard is not None:
            supplied = supplied & guard
        return F.when(supplied, F.try_element_at("fields", F.lit(column)).try_cast(kind)).otherwise(F.col(column))

    refused = F.coalesce(F.map_contains_key("fields", F.lit("status")), F.lit(False)) & ~saved
    return joined.withColumns({
        "vendor_name": patched("vendor_name", "string"), "category": patched("category", "string"),
        "total": patched("total", "double"), "payment_method": patched("payment_method", "string"),
        "invoice_date": patched("invoice_date", "date"), "status": patched("status", "string", saved),
        "status_refused": refused}).drop("fields")


def replace_items(items: DataFrame, replacements: DataFrame) -> DataFrame:
    """Supplied item lists replace all items of their invoice."""
    touched = replacements.select("invoice_id").distinct()
    kept = items.join(touched, "invoice_id", "left_anti")
    fresh = replacements.withColumn("arithmetic_check", F.lit("not_checked"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def apply_expense_decisions(expenses: DataFrame, decisions: DataFrame) -> DataFrame:
    last = latest(decisions, ["expense_id"], ["decided_at", "action"], ["action"])
    status = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected")
    return (expenses.join(last, "expense_id", "left").withColumn("status", F.coalesce(status, F.col("status")))
            .drop("action"))


def apply_request_decisions(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests move only out of ``pending_approval``; others report a refusal."""
    last = latest(decisions, ["request_id"], ["decided_at", "action"], ["action"])
    pending = F.col("status") == "pending_approval"
    new = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected")
    return requests.join(last, "request_id", "left").withColumns({
        "refused": new.isNotNull() & ~pending,
        "status": F.when(pending, F.coalesce(new, F.col("status"))).otherwise(F.col("status"))}).drop("action")


def book_payroll(to_process: DataFrame, expenses: DataFrame, as_of_day: Column) -> DataFrame:
    """One Salaries expense per company and period for what a payroll run adds.
    Idempotent: a reference that is booked already books nothing."""
    run = to_process.groupBy(COMPANY, "period").agg(money_sum("net_salary").alias("amount"))
    run = run.withColumn("reference_id", F.concat(F.lit("PAYROLL-"), "period"))
    booked = expenses.where(F.col("source") == "payroll").select(COMPANY, "reference_id")
    return run.join(booked, [COMPANY, "reference_id"], "left_anti").select(
        COMPANY, F.lit("Salaries").alias("category"), F.concat(F.lit("Payroll — "), "period").alias("vendor_name"),
        as_of_day.alias("expense_date"), "amount", F.lit("approved").alias("status"),
        F.lit("payroll").alias("source"), "reference_id")


def create_vendors(wanted: DataFrame, vendors: DataFrame) -> DataFrame:
    """New vendor rows; a name the company has already is left out."""
    fresh = wanted.groupBy(COMPANY, "name").agg(F.min("vendor_id").alias("vendor_id"))
    return fresh.join(vendors.select(COMPANY, "name"), [COMPANY, "name"], "left_anti")


def create_and_link(invoices: DataFrame, wanted: DataFrame, vendors: DataFrame) -> DataFrame:
    """Create vendors and link every purchase carrying the name they were created from.
    ``wanted``: company, name, vendor_id and, where a vendor gets a name of its own, the
    ``raw_name`` printed on the purchases; several raw names may become one vendor. Of a
    raw name that is wanted under several names the vendor of smallest id gets it."""
    created = create_vendors(wanted, vendors).withColumnRenamed("vendor_id", "nv")
    rows = invoices.where(F.col("vendor_id").isNull())
    raw = wanted.select(COMPANY, "name", (F.coalesce("raw_name", "name") if "raw_name" in wanted.columns else F.col("name")).alias("vendor_name"))
    named = raw.distinct().join(created, [COMPANY, "name"]).groupBy(COMPANY, "vendor_name").agg(F.min("nv").alias("nv"))
    links = splittable_join(rows, named, [COMPANY, "vendor_name"]).select(COMPANY, "invoice_id",
                                                                          F.col("nv").alias("vendor_id"))
    return bulk_link_vendor(invoices, links)


def ignore_names(ignored: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    return (ignored.select(COMPANY, "vendor_name").union(added.select(COMPANY, "vendor_name")).distinct()
            .join(removed.select(COMPANY, "vendor_name"), [COMPANY, "vendor_name"], "left_anti"))


def soft_delete(rows: DataFrame, deletions: DataFrame, keys: list[str]) -> DataFrame:
    """Rows stay; the first deletion sets the time."""
    when = deletions.groupBy(*keys).agg(F.min("deleted_at").alias("new_deleted_at"))
    return (rows.join(when, keys, "left").withColumn("deleted_at", F.coalesce("deleted_at", "new_deleted_at"))
            .drop("new_deleted_at"))


def sender_rules_from_reviews(rules: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rules after review decisions: per account and pattern the last action
    wins, and an account's existing rule stands until a review changes it."""
    address = F.lower(F.trim("from_address"))
    pattern = F.when(F.col("scope") == "address", address).otherwise(F.substring_index(address, "@", -1))
    implied = reviews.where(F.col("scope").isNotNull() & F.col("from_address").isNotNull()).select(
        "account_id", pattern.alias("pattern"), "action", F.col("reviewed_at").alias("at")) \
        .where(F.col("pattern") != "")
    existing = rules.select("account_id", "pattern", "action", F.lit(None).cast("timestamp_ntz").alias("at"))
    return latest(existing.unionByName(implied), ["account_id", "pattern"], ["at", "action"], ["action"])


def all_outflows(manual: DataFrame, from_invoices: DataFrame, from_payroll: DataFrame) -> DataFrame:
    """Approved outflows of every origin in one shape."""
    columns = [COMPANY, "source", "category", "vendor_name", "expense_date", "amount"]
    approved = manual.where(F.col("status") == "approved").select(*columns)
    return approved.unionByName(from_invoices.select(*columns)).unionByName(from_payroll.select(*columns))

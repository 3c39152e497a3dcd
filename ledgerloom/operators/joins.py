"""Joins between ledger entities. No join carries a broadcast hint: Spark
broadcasts a side only when its size (estimated, or measured by AQE) is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, where AQE
splits a hot key's partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.core import lookup
from ledgerloom.functions.predicates import PAYMENT_METHOD_MAP, day, error_hint
from ledgerloom.operators.aggregates import COMPANY
from ledgerloom.operators.skew import splittable_join

DEFAULT_EXPENSE_CATEGORY = "Raw Material"


def vendor_with_spend(vendors: DataFrame, spend: DataFrame) -> DataFrame:
    numbers = spend.select(COMPANY, "vendor_id", "total_spend", "invoice_count")
    return vendors.join(numbers, [COMPANY, "vendor_id"], "left").na.fill(0, ["total_spend", "invoice_count"])


def paid_flag(employees: DataFrame, payroll: DataFrame, as_of) -> DataFrame:
    period = F.date_format(day(as_of), "yyyy-MM")
    paid = payroll.where(F.col("period") == period).select(COMPANY, "employee_id", F.lit(True).alias("is_paid"))
    return (employees.join(paid, [COMPANY, "employee_id"], "left")
            .withColumn("payroll_status", F.when(F.col("is_paid"), "paid").otherwise("pending")).drop("is_paid"))


def payroll_to_process(employees: DataFrame, payroll: DataFrame, as_of) -> DataFrame:
    """Snapshot rows for active employees this period has not paid yet."""
    period = F.date_format(day(as_of), "yyyy-MM")
    paid = payroll.where(F.col("period") == period).select(COMPANY, "employee_id")
    return (employees.where("active").join(paid, [COMPANY, "employee_id"], "left_anti")
            .select(COMPANY, "employee_id", period.alias("period"), "salary", "bonus", "deductions",
                    F.round(F.col("salary") + F.col("bonus") - F.col("deductions"), 2).alias("net_salary")))


def book_expenses(invoices: DataFrame, expenses: DataFrame, as_of) -> DataFrame:
    """Expense rows for purchases sent to accounting that no expense covers yet."""
    sent = invoices.where((F.col("type") == "purchase") & (F.col("status") == "sent_to_accounting"))
    booked = expenses.where(F.col("invoice_id").isNotNull()).select(COMPANY, "invoice_id")
    return sent.join(booked, [COMPANY, "invoice_id"], "left_anti").select(
        COMPANY, "invoice_id", F.lit(DEFAULT_EXPENSE_CATEGORY).alias("category"), "vendor_name", "vendor_id",
        F.coalesce("invoice_date", day(as_of)).alias("expense_date"),
        F.coalesce("total", F.lit(0.0)).alias("amount"),
        lookup(F.coalesce("payment_method", F.lit("")), PAYMENT_METHOD_MAP).alias("payment_method"),
        F.lit("approved").alias("status"), F.lit("invoice").alias("source"),
        F.col("invoice_number").alias("reference_id"))


def attachment_messages(attachments: DataFrame, messages: DataFrame) -> DataFrame:
    return attachments.join(messages, ["account_id", "message_id"], "inner")


def request_timeline(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """Three or four ordered steps per request. The earliest order is a minimum
    over a struct, so a request with any number of orders needs no sort."""
    first = orders.where(F.col("request_id").isNotNull()).groupBy(COMPANY, "request_id").agg(F.min(F.struct(
        "created_at", "order_id", "vendor_name", "status", "updated_at")).alias("o"))
    joined = requests.join(first, [COMPANY, "request_id"], "left")
    decided = F.col("status") != "pending_approval"
    no_date = F.lit(None).cast("timestamp_ntz")

    def step(title: str, detail: Column, when: Column, done: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), detail.alias("detail"), when.alias("step_date"),
                        done.alias("completed"))

    submitted = step("Request submitted", F.concat_ws(" · ", "department", "requester_name"), F.col("created_at"),
                     F.lit(True))
    decision = step("Approval decision",
                    F.when(F.col("status") == "approved", "Approved").when(F.col("status") == "rejected", "Rejected")
                    .otherwise("Awaiting approval"), F.when(decided, F.col("updated_at")).otherwise(no_date), decided)
    delivered = F.col("o.status") == "delivered"
    issued = step("Purchase order issued", F.col("o.vendor_name"), F.col("o.created_at"), F.lit(True))
    arrived = step("Delivered", F.when(delivered, F.col("o.vendor_name")).otherwise("Not yet delivered"),
                   F.when(delivered, F.col("o.updated_at")).otherwise(no_date), delivered)
    open_step = step("Purchase order issued", F.lit("Not yet issued"), no_date, F.lit(False))
    steps = F.when(F.col("o").isNull(), F.array(submitted, decision, open_step)).otherwise(
        F.array(submitted, decision, issued, arrived))
    return joined.select(COMPANY, "request_id", F.posexplode(steps).alias("step", "s")).select(
        COMPANY, "request_id", "step", "s.*")


def file_audit(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Remote listing against stored files: rows on one side only and fields
    that differ. A file is known by its installation and id. A remote size or type
    counts only when it says something."""
    keys = ["installation_id", "file_id"]
    remote = listing.select(*keys, F.struct("size", "mimetype", "is_external").alias("r"))
    local = stored.select(*keys, F.struct("size", "mimetype", "is_external").alias("l"))
    both = remote.join(local, keys, "full_outer")
    stale = F.array_compact(F.array(
        F.when((F.col("r.size") != 0) & ~F.col("r.size").eqNullSafe(F.col("l.size")), "size"),
        F.when((F.col("r.mimetype") != "") & ~F.col("r.mimetype").eqNullSafe(F.col("l.mimetype")), "mimetype"),
        F.when(~F.coalesce("r.is_external", F.lit(False)).eqNullSafe(F.col("l.is_external")), "is_external")))
    finding = (F.when(F.col("l").isNull(), "list_only").when(F.col("r").isNull(), "store_only")
               .when(F.size(stale) > 0, "stale_metadata"))
    return (both.withColumn("finding", finding).where(F.col("finding").isNotNull())
            .select(*keys, "finding",
                    F.when(F.col("finding") == "stale_metadata", stale).otherwise(F.array().cast("array<string>"))
                    .alias("fields"),
                    F.col("r.size").alias("listed_size"), F.col("l.size").alias("stored_size")))


def new_scans_only(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads whose content the company has not stored, once per content. Runs
    before extraction; both sides are reduced to distinct hashes inside each
    task first, so a content copied a billion times ships one row per task."""
    hashed = lambda df: df.withColumn("file_hash", F.sha2(F.col("content"), 256))
    fresh = hashed(batch).groupBy(COMPANY, "file_hash").agg(
        F.min("upload_id").alias("upload_id"), F.count("*").alias("copies"))
    known = hashed(stored).select(COMPANY, "file_hash").distinct()
    return fresh.join(known, [COMPANY, "file_hash"], "left_anti")


def scan_outcomes(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Every upload with the stored row of the same content (``existing_id``, null when
    it is new) and the upload of the batch that stands for its copies (``kept_id``)."""
    hashed = lambda df: df.select(COMPANY, "upload_id", F.sha2(F.col("content"), 256).alias("file_hash"))
    fresh, known = hashed(batch), hashed(stored).groupBy(COMPANY, "file_hash").agg(F.min("upload_id").alias("existing_id"))
    kept = fresh.groupBy(COMPANY, "file_hash").agg(F.min("upload_id").alias("kept_id"))
    outcome = kept.join(known, [COMPANY, "file_hash"], "left")
    return splittable_join(fresh, outcome, [COMPANY, "file_hash"]).select(COMPANY, "upload_id", "existing_id", "kept_id")


def bulk_link_vendor(invoices: DataFrame, links: DataFrame) -> DataFrame:
    """Set the vendor on listed purchases of the same company; other ids are ignored."""
    mapping = links.select(COMPANY, "invoice_id", F.col("vendor_id").alias("new_vendor_id"))
    linked = F.when(F.col("type") == "purchase", F.coalesce("new_vendor_id", "vendor_id")).otherwise(
        F.col("vendor_id"))
    return (invoices.join(mapping, [COMPANY, "invoice_id"], "left").withColumn("vendor_id", linked)
            .drop("new_vendor_id"))


def conversation_counts(conversations: DataFrame, files: DataFrame, include_deleted: bool = True) -> DataFrame:
    rows = files if include_deleted else files.where(F.col("deleted_at").isNull())
    counts = rows.groupBy("conversation_id").agg(F.count("*").alias("file_count"))
    return (conversations.join(counts, "conversation_id", "left").na.fill(0, ["file_count"])
            .withColumn("needs_attention", F.col("last_error").isNotNull())
            .withColumn("last_error_hint", error_hint("last_error")))


def sender_verdicts(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Winning rule action per message. A rule names a full address or a bare
    domain. Spellings of one pattern are first reduced to one rule, so two left
    equi-joins find both without exploding messages or grouping them again; deny
    beats allow, among spellings and between address and domain.
    A sender with a third of all mail is a hot left key, which AQE splits."""
    cleaned = rules.select("account_id", F.lower(F.trim("pattern")).alias("pattern"), "action") \
                   .where(F.col("pattern") != "").groupBy("account_id", "pattern") \
                   .agg(F.max("action").alias("most"), F.bool_or(F.col("action") == "deny").alias("denied")) \
                   .select("account_id", "pattern", F.when(F.col("denied"), "deny").otherwise(F.col("most")).alias("action"))
    address = F.lower(F.trim("from_address"))
    domain = F.when(address.contains("@"), F.substring_index(address, "@", -1))
    keyed = messages.withColumn("address_key", F.when(address.contains("@"), address)).withColumn("domain_key", domain)
    full = cleaned.where(F.col("pattern").contains("@")).select(
        "account_id", F.col("pattern").alias("address_key"), F.col("action").alias("address_action"))
    bare = cleaned.where(~F.col("pattern").contains("@")).select(
        "account_id", F.col("pattern").alias("domain_key"), F.col("action").alias("domain_action"))
    joined = keyed.join(full, ["account_id", "address_key"], "left").join(bare, ["account_id", "domain_key"], "left")
    actions = F.array("address_action", "domain_action")
    verdict = (F.when(F.exists(actions, lambda a: F.coalesce(a == "deny", F.lit(False))), "deny")
               .when(F.exists(actions, lambda a: F.coalesce(a == "allow", F.lit(False))), "allow"))
    return joined.withColumn("verdict", verdict).drop("address_key", "domain_key", "address_action", "domain_action")


def orders_needing_approval(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """Orders placed against a request that is not approved (or does not exist)."""
    approved = requests.where(F.col("status") == "approved").select(COMPANY, "request_id")
    return orders.where(F.col("request_id").isNotNull()).join(approved, [COMPANY, "request_id"], "left_anti")


def undeletable_employees(employees: DataFrame, payroll: DataFrame) -> DataFrame:
    return employees.join(payroll.select(COMPANY, "employee_id"), [COMPANY, "employee_id"], "left_semi")


def known_vendors(invoices: DataFrame) -> DataFrame:
    return invoices.where(F.col("vendor_name").isNotNull()).select(COMPANY, "vendor_name").distinct()


def due_accounts(accounts: DataFrame, jobs: DataFrame) -> DataFrame:
    busy = jobs.where(F.col("status").isin("queued", "running")).select("account_id")
    return accounts.where(F.col("status") == "active").join(busy, "account_id", "left_anti")

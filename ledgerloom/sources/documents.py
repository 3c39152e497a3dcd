"""Nested document data into flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.core import ColumnLike, c, present, strip
from ledgerloom.functions.predicates import scanner_eligible
from ledgerloom.sources import schemas

DEFAULT_FOUND_CONFIDENCE = 0.5


def with_extraction(invoices: DataFrame, column: str = "raw_extraction_json") -> DataFrame:
    """Parse the audit blob once. A null blob (never extracted) stays null."""
    return invoices.withColumn("extraction", F.from_json(F.col(column), schemas.EXTRACTION_JSON))


def _entries(fields: tuple[str, ...], entry) -> Column:
    return F.array_compact(F.array(*[entry(name, F.col(f"extraction.{name}")) for name in fields]))


def field_confidence() -> Column:
    """Confidence per resolved field; an unresolved field has no entry at all."""
    return F.map_from_entries(_entries(schemas.CONFIDENCE_FIELDS, lambda name, f: F.when(
        f["value"].isNotNull() & f["confidence"].isNotNull(),
        F.struct(F.lit(name).alias("key"), f["confidence"].alias("value")))))


def field_locations() -> Column:
    return F.map_from_entries(_entries(schemas.CONFIDENCE_FIELDS, lambda name, f: F.when(
        f["value"].isNotNull() & f["bbox"].isNotNull() & f["page"].isNotNull(),
        F.struct(F.lit(name).alias("key"), F.struct(f["page"].alias("page"), f["bbox"].alias("bbox"))
                 .alias("value")))))


def extracted_fields() -> Column:
    """Value and status of the document-wide detections that found something."""
    def entry(name: str, f: Column) -> Column:
        confidence = F.coalesce(f["confidence"], F.lit(0.0))
        status = F.coalesce(present(f["status"]), F.when(confidence >= DEFAULT_FOUND_CONFIDENCE, "FOUND")
                            .otherwise("UNCERTAIN"))
        return F.when(f["value"].isNotNull(), F.struct(
            F.lit(name).alias("key"), F.struct(f["value"].alias("value"), confidence.alias("confidence"),
                                               status.alias("status")).alias("value")))

    return F.map_from_entries(_entries(schemas.EXTRACTED_FIELDS, entry))


def dynamic_fields() -> Column:
    found = F.filter(F.col("extraction.dynamic_fields"),
                     lambda e: present(e["key"]).isNotNull() & e["value"].isNotNull())
    cleaned = F.transform(found, lambda e: F.struct(
        e["key"].alias("key"), F.coalesce(e["label"], e["key"]).alias("label"), e["value"].alias("value"),
        F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"), e["page"].alias("page"),
        e["bbox"].alias("bbox")))
    return F.coalesce(cleaned, F.array().cast(cleaned_type()))


def cleaned_type() -> str:
    return ("array<struct<key:string,label:string,value:string,confidence:double,page:int,bbox:array<double>>>")


def extraction_views(invoices: DataFrame) -> DataFrame:
    """Reviewer-facing maps and scalars out of the audit blob."""
    return with_extraction(invoices).select(
        "*", field_confidence().alias("field_confidence"), field_locations().alias("field_locations"),
        extracted_fields().alias("extracted_fields"), dynamic_fields().alias("dynamic_fields"),
        F.coalesce(F.col("extraction.page_dimensions"), F.array().cast("array<array<double>>"))
        .alias("page_dimensions"),
        F.col("extraction.document_type.value").alias("detected_document_type"),
        F.col("extraction.classification_reason").alias("classification_reason")).drop("extraction")


def words_from_pages(results: DataFrame) -> DataFrame:
    """Pages of words to one row per word, keyed (doc_id, page, word_idx)."""
    pages = results.select("doc_id", F.posexplode("words_by_page").alias("page", "page_words"))
    return (pages.select("doc_id", "page", F.posexplode("page_words").alias("word_idx", "w"))
            .select("doc_id", "page", "word_idx", "w.text", "w.x0", "w.y0", "w.x1", "w.y1", "w.confidence",
                    "w.font_size"))


def header_value(headers: ColumnLike, name: str) -> Column:
    return F.try_element_at(c(headers), F.lit(name))


KEPT_HEADERS = ("From", "Subject", "To", "Date")


def kept_headers(headers: ColumnLike) -> Column:
    return F.map_filter(c(headers), lambda k, v: k.isin(*KEPT_HEADERS))


def mailbox_address(header: Column) -> Column:
    """``Name <addr>`` or a bare address; anything else is null."""
    bracketed = F.regexp_extract(header, r"<\s*([^<>\s]+)\s*>", 1)
    bare = F.regexp_extract(header, r"^\s*([^<>\s\"]+@[^<>\s\"]+)\s*$", 1)
    return F.coalesce(present(bracketed), present(bare))


def mailbox_name(header: Column) -> Column:
    before = strip(F.regexp_extract(header, r"^([^<]*)<[^<>]+>", 1))
    return present(strip(F.regexp_replace(before, r"^\"|\"$", "")))


def message_headers(messages: DataFrame) -> DataFrame:
    """Keep the four useful headers and split the mailboxes."""
    kept = messages.withColumn("headers", kept_headers("headers"))
    sender, receiver = header_value("headers", "From"), header_value("headers", "To")
    return kept.select("*", mailbox_name(sender).alias("from_name"), mailbox_address(sender).alias("from_address"),
                       mailbox_address(receiver).alias("to_address"),
                       header_value("headers", "Subject").alias("subject"))


def feed_attachments(feed: DataFrame) -> DataFrame:
    """One row per attachment. The position inside the message is the identity;
    the provider's attachment id changes on every fetch and is only carried."""
    return message_headers(feed).select(
        "account_id", "message_id", "thread_id", "received_at", "from_name", "from_address", "to_address", "subject",
        F.posexplode("attachments").alias("attachment_index", "a")).select(
        "account_id", "message_id", "thread_id", "received_at", "from_name", "from_address", "to_address", "subject",
        "attachment_index", F.col("a.filename").alias("filename"), F.col("a.mimetype").alias("mimetype"),
        F.col("a.size").alias("size"), F.col("a.attachment_id").alias("provider_attachment_id"))


def thread_attachments(messages: DataFrame) -> DataFrame:
    """Files of a message and of its replies; a reply's files carry the parent's
    timestamp as their thread. The parent repeated among its replies is skipped."""
    file_columns = F.posexplode("files").alias("file_index", "f")
    top = messages.select("conversation_id", F.col("ts").alias("message_ts"), F.lit(None).cast("string")
                          .alias("thread_ts"), F.col("user").alias("shared_by"), file_columns)
    replies = (messages.select("conversation_id", "ts", F.explode("replies").alias("r"))
               .where(F.col("r.ts") != F.col("ts"))
               .select("conversation_id", F.col("r.ts").alias("message_ts"), F.col("ts").alias("thread_ts"),
                       F.col("r.user").alias("shared_by"), F.posexplode("r.files").alias("file_index", "f")))
    return top.unionByName(replies).select("conversation_id", "message_ts", "thread_ts", "shared_by", "file_index",
                                           "f.*")


def unified_documents(chat: DataFrame, mail: DataFrame, uploads: DataFrame) -> DataFrame:
    """One listing over three sources; a source without a notion leaves nulls."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in (("chat", chat), ("email", mail),
                                                                    ("browser", uploads))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.withColumn("scanner_eligible", scanner_eligible())

"""Benchmark decontamination by winnowing (operator 1), in built-in functions only.

Of every run of ``WIDTH - GRAM + 1`` word 5-grams the one with the smallest hash is a
fingerprint, so each window of ``WIDTH`` words holds one, the same in every text. Texts
that share a fingerprint with a benchmark item are found by a join on the hash; each
shared fingerprint is then extended to all windows around it, which are compared with
the items' windows word by word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import shared

WIDTH, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of a text lower-cased in A-Z; null and empty texts have none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


def gram_hash(hashes: list[Column]) -> Column:
    """Hash of a run of words from the words' own hashes."""
    mixed = hashes[0]
    for j, h in enumerate(hashes[1:], 1):
        mixed = mixed.bitwiseXOR(F.shiftleft(h, 3 * j))
    return F.xxhash64(mixed)


def hashed(rows: DataFrame) -> DataFrame:
    """``words`` of ``text`` with ``hashes`` of each and their number. Every step is a
    projection of its own: a list used twice in one expression would be built twice."""
    rows = rows.withColumn("words", word_list(F.col("text")))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return rows.withColumn("n_words", F.size("hashes").cast("long"))


def fingerprints(rows: DataFrame, keep: list[str], gram: int, run: int) -> DataFrame:
    """``keep``, p, mark: the least hash of each ``run`` of ``gram``-word runs, from p on,
    where it differs from that of the run before; and one row p = -1 for every text.

    Places are exploded from the list of word hashes, so that all arithmetic is compiled
    code; no row carries words."""
    width = gram + run - 1
    last = F.greatest(F.col("n_words").cast("int") - width, F.lit(-1))
    rows = rows.select(*keep, "hashes", F.explode(F.sequence(F.lit(-1), last)).alias("p"))
    rows = rows.select(*keep, "p", *[F.get("hashes", F.col("p") + j).alias(f"h{j + 1}") for j in range(-1, width)])
    rows = rows.select(*keep, "p", *[gram_hash([F.col(f"h{i + j}") for j in range(gram)]).alias(f"g{i}") for i in range(run + 1)])
    least = lambda first, n: F.least(*[F.col(f"g{i}") for i in range(first, first + n)]) if n > 1 else F.col(f"g{first}")
    # the task number keeps the filter above the hashes; below them it would compute each anew
    rows = rows.select(*keep, "p", least(1, run).alias("mark"), least(0, run).alias("before"), F.spark_partition_id().alias("task"))
    rows = rows.where((F.col("task") >= 0) & ((F.col("p") <= 0) | (F.col("mark") != F.col("before"))))
    return rows.select(*keep, "p", F.when(F.col("p") < 0, F.xxhash64(*keep)).otherwise(F.col("mark")).alias("mark"))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(item_id, size, window): every run of ``width`` words as text joined by spaces;
    an item with fewer words is one window, one without words none."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("item_id", word_list(F.col("text")).alias("words")).withColumn("size", F.least(F.size("words"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    return rows.where("size > 0").select("item_id", "size", "words", F.explode(starts).alias("at")) \
        .select("item_id", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("window")).distinct()


def shared_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(key, at, size, item_id): every place of a document (word ``at``, from 1) where a
    window of an item stands; and (key, doc_id, n_words) of all rows, from the one pass
    that reads and hashes the texts. ``docs``: key, doc_id, text."""
    windows = shared.stored(item_windows(items, width=width), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``width`` numbers
    lists, keep, found, rows = hashed(docs), ["key", "doc_id", "n_words"], [], None
    for size in [*[s for s in sizes if s != width], width]:
        # windows too short to be winnowed are their own only fingerprint
        unit, run = (gram, width - gram + 1) if size == width else (size, 1)
        own = windows.where(F.col("size") == size)
        marks = fingerprints(hashed(own.select("item_id", F.col("window").alias("text"))), ["item_id"], unit, run).where("p >= 0")
        marks = shared.stored(marks.select("mark", F.lit(True).alias("hit")).distinct(), "marks")
        picked = fingerprints(lists, keep, unit, run).join(marks, "mark", "left").where("hit OR p = -1")
        picked = shared.stored(picked.select(*keep, "p", "mark"), "picked")
        rows = picked.where("p = -1").select(*keep)
        hits = picked.where("p >= 0").groupBy("key").agg(F.collect_set("mark").alias("marks"))
        # extend: all windows around the places of shared fingerprints
        texts = hashed(docs.select("key", "text").join(shared.stored(hits, "hits"), "key")).where(F.col("n_words") >= size)
        starts = F.sequence(F.lit(0), F.size("hashes") - unit)
        texts = texts.select("key", "marks", "words", "hashes").withColumn(
            "grams", F.transform(starts, lambda i: gram_hash([F.get("hashes", i + j) for j in range(unit)])))
        places = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains(F.col("marks"), F.get("grams", i - 1)))
        texts = texts.select("key", "words", places.alias("places"))
        around = F.transform("places", lambda p: F.sequence(F.greatest(p - (size - unit), F.lit(1)), p))
        spans = texts.select("key", "words", F.explode(F.array_distinct(F.flatten(around))).alias("at")) \
            .where(F.col("at") <= F.size("words") - (size - 1)) \
            .select("key", "at", F.array_join(F.slice("words", F.col("at"), F.lit(size)), " ").alias("window"))
        found.append(spans.join(own.select("window", "item_id"), "window").select("key", "at", F.lit(size).alias("size"), "item_id"))
    return reduce(DataFrame.unionByName, found), rows


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                  gram: int = GRAM) -> DataFrame:
    """(key, doc_id, n_words, n_hit, n_items, item_ids, contaminated) per row of ``docs``.

    A word is hit if it lies inside any place where ``width`` consecutive words of an item
    (all words of a shorter one) stand. Null and empty texts have no words; items without
    words match nothing, a null item id is ignored in the list; equal rows get equal
    results; a null doc id stays null; other columns are ignored; empty tables give no
    rows or no hits. Item ids are listed as strings in string order."""
    places, rows = shared_spans(shared.keyed(docs, id_col, text_col), items, width, gram)
    hits = places.groupBy("key").agg(F.collect_set(F.struct("at", "size")).alias("spans"),
                                     F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    hits = shared.stored(hits.select("key", F.size(covered).cast("long").alias("n_hit"), F.array_sort("ids").alias("item_ids")), "hit")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select("key", "doc_id", "n_words").join(hits, "key", "left").select(
        "key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))

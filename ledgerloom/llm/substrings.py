"""Removal of repeated passages by level-wise doubling (operator 3).

Only a window that repeats at half its length can repeat as a whole. The first level
looks at runs of half a window, and only at one per window: the one with the least hash,
which equal windows share. Windows around a run that occurs once are done; the others are
extended to the full length, compared again, and the earliest of equal ones stays.

Marks (hashes of runs or windows) travel packed, one row per slice of texts and bucket.
What a slice can decide by itself does not travel: of equal marks in a slice only the
earliest is sent, since all others are known to repeat. A passage in a third of all texts
thus meets its bucket once per slice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import shared
from ledgerloom.llm.kernels import Words, bounds, gather, let_go, mix, pieces, range_hashes, signed, windows, words

WINDOW = 20
BUCKETS_PER_SLOT, BUCKET_MARKS = 2, 1 << 22
#: entries of a packed row: text (rank, variant), mark with a second hash, place; done: nothing left to compare
_PACKED = "bucket INT, done BOOLEAN, ranks ARRAY<BIGINT>, variants ARRAY<INT>, marks ARRAY<BIGINT>, checks ARRAY<BIGINT>, places ARRAY<INT>"
_LISTS = ("ranks", "variants", "marks", "checks", "places")
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of every ``run``-word run, and for each window the index of
    its least run (the last of equal ones)."""
    keys, at = windows(hashes, first, run)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    runs = np.maximum(np.diff(first) - run + 1, 0)
    begin = gather(bounds(runs)[:-1], counts)
    best = begin.copy()
    for step in range(1, window - run + 1):
        other = begin + step
        best = np.where(keys[other] <= keys[best], other, best)
    return keys, at, best


def owner(found: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(found.first, at, "right") - 1


def scan(rows: DataFrame) -> DataFrame:
    """Stored key, doc_id, n_words, two digests of the words and their SHA-256."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(2)):
                n, found = len(texts), words(texts)
                hashes = range_hashes(texts.data, found.starts, found.ends)
                digests = [signed(range_hashes(hashes, found.first[:-1], found.first[1:], kind)) for kind in (1, 2)]
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).slice(texts.rows.start, n), "doc_id": batch.column(1).slice(texts.rows.start, n),
                    "n_words": found.counts(), "digest": digests[0], "digest2": digests[1],
                    "sha256": [hashlib.sha256(b" ".join(texts.raw(i).split())).digest() for i in range(n)]})

    return shared.stored(rows.select("key", "doc_id", "text").mapInArrow(
        read, "key BIGINT, doc_id BIGINT, n_words BIGINT, digest BIGINT, digest2 BIGINT, sha256 BINARY"), "substring-scan")


def spread(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def packed(bucket: np.ndarray, done: bool, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows per bucket of the entries (rank, variant, mark, check, place)."""
    order = np.lexsort((columns[4], columns[0], bucket))
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(edge, len(bucket)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order], kind)) for c, kind in zip(columns, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32)), pa.array(np.full(len(edge), done)), *lists],
                                      ["bucket", "done", *_LISTS])


def unpacked(table: pa.Table) -> list[np.ndarray]:
    """The entries of all rows and, last, whether each is done."""
    out = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(c.flatten()) for c in table.column(name).chunks]]) for name in _LISTS]
    sizes = np.concatenate([np.zeros(0, np.int64), *[np.asarray(pa.compute.list_value_length(c)) for c in table.column("ranks").chunks]])
    return [*[x.astype(np.int64) for x in out], np.repeat(np.asarray(table.column("done")), sizes.astype(np.int64))]


def groups_of(mark: np.ndarray, check: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by mark, then by text and place; where each mark begins in it; its size."""
    order = np.lexsort((place, rank, check, mark))
    mark, check = mark[order], check[order]
    edge = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]) | (check[1:] != check[:-1])))) if len(mark) else np.zeros(0, np.int64)
    return order, edge, np.diff(np.append(edge, len(mark)))


def exchange(texts: DataFrame, entries, first_stays: bool, columns: list[str], total: int = 0) -> DataFrame:
    """(rank, variant, marks, places) of the entries whose mark occurs more than once; with
    ``first_stays`` without the earliest of each mark. ``entries(batch, slice, found)``
    gives text index, mark, check and place arrays. ``columns`` starts with rank, variant, text;
    ``total`` marks at most are dealt to enough buckets for one to fit a task."""
    buckets = max(BUCKETS_PER_SLOT * shared.slots(texts.sparkSession), total // BUCKET_MARKS)

    def split(rank: np.ndarray, mark: np.ndarray, check: np.ndarray, place: np.ndarray, known: np.ndarray | None = None):
        """Indices to send on, whether the mark is known to repeat, and those decided."""
        order, edge, size = groups_of(mark, check, rank, place)
        if known is not None:  # a slice that already saw two says so
            size = np.where(np.maximum.reduceat(known[order], edge) if len(edge) else False, np.maximum(size, 2), size)
        again = size > 1
        head = np.zeros(len(order), bool)
        head[edge] = True
        of = np.cumsum(head) - 1
        ties = (rank[order] == rank[order][edge][of]) & (place[order] == place[order][edge][of]) & ~head if first_stays else np.zeros(0, bool)
        later = order[~head & ~ties] if first_stays else order[~head]
        return order[edge], again, later, order[ties] if first_stays else order[:0]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, variants = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for part in pieces(batch.column(2)):
                found = words(part)
                doc, mark, check, place = entries(batch, part, found)
                rank, variant = ranks[part.rows][doc], variants[part.rows][doc].astype(np.int64)
                heads, again, later, ties = split(rank, mark, check, place)
                # the sign of the place tells a mark that its slice holds more than once
                shown = np.where(again, -1 - place[heads], place[heads])
                yield packed(spread(mark[heads], buckets), False, rank[heads], variant[heads], mark[heads], check[heads], shown)
                if len(ties):
                    yield packed(spread(mark[ties], buckets), False, rank[ties], variant[ties], mark[ties], check[ties], place[ties])
                if len(later):
                    yield packed(spread(rank[later], buckets), True, rank[later], variant[later], mark[later], check[later], place[later])

    def judge(table: pa.Table) -> pa.Table:
        let_go()
        rank, variant, mark, check, place, done = unpacked(table)
        kept = np.flatnonzero(done)
        fresh = np.flatnonzero(~done)
        twice = place[fresh] < 0
        spot = np.where(twice, -1 - place[fresh], place[fresh])
        place[fresh] = spot
        heads, again, later, _ = split(rank[fresh], mark[fresh], check[fresh], spot, twice)
        chosen = [kept, fresh[later]] if first_stays else [kept, fresh[later], fresh[heads[again]]]
        i = np.concatenate(chosen)
        return pa.Table.from_batches([packed(spread(rank[i], buckets), True, rank[i], variant[i], mark[i], check[i], place[i])])

    def gathered(table: pa.Table) -> pa.Table:
        rank, variant, mark, _, place, _ = unpacked(table)
        order = np.lexsort((place, variant, rank))
        rank, variant, mark, place = rank[order], variant[order], mark[order], place[order]
        edge = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (variant[1:] != variant[:-1])))) if len(rank) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(edge, len(rank)), pa.int32())
        return pa.Table.from_arrays([pa.array(rank[edge]), pa.array(variant[edge].astype(np.int32)), pa.ListArray.from_arrays(
            offsets, pa.array(place.astype(np.int32)))], ["rank", "variant", "places"])

    sent = texts.select(*columns).mapInArrow(send, _PACKED).groupBy("bucket").applyInArrow(judge, _PACKED)
    return shared.stored(sent.groupBy("bucket").applyInArrow(gathered, "rank BIGINT, variant INT, places ARRAY<INT>"), "repeats")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, n_words, n_removed, kept_sha256, kept_text) per row of ``docs``;
    ``kept_text`` is null where nothing is removed.

    A word goes if it lies in a window of ``window`` words (an even number) whose words also stand earlier:
    in a text of smaller id, or earlier in the same text. Null and empty texts have no
    words; texts shorter than a window keep all; rows that repeat both id and text are one
    place and get equal results, different texts of one id are ordered by place; a null
    id comes before all others; other columns are ignored; an empty table gives no rows."""
    if window % 2 or window < 2:
        raise ValueError("window must be an even number of words")
    run = window // 2
    rows = shared.keyed(docs, id_col, text_col)
    scanned = scan(rows)
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)))

    # texts with the same words as one of smaller id go as a whole and need no windows
    texts = scanned.select("key", rank.alias("rank"), "n_words", "digest", "digest2")
    first = texts.groupBy("digest", "digest2", "n_words").agg(F.min("rank").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    same = F.pmod("digest", F.lit(2))  # one more key: both sides are shuffled for the join, so a hot text can be split
    copies = texts.withColumn("same", same).join(first.withColumn("same", same), ["same", "digest", "digest2", "n_words"])
    copies = shared.stored(copies.where("rank > first").select("key").distinct(), "copies")

    # different texts of one id are told apart by a number
    shared_ids = texts.select("rank", "key").distinct().groupBy("rank").agg(F.count("*").alias("texts")).where("texts > 1").select("rank")
    number = F.row_number().over(Window.partitionBy("rank").orderBy("key")).cast("int")
    variants = shared.stored(texts.select("rank", "key").distinct().join(shared_ids, "rank").select("key", number.alias("number")), "variants")
    live = rows.join(copies, "key", "left_anti").join(variants, "key", "left").select(
        rank.alias("rank"), F.coalesce("number", F.lit(0)).cast("int").alias("variant"), "text", "key")

    def runs(batch: pa.RecordBatch, part, found: Words):
        hashes = range_hashes(part.data, found.starts, found.ends)
        keys, at, best = anchors(hashes, found.first, window, run)
        chosen = np.unique(best)
        doc = owner(found, at[chosen])
        return doc, signed(keys[chosen]), np.zeros(len(chosen), np.int64), at[chosen] - found.first[doc]

    def full(batch: pa.RecordBatch, part, found: Words):
        hashes = range_hashes(part.data, found.starts, found.ends)
        own = batch.column(3).slice(part.rows.start, len(part))
        doc = np.repeat(np.arange(len(part)), np.asarray(pa.compute.list_value_length(own)))
        alive = np.zeros(len(hashes) + 1, bool)
        alive[found.first[doc] + np.asarray(own.flatten())] = True
        _, at, best = anchors(hashes, found.first, window, run)
        _, starts = windows(hashes, found.first, window)
        starts = starts[alive[at[best]]]
        doc = owner(found, starts)
        return (doc, signed(range_hashes(hashes, starts, starts + window, 1)), signed(range_hashes(hashes, starts, starts + window, 2)),
                starts - found.first[doc])

    total = scanned.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    half = exchange(live, runs, False, ["rank", "variant", "text"], total)
    held = live.join(half, ["rank", "variant"]).dropDuplicates(["rank", "variant"]).select("rank", "variant", "text", "places", "key")
    held = shared.stored(held, "substring-texts")
    later = exchange(held, full, True, ["rank", "variant", "text", "places"], total)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(1)):
                n, found = len(part), words(part)
                own = batch.column(2).slice(part.rows.start, n)
                doc = np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(own)))
                starts = found.first[doc] + np.asarray(own.flatten())
                cover = np.zeros(len(found.starts) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = []
                for d in range(n):
                    a, b = found.first[d], found.first[d + 1]
                    keep = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([part.data[s:e].tobytes() for s, e in zip(found.starts[keep].tolist(), found.ends[keep].tolist(),
                                                                                    strict=True)]))
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).slice(part.rows.start, n), "removed": np.diff(bounds(gone)[found.first]),
                    "sha": [hashlib.sha256(x).hexdigest() for x in kept], "kept": pa.array([x.decode() for x in kept], pa.string())})

    starts = later.withColumnRenamed("places", "starts")
    changed = held.select("rank", "variant", "key", "text").join(starts, ["rank", "variant"]).select("key", "text", "starts").mapInArrow(
        cut, "key BIGINT, removed BIGINT, sha STRING, kept STRING")
    whole = copies.select("key", F.lit(True).alias("is_copy"))
    judged = scanned.select("key", "doc_id", "n_words", "sha256").join(whole, "key", "left").join(shared.stored(changed, "changed"), "key", "left")
    gone = F.col("is_copy") & (F.col("n_words") >= window)
    return judged.select(
        "key", "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("sha256")))).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept_text"))

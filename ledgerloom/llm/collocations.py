"""Phrase collocations by mergeable Misra-Gries summaries (operator 13).

Occurrences of n-grams are dealt to hash partitions. A partition's summary keeps more
counters than its mass divided by the least count, so whatever is frequent survives; the
summaries of slices are merged in any order. Survivors set bits of a filter of fixed size,
and a second pass over the texts counts what passes it exactly, by the phrase itself.

Words and pairs come first; longer phrases are looked at only where all their pairs
survived, in a second round of summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import shared
from ledgerloom.llm.kernels import LOWER, Hasher, Texts, bounds, gather, mix, pieces, range_hashes, words

LEAST, LONGEST, FIRST, COVER = 30, 4, 2000, 80
UNKNOWN = "und"
#: bits of a filter, whatever the corpus holds; a full one passes more, never less
FILTER_BITS = 1 << 26
#: text bytes per hash partition, and the most partitions
PART_BYTES, MOST_PARTS = 16 << 20, 1 << 20
#: counters per (mass / least count): with more, fewer n-grams survive that are not frequent
SLACK = 4
#: occurrences a task holds before it sends its summaries; bytes of text at once
HELD, SLICE = 1 << 21, 1 << 22

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
INSIDE = ~SEPARATOR
INSIDE[[0x20, 0x09]] = False


class Grams:
    """The words of some texts and the n-grams inside their pieces."""

    def __init__(self, texts: Texts, langs: np.ndarray):
        """``langs``: a 64-bit number per text; n-grams of different ones differ."""
        self.low = Texts(texts.rows, LOWER[texts.data], texts.offsets)
        self.found = words(self.low, INSIDE)
        self.doc = self.found.doc()
        starts, ends = self.found.starts, self.found.ends
        self.hasher = Hasher(range_hashes(self.low.data, starts, ends))
        self.salt = langs[self.doc]
        cut = np.concatenate(([0], np.cumsum(SEPARATOR[self.low.data], dtype=np.int64)))
        self.linked = (cut[starts[1:]] == cut[ends[:-1]]) & (self.doc[1:] == self.doc[:-1])

    def starts(self, n: int) -> np.ndarray:
        """First words of the n-grams."""
        keep = np.ones(max(len(self.doc) - n + 1, 0), bool)
        for i in range(n - 1):
            keep &= self.linked[i:i + len(keep)]
        return np.flatnonzero(keep)

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix(self.hasher.of(at, at + n) + self.salt[at])

    def texts_of(self, at: np.ndarray, n: int) -> pa.Array:
        """The n-grams that begin at words ``at``, words joined by one blank."""
        lengths = self.found.ends - self.found.starts + 1
        where = bounds(lengths)
        sizes = where[at + n] - where[at] - 1
        # bytes of the words in question, each followed by a blank
        which = gather(at, np.full(len(at), n))
        source = np.append(self.low.data, np.uint8(32))
        body = source[np.minimum(gather(self.found.starts[which], lengths[which]), len(self.low.data))]
        body[bounds(lengths[which])[1:] - 1] = 32
        body = body[gather(bounds(sizes + 1)[:-1], sizes)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds(sizes)), pa.py_buffer(body))


class Filter:
    """Bits of the surviving n-grams: a stretch of them for each hash partition."""

    def __init__(self, parts: int, bits: np.ndarray | None = None, size: int = FILTER_BITS):
        self.parts, self.region, self.bits = parts, size // parts // 8 * 8, bits

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash partition and 32-bit key."""
        return ((keys >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def segment(self, short: np.ndarray) -> bytes:
        bits = np.zeros(self.region, np.uint8)
        bits[short.astype(np.int64) % self.region] = 1
        return np.packbits(bits).tobytes()

    def passes(self, keys: np.ndarray) -> np.ndarray:
        part, short = self.place(keys)
        at = part * self.region + short % self.region
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class Summary:
    """Misra-Gries counters. ``lost`` bounds by how much a counter is below the truth."""

    def __init__(self, capacity: int):
        self.capacity, self.lost, self.waiting = capacity, 0, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._more.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting >= max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        """Counters of equal keys are added; if too many remain, the largest that has
        no place is taken off all of them."""
        keys = np.concatenate([self.keys, *[k for k, _ in self._more]])
        counts = np.concatenate([self.counts, *[c for _, c in self._more]])
        self._more, self.waiting = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[edge], np.add.reduceat(counts, edge)
        if len(keys) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += cut
            counts = counts - cut
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def survivors(self, least: int) -> np.ndarray:
        """Keys whose true count may reach ``least``."""
        self.merge()
        return self.keys[self.counts + self.lost >= least]


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.fill_null(UNKNOWN).dictionary_encode()
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.asarray(own, np.uint64)[np.asarray(coded.indices)] if len(langs) else np.zeros(0, np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Grams]]:
    """Batches of (lang, text): the languages of a slice and its n-grams."""
    for batch in batches:
        langs, salts = batch.column(0), _salts(batch.column(0))
        for part in pieces(batch.column(1), SLICE):
            yield langs.slice(part.rows.start, len(part)), Grams(part, salts[part.rows])


def _possible(grams: Grams, n: int, pairs: Filter | None, ok: np.ndarray | None) -> np.ndarray:
    """First words of n-grams all of whose pairs pass."""
    at = grams.starts(n)
    if n > 2 and pairs is not None:
        keep = np.ones(len(at), bool)
        for i in range(n - 1):
            keep &= ok[at + i]
        at = at[keep]
    return at


def _pairs_ok(grams: Grams, pairs: Filter | None) -> np.ndarray | None:
    if pairs is None:
        return None
    ok, at = np.zeros(len(grams.doc), bool), grams.starts(2)
    ok[at] = pairs.passes(grams.keys(at, 2))
    return ok


def survivors(texts: DataFrame, sizes: tuple[int, ...], least: int, parts: int, pairs=None) -> Filter:
    """The filter of the n-grams of ``sizes`` words that may occur ``least`` times in a
    language. ``texts``: lang, text; ``pairs``: a broadcast filter that pairs must pass."""
    layout = Filter(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            part, short = layout.place(np.concatenate(held))
            both, counts = np.unique(part.astype(np.uint64) << np.uint64(32) | short.astype(np.uint64), return_counts=True)
            part, short = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            rows = {"part": [], "mass": [], "once": [], "often": [], "times": []}
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
                one = counts[a:b] == 1
                rows["part"].append(int(part[a]))
                rows["mass"].append(int(counts[a:b].sum()))
                rows["once"].append(short[a:b][one].tobytes())
                rows["often"].append(short[a:b][~one].tobytes())
                rows["times"].append(counts[a:b][~one].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), ("mass", pa.int64()), ("once", pa.binary()),
                                                                      ("often", pa.binary()), ("times", pa.binary())]))

        for _, grams in _slices(batches):
            ok = _pairs_ok(grams, pairs.value if pairs else None)
            for n in sizes:
                at = _possible(grams, n, pairs.value if pairs else None, ok)
                if len(at):
                    held.append(grams.keys(at, n))
                    size += len(at)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    sent = shared.stored(texts.mapInArrow(send, "part INT, mass BIGINT, once BINARY, often BINARY, times BINARY"), "phrase-counts")
    mass = sent.groupBy("part").agg(F.sum("mass").alias("total"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary = None, None
        finish = lambda: pa.RecordBatch.from_pydict({
            "part": pa.array([now], pa.int32()), "bits": pa.array([layout.segment(summary.survivors(least))], pa.binary())})
        for batch in batches:
            part, total = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, p in enumerate(part):
                if p != now:
                    if summary:
                        yield finish()
                    now, summary = p, Summary(SLACK * (total[i] // least) + 1)
                for keys, times in ((batch.column(2)[i], None), (batch.column(3)[i], batch.column(4)[i])):
                    keys = np.frombuffer(keys.as_buffer(), np.uint32)
                    if len(keys):
                        summary.add(keys, np.ones(len(keys), np.int64) if times is None else
                                    np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64))
        if summary:
            yield finish()

    dealt = sent.join(mass, "part").select("part", "total", "once", "often", "times").repartition(parts, "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(summarise, "part INT, bits BINARY").toArrow()  # FILTER_BITS / 8 bytes at most
    bits = np.zeros(layout.region * parts // 8, np.uint8)
    step = layout.region // 8
    for p, segment in zip(found.column("part").to_pylist(), found.column("bits"), strict=True):
        bits[p * step:(p + 1) * step] = np.frombuffer(segment.as_buffer(), np.uint8)
    return Filter(parts, bits)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Stored (lang, phrase, words, n): the exact counts of all phrases of 1 to ``longest``
    words that occur ``least`` times in a language, and with words 0 and an empty phrase
    the word occurrences of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(-(-size // PART_BYTES), 1), MOST_PARTS)
    short = spark.sparkContext.broadcast(survivors(texts, (1, 2)[:longest], least, parts))
    long_sizes = tuple(range(3, longest + 1))
    long = spark.sparkContext.broadcast(survivors(texts, long_sizes, least, parts, short)) if long_sizes else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, grams in _slices(batches):
            langs = langs.fill_null(UNKNOWN).dictionary_encode()
            code = np.asarray(langs.indices)[grams.doc] if len(langs) else np.zeros(0, np.int64)
            totals = np.bincount(code, minlength=len(langs.dictionary))
            yield pa.RecordBatch.from_pydict({"lang": langs.dictionary.cast(pa.string()), "phrase": pa.array([""] * len(totals), pa.string()),
                                              "words": pa.array(np.zeros(len(totals)), pa.int32()), "n": pa.array(totals, pa.int64())})
            ok = _pairs_ok(grams, short.value)
            for n in range(1, longest + 1):
                at = _possible(grams, n, short.value, ok)
                keys = grams.keys(at, n)
                keep = (short if n <= 2 else long).value.passes(keys)
                _, first, times = np.unique(keys[keep], return_index=True, return_counts=True)
                at = at[keep][first]
                yield pa.RecordBatch.from_pydict({
                    "lang": langs.dictionary.take(pa.array(code[at])).cast(pa.string()), "phrase": grams.texts_of(at, n).cast(pa.string()),
                    "words": pa.array(np.full(len(at), n), pa.int32()), "n": pa.array(times, pa.int64())})

    counted = texts.mapInArrow(count, "lang STRING, phrase STRING, words INT, n BIGINT").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return shared.stored(counted.where((F.col("n") >= least) | ((F.col("words") == 0) & (F.col("n") > 0))), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, cover: int = COVER,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to
    ``longest`` words that occur ``least`` times.

    A phrase is scored by its weakest cut in two, floor(2,000,000 a / (l + r)) of its count
    and those of the parts; ties go to the earliest cut. Phrases inside a longer one that
    makes up ``cover`` percent of their occurrences are left out. Null texts are empty, a
    null language is ``und``; words are compared with A-Z lower-cased and do not cross
    ``. , ; : ! ?`` and line ends; repeated rows count as often as they occur; texts may be of
    any length; other columns are ignored; an empty table gives no rows."""
    known = frequent(docs, least, longest, lang_col, text_col)
    phrases = known.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    parts = known.where("words BETWEEN 1 AND %d" % (longest - 1)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"]).join(
        parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    # 2,000,000 a may pass 64 bits, the quotient is at most 1,000,000
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.where("words >= 3").withColumn("w", F.split("phrase", " ")).select(
        "lang", "a", "words", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("i"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a")
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    left = scored.join(covered, ["lang", "phrase"], "left").where(
        f"outer IS NULL OR CAST(outer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {int(cover)}")

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    total = known.where("words = 0").select("lang", F.col("n").alias("total"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                                           F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))

"""Quality rules with tokeniser fertility (operator 2).

Base rules look at words, symbols, repeated lines and repeated word windows. The
method's own verdict compares how a public vocabulary splits a text with how it
splits the other texts of its language (or script): characters per token, share of
byte-fallback tokens and entropy of the token distribution must lie inside bands. The
entropy is that of windows of equally many tokens, so none of the three depends on how
long a text is."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import shared, tokens
from ledgerloom.llm.kernels import Texts, bounds, gather, pieces, range_hashes, signed, windows, words
from ledgerloom.llm.scripts import text_scripts

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MIN_WORDS, REPEAT_WIDTH = 50, 3
#: tokens of an entropy window: a text that passes the base rules has as many words at least
ENTROPY_WINDOW = MIN_WORDS
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: half-width of a band in spreads (half the distance of the outer quantiles), least
#: half-width as a share of the median, absolute least half-width
REACH, LEAST_SHARE, LEAST = 2.5, 0.1, {"chars_per_token": 0.2, "byte_share": 0.02, "entropy": 0.25}
RARE_GROUP = 50


def repeats(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a (doc, key) pair occurs more than once."""
    order = np.lexsort((keys, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(keys) else False
    return out


def later_equals(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many entries of each doc equal an earlier one, as a mask over entries."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    out = np.zeros(len(keys), bool)
    if len(keys):
        same = (doc[order][1:] == doc[order][:-1]) & (keys[order][1:] == keys[order][:-1])
        out[order[1:]] = same
    return out


def base_measures(texts: Texts) -> dict[str, np.ndarray]:
    data, offsets, n = texts.data, texts.offsets, len(texts)
    found = words(texts)
    doc = found.doc()
    total = lambda mask: np.diff(bounds(mask)[offsets])
    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, found.starts, 1)
    np.add.at(in_word, found.ends, -1)
    inside = np.cumsum(in_word[:-1]) > 0
    hashes = range_hashes(data, found.starts, found.ends)

    # lines
    breaks = data == 0x0A
    begins = np.zeros(len(data) + 1, bool)
    begins[1:] = breaks
    begins[offsets] = True
    starts = np.flatnonzero(begins[: len(data)])
    ends = np.append(starts[1:], len(data))
    ends = ends - (breaks[ends - 1] if len(ends) else 0)
    worded = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends = starts[worded], ends[worded]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    dup_lines = later_equals(line_doc, range_hashes(data, starts, ends))

    # 3-word windows
    keys, at = windows(hashes, found.first, REPEAT_WIDTH)
    again = at[repeats(doc[at], keys)]
    cover = np.zeros(len(doc) + REPEAT_WIDTH + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WIDTH, -1)
    repeated = np.cumsum(cover)[: len(doc)] > 0
    return {"n_words": found.counts(), "word_chars": total(inside & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[data]),
            "n_dup_lines": np.bincount(line_doc[dup_lines], minlength=n), "n_repeat_words": np.diff(bounds(repeated)[found.first])}


def window_entropy(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entropy of a text's windows of ENTROPY_WINDOW tokens less the greatest it can be,
    averaged so that every token counts once: whole windows one after the other, what is
    left over as part of a last window that ends with the text. A shorter text is one
    window."""
    counts = np.diff(at)
    width = np.minimum(np.maximum(counts, 1), ENTROPY_WINDOW)
    left = counts % width
    parts = counts // width + (left > 0)
    doc = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(doc)) - bounds(parts)[:-1][doc]
    starts = at[:-1][doc] + np.minimum(nth * width[doc], (counts - width)[doc])
    weight = np.where((nth == parts[doc] - 1) & (left[doc] > 0), left[doc], width[doc])
    pairs = np.sort(np.repeat(np.arange(len(doc), dtype=np.int64), width[doc]) << 32 | ids[gather(starts, width[doc])].astype(np.int64))
    edge = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    owner = pairs[edge] >> 32
    share = np.diff(np.append(edge, len(pairs))) / width[doc][owner]
    entropy = np.bincount(owner, -share * np.log2(share), len(doc)) - np.log2(width[doc])
    return np.bincount(doc, entropy * weight, len(counts)) / np.maximum(counts, 1)


def fertility(texts: Texts, encoder: tokens.Pieces, word_chars: np.ndarray) -> dict[str, np.ndarray]:
    ids, at = encoder.encode(texts)
    counts = np.diff(at)
    some = np.maximum(counts, 1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    fallback = np.bincount(doc, encoder.is_byte[ids], len(texts))
    return {"n_tokens": counts, "chars_per_token": word_chars / some, "byte_share": fallback / some,
            "entropy": window_entropy(ids, at)}


def measure(docs: DataFrame, vocabularies: list[str], id_col: str = "doc_id", text_col: str = "text",
            lang_col: str | None = "lang") -> DataFrame:
    """One stored row of counts and measures for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [tokens.sentence_pieces(path) for path in vocabularies]
        for batch in batches:
            for texts in pieces(batch.column(2)):
                n, base = len(texts), base_measures(texts)
                row = {"key": batch.column(0).slice(texts.rows.start, n), "doc_id": batch.column(1).slice(texts.rows.start, n),
                       "lang": batch.column(3).slice(texts.rows.start, n), "script": text_scripts(texts)} | base
                for i, encoder in enumerate(encoders):
                    row |= {f"{k}_{i}": v for k, v in fertility(texts, encoder, base["word_chars"]).items()}
                yield pa.RecordBatch.from_pydict(row)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = shared.keyed(docs, id_col, text_col).select("key", "doc_id", "text") if lang_col is None else docs.select(
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("key"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    if lang_col is None:
        rows = rows.withColumn("lang", lang)
    schema = "key BIGINT, doc_id BIGINT, lang STRING, script STRING, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, " \
             "n_dup_lines BIGINT, n_repeat_words BIGINT" + "".join(
                 f", n_tokens_{i} BIGINT, chars_per_token_{i} DOUBLE, byte_share_{i} DOUBLE, entropy_{i} DOUBLE"
                 for i in range(len(vocabularies)))
    return shared.stored(rows.mapInArrow(run, schema), "quality")


def bands(measured: DataFrame, vocabularies: int) -> DataFrame:
    """(grp, band of every measure) from all texts that pass the base rules. Values
    are rounded and counted first, so the quantiles are exact and the work small."""
    out = []
    for i in range(vocabularies):
        for name in MEASURES:
            column = f"{name}_{i}"
            counted = measured.where("NOT base_failed").groupBy("grp", F.round(column, 2).alias("v")).agg(F.count("*").alias("times"))
            low, mid, high = (F.percentile("v", q, F.col("times")) for q in (0.05, 0.5, 0.95))
            half = F.greatest((high - low) / 2 * REACH, F.abs(mid) * LEAST_SHARE, F.lit(LEAST[name]))
            out.append(counted.groupBy("grp").agg((mid - half).alias(f"{column}_low"), (mid + half).alias(f"{column}_high")))
    return reduce(lambda a, b: a.join(b, "grp"), out)


def quality(docs: DataFrame, vocabularies: list[str], id_col: str = "doc_id", text_col: str = "text",
            lang_col: str | None = "lang") -> DataFrame:
    """Counts, measures, ``base_failed``, ``kept`` and ``reason`` for every row.

    Base rules: fewer than 50 words, or more than half of the words inside 3-word
    windows found twice. Bands are per language, or per script where the language is
    missing or has fewer than 50 texts. Null and empty texts have no words and fail the
    base rules; repeated rows are judged alike and each returned; a null id stays null;
    other columns are ignored; an empty table gives no rows."""
    measured = measure(docs, vocabularies, id_col, text_col, lang_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    sizes = measured.where("NOT base_failed AND lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("texts"))
    known = sizes.where(F.col("texts") >= RARE_GROUP).select(F.col("lang").alias("known"))
    grp = F.when(F.col("known").isNotNull(), F.concat(F.lit("lang:"), "known")).otherwise(F.concat(F.lit("script:"), "script"))
    measured = measured.join(known, measured.lang == known.known, "left").withColumn("grp", grp).drop("known")
    limits = bands(measured, len(vocabularies))
    checks = [(f"{m}_{i}", s) for i in range(len(vocabularies)) for m in MEASURES for s in ("low", "high")]
    judged = measured.join(shared.stored(limits, "bands"), "grp", "left")
    reason = F.when(F.col("base_failed"), "base")
    for column, side in checks:
        limit = F.col(f"{column}_{side}")
        reason = reason.when(F.col(column) < limit if side == "low" else F.col(column) > limit, f"{column}_{side}")
    return judged.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()) \
        .drop(*[f"{c}_{s}" for c, s in checks])

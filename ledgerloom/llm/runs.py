"""Periodic runs of words inside a text (operator 12).

A run of period q and at least three periods starts with two places q apart whose texts
agree for the rest of the run. Suffixes of the words are united into classes from the
longest common prefix down, as in Kruskal's algorithm; each class keeps its places in
order, and two places that become neighbours at a distance within their common prefix
seed a run.

Only words inside a stretch that repeats within the text can matter, so suffixes are
sorted for those alone; all other words cost one hash. A text is worked on whole, in
arrays of a slice of texts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.kernels import Hasher, Texts, mix, pieces, range_hashes, windows, words

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: so many places or fewer are put into a class one by one
_FEW = 64


def least_overlap(least: int, periods: int) -> int:
    """Words that two places of a run at the distance of any period agree in, at least."""
    return min(max(least - q, (periods - 1) * q) for q in range(1, least + 1))


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions by the codes from there on, and the rank of each; prefix doubling that
    sorts only what is still equal."""
    order = np.argsort(codes, kind="stable")
    head = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
    rank = np.empty(len(codes), np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step, length = 1, len(codes)
    while True:
        size = np.bincount(rank, minlength=length)
        open_ = order[size[rank[order]] > 1]
        if not len(open_):
            return order, rank
        after = np.where(open_ + step < length, rank[np.minimum(open_ + step, length - 1)] + 1, 0)
        group = rank[open_]
        inner = np.lexsort((after, group))
        open_, after, group = open_[inner], after[inner], group[inner]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        fresh = first | np.concatenate(([True], after[1:] != after[:-1]))
        index = np.arange(len(open_))
        begin = np.maximum.accumulate(np.where(first, index, 0))
        at = np.maximum.accumulate(np.where(fresh, index, 0))
        order[group + index - begin] = open_
        rank[open_] = group + at - begin
        step *= 2


def common_prefixes(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal codes from positions a and b on, by bisection over hashes."""
    hasher, length = Hasher(codes), len(codes)
    found = np.zeros(len(a), np.int64)
    step = 1 << max(length - 1, 1).bit_length()
    while step := step >> 1:
        fits = np.flatnonzero(np.maximum(a, b) + found + step <= length)
        i, j = a[fits] + found[fits], b[fits] + found[fits]
        found[fits[hasher.of(i, i + step) == hasher.of(j, j + step)]] += step
    return found


def seeds(left: np.ndarray, right: np.ndarray, shared: np.ndarray, least: int, periods: int) -> np.ndarray:
    """(start, period, common prefix) of neighbours in classes of suffixes, from edges
    between neighbours of the suffix order and their common prefixes."""
    order = np.argsort(-shared, kind="stable")
    owner: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    out: list[tuple[int, int, int]] = []

    def root(i: int) -> int:
        if i not in owner:
            owner[i] = i
            places[i] = [i]
            return i
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for a, b, level in zip(left[order].tolist(), right[order].tolist(), shared[order].tolist(), strict=True):
        a, b = root(a), root(b)
        if len(places[a]) < len(places[b]):
            a, b = b, a
        large, small = places[a], places.pop(b)
        owner[b] = a
        for x in small:  # places of one class before are no new neighbours
            k = bisect_left(large, x)
            if k < len(large):
                d = large[k] - x
                if d * (periods - 1) <= level >= least - d:
                    out.append((x, d, level))
            if k:
                d = x - large[k - 1]
                if d * (periods - 1) <= level >= least - d:
                    out.append((large[k - 1], d, level))
        if len(small) > _FEW:
            large += small
            large.sort()
        else:
            for x in small:
                insort(large, x)
    return np.asarray(out, np.int64).reshape(-1, 3)


def find_runs(hashes: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period), in this order, of the runs in texts whose words
    first[d]:first[d+1] have these hashes: stretches of at least ``least`` words and
    ``periods`` smallest periods that no neighbouring word extends."""
    none = np.zeros((0, 4), np.int64)
    overlap = least_overlap(least, periods)
    keys, at = windows(hashes, first, overlap)
    doc = np.searchsorted(first, at, "right") - 1
    _, which, times = np.unique(mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    if not len(again):
        return none
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + overlap, -1)
    words_in = np.flatnonzero(np.cumsum(change)[:-1] > 0)  # words of repeated stretches
    doc = np.searchsorted(first, words_in, "right") - 1
    # a code per word and text; after each stretch one that occurs nowhere else
    _, code = np.unique(mix(hashes[words_in] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    last = np.flatnonzero(np.concatenate(((np.diff(words_in) > 1) | (np.diff(doc) > 0), [True])))
    place = np.arange(len(words_in)) + np.concatenate(([0], np.cumsum(np.bincount(last, minlength=len(words_in)))))[:-1]
    codes = np.empty(len(words_in) + len(last), np.int64)
    codes[place] = code
    codes[place[last] + 1] = code.max() + 1 + np.arange(len(last))
    origin = np.full(len(codes), -1, np.int64)
    origin[place] = words_in

    order, _ = suffix_order(codes)
    left, right = order[:-1], order[1:]
    same = codes[left] == codes[right]
    left, right = left[same], right[same]
    shared = common_prefixes(codes, left, right)
    deep = shared >= overlap
    found = seeds(left[deep], right[deep], shared[deep], least, periods)
    if not len(found):
        return none
    start, period, level = found.T
    # the first place of a run: the word before does not go on with the period
    found = found[(start == 0) | (codes[start - 1] != codes[start - 1 + period])]
    start, period, level = found.T
    length = period + level
    # of several periods of one stretch the smallest
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    keep = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))) if len(start) else np.zeros(0, bool)
    word = origin[start[keep]]
    doc = np.searchsorted(first, word, "right") - 1
    rows = np.column_stack((doc, word - first[doc], length[keep], period[keep]))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapse(raw: bytes, runs: np.ndarray) -> bytes:
    """Words joined by one blank, of each run only the first period."""
    own = raw.split()  # splits bytes at exactly the blanks that end a word
    if len(runs):
        change = np.zeros(len(own) + 1, np.int64)
        np.add.at(change, runs[:, 1] + runs[:, 3], 1)
        np.add.at(change, runs[:, 1] + runs[:, 2], -1)
        own = [w for w, gone in zip(own, (np.cumsum(change)[:-1] > 0).tolist(), strict=True) if not gone]
    return b" ".join(own)


def _read(texts: Texts, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    found = words(texts)
    runs = find_runs(range_hashes(texts.data, found.starts, found.ends), found.first, least, periods)
    cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    return runs, cut, [collapse(texts.raw(i), runs[cut[i]:cut[i + 1]]).decode() for i in range(len(texts))]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) per row of ``docs``: ``runs`` lists (start, length, period)
    by start and period, ``collapsed`` is the words outside all but the first periods of
    runs, joined by one blank.

    Words are what stands between ASCII blanks, unchanged. Null, empty and blank texts
    have no runs and an empty ``collapsed``; repeated rows get equal results; runs may
    overlap and nest; a text of any length is read whole by one task, with memory in
    proportion to its words; other columns are ignored; an empty table gives no rows."""
    if least < 2 or periods < 2:
        raise ValueError("a run has at least two words and two periods")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(1)):
                runs, cut, collapsed = _read(part, least, periods)
                fields = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.rows.start, len(part)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), fields),
                    pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(read, "doc_id BIGINT, runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>, collapsed STRING")

"""Language of texts and of spans inside them (operator 10).

The script of a word narrows the languages that may own it. The rest are scored by
character trigrams and whole words, counted over all training texts. A Viterbi pass
over the words with a penalty for each change of language labels the spans; the text's
language is the one with most letters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.kernels import Texts, bounds, mix, pieces, range_hashes
from ledgerloom.llm.scripts import NAMES, code_points, letter_table, lower_table, script_table

BUCKETS, MAX_LANGUAGES = 1 << 16, 1024
PENALTY, CLIP, SMOOTH, SCRIPT_SHARE = 20.0, 10.0, 0.5, 0.001
TRIGRAM, WORD, SCRIPT = 0, 1, 2
#: bytes of text worked on at once; a character takes some 60 bytes meanwhile
SLICE = 1 << 20


@dataclass
class Spelled:
    """Words (letter runs) of a slice in code points, with their features."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    script: np.ndarray
    word: np.ndarray  # bucket of each word
    inside: np.ndarray  # places of word characters
    trigram: np.ndarray  # bucket of each word character
    offsets: np.ndarray  # where each text begins

    def spread(self) -> np.ndarray:
        """For each word, where its characters begin in ``inside``."""
        return bounds(self.ends - self.starts)


def spell(texts: Texts) -> Spelled:
    points, offsets = code_points(texts)
    kind = letter_table()[points]
    inside = np.concatenate((kind > 0, [False]))
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    begins[offsets] |= inside[offsets]
    edge = offsets[offsets > 0] - 1
    stops[edge] |= inside[edge]
    starts, ends = np.flatnonzero(begins[:-1]), np.flatnonzero(stops[:-1]) + 1
    lettered = bounds(kind == 1)
    real = lettered[ends] > lettered[starts]  # marks alone are no word
    starts, ends = starts[real], ends[real]
    low = lower_table()[points].astype(np.uint64)
    sizes = ends - starts
    at = bounds(sizes)
    place = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    nth = place - np.repeat(starts, sizes)
    one, two = np.uint64(1), np.uint64(2)
    back = np.where(nth >= 1, low[place - 1], one)
    back2 = np.where(nth >= 2, low[place - 2], one)
    last = place == np.repeat(ends, sizes) - 1
    gram = mix(low[place] * np.uint64(0x9E3779B97F4A7C15) + back * np.uint64(0xC2B2AE3D27D4EB4F) + back2 * np.uint64(0x165667B19E3779F9)
               + np.where(last, two, one))
    word = range_hashes(low, starts, ends)
    mask = np.uint64(BUCKETS - 1)
    return Spelled(starts, ends, np.searchsorted(starts, offsets), script_table()[points[starts]] if len(starts) else np.zeros(0, np.uint8),
                   (word & mask).astype(np.int64), place, (gram & mask).astype(np.int64), offsets)


@dataclass
class Model:
    names: list[str]
    grams: np.ndarray  # language x bucket, log probability
    words: np.ndarray
    allowed: np.ndarray  # language x script


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over every row with a language. Tasks add up their own arrays first; the
    driver receives one number per language and used bucket, bounded by 2**17 each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                kinds, buckets = np.nonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(kinds), pa.string()), "kind": kinds, "bucket": buckets,
                                                  "n": counts[kinds, buckets]})
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for texts in pieces(batch.column(0), SLICE):
                own, found = langs[texts.rows], spell(texts)
                names = sorted(set(own))
                owner = np.fromiter((names.index(x) for x in own), np.int64, len(own))
                by_word = np.repeat(owner, np.diff(found.first))
                by_char = np.repeat(by_word, found.ends - found.starts)
                for kind, key, lang in ((TRIGRAM, found.trigram, by_char), (WORD, found.word, by_word),
                                        (SCRIPT, found.script.astype(np.int64), by_word)):
                    got = np.bincount(lang * BUCKETS + key, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                    for i, name in enumerate(names):
                        held.setdefault(name, np.zeros((3, BUCKETS), np.int64))[kind] += got[i]
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    counts = rows.mapInArrow(count, "lang STRING, kind BIGINT, bucket BIGINT, n BIGINT").groupBy("lang", "kind", "bucket").agg(
        F.sum("n").alias("n"))
    table = counts.toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} can be told apart")
    where = {n: i for i, n in enumerate(names)}
    raw = np.zeros((3, max(len(names), 1), BUCKETS))
    lang = np.fromiter((where[x] for x in table.column("lang").to_pylist()), np.int64, table.num_rows)
    raw[table.column("kind").to_numpy(), lang, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    log = lambda c: np.log((c + SMOOTH) / (c.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)
    scripts = raw[SCRIPT][:, : len(NAMES)]
    allowed = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(names, log(raw[TRIGRAM]), log(raw[WORD]), allowed)


def word_scores(found: Spelled, model: Model) -> np.ndarray:
    """Word x language: log likelihood below the best language's, at least -CLIP; a
    language that is not written in the word's script gets twice that."""
    at = found.spread()
    out = np.zeros((len(found.starts), len(model.names)))
    for i in range(len(model.names)):
        total = bounds_float(model.grams[i][found.trigram])
        out[:, i] = total[at[1:]] - total[at[:-1]] + model.words[i][found.word]
    fits = model.allowed[:, found.script].T
    fits |= ~fits.any(axis=1, keepdims=True)  # a script nobody uses narrows nothing
    out[~fits] = -np.inf
    out -= out.max(axis=1, keepdims=True, initial=-1e300)
    return np.where(fits, np.maximum(out, -CLIP), -2 * CLIP)


def bounds_float(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1)
    np.cumsum(values, out=out[1:])
    return out


def constant_is_best(scores: np.ndarray, penalty: float) -> int:
    """The language that labels the whole text if no run of words gains more than half
    a penalty elsewhere (then no path with changes can be better), else -1."""
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack((np.zeros((1, scores.shape[1])), gain[:-1])), axis=0)
    return best if (gain - low).max() <= penalty / 2 else -1


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """Best language of every word for several texts at once, longest first inside."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.asarray([len(scores[i]) for i in order])
    n, langs = len(order), scores[0].shape[1]
    flat, at = np.concatenate([scores[i] for i in order]), bounds(lengths)[:-1]
    value, back = np.zeros((n, langs)), []
    for t in range(int(lengths.max())):
        live = int(np.searchsorted(-lengths, -t, "left"))
        v = value[:live]
        best = v.argmax(axis=1)
        change = v[np.arange(live), best] - (penalty if t else 0)
        stay = v >= change[:, None]
        back.append(np.where(stay, np.arange(langs), best[:, None]).astype(np.int16))
        value[:live] = np.where(stay, v, change[:, None]) + flat[at[:live] + t]
    paths = [np.zeros(m, np.int16) for m in lengths.tolist()]
    for k, path in enumerate(paths):
        now = int(value[k].argmax())
        for t in range(len(path) - 1, -1, -1):
            path[t] = now
            now = int(back[t][k, now])
    out: list[np.ndarray] = [None] * n
    for k, i in enumerate(order):
        out[i] = paths[k]
    return out


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row; ``spans`` lists
    (begin, end, lang) in code points, ``score`` is the share of letters in spans of
    ``lang_pred``.

    A null text, one without letters, or a model without languages gives ``und`` and score 0. Ties go
    to the language first by name; repeated rows get equal rows; a null id stays null;
    other columns are ignored; texts of any length are read whole."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**17 numbers, never more than MAX_LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_model.value
        for batch in batches:
            for texts in pieces(batch.column(1), SLICE):
                n, found = len(texts), spell(texts)
                paths: list[np.ndarray | None] = [None] * n
                if m.names and len(found.starts):
                    scores = word_scores(found, m)
                    hard = []
                    for d in range(n):
                        own = scores[found.first[d]:found.first[d + 1]]
                        if len(own):
                            one = constant_is_best(own, penalty)
                            if one < 0:
                                hard.append(d)
                            else:
                                paths[d] = np.full(len(own), one, np.int16)
                    if hard:
                        for d, path in zip(hard, viterbi([scores[found.first[d]:found.first[d + 1]] for d in hard], penalty), strict=True):
                            paths[d] = path
                langs, shares, begins, ends, kinds, counts = [], [], [], [], [], []
                for d, path in enumerate(paths):
                    if path is None:
                        langs.append("und")
                        shares.append(0.0)
                        counts.append(0)
                        continue
                    s, e = found.starts[found.first[d]:found.first[d + 1]], found.ends[found.first[d]:found.first[d + 1]]
                    letters = np.bincount(path, e - s, len(m.names))
                    top = int(letters.argmax())
                    langs.append(m.names[top])
                    shares.append(float(letters[top] / letters.sum()))
                    edge = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
                    begins.append(s[edge] - found.offsets[d])
                    ends.append(e[np.append(edge[1:], len(path)) - 1] - found.offsets[d])
                    kinds += [m.names[k] for k in path[edge].tolist()]
                    counts.append(len(edge))
                join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                spans = pa.ListArray.from_arrays(pa.array(bounds(np.asarray(counts)), pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(join(begins), pa.int64()), pa.array(join(ends), pa.int64()), pa.array(kinds, pa.string())],
                    ["begin", "end", "lang"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.rows.start, n), pa.array(langs, pa.string()),
                                                  pa.array(shares, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE, "
                                "spans ARRAY<STRUCT<`begin`: BIGINT, `end`: BIGINT, lang: STRING>>")


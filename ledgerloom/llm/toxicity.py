"""Toxicity by a subsequence string kernel with Nyström landmarks (operator 4).

Two words are alike by the letter subsequences they share, each discounted by the gaps
it spans, so inserted or missing characters lower the value but do not lose it. The
landmarks are the words of labelled texts that speak most for the label. A text is the
vector of its words' pooled kernel values to every landmark, mapped by the inverse root of the
landmarks' own kernel matrix; a linear support vector machine separates these, and a
logistic curve fitted on its margins gives the score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.kernels import Texts, held, pieces, words
from ledgerloom.llm.tokens import ChunkEncoder

DECAY, ORDERS = 0.6, (2, 3)
#: labelled texts at most (the bound of the training sample), landmarks, least texts a landmark occurs in
MAX_LABELLED, LANDMARKS, LEAST_TEXTS = 20_000, 64, 3
#: kernel values up to this are chance likeness; a word may lack this share of a landmark's letters; power
FLOOR, MAY_LACK, SHARPEN = 0.4, 0.25, 2
#: a landmark is not this much like one already chosen
APART = 0.7
WIDTH = 32
# Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def plain(word: str) -> str:
    """Letters of a word in lower case, with digits and signs that stand for letters."""
    word = word.strip("\t\n\v\f\r .,;:!?\"'()[]{}*#%&|<>-_").lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word.translate(LEET)))


def _mask(word: str) -> int:
    out = 0
    for c in set(word):
        out |= 1 << (ord(c) & 63)
    return out


def codes(texts: list[str]) -> np.ndarray:
    """Code points, one row per text, padded with 0."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(int(sizes.max(initial=0)), 1)), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), "<i4")
    return out


def raw_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum over ORDERS of the gap-weighted subsequence kernel for the columns of two
    padded code arrays; the pads of the two sides (0 and 1) differ, so they never match."""
    n, square = s.shape[1], np.float32(DECAY * DECAY)
    same = (s[:, None, :] == t[None, :, :]).astype(np.float32) * square
    total = np.zeros(n, np.float32)
    prior = np.ones((len(s) + 1, len(t) + 1, n), np.float32)
    for order in range(1, max(ORDERS) + 1):
        match = prior[:-1, :-1] * same
        if order in ORDERS:
            total += match.sum(axis=(0, 1))
        if order < max(ORDERS):
            prior = np.zeros_like(prior)
            for a in range(1, len(s) + 1):
                run = np.zeros(n, np.float32)
                for b in range(1, len(t) + 1):
                    run = DECAY * run + match[a - 1, b - 1]
                    prior[a, b] = DECAY * prior[a - 1, b] + run
    return total


def own_kernel(s: np.ndarray) -> np.ndarray:
    return raw_kernel(s, np.where(s == 0, 1, s))


def pair_kernel(s: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Normalised kernel, 0 to 1, of row i[k] of ``s`` with row j[k] of ``t``; pairs of
    like lengths are computed together."""
    sizes, others = (s > 0).sum(axis=1), (t > 0).sum(axis=1)
    out, norm = np.zeros(len(i), np.float32), np.zeros(len(s), np.float32)
    used = np.unique(i)
    used = used[np.argsort(sizes[used], kind="stable")]
    for k in range(0, len(used), 4000):
        part = used[k:k + 4000]
        norm[part] = own_kernel(s[part, :max(sizes[part[-1]], 1)].T)
    other = own_kernel(t.T)
    order = np.lexsort((others[j], sizes[i]))
    for k in range(0, len(order), 4000):
        part = order[k:k + 4000]
        left, right = s[i[part], :max(sizes[i[part]].max(), 1)], t[j[part], :max(others[j[part]].max(), 1)]
        out[part] = raw_kernel(left.T, np.where(right == 0, 1, right).T)
    scale = np.sqrt(norm[i] * other[j])
    return np.minimum(np.divide(out, scale, out=np.zeros(len(i), np.float32), where=scale > 0), 1)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    pairs = np.arange(len(left))
    return pair_kernel(codes(left), codes(right), pairs, pairs) if left else np.zeros(0)


class Likeness(ChunkEncoder):
    """For each distinct word the landmarks it is like, as (landmark, value) pairs."""

    def __init__(self, landmarks: list[str]):
        super().__init__()
        self.landmarks, self.codes = landmarks, codes(landmarks)
        self.masks = np.asarray([_mask(x) for x in landmarks], np.uint64)
        self.may_lack = (np.bitwise_count(self.masks) * MAY_LACK).astype(np.uint8)

    def _starts(self, texts: Texts) -> np.ndarray:
        """Every word is a chunk, whatever its first character."""
        begins = texts.offsets[:-1]
        return np.union1d(words(texts).starts, begins[begins < len(texts.data)])

    def encode_strings(self, strings: list[str]) -> list[list[int]]:
        parts, owner = [], []
        for i, word in ((i, plain(word)) for i, chunk in enumerate(strings) for word in chunk.split()):  # as fit() splits
            for at in range(0, max(len(word) - WIDTH // 2, 1), WIDTH // 2):  # a very long word in overlapping parts
                parts.append(word[at:at + WIDTH])
                owner.append(i)
        masks = np.asarray(list(map(_mask, parts)), np.uint64)
        w, j = np.nonzero(np.bitwise_count(self.masks[None, :] & ~masks[:, None]) <= self.may_lack)
        value = pair_kernel(codes(parts), self.codes, w, j)
        out: list[list[int]] = [[] for _ in strings]
        for i in np.flatnonzero(value > FLOOR).tolist():
            out[owner[w[i]]] += [int(j[i]), int(value[i] * 65535)]
        return out

    def features(self, texts: Texts) -> np.ndarray:
        """Three values per landmark over the words of a text, each of the kernel to the
        power SHARPEN: the largest, the logarithm of the sum, the sum by root of length."""
        ids, at = self.encode(texts)
        m, n = len(self.landmarks), len(texts)
        found = words(texts)
        cell = np.repeat(np.arange(n), np.diff(at) // 2) * m + ids[0::2]
        value = (ids[1::2] / 65535) ** SHARPEN
        spelt = [self._spelt(texts, found)] if len(found.starts) else []
        for cells, values in spelt:
            cell, value = np.append(cell, cells).astype(np.int64), np.append(value, values)
        most = np.zeros(n * m)
        np.maximum.at(most, cell, value)
        total = np.bincount(cell, value, n * m).reshape(n, m)
        return np.hstack((most.reshape(n, m), np.log1p(total), total / np.sqrt(found.counts() + 1.0)[:, None]))

    def _spelt(self, texts: Texts, found) -> tuple[list[int], list[float]]:
        """Words written letter by letter, with blanks between."""
        single = np.flatnonzero(found.ends - found.starts == 1)
        cells, values = [], []
        doc = np.searchsorted(found.first, single, "right") - 1
        for run in np.split(single, np.flatnonzero((np.diff(single) != 1) | (np.diff(doc) != 0)) + 1):
            if len(run) >= 3:
                d = int(np.searchsorted(found.first, run[0], "right")) - 1
                pairs = self.encode_strings([texts.data[found.starts[run]].tobytes().decode("ascii", "replace")])[0]
                cells += [d * len(self.landmarks) + j for j in pairs[0::2]]
                values += [(v / 65535) ** SHARPEN for v in pairs[1::2]]
        return cells, values


def likeness(landmarks: list[str]) -> Likeness:
    """One per worker, so that words are compared once."""
    return held((Likeness, *landmarks), lambda: Likeness(landmarks))


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # over the features, the Nyström map folded in
    bias: float
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, gram: np.ndarray, cost: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float, float, float]:
    """Squared-hinge linear machine by Newton steps on the Nyström features, then the
    logistic curve on its margins."""
    value, vector = np.linalg.eigh(gram ** SHARPEN)
    root = np.kron(np.eye(3), vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T)
    z = np.hstack((x @ root, np.ones((len(x), 1))))
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, max((y == 0).sum(), 1) / max((y > 0).sum(), 1), 1.0) ** 0.5 * cost
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        slack = np.maximum(1 - sign * (z @ w), 0)
        active = slack > 0
        za = z[active] * weight[active, None]
        step = np.linalg.solve(ridge + z[active].T @ za, ridge @ w - za.T @ (sign * slack)[active])
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    margin = z @ w
    # targets a little inside 0 and 1, so that separable labels do not make a step of the curve
    toxic, clean = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    slope = 2.0  # the curve passes 1/2 where the machine decides
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        step = (margin * (p - target)).sum() / ((margin ** 2 * p * (1 - p)).sum() + 1e-3)
        slope -= np.clip(step, -1, 1)
        if abs(step) < 1e-8:
            break
    return root @ w[:-1], float(w[-1]), float(max(slope, 1e-6)), 0.0


def fit(texts: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """``texts``: at most MAX_LABELLED labelled rows. Word counts are added up by Spark;
    the driver gets the landmarks and one vector per labelled text."""
    rows = texts.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y")) \
        .where("text IS NOT NULL AND y IS NOT NULL").dropDuplicates(["text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in set(map(plain, text.split())):
                    seen.setdefault(word, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "clean": pa.array([a for a, _ in seen.values()], pa.int64()),
                                              "toxic": pa.array([b for _, b in seen.values()], pa.int64())})

    size = {r["y"] > 0: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = size.get(False, 0), size.get(True, 0)
    if not clean or not toxic:
        return Model([], np.zeros(0), -1.0 if not toxic else 1.0, 4.0, 0.0)
    counted = rows.mapInArrow(count, "word STRING, clean BIGINT, toxic BIGINT").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, c = F.col("toxic") / float(toxic), F.col("clean") / float(clean)
    both = (F.col("toxic") + F.col("clean")) / float(toxic + clean)
    best = counted.where((F.col("toxic") >= LEAST_TEXTS) & (a > c) & (F.length("word") >= 3) & (F.length("word") <= WIDTH)) \
        .select("word", (F.pow(a - c, F.lit(2)) / both).alias("weight")).orderBy(F.desc("weight"), "word").limit(8 * LANDMARKS)
    landmarks: list[str] = []
    for word in [r["word"] for r in best.collect()]:
        if len(landmarks) < LANDMARKS and (not landmarks or kernel([word] * len(landmarks), landmarks).max() < APART):
            landmarks.append(word)
    if not landmarks:
        return Model([], np.zeros(0), -1.0, 4.0, 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = likeness(landmarks)
        for batch in batches:
            for part in pieces(batch.column(0)):
                x = like.features(part)
                yield pa.RecordBatch.from_pydict({"y": batch.column(1).slice(part.rows.start, len(part)), "x": list(x)})

    table = rows.mapInArrow(features, "y INT, x ARRAY<DOUBLE>").toArrow()
    x = np.asarray(table.column("x").to_pylist(), float).reshape(-1, 3 * len(landmarks))
    y = table.column("y").to_numpy()
    m = len(landmarks)
    gram = kernel([a for a in landmarks for _ in range(m)], landmarks * m).reshape(m, m)
    return Model(landmarks, *train(x, y, gram))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row. Null and empty texts are like no
    landmark and get the score of the bias alone; repeated rows get equal scores; a null
    id stays null; other columns are ignored; long texts and words are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = likeness(model.landmarks)
        for batch in batches:
            for texts in pieces(batch.column(1)):
                x = like.features(texts) if model.landmarks else np.zeros((len(texts), 0))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(texts.rows.start, len(texts)), "score": model.score(x)})

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id BIGINT, score DOUBLE").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", limit: int = MAX_LABELLED) -> DataFrame:
    """The texts of at most ``limit`` labelled rows, those of the smallest hashes. The
    chosen ids are broadcast: at most ``limit`` pairs of numbers."""
    chosen = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y")) \
        .where("label_id IS NOT NULL AND y IS NOT NULL").groupBy("label_id").agg(F.max("y").alias("y")) \
        .orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("label_id")).select(F.col("text"), F.col("y").alias(label_col))

"""Array kernels over the bytes of one batch of texts: word bounds and hashes.

Texts stay in Arrow's byte buffer; no Python string per word is made. All hashes
are polynomial sums modulo 2**64 followed by a bit mixer, so the hash of any byte
or word range is a difference of prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes of text worked on at once
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
#: digits, lower-case letters and everything outside ASCII, for text already lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
_BLOCK = 1 << 16
#: of longer byte ranges that follow each other, so many bytes are hashed at once
_STRETCH = 1 << 22


@lru_cache(maxsize=len(_BASES))
def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0.._BLOCK-1 and their inverses modulo 2**64."""
    up, down = np.full(_BLOCK, base, U64), np.full(_BLOCK, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Hasher:
    """Hashes of ranges of ``values`` from one array of prefix sums; powers are kept for
    one block and one step per block, so they do not grow with the values."""

    def __init__(self, values: np.ndarray, kind: int = 0):
        self.base, n = _BASES[kind], len(values)
        up, self.down = powers(self.base)
        jumps = [pow(self.base, _BLOCK * i, 1 << 64) for i in range(n // _BLOCK + 1)]
        self.back = np.asarray([pow(j, -1, 1 << 64) for j in jumps], U64)
        self.total = np.zeros(n + 1, U64)
        for i, jump in enumerate(jumps):
            part = values[i * _BLOCK:(i + 1) * _BLOCK]
            if len(part):
                out = self.total[i * _BLOCK + 1:i * _BLOCK + 1 + len(part)]
                np.cumsum((part.astype(U64) + U64(1)) * up[:len(part)] * U64(jump), out=out)
                out += self.total[i * _BLOCK]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        shift = self.down[starts & (_BLOCK - 1)] * self.back[starts >> 16]
        return mix((self.total[ends] - self.total[starts]) * shift + (ends - starts).astype(U64) * U64(self.base))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hash of values[start:end] for every range; ``kind`` picks one of three
    independent hashes."""
    if len(values) <= _STRETCH or not len(starts) or (starts[1:] < ends[:-1]).any():
        return Hasher(values, kind).of(starts, ends)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(values) + _STRETCH, _STRETCH)))
    return np.concatenate([Hasher(values[starts[a]:ends[b - 1]], kind).of(starts[a:b] - starts[a], ends[a:b] - starts[a])
                           for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])


@dataclass
class Texts:
    """Some texts of a batch: ``data`` bytes, text i at offsets[i]:offsets[i+1]."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Word i of all texts at data[starts[i]:ends[i]]; words of text d are
    first[d]:first[d+1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def pieces(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column in slices of about ``limit`` bytes; a longer
    text is a slice of its own. Null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(slice(at, end), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        at = end


def words(texts: Texts, table: np.ndarray = WORD) -> Words:
    """Maximal runs of bytes of ``table`` inside each text."""
    n, offsets = len(texts.data), texts.offsets
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[texts.data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    begins[offsets] |= inside[offsets]
    edge = offsets[offsets > 0] - 1
    stops[edge] |= inside[edge]
    starts, ends = np.flatnonzero(begins[:n]), np.flatnonzero(stops[:n]) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, width: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside texts, and the word each starts at."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    starts = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return range_hashes(hashes, starts, starts + width, kind), starts


def bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def gather(positions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices position[i] .. position[i]+count[i]-1, one range after the other."""
    at = bounds(counts)
    return np.repeat(positions - at[:-1], counts) + np.arange(at[-1])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """``make()``, kept in this worker for the next task that asks for the same ``key``.
    Only the last one is kept, so a reused worker does not gather what earlier stages needed."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drops what ``held`` keeps, before a task that needs the memory itself."""
    _HELD.clear()

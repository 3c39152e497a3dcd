"""Code points, letters and scripts of a slice of texts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from ledgerloom.llm.kernels import Texts

# First and last code point of each script's main blocks.
RANGES = {
    "latin": [(0x0041, 0x005A), (0x0061, 0x007A), (0x00AA, 0x00AA), (0x00BA, 0x00BA), (0x00C0, 0x024F), (0x1E00, 0x1EFF),
              (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
NAMES = ["other", *RANGES]
_SIZE = 0x110000


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    out = np.zeros(_SIZE, np.uint8)
    for i, ranges in enumerate(RANGES.values(), 1):
        for first, last in ranges:
            out[first:last + 1] = i
    return out


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """1 for letters, 2 for marks, which continue a word but do not make one."""
    out = np.zeros(_SIZE, np.uint8)
    for i in range(0x323B0):
        kind = unicodedata.category(chr(i))[0]
        out[i] = 1 if kind == "L" else 2 if kind == "M" else 0
    return out


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    out = np.arange(_SIZE, dtype=np.uint32)
    for i in np.flatnonzero(letter_table() == 1).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the slice and where each text's begin."""
    points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), "<u4")
    lead = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[texts.offsets]


def text_scripts(texts: Texts) -> list[str]:
    """The script with most letters of each text; 'none' without letters."""
    points, at = code_points(texts)
    kinds = np.where(letter_table()[points] == 1, script_table()[points].astype(np.int64) + 1, 0)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    counts = np.bincount(doc * 16 + kinds, minlength=16 * len(texts)).reshape(-1, 16)[:, 1:]
    best = counts.argmax(axis=1)
    return ["none" if counts[i, b] == 0 else NAMES[b] for i, b in enumerate(best.tolist())]

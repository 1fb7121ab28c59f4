"""Hashed n-grams of texts, as NumPy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SLICE = 1 << 20
_SPACE = re.compile(r"\s")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def slices(text: str) -> Iterator[str]:
    """The text in pieces of a million characters or a little more, cut at white space."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        gap = _SPACE.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def chained(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` values that follow one another."""
    size = len(values) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = values[:size] + np.uint64(n)
    for k in range(1, n):
        out = out * _STEP + values[k : k + size]
    return out


def letter_grams(text: str, longest: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of up to ``longest`` letters, lower-cased; what stands between words counts as one blank."""
    points = code_points(text.lower())
    letter = letters()[points]
    if not letter.any():
        return
    kept = letter | np.append(True, letter[:-1])
    line = np.where(letter, points, 32)[kept].astype(np.uint64)
    line = np.concatenate([[np.uint64(32)], line, [np.uint64(32)]]) if line[0] != 32 else np.append(line, np.uint64(32))
    for n in range(1, longest + 1):
        yield chained(line, n)


@lru_cache(1)
def kinds() -> np.ndarray:
    """Bits for each code point: 1 upper case, 2 letter, 4 digit, 8 anything else that is not white space; 0 white space."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        out[c] = 0 if x.isspace() else (3 if x.isupper() else 2) if x.isalpha() else 4 if x.isdigit() else 8
    return out


@lru_cache(1)
def lower_case() -> np.ndarray:
    """For each code point the first one of its lower case."""
    return np.fromiter((ord(chr(c).lower()[0]) for c in range(0x110000)), np.uint32, 0x110000)


def style_grams(text: str, letters_of: int = 3, words_of: int = 2, shapes_of: int = 4) -> Iterator[np.ndarray]:
    """Hashes of n-grams of characters, of words, and of word shapes (case, digits, signs, length, whether a word repeats)."""
    points = code_points(text)
    kind = kinds()[points]
    inside = kind > 0
    if not inside.any():
        return
    low = np.where(kind == 4, 48, np.where(inside, lower_case()[points], 32)).astype(np.uint64)
    kept = inside | np.append(False, inside[:-1])
    for n in range(1, letters_of + 1):
        yield chained(low[kept], n) + np.uint64(1 << 40)
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    low, kind, first = low[inside], kind[inside], (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(first, len(low)))
    place = np.arange(len(low)) - np.repeat(first, lengths)
    mixed = (low + np.uint64(7)) * (place.astype(np.uint64) * _MIX | np.uint64(1))
    words = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), first)
    for n in range(1, words_of + 1):
        yield chained(words, n) + np.uint64(2 << 40)
    seen = np.bitwise_or.reduceat(kind, first).astype(np.uint64)
    last = kind[first + lengths - 1].astype(np.uint64)
    repeats = np.append(False, words[1:] == words[:-1]).astype(np.uint64)
    sizes = np.minimum(np.log2(lengths).astype(np.uint64), 6)
    shapes = seen | last << np.uint64(4) | sizes << np.uint64(8) | repeats << np.uint64(12)
    for n in range(1, shapes_of + 1):
        yield chained(shapes, n) + np.uint64(n + 3 << 40)

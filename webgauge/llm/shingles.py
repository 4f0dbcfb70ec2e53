"""Shingle hashes of texts, as arrays."""

from __future__ import annotations

import numpy as np

from .common import chunks_by_size
from .pretok import SPACE, _class_table, code_points, hashes

STEP = np.uint64(0x9E3779B97F4A7C15)


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, first word of each text and the end): words are runs without white space."""
    cp, offsets = code_points(texts)
    n = len(cp)
    word = np.zeros(n + 2, bool)
    word[1:-1] = _class_table()[cp] != SPACE
    start = word[1:-1] & ~word[:-2]
    end = word[1:-1] & ~word[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] |= word[1:-1][inner]
    end[inner - 1] |= word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return cp, starts, ends, np.searchsorted(starts, offsets)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def shingle_batches(texts: list[str], words: int, chars_at_once: int = 2_000_000):
    """(lo, hi, word hashes, word bounds, shingle hashes, shingle bounds) of consecutive texts in lower case.

    A text of fewer words than ``words``, but some, has one shingle of them all.
    """
    for lo, hi in chunks_by_size(texts, chars_at_once):
        cp, starts, ends, bounds = word_spans([t.lower() for t in texts[lo:hi]])
        h = hashes(cp, starts, ends)
        count = np.diff(bounds)
        own = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        at = np.concatenate([[0], np.cumsum(own)])
        first = np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], own)
        padded = np.concatenate([h, np.zeros(words, np.uint64)])
        short = np.repeat(count < words, own)
        left = np.repeat(count, own)
        s = np.zeros(at[-1], np.uint64)
        for k in range(words):
            s = s * STEP + np.where(short & (k >= left), np.uint64(0), padded[first + k])
        yield lo, hi, h, bounds, _mixed(s), at


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for lo, hi, _, _, s, at in shingle_batches(texts, words):
        out += [np.unique(s[at[i] : at[i + 1]]) for i in range(hi - lo)]
    return out

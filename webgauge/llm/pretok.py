"""Vectorised pre-tokenisation and caches of distinct pre-tokens.

Texts become one array of code points; the boundaries that the tokenizers' split patterns define are found with
array operations, and each pre-token gets a 64-bit keyed polynomial hash.  Distinct pre-tokens (far fewer than
occurrences) are handed to an encoder once and kept in a bounded cache per Python worker.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE = 1, 2, 3
CLASSES = {LETTER: r"\p{L}+", NUMBER: r"\p{N}+", SPACE: r"\s+"}
#: Code points that can be of a class: planes 4 to 13 are unassigned, 15 and 16 are for private use.
CLASSED = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)]
WORD, BYTE = "word", "byte"

_tables: dict[str, np.ndarray] = {}


def _runs(pattern: str, text: str) -> list[tuple[int, int]]:
    """Where the library finds the pattern in a text."""
    from tokenizers import Regex, pre_tokenizers

    return [at for _, at in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text)]


def _class_table() -> np.ndarray:
    """The class of every code point by the tokenizers library's own tables, which know newer letters than Python's."""
    if "class" not in _tables:
        t = np.zeros(0x110000, np.uint8)
        text = "".join(map(chr, CLASSED))
        runs = np.array(_runs("|".join(CLASSES.values()), text), np.int64)  # each of one class
        first = "\0".join(text[a] for a in runs[:, 0].tolist())
        kind = np.zeros(len(runs), np.uint8)
        for k, pattern in CLASSES.items():
            kind[[a // 2 for a, _ in _runs(pattern, first)]] = k
        lengths = runs[:, 1] - runs[:, 0]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        t[np.array(CLASSED)[np.repeat(runs[:, 0], lengths) + within]] = np.repeat(kind, lengths)
        _tables["class"] = t
        _tables["other"] = _normalised_otherwise()
        _tables["mix"] = np.random.default_rng(20240607).integers(1, 2**63, 0x110000, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["class"]


def library_normalizer():
    """The word vocabulary's normaliser in the tokenizers library."""
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def _normalised_otherwise() -> np.ndarray:
    """Code points that the library may normalise otherwise than Python: the two know letters and marks of different ages."""
    other = np.zeros(0x110000, bool)
    normalize = library_normalizer()
    chars = [chr(i) for i in CLASSED if i]
    other[[ord(c) for c in chars if unicodedata.category(c) == "Cn"]] = True
    # single characters; marks before and after known ones of several classes; pairs that compose
    cases = [(c, c) for c in chars]
    cases += [(c, "a" + x) for c in chars if unicodedata.combining(c) for known in "\u0300\u0323\u0345\u3099" for x in (known + c, c + known)]
    for c in chars:
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in parts.split())
            cases += [(x, pair) for x in pair]
    text = "\0".join(x for _, x in cases)
    for (c, _), a, b in zip(cases, normalize(text).split("\0"), clean_word_text(text).split("\0")):
        if a != b:
            other[ord(c)] = True
    return other


def _mix_table() -> np.ndarray:
    _class_table()
    return _tables["mix"]


def _powers(n: int) -> np.ndarray:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        p = np.full(max(n, 4096), np.uint64(0x9E3779B97F4A7C15))
        p[0] = 1
        _tables["pow"] = have = np.multiply.accumulate(p)
    return have


def clean_word_text(text: str) -> str:
    """The normaliser of the word vocabulary: NFC, then lower case one character at a time."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # a final capital sigma has no context here
    return text.lower()


def clean_word_texts(texts: list[str]) -> list[str]:
    """``clean_word_text`` of each; texts with characters that Python may normalise otherwise are left to the library."""
    out = [clean_word_text(t) for t in texts]
    _class_table()
    rest = [i for i, t in enumerate(texts) if not t.isascii()]
    cp, offsets = code_points([texts[i] for i in rest])
    other = np.flatnonzero(_tables["other"][cp])
    if len(other):
        normalize = library_normalizer()
        for k in np.unique(np.searchsorted(offsets, other, side="right") - 1).tolist():
            out[rest[k]] = normalize(texts[rest[k]])
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points and the offset of each text (one offset more than texts)."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def spans(cp: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts laid end to end.

    ``word``: contractions, letter runs, single numbers, runs of anything else; white space is dropped.
    ``byte``: contractions, and runs of letters, numbers or anything else with one space before; white space runs.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = _class_table()[cp]
    first = np.zeros(n + 1, bool)  # where a text begins
    first[offsets] = True
    brk = np.empty(n + 1, bool)
    brk[0] = brk[n] = True
    np.not_equal(cls[1:], cls[:-1], out=brk[1:n])
    brk |= first
    if kind == WORD:
        brk[:n] |= cls == NUMBER
    quote = np.flatnonzero((cp == 39) & brk[:n] & brk[1:])
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == LETTER) & ~first[quote + 1]]
    if kind == BYTE and len(quote):
        quote = quote[first[quote] | (cp[quote - 1] != 32)]
    if kind == BYTE:
        last = np.flatnonzero((cls == SPACE) & brk[1:] & ~first[1:])
        last = last[last + 1 < n]
        brk[last] = True
        brk[last[cp[last] == 32] + 1] = False
    if len(quote):
        a = cp[quote + 1]
        b = cp[np.minimum(quote + 2, n - 1)]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        two &= (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        for hit, k in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            brk[q + 1] = False
            brk[q + 1 + k] = True
    edges = np.flatnonzero(brk)
    starts, ends = edges[:-1], edges[1:]
    if kind == WORD:
        keep = cls[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans don't overlap and ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.repeat(starts, lengths) if lengths.sum() == len(cp) else None
    if inside is None:
        index = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        chars = _mix_table()[cp[index]]
        inside = index - np.repeat(starts, lengths)
    else:
        chars = _mix_table()[cp]
        inside = np.arange(len(cp)) - inside
    chars *= _powers(int(lengths.max()))[inside]
    h = np.add.reduceat(chars, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class SpanCache:
    """Values of distinct pre-tokens by hash, in sorted arrays; emptied when it holds ``limit`` keys or ``room`` values.

    ``encode(list of words)`` gives (lengths, flat values): the values of each word one after the other.
    """

    def __init__(self, encode, dtype, limit: int = 700_000, room: int | None = None):
        self.encode, self.dtype, self.limit, self.room = encode, dtype, limit, room
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.dtype)

    def lookup(self, text: str, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each span, where its values begin in ``self.flat`` and how many they are."""
        codes, uniques = pd.factorize(h)
        if len(self.keys) + len(uniques) > self.limit or self.room is not None and len(self.flat) > self.room:
            self.clear()
        at = np.searchsorted(self.keys, uniques)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == uniques if len(self.keys) else np.zeros(len(uniques), bool)
        if not known.all():
            example = np.empty(len(uniques), np.int64)
            example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = np.flatnonzero(~known)
            words = [text[s:e] for s, e in zip(starts[example[new]].tolist(), ends[example[new]].tolist())]
            lengths, flat = self.encode(words)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + len(self.flat)
            keys = np.concatenate([self.keys, uniques[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at = np.concatenate([self.at, begin])[order]
            self.len = np.concatenate([self.len, np.asarray(lengths, np.int32)])[order]
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            at = np.searchsorted(self.keys, uniques)
        return self.at[at][codes], self.len[at][codes]


def gather(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + lengths[i]] of each i, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return flat[:0]
    full = lengths > 0
    at, lengths = at[full], lengths[full].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out[begin[0]] = at[0]
    out[begin[1:]] = at[1:] - at[:-1] - lengths[:-1] + 1
    return flat[np.cumsum(out)]

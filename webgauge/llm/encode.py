"""Whole-text token ids with the tokenizers library, its work done once for each distinct pre-token."""

from __future__ import annotations

import json
import re

import numpy as np

from .common import chunks_by_size, single_threaded
from .pretok import BYTE, WORD, SpanCache, clean_word_texts, code_points, gather, hashes, spans

CHARS_AT_ONCE = 3_000_000
_encoders: dict[str, "TextEncoder"] = {}


def tokenizer_layout(path: str) -> tuple[dict, str, list[str]]:
    """The file's JSON, its kind of pre-tokens, and the strings of its added tokens."""
    with open(path, encoding="utf-8") as f:
        layout = json.load(f)
    kind = WORD if layout["model"].get("end_of_word_suffix") else BYTE
    return layout, kind, [t["content"] for t in layout["added_tokens"]]


class TextEncoder:
    """Ids of whole texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    Pre-tokens are independent of each other under BPE, so distinct ones are encoded by the library once and their
    ids gathered.  Texts that hold an added token's string go to the library whole.
    """

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        layout, self.kind, added = tokenizer_layout(path)
        self.library = self.of_words = Tokenizer.from_file(path)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        if self.kind == WORD:
            vocab = layout["model"]["vocab"]
            self.is_end = np.zeros(max(vocab.values()) + 1, bool)
            self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
            # pre-tokens are normalised already, and doing so again may reorder marks
            self.of_words = Tokenizer.from_str(json.dumps(layout | {"normalizer": None}))
        del layout
        self.cache = SpanCache(self._encode_words, np.uint16 if self.library.get_vocab_size() <= 65536 else np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == WORD:  # white space is dropped and each pre-token's last id is marked, so words can share a call
            texts = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
            ids = np.concatenate([np.asarray(e.ids, np.int64) for e in self.of_words.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(words):
                return np.diff(ends, prepend=0), ids
        got = [e.ids for i in range(0, len(words), 5000) for e in self.of_words.encode_batch_fast(words[i : i + 5000], add_special_tokens=False)]
        return np.array([len(x) for x in got]), np.fromiter((i for x in got for i in x), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, number of ids of each text)."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        for lo, hi in chunks_by_size(texts, CHARS_AT_ONCE):
            chunk = texts[lo:hi]
            whole = [i for i, t in enumerate(chunk) if self.special and self.special.search(t)]
            plain = clean_word_texts(chunk) if self.kind == WORD else list(chunk)
            for i in whole:
                plain[i] = ""
            cp, offsets = code_points(plain)
            starts, ends = spans(cp, offsets, self.kind)
            at, lengths = self.cache.lookup("".join(plain), starts, ends, hashes(cp, starts, ends)) if len(starts) else (starts, starts)
            ids = gather(self.cache.flat, at, lengths)
            before = np.concatenate([[0], np.cumsum(lengths)])
            bound = before[np.searchsorted(starts, offsets)]
            count = np.diff(bound)
            if whole:
                pieces = np.split(ids, bound[1:-1])
                for i in whole:
                    pieces[i] = np.asarray(self.library.encode(chunk[i], add_special_tokens=False).ids, ids.dtype if len(ids) else np.uint32)
                    count[i] = len(pieces[i])
                ids = np.concatenate([p.astype(np.uint32) for p in pieces])
            parts.append(ids.astype(np.uint32))
            counts[lo:hi] = count
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts


def encoder(path: str) -> TextEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]

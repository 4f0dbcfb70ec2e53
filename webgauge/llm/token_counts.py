"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are laid end to end as symbol arrays.  In each round every sequence merges its pair of
lowest rank at all its places at once; sequences without a mergeable pair leave.  What survives is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_size, text_or_empty, tokenizer_path
from .encode import CHARS_AT_ONCE, tokenizer_layout
from .pretok import WORD, SpanCache, clean_word_texts, code_points, hashes, spans

VOCABULARY = "word_bpe_49k.json"
MAX_TOKENS = 2048
_counters: dict[str, "TokenCounter"] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by the published rule."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeTable:
    """Merges as sorted arrays: pair key -> rank and merged symbol."""

    def __init__(self, layout: dict):
        vocab, suffix = layout["model"]["vocab"], layout["model"].get("end_of_word_suffix") or ""
        self.width = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in layout["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.none = len(merges)
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.final = np.array([vocab[c + suffix] for c in names], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)


def merge_all(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end; (surviving symbols laid end to end, their number in each sequence)."""
    count = lengths.astype(np.int64).copy()
    final: list[np.ndarray] = [np.zeros(0, np.int64)] * 0
    owner_final: list[np.ndarray] = []
    owner = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.full(len(symbols), table.none, np.int64)
    if len(symbols) > 1:
        inner = owner[1:] == owner[:-1]
        rank[:-1][inner] = table.ranks(symbols[:-1][inner], symbols[1:][inner])
    while len(symbols):
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(begin, len(symbols)))
        lowest = np.minimum.reduceat(rank, begin)
        done = np.repeat(lowest == table.none, size)
        if done.any():
            final.append(symbols[done])
            owner_final.append(owner[done])
            symbols, owner, rank = symbols[~done], owner[~done], rank[~done]
            keep = lowest != table.none
            size, lowest = size[keep], lowest[keep]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == np.repeat(lowest, size))
        # of touching places (a a a) every second one merges, from the left
        run = np.cumsum(np.concatenate([[True], hit[1:] != hit[:-1] + 1])) - 1
        head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run
        hit = hit[(np.arange(len(hit)) - head[run]) % 2 == 0]
        symbols[hit] = table.merged[rank[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        np.subtract.at(count, owner[hit], 1)
        moved = np.cumsum(keep) - 1
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        now = moved[hit]
        fresh = np.unique(np.concatenate([now, now[now > 0] - 1]))
        rank[fresh] = table.none
        fresh = fresh[fresh + 1 < len(symbols)]
        fresh = fresh[owner[fresh] == owner[fresh + 1]]
        rank[fresh] = table.ranks(symbols[fresh], symbols[fresh + 1])
    if final:
        every, owners = np.concatenate(final), np.concatenate(owner_final)
        return every[np.argsort(owners, kind="stable")], count
    return symbols, count


class TokenCounter:
    """Counts tokens of whole texts under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        layout, self.kind, added = tokenizer_layout(path)
        self.table = MergeTable(layout)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.cache = SpanCache(lambda words: (np.ones(len(words), np.int64), self.count_words(words)), np.int32)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        out = self.table.inner[data]
        last = np.cumsum(lengths) - 1
        out[last] = self.table.final[data[last]]
        return out, lengths

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of each (non-empty) pre-token, and how many."""
        return merge_all(self.table, *self.symbols(words))

    def count_words(self, words: list[str]) -> np.ndarray:
        return self.ids(words)[1]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an added token's string in a text is one token."""
        totals = np.zeros(len(texts), np.int64)
        for lo, hi in chunks_by_size(texts, CHARS_AT_ONCE):
            parts, owner = [], []
            for i in range(lo, hi):
                pieces = self.special.split(texts[i]) if self.special and self.special.search(texts[i]) else [texts[i]]
                totals[i] += len(pieces) - 1
                parts += pieces
                owner += [i] * len(pieces)
            if self.kind == WORD:
                parts = clean_word_texts(parts)
            cp, offsets = code_points(parts)
            starts, ends = spans(cp, offsets, self.kind)
            if not len(starts):
                continue
            at, _ = self.cache.lookup("".join(parts), starts, ends, hashes(cp, starts, ends))
            before = np.concatenate([[0], np.cumsum(self.cache.flat[at], dtype=np.int64)])
            np.add.at(totals, owner, np.diff(before[np.searchsorted(starts, offsets)]))
        return totals


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row for each input row.

    A null text counts as empty (0 tokens); a null id stays null; other columns aren't read, whatever their names;
    repeated rows give repeated results; an empty table gives an empty result.  Texts of any length are counted whole, a
    few million characters at a time; a longer one is held alone.  Row-wise: no shuffle.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for b in batches:
            n = counts.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(n > max_tokens)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)

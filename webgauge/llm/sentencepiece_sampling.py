"""Sampled segmentations over a SentencePiece vocabulary, and their decoding.

A text is a space and itself, its spaces written as the word mark; segments begin at each mark, which no piece crosses.  One
of more than SEGMENT_CHARS characters is also parted between characters that no piece holds side by side; whatever is
left is one segment, however long.  The lattice of a segment has an edge for each piece that matches, and a byte-fallback edge for
a character that is no piece.  Forward filtering sums the weights exp(theta * score) of all paths to each node, once for
each distinct segment; backward sampling then draws every segment's path edge by edge.  Its random numbers are a
function of the row's key and the position only, so a row is segmented alike in any run and partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_size, text_or_empty, tokenizer_path
from .pretok import SpanCache, _mix_table, _powers, code_points, gather, hashes

MODEL = "piece_bpe_32k.model"
THETA = 5e-4
SEGMENT_CHARS = 48
MARK, OWN_MARK = "▁", "\udc00"  # a mark that a text itself holds is replaced by a code point that no text can hold
BYTE_EDGE = 0xFFFF
#: Pieces added by hand, such as runs of spaces, have no score; of these only the single mark takes part.
UNSCORED = -1e8
_samplers: dict[tuple[str, float], "Sampler"] = {}


def _uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = seed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Sampler:
    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.theta = theta
        self.raw: list[bytes] = [b""] * size
        self.byte_id = np.zeros(256, np.int64)
        self.is_byte = np.zeros(size, bool)
        pieces: list[str] = []
        ids: list[int] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b], self.raw[i], self.is_byte[i] = i, bytes([b]), True
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = piece.replace(MARK, " ").encode()
                if piece == MARK or model.get_score(i) > UNSCORED and MARK not in piece[1:]:
                    pieces.append(piece)
                    ids.append(i)
        cp, offsets = code_points(pieces)
        h = self._substrings(cp, offsets[:-1], np.diff(offsets))
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array(ids)[order]
        scores = np.array([model.get_score(i) for i in ids])
        lowest = scores[scores > UNSCORED].min()
        self.score = np.where(scores > UNSCORED, scores, lowest)[order] * theta
        self.byte_score = (lowest - 1000) * theta
        self.longest = int(np.diff(offsets).max())
        self.raw_len = np.array([len(b) for b in self.raw])
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        beside = np.ones(len(cp), bool)
        beside[offsets[:-1]] = False
        at = np.flatnonzero(beside)
        self.pairs = np.unique(self._pairs(cp, at))
        self.cache = SpanCache(self._lattices, np.int64, limit=400_000, room=8_000_000)
        self._clear_edges()

    def _clear_edges(self) -> None:
        self.edge_len, self.edge_id, self.edge_cum = np.zeros(0, np.uint8), np.zeros(0, np.uint16), np.zeros(0, np.float32)

    @staticmethod
    def _inverse(n: int) -> np.ndarray:
        b = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        p = np.full(n, np.uint64(b))
        p[0] = 1
        return np.multiply.accumulate(p)

    @staticmethod
    def _pairs(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number of each character of ``at`` and the one before it."""
        return cp[at - 1].astype(np.int64) << 21 | cp[at].astype(np.int64)

    def _substrings(self, cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A hash of cp[starts : starts + lengths] by prefix sums."""
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix_table()[cp] * _powers(len(cp))[: len(cp)], dtype=np.uint64)])
        h = (prefix[starts + lengths] - prefix[starts]) * self._inverse(len(cp) + 1)[starts]
        return h ^ (h >> np.uint64(32))

    def _lattices(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Edges of new segments; a value for each node: where its edges begin * 64 + how many they are."""
        if not len(self.cache.keys):
            self._clear_edges()
        parts = []
        for lo, hi in chunks_by_size(words, 400_000):
            parts.append(self._lattice_part(words[lo:hi]))
        return np.array([len(w) for w in words], np.int64), np.concatenate(parts)

    def _lattice_part(self, words: list[str]) -> np.ndarray:
        cp, offsets = code_points(words)
        n = len(cp)
        sizes = np.diff(offsets)
        place = np.arange(n) - np.repeat(offsets[:-1], sizes)
        left = np.repeat(sizes, sizes) - place
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix_table()[cp] * _powers(n)[:n], dtype=np.uint64)])
        inverse = self._inverse(n + 1)
        ends, lengths, which = [], [], []
        single = np.zeros(n, bool)
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            h = (prefix[at + size] - prefix[at]) * inverse[at]
            h ^= h >> np.uint64(32)
            k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = self.hash[k] == h
            ends.append(at[hit] + size - 1)
            lengths.append(np.full(int(hit.sum()), size))
            which.append(k[hit])
            if size == 1:
                single[at[hit]] = True
        none = np.flatnonzero(~single)
        ends.append(none)
        lengths.append(np.ones(len(none), np.int64))
        which.append(np.full(len(none), -1))
        end, length, which = np.concatenate(ends), np.concatenate(lengths), np.concatenate(which)
        order = np.argsort(end, kind="stable")
        end, length, which = end[order], length[order], which[order]
        score = np.where(which >= 0, self.score[which], self.byte_score)
        # every path passes a node that no edge crosses, so weights are summed from the last one
        steps = np.bincount(end - length + 1, minlength=n + 1) - np.bincount(end, minlength=n + 1)
        crossed = np.cumsum(steps)[:n] > 0
        place = np.arange(n)
        place -= np.maximum.accumulate(np.where(np.concatenate([[True], ~crossed[:-1]]), place, 0))
        # alpha of node i (after character i); the place summed from has alpha 0
        alpha = np.zeros(n)
        cum = np.zeros(len(end))
        count = np.bincount(end, minlength=n)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        by_place = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(int(place.max(initial=-1)) + 2))
        every = np.arange(len(end))
        for p in range(len(bounds) - 1):
            nodes = by_place[bounds[p] : bounds[p + 1]]
            c = count[nodes]
            edges = gather(every, begin[nodes], c)
            first = np.concatenate([[0], np.cumsum(c)[:-1]])
            before = length[edges] <= p
            value = score[edges] + np.where(before, alpha[end[edges] - length[edges]], 0.0)
            top = np.maximum.reduceat(value, first)
            weight = np.exp(value - np.repeat(top, c))
            total = np.add.reduceat(weight, first)
            alpha[nodes] = top + np.log(total)
            running = np.cumsum(weight)
            running -= np.repeat(running[first] - weight[first], c)
            cum[edges] = running / np.repeat(total, c)
        base = len(self.edge_len)
        self.edge_len = np.concatenate([self.edge_len, length.astype(np.uint8)])
        self.edge_id = np.concatenate([self.edge_id, np.where(which >= 0, self.id[which], BYTE_EDGE).astype(np.uint16)])
        self.edge_cum = np.concatenate([self.edge_cum, cum.astype(np.float32)])
        return (begin + base) * 64 + count

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids laid end to end, number of ids of each text); an empty text has none."""
        ids_parts, counts = [], np.zeros(len(texts), np.int64)
        for lo, hi in chunks_by_size(texts, 1_500_000):
            chunk = [MARK + t.replace(MARK, OWN_MARK).replace(" ", MARK) if t else "" for t in texts[lo:hi]]
            ids, n = self._sample_chunk(chunk, keys[lo:hi])
            ids_parts.append(ids)
            counts[lo:hi] = n
        return (np.concatenate(ids_parts) if ids_parts else np.zeros(0, np.int64)), counts

    def _sample_chunk(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cp, offsets = code_points(texts)
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        starts = np.flatnonzero(cp == ord(MARK))  # each text begins with one
        sizes = np.diff(np.append(starts, n))
        long = np.flatnonzero(sizes > SEGMENT_CHARS)
        if len(long):
            inner = gather(np.arange(n), starts[long] + 1, sizes[long] - 1)
            pairs = self._pairs(cp, inner)
            known = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] == pairs
            starts = np.sort(np.concatenate([starts, inner[~known]]))
            sizes = np.diff(np.append(starts, n))
        at, _ = self.cache.lookup("".join(texts), starts, starts + sizes, hashes(cp, starts, starts + sizes))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        seed = keys.astype(np.uint64)[owner]
        origin = starts - offsets[owner]
        chosen = np.full(n, -1, np.int64)
        node = sizes.copy()
        live = np.arange(len(starts))
        nodes = self.cache.flat
        while len(live):
            packed = nodes[at[live] + node[live] - 1]
            edge = packed >> 6
            last = edge + (packed & 63) - 1
            u = _uniform(seed[live], origin[live] + node[live])
            move = np.flatnonzero((edge < last) & (self.edge_cum[edge] < u))
            while len(move):
                edge[move] += 1
                move = move[(edge[move] < last[move]) & (self.edge_cum[edge[move]] < u[move])]
            node[live] -= self.edge_len[edge]
            chosen[starts[live] + node[live]] = self.edge_id[edge]
            live = live[node[live] > 0]
        used = np.flatnonzero(chosen >= 0)
        ids = chosen[used]
        count = np.diff(np.searchsorted(used, offsets))
        odd = np.flatnonzero(ids == BYTE_EDGE)
        if len(odd):  # a character becomes the pieces of its bytes
            chars = [MARK if c == ord(OWN_MARK) else chr(c) for c in cp[used[odd]].tolist()]
            raw = [c.encode() for c in chars]
            extra = np.ones(len(ids), np.int64)
            extra[odd] = [len(b) for b in raw]
            wide = np.repeat(ids, extra)
            wide[wide == BYTE_EDGE] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            np.add.at(count, np.searchsorted(offsets, used[odd], side="right") - 1, extra[odd] - 1)
            ids = wide
        return ids, count

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes of pieces laid end to end, word marks as spaces."""
        return gather(self.raw_flat, self.raw_at[ids], self.raw_len[ids])

    def decode(self, ids) -> str:
        """The text of one segmentation: all but the space put before it."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode()[1:]


def sampler(path: str, theta: float) -> Sampler:
    if (path, theta) not in _samplers:
        _samplers[path, theta] = Sampler(path, theta)
    return _samplers[path, theta]


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(seed)).alias("key"), text_or_empty().alias("text"))


def sample_segmentations(docs: DataFrame, model: str | None = None, theta: float = THETA, seed: int = 0) -> DataFrame:
    """(doc_id, ids) of every document: a segmentation drawn by the row's key.

    A null text counts as empty (no ids); a null id is a key like another; rows of equal id and text get equal results;
    other columns aren't read; an empty table gives an empty result.  Pieces with word marks inside take no part, as in
    the library's own segmentation of spaced text.  Texts of any length are segmented whole: a task
    holds some 200 bytes for each character of the longest one.
    """
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, theta)
        for b in batches:
            ids, n = s.sample(b.column(2).to_pylist(), b.column(1).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    source = _keyed(docs, seed)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_segmentations(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids).

    Null or no ids give an empty text; a null doc_id is kept; repeated rows give repeated results; other columns aren't
    read; an empty table gives an empty result.
    """
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, THETA)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def segmentation_digests(docs: DataFrame, model: str | None = None, theta: float = THETA, seed: int = 0) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless) of every document; lossless: its pieces decode to the text itself.

    Nulls, repeated rows, long texts and an empty table as for ``sample_segmentations``; an empty text has no pieces and
    the crc32 of nothing.
    """
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, theta)
        for b in batches:
            texts = b.column(2).to_pylist()
            crc, same, count = [], [], []
            for lo, hi in chunks_by_size(texts, 3_000_000):
                ids, n = s.sample(texts[lo:hi], b.column(1).to_numpy()[lo:hi])
                data = memoryview(ids.astype("<u4").tobytes())
                back = memoryview(s.decode_bytes(ids).tobytes())
                sizes = np.concatenate([[0], np.cumsum(s.raw_len[ids])])
                at = np.concatenate([[0], np.cumsum(n)])
                for i, t in enumerate(texts[lo:hi]):
                    crc.append(zlib.crc32(data[4 * at[i] : 4 * at[i + 1]]))
                    same.append(back[sizes[at[i]] : sizes[at[i + 1]]] == (b" " + t.encode() if t else b""))
                count += n.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    source = _keyed(docs, seed)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, lossless boolean")

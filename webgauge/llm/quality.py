"""Bradley-Terry quality ranking: scores learned from preference pairs, thresholded at a score quantile.

Each labelled good text is preferred to each labelled bad one.  The score is linear in features of the whole text;
its weights minimise the logistic loss of score differences over sampled pairs.  The cut is the quantile of the
training scores that errs least; scores are mapped to 0..1 so that the cut is at 0.7.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_size, text_or_empty
from .pretok import SPACE, WORD, _class_table, code_points, hashes, spans

BUCKETS = 2048
#: Bound of the labelled sample that the model is fitted on: so many rows, the least by a hash of doc_id.
SAMPLE_ROWS = 8000
CUT = 0.7
SYMBOLS = "!$%&#*|?.,;:"
SHAPES = 14 + len(SYMBOLS)


def features(texts: list[str]) -> np.ndarray:
    """A row for each text: shape numbers, then the share of its tokens in each hash bucket.  Zero for empty texts."""
    out = np.zeros((len(texts), SHAPES + BUCKETS), np.float32)
    for lo, hi, shape, bucket, owner in _parts(texts):
        out[lo:hi, :SHAPES] = shape
        flat = np.bincount(owner * BUCKETS + bucket, minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
        out[lo:hi, SHAPES:] = flat / np.maximum(1, flat.sum(axis=1, keepdims=True))
    return out


def _parts(texts: list[str]):
    """(lo, hi, shape numbers, bucket of each token, its text) of consecutive texts."""
    for lo, hi in chunks_by_size(texts, 2_000_000):
        n = hi - lo
        cp, offsets = code_points(texts[lo:hi])
        lower = [t.lower() for t in texts[lo:hi]]
        low_cp, low_offsets = code_points(lower)
        sizes = np.diff(offsets).astype(float)
        own = np.repeat(np.arange(n), np.diff(offsets))
        per_char = lambda hit: np.bincount(own[hit], minlength=n) / np.maximum(1, sizes)
        cls = _class_table()[cp]
        columns = [np.log1p(sizes), per_char(cls == SPACE), per_char(cls == 2), per_char(cls == 0), per_char(cp == 10)]
        # upper case: the characters that lower case changes (texts whose length it changes are compared by their ends)
        if len(cp) == len(low_cp) and (offsets == low_offsets).all():
            columns.append(per_char(cp != low_cp))
        else:
            columns.append(np.array([sum(a != b for a, b in zip(t, x)) / max(1, len(t)) for t, x in zip(texts[lo:hi], lower)]))
        columns += [per_char(cp == ord(c)) for c in SYMBOLS]
        starts, ends = spans(low_cp, low_offsets, WORD)
        owner = np.searchsorted(low_offsets, starts, side="right") - 1
        h = hashes(low_cp, starts, ends)
        letters = _class_table()[low_cp[starts]] == 1 if len(starts) else np.zeros(0, bool)
        words, word_owner, length = h[letters], owner[letters], (ends - starts)[letters]
        count = np.bincount(word_owner, minlength=n)
        some = np.maximum(1, count)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
        order = np.lexsort((words, word_owner))
        w, o = words[order], word_owner[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        runs = np.diff(np.append(at, len(w)))
        most = np.zeros(n)
        np.maximum.at(most, o[at], runs)
        mean = np.bincount(word_owner, weights=length, minlength=n) / some
        tokens = np.bincount(owner, minlength=n)
        columns += [
            np.log1p(count), mean, np.bincount(word_owner, weights=length > 12, minlength=n) / some, np.bincount(word_owner, weights=same, minlength=n) / some,
            np.bincount(o[at], minlength=n) / some, most / some, count / np.maximum(1, tokens), np.bincount(word_owner, weights=length <= 3, minlength=n) / some,
        ]
        yield lo, hi, np.stack(columns, axis=1).astype(np.float32), (h % np.uint64(BUCKETS)).astype(np.int64), owner


@dataclasses.dataclass
class Ranker:
    """Score of a text: (shape - mean) / scale, bucket shares -> weights; then a logistic map with the cut at 0.7."""

    mean: np.ndarray
    scale: np.ndarray
    shape_weights: np.ndarray
    bucket_weights: np.ndarray
    cut: float
    slope: float
    constant: float | None = None  # of every text, where the labels show one class only

    def raw(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, shape, bucket, owner in _parts(texts):
            total = np.bincount(owner, weights=self.bucket_weights[bucket], minlength=hi - lo)
            out[lo:hi] = ((np.clip((shape - self.mean) / self.scale, -6, 6)) @ self.shape_weights) + total / np.maximum(1, np.bincount(owner, minlength=hi - lo))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.slope * (self.raw(texts) - self.cut) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, steps: int = 800, batch: int = 128, seed: int = 11) -> Ranker:
    """Fit on feature rows x, which are scaled in place, and labels y (1 preferred to 0).

    Without both classes nothing can be ranked: every text scores 1 unless all labels are 0, then 0.
    """
    nothing = np.zeros(SHAPES), np.ones(SHAPES), np.zeros(SHAPES), np.zeros(BUCKETS), 0.0, 1.0
    good, bad = np.flatnonzero(y > 0.5), np.flatnonzero(y <= 0.5)
    if not len(good) or not len(bad):
        return Ranker(*nothing, constant=0.0 if len(bad) else 1.0)
    mean, scale = x[:, :SHAPES].mean(axis=0), x[:, :SHAPES].std(axis=0) + 1e-6
    x[:, :SHAPES] = np.clip((x[:, :SHAPES] - mean) / scale, -6, 6)
    boost = np.ones(x.shape[1], np.float32)
    boost[SHAPES:] = 20  # shares are small numbers
    x *= boost
    rng = np.random.default_rng(seed)
    w, seen = np.zeros(x.shape[1], np.float32), np.full(x.shape[1], 1e-3, np.float32)
    total = np.zeros(x.shape[1])
    for step in range(steps):
        d = x[rng.choice(good, batch)] - x[rng.choice(bad, batch)]
        g = -(1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) @ d / batch + 1e-4 * w
        seen += g * g
        w -= 0.1 * g / np.sqrt(seen)
        if step >= steps // 2:
            total += w
    w = total / (steps - steps // 2)
    s = x @ w
    order = np.argsort(s)
    # below the cut all is rejected: the quantile with fewest errors, errors on good texts counted twice
    errors = np.concatenate([[0], np.cumsum(np.where(y[order] > 0.5, 2, -1))])
    q = int(np.flatnonzero(errors == errors.min()).mean())
    cut = float(s[order[0]] - 1) if q == 0 else float(s[order[-1]] + 1) if q == len(s) else float((s[order[q - 1]] + s[order[q]]) / 2)
    spread = abs(s[good].mean() - s[bad].mean()) or 1.0
    w = w * boost
    return Ranker(mean, scale, w[:SHAPES], w[SHAPES:], cut, 8.0 / spread)


def held_out(column: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_ranker(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_column: str = "quality") -> Ranker:
    """Fit on at most ``sample_rows`` labelled documents that aren't held out.

    Several labels of an id are averaged; of several texts of an id the least is learned.  Null ids, null labels, labels
    without a document and documents without a label are left out; a null text counts as empty; without both classes,
    as from an empty table, every text gets one score (1, or 0 if all labels are 0).
    """
    label = labels.where(F.col("doc_id").isNotNull() & F.col(label_column).isNotNull() & ~held_out())
    label = label.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg(F.col(label_column).cast("double")).alias("y"))
    chosen = label.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # bounded, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(2).to_pylist())
            some = [np.flatnonzero(r) for r in x]  # most buckets of a text are empty
            at, value = ([v.tobytes() for v in vs] for vs in ([k.astype(np.uint16) for k in some], [r[k] for r, k in zip(x, some)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["id", "y", "at", "value"])

    rows = texts.select("id", "y", "text").mapInArrow(run, "id long, y double, at binary, value binary").toPandas().sort_values("id")
    x = np.zeros((len(rows), SHAPES + BUCKETS), np.float32)
    for r, at, value in zip(x, rows["at"], rows["value"]):
        r[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return fit_pairs(x, rows["y"].to_numpy(float).copy())


def score_documents(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, and its score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(text.tolist()))

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), score(text_or_empty()).alias("score"))


def rank_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A null text counts as empty and is scored; a null id counts as not held out but can't be labelled; repeated rows
    get repeated results; a text of any length is read whole, its features being shares and logarithms; lang, source and
    other columns aren't read; an empty table gives an empty result.
    """
    scored = score_documents(docs.select("doc_id", "text"), train_ranker(docs, labels, sample_rows))
    scored = scored.select("doc.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, unchanged, that the ranker doesn't reject.

    A null text is scored as empty and stays null where kept; repeated rows stay or go together; a null id may stay; extra
    columns are kept whatever their names; an empty table gives an empty result.
    """
    return score_documents(docs, train_ranker(docs, labels, sample_rows)).where(F.col("score") >= CUT).select("doc.*")

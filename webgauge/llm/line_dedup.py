"""Line deduplication by winnowing over line hashes.

A gram is a line and as many after it as make up GRAM_WORDS words.  Each window - the grams that begin within one such
stretch - selects its least gram hash as fingerprint, so two texts that share a run of two stretches (2 * GRAM_WORDS
words of whole lines, or a single line of GRAM_WORDS) surely share a fingerprint.  Positions of a fingerprint are joined
with its first position in document order; the match is extended line by line both ways; later runs are deleted.

Later documents may share longer runs with each other than with that first one, as around a notice held by many.  So
runs around a fingerprint that leave its first match are told by hash and joined with their own first position: those
that begin or end with the fingerprint's gram, and the least runs of two stretches that hold it.  A run of two stretches
or more is the union of such least runs, so together they delete what extension against every earlier position would.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, discard, join_salted, join_to_unique, text_or_empty, write_table

GRAM_WORDS = 25


def line_hashes(text: str) -> tuple[list[int], list[int], list[int]]:
    """(hash, words, index) of each line that has words; white space in lines is made uniform first."""
    hashes, words, index = [], [], []
    for i, line in enumerate(text.split("\n")):
        parts = line.split()
        if parts:
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(parts)) - (1 << 63))
            words.append(len(parts))
            index.append(i)
    return hashes, words, index


def fingerprints(hashes: list[int], words: list[int], gram_words: int = GRAM_WORDS) -> list[tuple[int, int]]:
    """(gram hash, first line) of each window's least gram; lines count among those with words."""
    n = len(hashes)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(before, before[:-1] + gram_words)  # lines i .. end - 1; end > n: too few words left
    whole = int((end <= n).sum())
    raw = np.array(hashes, "<i8").tobytes()
    grams = [xxhash.xxh3_64_intdigest(raw[8 * i : 8 * e]) - (1 << 63) for i, e in zip(range(whole), end.tolist())]
    chosen: dict[int, int] = {}
    for i in range(whole):
        window = grams[i : min(int(end[i]), whole)]
        k = i + len(window) - 1 - window[::-1].index(min(window))
        chosen[k] = grams[k]
    return [(h, k) for k, h in sorted(chosen.items())]


def extend(own: np.ndarray, source: np.ndarray, at: int, source_at: int) -> tuple[int, int]:
    """The lines lo .. hi - 1 of ``own`` that equal those of ``source`` around a match."""
    back = min(at, source_at)
    differ = np.flatnonzero(own[at - back : at][::-1] != source[source_at - back : source_at][::-1])
    lo = at - (int(differ[0]) if len(differ) else back)
    ahead = min(len(own) - at, len(source) - source_at)
    differ = np.flatnonzero(own[at : at + ahead] != source[source_at : source_at + ahead])
    return lo, at + (int(differ[0]) if len(differ) else ahead)


#: Line comparisons up to which matches are extended one by one.
DIRECT = 1 << 22
PRIMES, FACTORS = ((1 << 31) - 1, (1 << 31) - 19), (1_103_515_245, 1_999_999_943)


def _powers(factor: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(factor, len(out), prime)) % np.uint64(prime)])
    return out[:n]


class Stretches:
    """Equality of stretches of two line arrays at any places, in constant time each: by two polynomial hashes."""

    def __init__(self, own: np.ndarray, source: np.ndarray):
        n = self.n = max(len(own), len(source)) + 1
        self.tables = []
        for prime, factor in zip(PRIMES, FACTORS):
            power = _powers(factor, prime, n)
            sums = []
            for lines in (own, source):
                terms = lines.view(np.uint64) % np.uint64(prime) * power[: len(lines)] % np.uint64(prime)
                sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(prime)]))
            self.tables.append((np.uint64(prime), power, *sums))

    def equal(self, at: np.ndarray, source_at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the lines from each ``at`` equal those from each ``source_at``, so many as ``length``."""
        same = np.ones(len(at), bool)
        for prime, power, own, source in self.tables:
            a = (own[at + length] + prime - own[at]) % prime * power[self.n - 1 - at] % prime
            b = (source[source_at + length] + prime - source[source_at]) % prime * power[self.n - 1 - source_at] % prime
            same &= a == b
        return same

    def longest(self, at: np.ndarray, source_at: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many lines are equal from each pair of places on, or before them; ``most`` at most."""
        least, most = np.zeros_like(most), most.copy()
        while (least < most).any():
            half = (least + most + 1) // 2
            shift = half if back else 0
            same = self.equal(at - shift, source_at - shift, half)
            least, most = np.where(same, half, least), np.where(same, most, half - 1)
        return least


def extensions(own: np.ndarray, source: np.ndarray, at: np.ndarray, source_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``extend`` for matches in the order of ``at``.

    Matches of one distance that lie in each other's extension share it.  Where texts repeat themselves so often that
    comparing lines would take time with the square of their length, lengths are found by halving, with hashes.
    """
    far = at - source_at
    if len(np.unique(far)) * min(len(own), len(source)) > DIRECT:
        same = Stretches(own, source)
        lo = at - same.longest(at, source_at, np.minimum(at, source_at), True)
        return lo, at + same.longest(at, source_at, np.minimum(len(own) - at, len(source) - source_at), False)
    lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    done: dict[int, tuple[int, int]] = {}
    for i, (a, b, d) in enumerate(zip(at.tolist(), source_at.tolist(), far.tolist())):
        if a >= done.get(d, (0, 0))[1]:
            done[d] = extend(own, source, a, b)
        lo[i], hi[i] = done[d]
    return lo, hi


def around(before: np.ndarray, at: np.ndarray, gram_words: int = GRAM_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Between which lines all runs around each gram lie, that ``runs_beyond`` looks at."""
    n, both = len(before) - 1, 2 * gram_words
    e = np.searchsorted(before, before[at] + gram_words)
    low = np.searchsorted(before, before[e] - both, side="right") - 1
    high = np.minimum(np.searchsorted(before, before[at] + both), n)
    first = np.searchsorted(before, before[e - 1] - both, side="right")
    last = np.minimum(np.searchsorted(before, before[at + 1] + both) - 1, n)
    return np.minimum(first, np.maximum(low, 0)), np.maximum(last, high)


def matches_to_look_beyond(own: np.ndarray, before: np.ndarray, cut: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram_words: int = GRAM_WORDS) -> np.ndarray:
    """The matches around which a run may leave the match, but for those that can tell nothing new.

    Where all lines around are deleted already, runs are looked at only as first places of their kind: so of matches with
    equal lines around them, cut at the same places, the first will do.
    """
    begin, end = around(before, at, gram_words)
    rest = np.flatnonzero((lo > begin) | (hi < end))
    if len(rest) < 64:
        return rest
    left = np.concatenate([[0], np.cumsum(~cut)])
    spent = left[end[rest]] == left[begin[rest]]
    a, b = begin[rest[spent]], end[rest[spent]]
    key = [at[rest[spent]] - a, b - a, np.maximum(lo[rest[spent]], a) - a, np.minimum(hi[rest[spent]], b) - a]
    same = Stretches(own, own[:0])
    for prime, power, sums, _ in same.tables:
        key.append(((sums[b] + prime - sums[a]) % prime * power[same.n - 1 - a] % prime).astype(np.int64))
    _, first = np.unique(np.stack(key, axis=1), axis=0, return_index=True)
    return np.sort(np.concatenate([rest[~spent], rest[spent][first]]))


def runs_beyond(before: np.ndarray, at: int, lo: int, hi: int, gram_words: int = GRAM_WORDS) -> list[tuple[int, int]]:
    """Runs (a, b) of lines a .. b - 1 around the gram at line ``at`` that aren't within its match lo .. hi - 1.

    ``before``: words before each line, and in all.  Runs that begin or end with the gram have fewer than two stretches
    or are the least that have them; those that hold it elsewhere are the least from their first or to their last line.
    """
    n, both = len(before) - 1, 2 * gram_words
    e = int(np.searchsorted(before, before[at] + gram_words))
    low = int(np.searchsorted(before, before[e] - both, side="right")) - 1  # the last line from which two stretches end by e
    high = min(int(np.searchsorted(before, before[at] + both)), n)
    first = int(np.searchsorted(before, before[e - 1] - both, side="right"))  # two stretches from an earlier line end before the gram does
    last = min(int(np.searchsorted(before, before[at + 1] + both)) - 1, n)
    if lo <= min(first, max(low, 0)) and hi >= max(last, high):
        return []
    found = [(at, b) for b in range(e + 1, high + 1)] + [(a, e) for a in range(max(low, 0), at)]
    ends = np.searchsorted(before, before[first:at] + both)
    found += [(a, b) for a, b in zip(range(first, at), ends.tolist()) if b <= n]
    begins = np.searchsorted(before, before[e + 1 : last + 1] - both, side="right") - 1
    found += [(a, b) for a, b in zip(begins.tolist(), range(e + 1, last + 1)) if a >= 0]
    return [(a, b) for a, b in found if a < lo or b > hi]


def _cut(text: str, lines: list[int]) -> str:
    """``text`` without the lines of these numbers (among lines with words); blank lines between deleted ones go too."""
    gone, out, number, last_gone = set(lines), [], -1, False
    for line in text.split("\n"):
        if line.split():
            number += 1
            last_gone = number in gone
            if not last_gone:
                out.append(line)
        elif not (last_gone and number + 1 in gone):
            out.append(line)
    return "\n".join(out)


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS) -> DataFrame:
    """Every row of ``docs`` with all its columns, text without repeated runs, and lines_removed (int).

    The first of repeated runs, in the order of doc_id (null last), stays whole unless part of it repeats an earlier
    one; a run may repeat within a text, and a text of any length that repeats itself takes time in proportion to its
    length, but for a logarithm.  A run is deleted if it has a fingerprint in common with any earlier copy: surely
    if it has twice ``gram_words`` words or is a line of ``gram_words``, never if it has fewer than ``gram_words``.  A null text stays null; repeated rows keep one text; a document may be left with an empty text; an
    input column named lines_removed is replaced; an empty table gives an empty result.
    """

    @F.pandas_udf("lines binary, words binary, h array<long>, at array<int>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h, w, _ = line_hashes(t)
            f = fingerprints(h, w, gram_words)
            out.append((np.array(h, "<i8").tobytes(), np.array(w, "<i4").tobytes(), [x for x, _ in f], [k for _, k in f]))
        return pd.DataFrame(out, columns=["lines", "words", "h", "at"])

    docs = docs.drop("lines_removed")
    table = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), scan(text_or_empty()).alias("k"), F.monotonically_increasing_id().alias("row"))
    table = write_table(table.select("row", "doc", "k.*"), "lines")

    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").cast("long").alias("id"), F.col("row"), F.col("p.at").alias("at"))
    marks = table.select("row", "doc.doc_id", "doc", F.explode(F.arrays_zip("h", "at")).alias("p")).select("row", F.col("p.h").alias("h"), F.col("p.at").alias("at"), order.alias("place"))
    marks = write_table(marks, "marks")
    first = marks.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_to_unique(marks, first, "h", marks.count()).where("row <> first.row or at <> first.at")
    rank = [F.col("place.none").alias("none"), F.coalesce("place.id", F.lit(0)).alias("id")]
    pairs = later.groupBy("row", *rank, F.col("first.row").alias("source")).agg(F.collect_list(F.struct(F.col("at"), F.col("first.at").alias("source_at"))).alias("matches"))
    pairs = write_table(pairs, "pairs")
    lines = table.select("row", "lines", "words")
    sources = pairs.groupBy("source").agg(F.count("*").alias("n")).join(lines.select(F.col("row").alias("source"), F.col("lines").alias("source_lines")), "source")
    joined = join_salted(pairs.join(lines, "row"), sources, "source", pairs.count(), "row")

    def runs(batches):
        for pdf in batches:
            found = []
            for own, words, source, matches in zip(pdf["lines"], pdf["words"], pdf["source_lines"], pdf["matches"]):
                raw, own, source = own, np.frombuffer(own, "<i8"), np.frombuffer(source, "<i8")
                before = np.concatenate([[0], np.cumsum(np.frombuffer(words, "<i4"), dtype=np.int64)])
                at, source_at = np.array([m["at"] for m in matches], np.int64), np.array([m["source_at"] for m in matches], np.int64)
                order = np.lexsort((source_at, at))
                at, source_at = at[order], source_at[order]
                lo, hi = extensions(own, source, at, source_at)
                covered = np.zeros(len(own) + 1, np.int64)
                full = hi > lo
                np.add.at(covered, lo[full], 1)
                np.add.at(covered, hi[full], -1)
                cut = np.cumsum(covered[:-1]) > 0
                beyond: set[tuple[int, int]] = set()
                rest = matches_to_look_beyond(own, before, cut, at, lo, hi, gram_words)
                for a, x, y in zip(at[rest].tolist(), lo[rest].tolist(), hi[rest].tolist()):
                    beyond.update(runs_beyond(before, a, x, y, gram_words))
                at = sorted(beyond)
                found.append((np.flatnonzero(cut).tolist(), [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) - (1 << 63) for a, b in at], [a for a, _ in at], [b for _, b in at]))
            yield pd.concat([pdf[["row", "none", "id"]], pd.DataFrame(found, columns=["gone", "h", "a", "b"], index=pdf.index)], axis=1)

    found = joined.select("row", "none", "id", "lines", "words", "source_lines", "matches").mapInPandas(runs, "row long, none boolean, id long, gone array<int>, h array<long>, a array<int>, b array<int>")
    found = write_table(found, "runs")
    for scratch in (marks, pairs):
        discard(scratch)
    beyond = found.select("row", "none", "id", F.explode(F.arrays_zip("h", "a", "b")).alias("r")).select("row", "r.*", F.struct("none", "id", "row", F.col("r.a").alias("a")).alias("place"))
    first = beyond.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    more = join_to_unique(beyond, first, "h", beyond.count()).where("row <> first.row or a <> first.a").select("row", F.sequence("a", F.col("b") - 1).alias("gone"))
    gone = found.select("row", "gone").unionByName(more).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = write_table(gone, "gone")
    discard(found)

    # rows that no deleted line can belong to skip the join
    slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(gone.select(slot.alias("slot")).distinct())
    source = table.select("row", "doc", slot.alias("slot"))

    @F.pandas_udf("string")
    def delete(texts: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _cut(t, list(g)) if g is not None and len(g) else t for t, g in zip(texts, lines)], dtype=object)

    hit = source.join(slots, "slot", "left_semi").join(gone, "row", "left").withColumn("text", delete(F.col("doc.text").cast("string"), F.coalesce("gone", F.array().cast("array<int>"))))
    rest = source.join(slots, "slot", "left_anti").select("doc", F.col("doc.text").cast("string").alias("text"), F.lit(0).alias("lines_removed"))
    both = hit.select("doc", "text", F.size(F.coalesce("gone", F.array().cast("array<int>"))).alias("lines_removed")).unionByName(rest)
    return both.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns], "lines_removed")

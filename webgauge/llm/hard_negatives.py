"""Hard-negative mining with bit-sliced integer products.

Components are integers in two's complement.  The product of a row with an anchor is summed bit-plane by bit-plane of the
row, the most significant first: what the planes below can still add lies between (2^r - 1) times the sum of the anchor's
negative and of its positive components.  Pairs whose interval can't qualify any more are dropped after each plane; the
few that are left go on as single pairs of packed planes, whose products are counts of common bits.  What passes all
planes has its exact score.

Anchors are a stated query set.  They are taken in blocks of at most BLOCK_BYTES, which are broadcast; each pass reads the
rows where they lie, without a shuffle, and every task keeps the best of its rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, write_table
from .vectors import component_bound, exact_product, floored, whole_vectors

SCALE, BEST = 256, 5
#: Bound of what is broadcast at once: vectors of anchors as longs, with their positives.
BLOCK_BYTES = 16 << 20
#: Rows and anchors whose scores are held at once.
TILE_ROWS, TILE_ANCHORS = 2048, 512
#: Pairs go on one by one when at most this share of them is left.
SPARSE = 1 / 16

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def planes_of(q: np.ndarray) -> int:
    """Bits of the components in two's complement."""
    return int(max(q.max(initial=0), -1 - q.min(initial=0))).bit_length() + 1


def packed_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """(planes, rows, words): the bits of each plane, 64 components in a word."""
    words = -(-max(1, q.shape[1]) // 64)
    out = np.zeros((planes, len(q), words * 8), np.uint8)
    for i in range(planes):
        bits = np.packbits((q >> i) & 1, axis=1)
        out[i, :, : bits.shape[1]] = bits
    return out.view(np.uint64)


def plane_weight(i: int, planes: int) -> int:
    return -(1 << i) if i == planes - 1 else 1 << i


def sliced_products(rows: np.ndarray, anchors: np.ndarray, keep: np.ndarray, qualify: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs of ``keep`` that qualify.

    ``qualify(low, high, anchor)`` says which pairs may still qualify by bounds of their scores: matrices of all rows by
    all anchors with ``anchor`` None, or one entry for each pair with the pair's anchor.
    """
    planes, own = planes_of(rows), planes_of(anchors)
    up, down = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    exact = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) << planes < 1 << 53
    kind = np.float64 if exact else np.int64
    columns, score = anchors.T.astype(kind), np.zeros((len(rows), len(anchors)), kind)
    i = planes
    while i and np.count_nonzero(keep) > SPARSE * keep.size:
        i -= 1
        score += plane_weight(i, planes) * (((rows >> i) & 1).astype(kind) @ columns)
        rest = (1 << i) - 1
        keep = keep & qualify(score + rest * down, score + rest * up, None)
    row, anchor = np.nonzero(keep)
    score = score[row, anchor].astype(np.int64)
    if i and len(row):
        row_bits, anchor_bits = packed_planes(rows, i), packed_planes(anchors, own)
        while i and len(row):
            i -= 1
            mine, product = row_bits[i][row], np.zeros(len(row), np.int64)
            for j in range(own):
                product += plane_weight(j, own) * np.bitwise_count(mine & anchor_bits[j][anchor]).sum(axis=1, dtype=np.int64)
            # all planes are below the sign, unless none was done as a whole
            score += plane_weight(i, planes) * product
            rest = (1 << i) - 1
            left = qualify(score + rest * down[anchor], score + rest * up[anchor], anchor)
            row, anchor, score = row[left], anchor[left], score[left]
    return row, anchor, score


class Best:
    """The best few (score, id) of each group, higher scores first, ties by smaller id."""

    def __init__(self, groups: int, count: int):
        self.count = count
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))
        #: Scores below this have no place in the group any more.
        self.least = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = (np.concatenate([a, b]) for a, b in zip(self.found, (group, score, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.searchsorted(group, group)
        place = np.arange(len(group)) - first
        top = place < self.count
        self.found = group[top], score[top], ids[top]
        last = place == self.count - 1
        self.least[group[last]] = score[last]


class Anchors:
    """The anchors of one length in a block, by label, with the windows of their positives where these are known."""

    def __init__(self, frame: pd.DataFrame, dims: int):
        order = frame["label"].to_numpy(np.int64).argsort(kind="stable")
        self.frame = frame.iloc[order].reset_index(drop=True)
        self.row, self.label = self.frame["row"].to_numpy(np.int64), self.frame["label"].to_numpy(np.int64)
        self.q = np.array([np.frombuffer(x, "<i4") for x in self.frame["q"]], np.int64).reshape(-1, dims)


def _rows_of(batch) -> list[tuple]:
    """[(row, vec_id, label, components)] of a batch, split by length."""
    dims = batch.column("dims").to_numpy()
    out = []
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        numbers = [batch.column(c).to_numpy()[at] for c in ("row", "vec_id", "label")]
        q = np.frombuffer(b"".join(batch.column("q").take(pa.array(at)).to_pylist()), "<i4").astype(np.int64).reshape(len(at), d)
        out.append((d, *numbers, q))
    return out


def _tiles(n: int, size: int):
    return ((lo, min(n, lo + size)) for lo in range(0, n, size))


def nth_largest(a: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest entry of each column."""
    return np.partition(a, len(a) - n, axis=0)[len(a) - n]


def mine_positives(block: dict[int, Anchors], batches, count: int):
    """(dims, anchor's index, vec_id, score): the best rows of the anchors' own labels among these batches."""
    best = {d: Best(len(a.row), count) for d, a in block.items()}
    lowest = np.iinfo(np.int64).min
    for batch in batches:
        for d, row, vec_id, label, q in _rows_of(batch):
            if d not in block:
                continue
            a, top = block[d], best[d]
            for x in np.unique(label).tolist():
                lo, hi = np.searchsorted(a.label, [x, x + 1])
                mine = np.flatnonzero(label == x)
                for i, j in _tiles(hi - lo, TILE_ANCHORS):
                    i, j = lo + i, lo + j
                    for m, n in _tiles(len(mine), TILE_ROWS):
                        part = mine[m:n]
                        keep = row[part][:, None] != a.row[i:j][None]
                        least = top.least[i:j].copy()

                        def qualify(low, high, anchor, keep=keep, least=least):
                            if anchor is None:
                                if len(low) >= count:  # so many rows have at least this score
                                    np.maximum(least, nth_largest(np.where(keep, low, lowest), count), out=least, casting="unsafe")
                                return high >= least
                            return high >= least[anchor]

                        r, c, score = sliced_products(q[part], a.q[i:j], keep, qualify)
                        top.add(c + i, score, vec_id[part][r])
    for d, top in best.items():
        group, score, ids = top.found
        yield d, group, ids, score


def mine_negatives(block: dict[int, Anchors], windows: dict, batches, count: int):
    """(dims, anchor's index, place of the positive, vec_id, score): the best rows of other labels in the window of each
    positive, of ``windows[dims]``: (least, largest) scores of each anchor and positive."""
    best = {d: Best(windows[d][0].size, count) for d in block}
    for batch in batches:
        for d, row, vec_id, label, q in _rows_of(batch):
            if d not in block:
                continue
            a, top = block[d], best[d]
            least, most = windows[d]
            slots = least.shape[1]
            for i, j in _tiles(len(a.row), TILE_ANCHORS):
                for m, n in _tiles(len(row), TILE_ROWS):
                    keep = label[m:n][:, None] != a.label[i:j][None]
                    # the group's least place rises as rows are found
                    floor = np.where(most >= least, np.maximum(least, top.least.reshape(least.shape)), np.iinfo(np.int64).max)[i:j]
                    low_end, high_end = floor.min(axis=1), most[i:j].max(axis=1)

                    def qualify(low, high, anchor, low_end=low_end, high_end=high_end):
                        at = slice(None) if anchor is None else anchor
                        return (high >= low_end[at]) & (low <= high_end[at])

                    r, c, score = sliced_products(q[m:n], a.q[i:j], keep, qualify)
                    ids = vec_id[m:n][r]
                    for s in range(slots):
                        fits = (score >= floor[c, s]) & (score <= most[i:j][c, s])
                        top.add((c[fits] + i) * slots + s, score[fits], ids[fits])
    for d, top in best.items():
        group, score, ids = top.found
        slots = windows[d][0].shape[1]
        yield d, group // slots, group % slots, ids, score


def integer_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, dims, q) of rows that take part, written; ``row`` numbers them."""

    def run(batches):
        for batch in batches:
            _, found = whole_vectors(batch.column("embedding"))
            for d, at, matrix in found:
                good, q = floored(matrix, scale, component_bound(d, 60))
                at, q = pa.array(at[good]), q.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(np.full(len(at), d, np.int32)), pa.array([x.tobytes() for x in q], pa.binary())],
                    names=["vec_id", "label", "dims", "q"],
                )

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("try_cast(label AS bigint)").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = source.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(run, "vec_id long, label long, dims int, q binary")
    return write_table(whole.select(F.monotonically_increasing_id().alias("row"), "*"), "integer-vectors")


def positive_windows(a: Anchors, found: pd.DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score of a negative for each anchor and positive; empty where there's none."""
    least, most = np.full((len(a.row), count), np.iinfo(np.int64).max), np.full((len(a.row), count), np.iinfo(np.int64).min)
    at, slot, score = (found[c].to_numpy(np.int64) for c in ("at", "slot", "score"))
    least[at, slot], most[at, slot] = score - score // 5, score  # 80 p <= 100 n; below zero nothing is both
    return least, most


def hard_negatives(
    vectors: DataFrame, label: Column | None = None, is_anchor: Column | None = None, scale: int = SCALE, count: int = BEST, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    A row's score is the inner product of its and the anchor's components floor(scale * x).  An anchor's positives are
    the best ``count`` other rows of its label, a positive's negatives the best ``count`` rows of other labels with 80 to
    100 hundredths of its score; ties go to smaller ids.  ``label``, over the whole number ``label`` and ``vec_id``,
    restates labels; ``is_anchor`` says which rows are anchors (those whose id 100 divides).

    Rows with a null id, a label or vector that is null, or a null or non-finite component take no part, nor do vectors
    whose score with one like them fits no long (components from 2^27 on at 64 of them).  Vectors of different length
    have no score.  Repeated rows are rows of their own: each is another's positive or negative, and each an anchor.
    A positive without negatives gives no row.  Other columns aren't read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors, scale)
    if label is not None:
        rows = rows.withColumn("label", label)
    anchors = rows.where(F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor)
    size = anchors.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    if not size.n:
        return spark.createDataFrame([], SCHEMA)
    blocks = -(-size.n * (size.dims + 8 * count) * 8 // block_bytes)
    results = scratch_path(spark, "negatives")
    for b in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toPandas()
        if not len(part):
            continue
        block = {d: Anchors(frame, d) for d, frame in part.groupby("dims")}
        _negatives_of_block(rows, block, count).write.parquet(f"{results}/{b}")
        del part, block
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(results)


def _ranked(df: DataFrame, count: int, *group: str) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= count)


def _negatives_of_block(rows: DataFrame, block: dict[int, Anchors], count: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(block)

    def positives(batches):
        for d, at, ids, score in mine_positives(sent.value, batches, count):
            yield pa.RecordBatch.from_pydict({"dims": np.full(len(at), d, np.int32), "at": at, "vec_id": ids, "score": score})

    best = _ranked(rows.mapInArrow(positives, "dims int, at long, vec_id long, score long"), count, "dims", "at").toPandas()
    best = best.assign(slot=best["place"] - 1)
    empty = best.iloc[:0]
    by_dims = dict(list(best.groupby("dims")))
    windows = {d: positive_windows(a, by_dims.get(d, empty), count) for d, a in block.items()}
    names = {}  # of each anchor and positive: the positive's id
    for d, a in block.items():
        names[d] = np.zeros((len(a.row), count), np.int64)
        found = by_dims.get(d, empty)
        names[d][found["at"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["vec_id"].to_numpy(np.int64)
    known = context.broadcast((windows, names))

    def negatives(batches):
        windows, names = known.value
        for d, at, slot, ids, score in mine_negatives(sent.value, windows, batches, count):
            ids_of = sent.value[d].frame["vec_id"].to_numpy(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "dims": np.full(len(at), d, np.int32), "at": at, "slot": slot, "anchor_id": ids_of[at], "positive_id": names[d][at, slot],
                    "positive_score": windows[d][1][at, slot], "vec_id": ids, "score": score,
                }
            )

    found = rows.mapInArrow(negatives, "dims int, at long, slot long, anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    best = _ranked(found, count, "dims", "at", "slot")
    return best.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

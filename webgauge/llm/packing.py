"""Bound-certified best-fit packing of tokenised documents into fixed-size sequences.

Pieces are dealt to cells of bounded size and packed best-fit decreasing.  Dual feasible functions give a lower bound
on each cell's sequences; a cell that meets its bound is certified.  Cells with a gap exchange the documents of their
loose sequences (every cell gives its loosest one), which are dealt anew and packed again until the whole is certified
or a round saves nothing.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tokenizer_path, write_table
from .encode import encoder

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
CELL_ROWS = 50_000


def dual_feasible_bound(histogram: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins that sizes need; histogram[s] is the number of items of size s (0..capacity).

    The largest of the bounds by U(eps) (items over capacity - eps count as full, those under eps not at all) for
    every eps, and by the rounding functions u(k), k = 1..32.
    """
    h = np.zeros(capacity + 1, np.int64)
    h[: len(histogram)] = histogram
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(h), np.cumsum(h * sizes)
    eps = np.arange(0, capacity // 2 + 1)
    full = number[capacity] - number[capacity - eps]
    middle = volume[capacity - eps] - np.where(eps > 0, volume[np.maximum(eps - 1, 0)], 0)
    best = int((full + -(-middle // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        # in units of capacity / (capacity * k): integers all the way
        value = np.where(exact, sizes * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((h * value).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, its offset there, number of bins); each item goes to the fullest bin that holds it."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0  # rooms: bit r is set while some bin has r places left
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            r, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - r
        by_room[r - s].append(b)
        rooms |= 1 << (r - s)
    return where, offset, bins


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            ids, counts = enc.encode(b.column(1).to_pylist())
            ends = np.cumsum(counts)
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (lo, hi) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((i, p, at, len(part), zlib.crc32(part.tobytes())))
            t = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(t[:, 0])), pa.array(t[:, 1].astype(np.int32)), *(pa.array(t[:, k]) for k in (2, 3, 4))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select("doc_id", text_or_empty().alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _bound(pieces: DataFrame, capacity: int) -> int:
    """The bound over all pieces; the driver gets their lengths' histogram, at most ``capacity`` rows."""
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    return dual_feasible_bound(histogram, capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences of a packing, the least number that its pieces need): equal where it is certified as optimal."""
    return packed.agg(F.count_if(F.col("offset") == 0)).first()[0], _bound(packed, capacity)


def _pack_cells(pieces: DataFrame, cells: int, round_no: int, capacity: int) -> DataFrame:
    """Deal ``pieces`` to cells and pack each; adds sequence_id, offset, cell_bound, gap (sequences over it), fill, loosest."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy(np.int64)
        where, offset, bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(where, weights=sizes, minlength=bins).astype(np.int64)
        bound = dual_feasible_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        cell = int(pdf["cell"].iloc[0])
        return pdf.drop(columns="cell").assign(sequence_id=(round_no << 48) + (cell << 20) + where, offset=offset, cell_bound=bound, gap=bins - bound, fill=fill[where], loosest=where == int(fill.argmin()))

    # rows don't depend on each other's place: equal keys (repeated rows) only share a cell
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("key", F.lit(round_no)), F.lit(cells)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("cell").applyInPandas(pack, f"{fields}, sequence_id long, offset long, cell_bound long, gap long, fill long, loosest boolean")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, cell_bound, gap): a row for each piece of each document.

    cell_bound is the least number of sequences that the pieces packed together with this one need, gap how many more
    they got when packed; ``certificate`` gives both for the whole.
    A null text counts as empty (one piece, the end id); null ids are kept; repeated rows are packed each; pieces of equal
    length are taken in the order of their rows in the cell; a text of any length is encoded whole and cut only by
    ``capacity``; other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = tokenized_pieces(docs, vocabulary or tokenizer_path(VOCABULARY), capacity, end_id)
    pieces = write_table(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    total = pieces.count()
    if not total:
        return pieces.drop("key").withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset", "cell_bound", "gap")})
    bound = _bound(pieces, capacity)

    columns = pieces.columns
    done: list[DataFrame] = []  # tables whose sequences stay
    todo, rows, before = pieces, total, None
    kept = 0
    for round_no in itertools.count():  # each round but the last has fewer sequences than the one before
        packed = write_table(_pack_cells(todo, max(1, -(-rows // cell_rows)), round_no, capacity), "packed")
        full = (F.col("gap") <= 0) | (F.col("fill") == capacity)
        give = ~full | F.col("loosest")
        first = F.col("offset") == 0  # one row of each sequence
        s = packed.agg(F.count_if(first).alias("bins"), F.count_if(first & give).alias("loose"), F.count_if(give).alias("rows")).first()
        if before is not None and s["bins"] >= before[1]:
            done.append(before[0])  # the exchange saved nothing: what was exchanged stays as it was
            break
        if kept + s["bins"] <= bound or s["loose"] <= 1:
            done.append(packed)
            break
        done.append(packed.where(~give))
        kept += s["bins"] - s["loose"]
        before = (packed.where(give), s["loose"])
        todo, rows = packed.where(give).select(columns), s["rows"]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "cell_bound", "gap")

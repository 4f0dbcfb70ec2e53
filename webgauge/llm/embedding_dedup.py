"""Embedding near-duplicates as an exact metric range join.

Unit vectors are points on the sphere; cosine >= t is chord distance <= r = sqrt(2 - 2t).  Pivots, more the more vectors
a label has, split them into cells by nearest pivot.  A vector is replicated to every other cell whose
members can lie within r of it: by the triangle inequality only where d(x, q) - d(x, home) <= 2r, and of these only where
the plane halfway between the two pivots is no farther than r.  Each cell then joins alone: its home vectors against home
and replicas.

A label of up to CELL_ROWS vectors has its cells made and joined within one task.  Of a larger one pivots are a table,
vectors are dealt to chunks that meet them, and cells are joined as tasks, large ones in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, group_bounds, join_to_unique, whole_groups, write_table
from .components import connected_components, union_pairs

THRESHOLD = 0.98
CELL_ROWS = 2000
#: Vectors that one task compares with all pivots of their label, some at a time.
CHUNK_ROWS, AT_ONCE = 20_000, 256
#: A float computed from r may be off by rounding; cells take a little more than the bound.
SLACK = 1e-6


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key, unit): key names equal unit vectors of a label; all null where a vector can't link."""

    def run(batches):
        for pdf in batches:
            units = []
            for v in pdf["embedding"]:
                x = None
                if v is not None and len(v):
                    x = np.array([np.nan if c is None else c for c in v], np.float64)
                    if np.isfinite(x).all() and x.any():
                        x = x / np.abs(x).max()  # no overflow or underflow in the norm
                        x = x / math.sqrt(float(x @ x))
                    else:
                        x = None
                units.append(None if x is None else (x + 0.0).tobytes())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "unit": units}, columns=["vec_id", "label", "unit"])

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = source.mapInPandas(run, "vec_id long, label string, unit binary")
    usable = F.col("label").isNotNull() & F.col("unit").isNotNull()
    return units.withColumn("key", F.when(usable, F.sha2(F.concat(F.sha2("unit", 256), F.col("label")).cast("binary"), 256))).withColumn("unit", F.when(usable, F.col("unit")))


def pivot_count(rows: int) -> int:
    """Of a label in one task: as many pivots as a cell then has vectors on average."""
    return max(1, math.ceil(math.sqrt(rows)))


def cells_of(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each vector; vector and cell of each replica)."""
    homes, who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(units), AT_ONCE):
        dots = units[lo : lo + AT_ONCE] @ pivots.T
        home = dots.argmax(axis=1)
        distance = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
        rows = np.arange(len(dots))
        to = distance - distance[rows, home][:, None] <= 2 * radius + SLACK
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots[home] @ pivots.T)))
        to &= (dots[rows, home][:, None] - dots) <= (radius + SLACK) * np.maximum(apart, 1e-12)
        to[rows, home] = False
        i, j = np.nonzero(to)
        homes.append(home)
        who.append(i + lo)
        where.append(j)
    return np.concatenate(homes), np.concatenate(who), np.concatenate(where)


def link_cell(units: np.ndarray, home: np.ndarray, member: np.ndarray, weight: np.ndarray, threshold: float, rows: int = 512, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the members linked to each home vector, itself not counted; least linked vector of each set)."""
    index, others = np.flatnonzero(home), np.flatnonzero(member)
    links, root = np.zeros(len(units), np.int64), np.arange(len(units))
    for i in range(0, len(index), rows):
        left = index[i : i + rows]
        for j in range(0, len(others), columns):
            right = others[j : j + columns]
            hit = units[left] @ units[right].T >= threshold
            hit &= left[:, None] != right[None, :]
            links[left] += hit @ weight[right]
            a, b = np.nonzero(hit)
            union_pairs(root, left[a], right[b])
    return links[index], root


def join_label(units: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the members linked to each vector, least linked vector of each set) of one label's distinct vectors."""
    n = len(units)
    links, root = np.zeros(n, np.int64), np.arange(n)
    pivots = units[np.unique(np.linspace(0, n - 1, pivot_count(n)).astype(np.int64))]
    home, who, where = cells_of(units, pivots, math.sqrt(2 - 2 * threshold))
    index, cell = np.concatenate([np.arange(n), who]), np.concatenate([home, where])
    own = np.arange(len(index)) < n
    order = np.lexsort((index, cell))
    index, cell, own = index[order], cell[order], own[order]
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo > 1 and own[lo:hi].any():
            part = index[lo:hi]
            linked, least = link_cell(units[part], own[lo:hi], np.ones(hi - lo, bool), weight[part], threshold)
            links[part[own[lo:hi]]] = linked
            moved = np.flatnonzero(least != np.arange(hi - lo))
            union_pairs(root, part[moved], part[least[moved]])
    return links, root


def _join_small(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root) of labels that fit a task: each is split by its own pivots there."""

    def run(batches):
        for pdf in whole_groups(batches, "group"):
            out = []
            for lo, hi in group_bounds(pdf["group"].to_numpy()):
                part = pdf.iloc[lo:hi].sort_values("rep")  # so that the least member is the least rep
                rep = part["rep"].to_numpy()
                links, root = join_label(np.array([np.frombuffer(u) for u in part["unit"]]), part["weight"].to_numpy(np.int64), threshold)
                out.append(pd.DataFrame({"rep": rep, "links": links, "root": rep[root]}))
            yield pd.concat(out, ignore_index=True)

    return reps.repartition("group").sortWithinPartitions("group").select("group", "rep", "weight", "unit").mapInPandas(run, "rep long, links long, root long")


def _assign(reps: DataFrame, radius: float, cell_rows: int) -> DataFrame:
    """(group, rep, weight, unit, home, to) of vectors of large labels (with n, the label's vectors).

    Replicas have to be moved and, where vectors lie all alike, grow with the pivots: so there are pivots for cells of
    half ``cell_rows``, and from where these are more, the square root of the vectors.
    """
    k = F.least(F.ceil(F.sqrt("n")), F.ceil(F.col("n") * 2 / cell_rows)).cast("int")
    drawn = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 40))
    # about twice as many as pivots are drawn, then the first of these by the same number
    sample = reps.select("group", "unit", "n", drawn.alias("drawn"), "rep").where(F.col("drawn") < (1 << 40) * 2.0 * k / F.col("n"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("drawn", "rep"))
    pivots = sample.withColumn("cell", place - 1).where(F.col("cell") < k)
    chunks = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")
    pivots = write_table(pivots.select("group", "cell", "unit", "n"), "pivots").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("n")
    dealt = reps.select("group", "rep", "weight", "unit", F.pmod(F.xxhash64("rep", F.lit(3)), chunks).cast("int").alias("chunk"))

    def assign(vectors: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"group": [], "rep": [], "weight": [], "unit": [], "home": [], "to": []})
        units = np.array([np.frombuffer(u) for u in vectors["unit"]])
        if len(pivots):
            centers = np.array([np.frombuffer(u) for u in pivots.sort_values("cell")["unit"]])
            home, who, where = cells_of(units, centers, radius)
        else:  # none was drawn: one cell
            home, who, where = np.zeros(len(units), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        to = np.split(where, np.searchsorted(who, np.arange(1, len(units))))
        return vectors.drop(columns="chunk").assign(home=home, to=[t.tolist() for t in to])

    return dealt.groupBy("group", "chunk").cogroup(pivots.groupBy("group", "chunk")).applyInPandas(assign, "group binary, rep long, weight long, unit binary, home long, to array<long>")


def _join_large(reps: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """(rep, links, root) of labels that are split by a table of pivots; a root may come several times."""
    placed = write_table(_assign(reps, math.sqrt(2 - 2 * threshold), cell_rows), "placed")
    # a cell's home vectors and its members (replicas too) are dealt to blocks; a task joins one of each, so its size is
    # bounded however many vectors a cell has
    members = placed.select("group", "rep", "weight", "unit", "home", F.explode(F.concat(F.array("home"), "to")).alias("cell"))
    own = F.col("home") == F.col("cell")
    block = lambda n: F.ceil(F.col(n) / (2 * cell_rows)).cast("int")
    parts = members.groupBy("group", "cell").agg(F.count_if(own).alias("homes"), F.count("*").alias("n"))
    parts = parts.where("homes > 0").select(F.struct("group", "cell").alias("part"), block("homes").alias("k"), block("n").alias("m"), "n")
    members = join_to_unique(members.withColumn("part", F.struct("group", "cell")), parts, "part", members.count())
    h, j = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("m")).cast("int")
    members = members.withColumns({"own": own, "h": h, "j": j})
    as_member = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(x.alias("h"), F.col("j").alias("j")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda x: F.struct(F.col("h").alias("h"), x.alias("j")))
    tasks = F.when(F.col("own"), F.array_distinct(F.concat(as_member, as_home))).otherwise(as_member)
    members = members.withColumn("t", F.explode(tasks))
    task = F.concat_ws("-", F.hex("group"), "cell", "t.h", "t.j")
    members = members.select(task.alias("task"), "rep", "weight", "unit", (F.col("own") & (F.col("h") == F.col("t.h"))).alias("mine"), (F.col("j") == F.col("t.j")).alias("member"))

    def run(batches):
        for pdf in whole_groups(batches, "task"):
            pdf = pdf.sort_values(["task", "rep"], ignore_index=True)  # so that the least member is the least rep
            units, weight = np.array([np.frombuffer(u) for u in pdf["unit"]]), pdf["weight"].to_numpy(np.int64)
            mine, member, rep = pdf["mine"].to_numpy(bool), pdf["member"].to_numpy(bool), pdf["rep"].to_numpy()
            out = [(rep[:0], rep[:0], rep[:0])]
            for lo, hi in group_bounds(pdf["task"].to_numpy()):
                own = rep[lo:hi]
                links, root = link_cell(units[lo:hi], mine[lo:hi], member[lo:hi], weight[lo:hi], threshold)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                home = own[mine[lo:hi]]
                out += [(home, links, home), (own[moved], np.zeros(len(moved), np.int64), own[root[moved]])]
            yield pd.DataFrame(dict(zip(("rep", "links", "root"), map(np.concatenate, zip(*out)))))

    return members.repartition("task").sortWithinPartitions("task").mapInPandas(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Rows link when labels are equal (as text) and cosine >= threshold in double precision.  Null labels, and vectors that
    are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of different length.
    Repeated rows link with each other.  A null vec_id gives null component_id and kept false.  Other columns aren't
    read; an empty table gives an empty result.
    """
    rows = write_table(unit_vectors(vectors), "units")
    group = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("unit"), "label"), 256))
    reps = rows.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.max("unit").alias("unit"))
    reps = write_table(reps.select("*", F.monotonically_increasing_id().alias("rep"), group.alias("group")), "reps")
    total = reps.count()
    sizes = write_table(reps.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    slim = reps.select("group", "rep", "weight", "unit")
    joined = _join_small(join_to_unique(slim, sizes.where(F.col("n") <= cell_rows), "group", total), threshold)
    large = sizes.where(F.col("n") > cell_rows)
    if not large.isEmpty():
        joined = joined.unionByName(_join_large(join_to_unique(slim, large, "group", total), threshold, cell_rows))
    joined = write_table(joined, "joined")
    sets = connected_components(joined.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = joined.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("label", "key", "rep", "least", "weight").join(counts, "rep").join(sets.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    known = join_to_unique(known, least, "component", total)
    known = write_table(known.select("key", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id", "weight"), "known")
    discard(joined)
    slim = rows.select("vec_id", "key")
    found = join_to_unique(slim.where("key is not null"), known.withColumnRenamed("weight", "n"), "key", rows.count()).select("vec_id", "n_links", "component_id")
    alone = slim.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

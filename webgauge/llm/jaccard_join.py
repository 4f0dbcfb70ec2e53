"""N-gram Jaccard join with Bayesian candidate pruning.

Texts of equal word sequence form a class.  MinHash bands of the classes' shingles give buckets; within a bucket,
values are compared a few at a time, and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior, binomial likelihood) falls below a tolerance.  What survives connects classes to
cells; all pairs of a cell are then verified exactly by their shingles, whichever bucket they came from.

A bucket's members are first compared with its least one, wherever they are, so that a large group of near copies is
one set before anything is grouped.  Only buckets that still hold several sets have their other pairs compared, and a
large one is dealt to blocks: a task compares two blocks, and two blocks of one and the same set are never compared.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, group_bounds, join_to_unique, only_slots_of, split_by_slots, text_or_empty, whole_groups, write_table
from .components import connected_components, union_pairs
from .shingles import shingle_batches, shingle_sets

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 4 values: a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
STEP, TOLERANCE = 16, 1e-6
CELL_ROWS = 1500
#: Members of a bucket that one task compares with as many others at most.
BLOCK_ROWS = 2000


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(97)
    return r.integers(1, 2**31, n, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, np.int64).astype(np.uint32)


def signatures(s: np.ndarray, at: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values (texts x n) of shingle hashes laid end to end; texts without shingles get the largest value."""
    out = np.full((len(at) - 1, n), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    mul, add = _hash_family(n)
    low, high = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    begin = at[:-1][full]
    for k in range(n):
        h = low * mul[k]
        h += add[k]
        h ^= h >> np.uint32(15)
        h += high
        h *= mul[n - 1 - k]
        out[full, k] = np.minimum.reduceat(h, begin)
    return out


@functools.lru_cache
def least_matches(threshold: float, tolerance: float, n: int = BANDS * ROWS, step: int = STEP) -> tuple[int, ...]:
    """After step, 2 step, ... compared values: the fewest matches with P(similarity >= threshold | matches) >= tolerance."""
    grid = (np.arange(4000) + 0.5) / 4000
    out = []
    for m in range(step, n + 1, step):
        for k in range(m + 1):
            like = k * np.log(grid) + (m - k) * np.log1p(-grid)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() >= tolerance * like.sum():
                out.append(k)
                break
    return tuple(out)


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (i, j) of signature rows aren't pruned."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int64)
    for step, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(step * STEP, (step + 1) * STEP)
        matches[alive] += (sig[i[alive], part] == sig[j[alive], part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


def connect_bucket(sig: np.ndarray, known: np.ndarray, side: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Least row of each row's set after pruning; pairs already in one set aren't compared.

    known: numbers of sets that rows are in; side: False and True in a task of two blocks, whose rows are compared
    across only; else all False.
    """
    _, first, back = np.unique(known, return_index=True, return_inverse=True)
    root = first[back]
    both = bool(side.any())
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    if len(left) > len(right) and both:
        left, right = right, left
    for i in left.tolist():
        j = right if both else np.arange(i + 1, len(sig))
        j = j[root[j] != root[i]]
        if len(j):
            j = j[surviving(sig, np.full(len(j), i), j, threshold, tolerance)]
            union_pairs(root, np.full(len(j), i), j)
    return root


def verify(sets: list[np.ndarray], weight: np.ndarray, threshold: float, left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the sets linked to each set, least member of each set's component), exactly, over all pairs.

    With ``left`` and ``right`` (boolean, disjoint) only over pairs between the two.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    links, root = np.zeros(n, np.int64), np.arange(n)
    cross = left is not None
    if n == 2 and not cross:
        both = len(np.intersect1d(*sets, assume_unique=True))
        if both and both >= threshold * (sizes.sum() - both) * (1 - 1e-9):
            links[:] = weight[::-1]
            root[:] = 0
        return links, root
    index, columns = (np.flatnonzero(left), np.flatnonzero(right)) if cross else (np.arange(n), np.arange(n))
    if not n or not len(index) or not len(columns):
        return links, root
    owner = np.repeat(np.arange(n), sizes)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1  # a shingle of one set only is in no intersection
    renamed = np.cumsum(count > 1) - 1
    owner, code = owner[shared], renamed[code[shared]]
    width, step, rows = int((count > 1).sum()), 4096, 512
    for lo in range(0, len(index), rows):
        own = index[lo : lo + rows]
        both = np.zeros((len(own), len(columns)), np.float32)
        for c in range(0, width, step):
            part = (code >= c) & (code < c + step)
            dense = np.zeros((n, min(step, width - c)), np.float32)
            dense[owner[part], code[part] - c] = 1
            both += dense[own] @ dense[columns].T
        union = sizes[own][:, None] + sizes[columns][None, :] - both
        hit = (both > 0) & (both >= threshold * union * (1 - 1e-9))
        if not cross:
            hit[np.arange(len(own)), own] = False
        links[own] += hit @ weight[columns]
        if cross:
            links[columns] += weight[own] @ hit
        i, j = np.nonzero(hit)
        union_pairs(root, own[i], columns[j])
    return links, root


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, digest, some, sig): digest names the word sequence; some: it has words at all."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            digest, some, sig = [], [], []
            for lo, hi, h, bounds, s, at in shingle_batches(texts, words):
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
                parts = []
                for seed in (0x2545F4914F6CDD1D, 0x8EBC6AF09C88C6E3):
                    x = (h ^ (h >> np.uint64(29))) * (place * np.uint64(seed) + np.uint64(seed | 1))
                    x ^= x >> np.uint64(31)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    parts.append(total[bounds[1:]] - total[bounds[:-1]])
                count = np.diff(bounds)
                digest += [f"{a:016x}{b:016x}{n:x}" for a, b, n in zip(*(p.tolist() for p in parts), count.tolist())]
                some += (count > 0).tolist()
                sig += [r.tobytes() for r in signatures(s, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(digest, pa.string()), pa.array(some, pa.bool_()), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "digest", "some", "sig"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return source.mapInArrow(run, "doc_id long, text_hash long, digest string, some boolean, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(rep, band) of every band of every class."""

    def bands(batches):
        for b in batches:
            sig = np.array([np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()]).reshape(-1, BANDS, ROWS)
            key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                key = (key ^ sig[:, :, r].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
            flat = pa.array(key.view(np.int64).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), flat], names=["rep", "band"])

    return reps.select("rep", "sig").mapInArrow(bands, "rep long, band long")


def _star_edges(pairs: DataFrame, sigs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The pairs (rep, low) that survive the pruning, as edges (a, b); few values of low may have most rows."""

    def compare(batches):
        for b in batches:
            if b.num_rows:
                sig = np.array([np.frombuffer(x, np.uint32) for k in (2, 3) for x in b.column(k).to_pylist()])
                n = b.num_rows
                ok = pa.array(surviving(sig, np.arange(n), np.arange(n) + n, threshold, tolerance))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    lows = pairs.groupBy("low").agg(F.count("*").alias("n")).join(sigs.select(F.col("rep").alias("low"), F.col("sig").alias("low_sig")), "low")
    both = join_to_unique(pairs.join(sigs, "rep"), lows, "low", pairs.count())
    return both.select("rep", "low", "sig", "low_sig").mapInArrow(compare, "a long, b long")


def _block_tasks(members: DataFrame, block_rows: int) -> DataFrame:
    """(task, side, ...) of bucket members (band, rep, root): a row for each task that a member is part of.

    A bucket of up to ``block_rows`` members is one task.  In a larger one, sets of over ``block_rows`` members get
    blocks of their own, all others share blocks, and each two blocks that aren't of one set are a task.
    """
    sets = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    sets = sets.withColumn("owner", F.when(F.col("n") > block_rows, F.col("root")).otherwise(F.lit(-1)))  # classes are numbered from 0
    blocks = sets.groupBy("band", "owner").agg(F.sum("n").alias("rows")).withColumn("k", F.ceil(F.col("rows") / block_rows).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(F.col("owner").alias("owner"), i.alias("i")))
    lists = blocks.groupBy("band").agg(F.array_sort(F.flatten(F.collect_list(own))).alias("blocks"), F.collect_set(F.when(F.col("owner") >= 0, F.col("owner"))).alias("owners"), F.max(F.when(F.col("owner") < 0, F.col("k"))).alias("shared"), F.sum("rows").alias("n"))
    dealt = join_to_unique(members, lists, "band", members.count())
    owner = F.when(F.array_contains("owners", F.col("root")), F.col("root")).otherwise(F.lit(-1))
    count = F.when(F.col("owner") < 0, F.col("shared")).otherwise(F.size(F.filter("blocks", lambda b: b["owner"] == F.col("owner"))))
    dealt = dealt.withColumn("owner", owner).withColumn("block", F.struct("owner", F.pmod(F.xxhash64("rep"), count).cast("int").alias("i")))
    others = F.filter("blocks", lambda b: (b["owner"] < 0) | (b["owner"] != F.col("owner")))
    dealt = dealt.select("band", "rep", "root", "block", F.explode(others).alias("other"))
    return dealt.select(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "band", (F.col("block") > F.col("other")).alias("side"), "rep", "root")


def _candidate_edges(reps: DataFrame, threshold: float, tolerance: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between classes that connect what survives the pruning in some bucket."""
    banded = write_table(_bands(reps), "bands")
    full = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1")
    full = write_table(full, "full")
    total = BANDS * reps.count()
    members = write_table(join_to_unique(only_slots_of(banded, "band", full, "band"), full, "band", total).select("band", "n", "low", "rep"), "members")
    discard(banded)
    # buckets with the same members hold the same pairs: one of them is enough
    h = lambda seed: F.bit_xor(F.xxhash64("rep", F.lit(seed)))
    same = members.groupBy("band").agg(F.first("n").alias("n"), F.first("low").alias("low"), h(1).alias("x"), h(2).alias("y"))
    single = write_table(same.groupBy("n", "low", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "single")
    members = write_table(join_to_unique(members.drop("n"), single, "band", total), "members")
    pairs = write_table(members.where("rep <> low").select("rep", "low").distinct(), "pairs")
    involved = pairs.select("rep").union(pairs.select("low")).distinct()
    sigs = write_table(only_slots_of(reps.select("rep", "sig"), "rep", involved, "rep").join(involved, "rep"), "sigs")
    star = write_table(_star_edges(pairs, sigs, threshold, tolerance), "star")
    discard(pairs)

    # a member that goes with its bucket's least one, in whatever bucket, is of that one's set
    sets = star.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("root"))
    rooted = members.where("n > 2").join(sets, "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
    rooted = write_table(rooted, "rooted")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least <> most").select("band", "n")
    mixed = write_table(join_to_unique(rooted, mixed, "band", total).select("band", "rep", "root"), "mixed")
    for scratch in (members, rooted):
        discard(scratch)
    tasks = _block_tasks(mixed, block_rows).join(sigs, "rep")

    def connect(batches):
        def solve(pdf):
            sig = np.array([np.frombuffer(x, np.uint32) for x in pdf["sig"]])
            rep, task = pdf["rep"].to_numpy(), pdf["task"].to_numpy()
            known, side = pdf["root"].to_numpy(), pdf["side"].to_numpy(bool)
            a, b = [rep[:0]], [rep[:0]]
            for lo, hi in group_bounds(task):
                root = connect_bucket(sig[lo:hi], known[lo:hi], side[lo:hi], threshold, tolerance)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                a.append(rep[lo + moved])
                b.append(rep[lo + root[moved]])
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        for pdf in whole_groups(batches, "task"):  # a task has two blocks at most
            yield solve(pdf)

    found = tasks.repartition("task").sortWithinPartitions("task").select("task", "side", "rep", "root", "sig").mapInPandas(connect, "a long, b long")
    return star.unionByName(found).distinct()


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, class_id, n_links, kept, text_hash) of every document.

    Documents link when the Jaccard similarity of their sets of ``words`` consecutive words (lower case, split at white
    space) is >= threshold; a text of fewer words is one shingle; texts without words (null, empty) link with nothing.
    class_id is the least doc_id that links reach (null ids last), n_links counts linked documents, copies included,
    kept marks the document whose id is its class_id.  Repeated rows link with each other.  A text of any length is
    shingled whole; verification holds the shingle hashes of a block's texts.  Other columns aren't read; an empty table
    gives an empty result.
    """
    rows = write_table(_classes(docs, words), "classes")
    reps = rows.where("some").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("who"), F.count("*").alias("weight"), F.max("sig").alias("sig"))
    reps = write_table(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    slim = reps.select("rep", "digest", "least", "weight", F.col("who.doc_id").alias("doc_id"), F.col("who.text_hash").alias("text_hash"))
    cells = connected_components(_candidate_edges(reps, threshold, tolerance)).select(F.col("id").alias("rep"), F.col("component").alias("cell"))

    total = reps.count()
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    active = join_to_unique(cells, sizes, "cell", total).join(slim, "rep").select("rep", "cell", "n", "weight", "doc_id", "text_hash")
    active = write_table(active, "active")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = only_slots_of(texts, "text_hash", active, "text_hash")
    keyed = active.join(texts, (active["doc_id"].eqNullSafe(texts["doc_id"])) & (active["text_hash"] == texts["text_hash"])).select("rep", "cell", "n", "weight", "text")
    keyed = cell_texts = write_table(keyed.dropDuplicates(["rep"]), "cell_texts")

    small = max(1, math.ceil(active.count() / cell_rows))
    # small cells share a task; a large one is dealt to blocks, and each pair of blocks is a task of bounded size
    k = F.when(F.col("n") > cell_rows, F.ceil(F.col("n") / cell_rows).cast("int")).otherwise(F.lit(1))
    keyed = keyed.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = F.concat_ws("-", "cell", F.least("block", "other"), F.greatest("block", "other"))
    task = F.when(F.col("k") > 1, pair).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("cell"), F.lit(small)).cast("string")))
    keyed = keyed.withColumn("task", task)

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "rep"], ignore_index=True)
        sets = shingle_sets(pdf["text"].tolist(), words)
        cell, rep, block = pdf["cell"].to_numpy(), pdf["rep"].to_numpy(), pdf["block"].to_numpy()
        weight = pdf["weight"].to_numpy(np.int64)
        out = []
        for lo, hi in group_bounds(cell):
            first = block[lo:hi] == block[lo:hi].min()
            across = () if first.all() else (first, ~first)
            links, root = verify(sets[lo:hi], weight[lo:hi], threshold, *across)
            own = rep[lo:hi]
            out.append(pd.DataFrame({"rep": own, "links": links, "root": own[root]}))
        return pd.concat(out, ignore_index=True)

    joined = keyed.select("task", "cell", "rep", "block", "weight", "text").groupBy("task").applyInPandas(check, "rep long, links long, root long")
    joined = write_table(joined, "joined")
    discard(cell_texts)
    sets = connected_components(joined.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = joined.groupBy("rep").agg(F.sum("links").alias("links"))
    known = slim.select("rep", "digest", "least", "weight").join(counts, "rep", "left").join(sets.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    known = join_to_unique(known, least, "component", total).select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.col("weight").alias("n"))
    known = write_table(known, "known")
    slim_rows = rows.select("doc_id", "text_hash", "digest", "some")
    found = join_to_unique(slim_rows.where("some"), known, "digest", rows.count()).select("doc_id", "class_id", "n_links", "text_hash")
    alone = slim_rows.where("not some").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_hash")
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, that are the first of their group; texts without words all stay.

    Of repeated rows (equal id and text) in a group one stays.
    """
    found = jaccard_join(docs, words, threshold)
    rows = write_table(found.groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"), F.max("n_links").alias("links")), "groups")
    key = F.xxhash64(text_or_empty())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__wg_id")) & (key == F.col("__wg_hash"))
    named = rows.select(F.col("doc_id").alias("__wg_id"), F.col("text_hash").alias("__wg_hash"), "kept", "n", "links")
    drop = named.where("not kept").select("__wg_id", "__wg_hash")
    again = named.where("kept and n > 1 and links > 0").select("__wg_id", "__wg_hash")
    maybe, rest = split_by_slots(docs, key, drop.unionByName(again), "__wg_hash")  # most texts aren't shuffled
    left = maybe.join(drop, same, "left_anti")
    if again.isEmpty():
        return rest.unionByName(left)
    single = left.join(again, same, "left_semi").withColumn("__wg_key", key).dropDuplicates(["doc_id", "__wg_key"]).drop("__wg_key")
    return rest.unionByName(left.join(again, same, "left_anti")).unionByName(single)

"""Centroid clustering of integer vectors by kd-tree filtering.

Each task splits its vectors into blocks and each block into a kd-tree, whose nodes hold the sum, the squared norms and
the box of their vectors (the count follows from the place in the tree).  The trees are written once.  A round passes the
centroids down each tree: one that is farther than another from every point of a node's box is dropped there; a node
with one centroid left is assigned whole, by its sums; what is left in the leaves is resolved vector by vector.  All
arithmetic is on integers, so the result doesn't depend on how vectors are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .vectors import component_bound, exact_product, floored, whole_vectors

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a tree, and of a leaf at most.
TREE_ROWS, LEAF_ROWS = 1024, 32

TREE_SCHEMA = "ids array<long>, width int, points binary, sums binary, squares binary, low binary, high binary"


def level_edges(n: int, leaf: int = LEAF_ROWS) -> list[np.ndarray]:
    """Where the nodes of each level begin and end among n ordered vectors: halves of halves."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        e = levels[-1]
        halved = np.empty(2 * len(e) - 1, np.int64)
        halved[::2], halved[1::2] = e, (e[:-1] + e[1:]) // 2
        levels.append(halved)
    return levels


def kd_order(points: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """An order in which every node's vectors are the lower or upper half of its parent's along its widest component."""
    order = np.arange(len(points))
    for above, below in zip(edges[:-1], edges[1:]):
        for node in range(len(above) - 1):
            lo, mid, hi = above[node], below[2 * node + 1], above[node + 1]
            part = points[order[lo:hi]]
            wide = int((part.max(axis=0) - part.min(axis=0)).argmax())
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, wide], mid - lo)]
    return order


class Tree:
    """Ordered vectors and, for each level, sum, squared norms and box of every node."""

    def __init__(self, points: np.ndarray, edges: list, sums: list, squares: list, low: list, high: list):
        self.points, self.edges, self.sums, self.squares, self.low, self.high = points, edges, sums, squares, low, high

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple["Tree", np.ndarray]:
        """(tree, order of its vectors)."""
        edges = level_edges(len(points), leaf)
        order = kd_order(points, edges)
        points = points[order]
        at = edges[-1][:-1]
        norms = (points * points).sum(axis=1)
        nodes = [(np.add.reduceat(points, at), np.add.reduceat(norms, at), np.minimum.reduceat(points, at), np.maximum.reduceat(points, at))]
        for _ in edges[1:]:
            s, q, lo, hi = nodes[0]
            nodes.insert(0, (s[::2] + s[1::2], q[::2] + q[1::2], np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))
        return cls(points, edges, *map(list, zip(*nodes))), order

    def packed(self, ids: list) -> dict:
        width = next(w for w in (1, 2, 4) if abs(int(np.abs(self.points).max(initial=0))) < 1 << (8 * w - 1))
        small = f"<i{width}"
        flat = lambda levels, kind: np.concatenate(levels).astype(kind).tobytes()
        return {
            "ids": ids, "width": width, "points": self.points.astype(small).tobytes(), "sums": flat(self.sums, "<i8"),
            "squares": flat(self.squares, "<i8"), "low": flat(self.low, small), "high": flat(self.high, small),
        }

    @classmethod
    def unpacked(cls, row: dict, dims: int, leaf: int = LEAF_ROWS) -> "Tree":
        edges = level_edges(len(row["ids"]), leaf)
        cuts = np.cumsum([len(e) - 1 for e in edges])[:-1]
        small = f"<i{row['width']}"
        read = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
        nodes = [np.split(read(n, k).reshape(-1, dims) if n != "squares" else read(n, k), cuts) for n, k in (("sums", "<i8"), ("squares", "<i8"), ("low", small), ("high", small))]
        return cls(read("points", small).reshape(-1, dims), edges, *nodes)


def undominated(low: np.ndarray, high: np.ndarray, centers: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which of the living centroids of each box are not strictly farther than its middle's nearest one from all of it."""
    norms = (centers * centers).sum(axis=1)
    middle = norms - exact_product(low + high, centers)  # distance to the middle, but for what all centroids share
    best = np.where(alive, middle, np.iinfo(np.int64).max).argmin(axis=1)
    away = centers[None] - centers[best][:, None]  # the corner that lies farthest this way is the last to prefer it
    reach = np.where(away > 0, high[:, None] * away, low[:, None] * away).sum(axis=2)
    return alive & (norms[None] - norms[best][:, None] - 2 * reach <= 0)


def filter_tree(tree: Tree, centers: np.ndarray):
    """(whole nodes as (level, nodes, their centroids) triples; vectors of unsure leaves, their centroids)."""
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centers)), bool)
    whole = []
    for level in range(len(tree.edges)):
        alive = undominated(tree.low[level][nodes], tree.high[level][nodes], centers, alive)
        sure = alive.sum(axis=1) == 1
        whole.append((level, nodes[sure], alive[sure].argmax(axis=1)))
        nodes, alive = nodes[~sure], alive[~sure]
        if level < len(tree.edges) - 1:
            nodes, alive = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([alive, alive])
    lo, hi = tree.edges[-1][nodes], tree.edges[-1][nodes + 1]
    rows = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist())] or [np.zeros(0, np.int64)])
    choice = np.repeat(alive, hi - lo, axis=0)
    distance = (centers * centers).sum(axis=1) - 2 * exact_product(tree.points[rows], centers)
    return whole, rows, np.where(choice, distance, np.iinfo(np.int64).max).argmin(axis=1)


def cluster_sums(tree: Tree, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum, squared norms) of the vectors nearest to each centroid."""
    n, squares, sums = np.zeros(len(centers), np.int64), np.zeros(len(centers), np.int64), np.zeros_like(centers)
    whole, rows, nearest = filter_tree(tree, centers)
    for level, nodes, to in whole:
        np.add.at(n, to, np.diff(tree.edges[level])[nodes])
        np.add.at(sums, to, tree.sums[level][nodes])
        np.add.at(squares, to, tree.squares[level][nodes])
    np.add.at(n, nearest, 1)
    np.add.at(sums, nearest, tree.points[rows])
    np.add.at(squares, nearest, (tree.points[rows] ** 2).sum(axis=1))
    return n, sums, squares


def clusters_of(tree: Tree, centers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tree.points), np.int64)
    whole, rows, nearest = filter_tree(tree, centers)
    for level, nodes, to in whole:
        for node, c in zip(nodes.tolist(), to.tolist()):
            out[tree.edges[level][node] : tree.edges[level][node + 1]] = c
    out[rows] = nearest
    return out


def plant_trees(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The kd-trees of all usable vectors, one in a row, written as a table."""
    bound = component_bound(dims, 60)  # of a distance: its terms are up to four times a product's

    def run(batches):
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), *[(c, pa.binary()) for c in ("points", "sums", "squares", "low", "high")]])
        ids, held = [], np.zeros((0, dims), np.int64)

        def rows(least: int):
            nonlocal ids, held
            while len(ids) >= least and ids:
                tree, order = Tree.of(held[:tree_rows])
                part = ids[:tree_rows]
                yield pa.RecordBatch.from_pylist([tree.packed([part[i] for i in order.tolist()])], schema)
                ids, held = ids[tree_rows:], held[tree_rows:]

        for batch in batches:
            _, found = whole_vectors(batch.column("embedding"), dims)
            for _, at, matrix in found:
                good, points = floored(matrix, scale, bound // 2)
                ids += batch.column("vec_id").take(at[good]).to_pylist()
                held = np.concatenate([held, points])
            yield from rows(tree_rows)
        yield from rows(1)

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return write_table(source.mapInArrow(run, TREE_SCHEMA), "kd-trees")


def first_centroids(vectors: DataFrame, clusters: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The kept vectors whose ``seed:vec_id`` has the least hashes, at most one row for each centroid."""
    bound = component_bound(dims, 60) // 2
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    fits = lambda c: (c * F.lit(float(scale)) >= F.lit(float(-bound))) & (c * F.lit(float(scale)) < F.lit(bound + 1.0))
    real = F.forall(F.col("embedding").cast("array<double>"), lambda c: c.isNotNull() & fits(c))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("long").cast("string"), F.lit("null")))
    kept = vectors.where((F.size("embedding") == dims) & F.coalesce(real, F.lit(False))).select(F.sha2(name, 256).alias("h"), F.col("embedding"))
    drawn = kept.orderBy("h", "embedding").limit(clusters).select("h", x.alias("x")).collect()
    return np.array([[int(c) for c in r.x] for r in sorted(drawn, key=lambda r: r.h)], np.int64).reshape(-1, dims)


def _totals(trees: DataFrame, centers: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """cluster: (count, sums, squared norms) over all trees; a row of each cluster comes to the driver."""
    k, dims = centers.shape

    def run(batches):
        n, sums, squares = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                a, b, c = cluster_sums(Tree.unpacked(row, dims), centers)
                n, sums, squares = n + a, sums + b, squares + c
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": found.astype(np.int32), "n": n[found], "squares": squares[found], "sums": pa.array(sums[found].tolist(), pa.list_(pa.int64()))})

    parts = trees.mapInArrow(run, "cluster int, n long, squares long, sums array<long>")
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    each = [whole(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), whole(F.col("squares")).alias("squares"), *each).collect()
    return {r.cluster: (r.n, [int(r[f"s{i}"]) for i in range(dims)], int(r.squares)) for r in rows}


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of (vec_id, embedding).

    Kept are vectors of ``dims`` components, none null or non-finite; each becomes floor(scale * x).  Vectors with an
    integer beyond 2^26 for 64 components take no part, since distances must fit a long.  Centroids start as the kept
    vectors of the least sha256 of ``seed:vec_id`` (fewer if fewer are kept; rows of one id by their components); in each
    round vectors go to the nearest centroid, ties to the smaller number, and non-empty centroids move to their vectors'
    floored mean.  A repeated row counts as often as it comes; a null vec_id stays null and draws as ``null``.  Inertia
    that no long holds is null.  Other columns aren't read; an empty table gives an empty result.
    """
    centers = first_centroids(vectors, clusters, dims, scale, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centers):
        return vectors.sparkSession.createDataFrame([], schema)
    trees = plant_trees(vectors, dims, scale)
    for _ in range(rounds):
        for c, (n, sums, _) in _totals(trees, centers).items():
            centers[c] = [s // n for s in sums]
    spread = {}
    for c, (n, sums, squares) in _totals(trees, centers).items():
        at = centers[c].tolist()
        spread[c] = squares - 2 * sum(x * s for x, s in zip(at, sums)) + n * sum(x * x for x in at)
    fits = lambda x: x if x < 1 << 63 else None
    inertia = fits(sum(spread.values()))
    spread = [fits(spread.get(c, 0)) for c in range(len(centers))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]

    def assign(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree.unpacked(row, dims)
                to = clusters_of(tree, centers)
                distance = ((tree.points - centers[to]) ** 2).sum(axis=1)
                to = to.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(to, pa.int32()), pa.array(distance, pa.int64()), pa.array([spread[c] for c in to], pa.int64()),
                        pa.array([inertia] * len(to), pa.int64()), pa.array([names[c] for c in to], pa.string()),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return trees.mapInArrow(assign, schema)

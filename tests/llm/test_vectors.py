"""Centroid clustering and hard-negative mining, against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from webgauge.llm.centroid_clustering import Tree, cluster_sums, cluster_vectors, clusters_of, undominated
from webgauge.llm.hard_negatives import hard_negatives, packed_planes, plane_weight, planes_of, sliced_products
from webgauge.llm.queries import op11_centroid_clustering, op12_hard_negatives
from webgauge.llm.vectors import exact_product

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, row string, q int, dims string, ids string, score long"


@pytest.fixture(scope="module")
def make_vectors(spark):
    """Vectors with extra columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, v, y, "c", "r", 1, "d", "i", 2) for i, v, y in rows], SCHEMA).repartition(3)


def odd_vectors(dims=64, n=260, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, dims))
    rows = [(i, (centers[i % 9] + 0.3 * rng.normal(size=dims)).tolist(), int(rng.integers(0, 10))) for i in range(n)]
    whole = rows[5][1]
    rows += [
        rows[3], rows[3], (100, rows[100 % n][1], 4), (None, whole, 1), (1000, None, 1), (1001, [], 1), (1002, whole[:-1], 1), (1003, whole + [0.0], 1), (1004, [None] + whole[1:], 1),
        (1005, [float("nan")] + whole[1:], 1), (1006, whole[:-1] + [float("inf")], 1), (1007, [0.0] * dims, 2), (1100, [-x for x in whole], 3), (1200, whole, None), (1300, [1e300] * dims, 2),
    ]
    return rows


def floored(v, scale):
    return [math.floor(scale * x) for x in v]


def plain_clusters(rows, clusters=16, rounds=3, dims=64):
    fits = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(math.floor(64 * x)) <= 1 << 26 for x in v)
    kept = [(i, floored(v, 64)) for i, v, _ in rows if fits(v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(((name(i), v) for i, v in kept))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in kept]
        for k in range(len(centers)):
            own = [v for (_, v), t in zip(kept, to) if t == k]
            if own:
                centers[k] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {k: sum(d for _, d, c in found if c == k) for _, _, k in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((-1 if i is None else i, c, d, total[c], sum(total.values()), sha[c]) for i, d, c in found)


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors(n=9), [(i, [1.5] * 64, 0) for i in range(300)], [(i, [x * 1e5 for x in v], y) for i, v, y in odd_vectors(n=80) if v and None not in v], []], ids=["many", "few", "alike", "large", "none"])
def test_clusters_are_those_of_plain_integers(make_vectors, rows):
    got = cluster_vectors(make_vectors(rows)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in got) == plain_clusters(rows)


def test_clusters_do_not_depend_on_the_dealing(make_vectors, spark):
    rows = odd_vectors(n=3000, seed=3)
    a = {tuple(r) for r in cluster_vectors(make_vectors(rows)).collect()}
    assert a == {tuple(r) for r in cluster_vectors(make_vectors(rows[::-1]).coalesce(1)).collect()}


@pytest.mark.parametrize("dims", [1, 3, 64])
def test_tree_gives_sums_and_clusters(dims):
    rng = np.random.default_rng(dims)
    for n in (1, 2, 31, 33, 500, 1024):
        points = rng.integers(-40, 40, (n, dims)) // rng.integers(1, 9)
        centers = points[rng.integers(0, n, 7)]
        tree, order = Tree.of(points, leaf=4)
        tree = Tree.unpacked(tree.packed(list(range(n))), dims, leaf=4)
        expected = ((points[order][:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (clusters_of(tree, centers) == expected).all()
        count, sums, squares = cluster_sums(tree, centers)
        for k in range(7):
            own = points[order][expected == k]
            assert (count[k], sums[k].tolist(), squares[k]) == (len(own), own.sum(axis=0).tolist(), (own**2).sum())


def test_only_strictly_farther_centroids_are_dropped():
    low, high, centers = np.array([[0, 0]]), np.array([[2, 2]]), np.array([[1, 1], [5, 1], [3, 1]])
    assert undominated(low, high, centers, np.ones((1, 3), bool)).tolist() == [[True, False, True]]  # (2, y) is as near to (3, 1)


def test_clusters_prune_and_assign_whole_nodes():
    from webgauge.llm.centroid_clustering import filter_tree

    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(0, 20, (500, 8)) + 1000 * k for k in range(4)])
    whole, rows, _ = filter_tree(Tree.of(points)[0], points[::500])
    assert not len(rows) and sum(len(nodes) for _, nodes, _ in whole) == 4


def plain_negatives(rows, scale=256):
    bound = lambda v: math.isqrt((1 << 60) // max(1, len(v)))
    usable = lambda i, v, y: i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) and abs(scale * x) <= bound(v) for x in v)
    kept = [(i, floored(v, scale), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if usable(i, v, y)]
    out = []
    for a, (anchor, va, ya) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, y) for b, (i, v, y) in enumerate(kept) if a != b and len(v) == len(va))
        for p, positive, _ in [s for s in scored if s[2] == ya][:5]:
            found = [s for s in scored if s[2] != ya and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(anchor, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(found)]
    return sorted(out)


def restated():
    from pyspark.sql import functions as F

    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
@pytest.mark.parametrize("rows", [odd_vectors(n=420, seed=7), odd_vectors(dims=3, n=300, seed=8), odd_vectors(dims=130, n=120, seed=9), [(i, [0.25] * 5, i % 2) for i in range(210)], [(i, [30000.0 * x for x in v], y) for i, v, y in odd_vectors(n=220) if v and None not in v], []], ids=["many", "short", "long", "ties", "large", "none"])
def test_negatives_are_those_of_plain_integers(make_vectors, rows, block_bytes):
    got = hard_negatives(make_vectors(rows), label=restated(), block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows)


def test_hard_negatives_of_vectors_without_anchors(make_vectors):
    assert hard_negatives(make_vectors([(1, [1.0], 1), (2, [1.0], 2)])).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.02, 1.0])
def test_planes_give_exact_products(share):
    rng = np.random.default_rng(1)
    for dims in (1, 64, 70):
        rows, anchors = rng.integers(-300, 300, (50, dims)), rng.integers(-9, 200, (20, dims))
        keep = rng.random((50, 20)) <= share
        seen = []

        def qualify(low, high, anchor):
            seen.append(anchor is None)
            return high >= low

        r, a, score = sliced_products(rows, anchors, keep, qualify)
        assert (np.sort(r * 20 + a) == np.flatnonzero(keep)).all() and (score == (rows @ anchors.T)[r, a]).all()
        assert len(seen) == (planes_of(rows) if keep.any() else 0)


def test_intervals_hold_the_score_and_tighten():
    rng = np.random.default_rng(2)
    rows, anchors = rng.integers(-256, 256, (40, 64)), rng.integers(-256, 256, (30, 64))
    true, widths = rows @ anchors.T, []

    def qualify(low, high, anchor):
        assert (low <= true).all() and (true <= high).all()
        widths.append((high - low).max())
        return np.ones(low.shape, bool)

    sliced_products(rows, anchors, np.ones((40, 30), bool), qualify)
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0
    planes = planes_of(rows)
    bits = packed_planes(rows, planes)
    assert sum(plane_weight(i, planes) * int(np.bitwise_count(bits[i]).sum()) for i in range(planes)) == rows.sum()


def test_products_beyond_doubles():
    a = np.array([[1 << 29, 3], [1 << 29, 1]])
    assert exact_product(a, a).tolist() == [[(1 << 58) + 9, (1 << 58) + 3], [(1 << 58) + 3, (1 << 58) + 1]]


def test_queries_apply_them_to_whole_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rows = [tuple(r) for r in rows]
    assert sorted(tuple(r) for r in op11_centroid_clustering(spark, "/root/testdata/sf0.001").collect()) == plain_clusters(rows)
    assert sorted(tuple(r) for r in op12_hard_negatives(spark, "/root/testdata/sf0.001").collect()) == plain_negatives(rows)

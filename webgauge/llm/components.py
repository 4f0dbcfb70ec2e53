"""Connected components by alternating large-star and small-star steps, each a min aggregation and a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_to_unique, write_table


def _sum(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _star(edges: DataFrame, small: bool, rows: int) -> DataFrame:
    """edges (a, b), a > b.  Neighbours of each u are linked to the least of them and u; small: only lesser neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    # a hub has many neighbours, but of these few are lesser ones
    joined = both.join(least.drop("n"), "u") if small else join_to_unique(both, least, "u", 2 * rows)
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the least id that links reach.  No loops or order needed in edges."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = write_table(edges, "edges")
    mark = _sum(edges)
    while mark[0]:
        last, edges = edges, write_table(_star(_star(edges, small=False, rows=mark[0]), small=True, rows=mark[0]), "edges")
        now = _sum(edges)
        discard(last)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def union_pairs(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i[k] and j[k] for every k; root[x] is the least member of x's set, before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up

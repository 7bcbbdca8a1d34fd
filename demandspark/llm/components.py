"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), every step a join on a written table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, centre) for the links (u, v): a star for each component around its smallest node, the centres themselves left out."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node hangs on the smallest of the node and its neighbours."""
    both = written(_both(edges))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), (both, least)


def _small_star(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """A node's smaller neighbours and the node itself hang on the smallest of them. Edges point from the larger (u) to the smaller (v)."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), (least,)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of edges(u, v), both long, the smallest node that it reaches. Loops and repeated edges do no harm.

    The number of rounds grows with the logarithm of the nodes. Raises if max_rounds don't suffice (then nothing is returned)."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    if not state[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        large, used = _large_star(now)
        large = written(large)
        small, more = _small_star(large)
        after = written(small)
        for old in (now, large, *used, *more):
            dropped(old)
        now, before, state = after, state, _state(after)
        if state == before:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

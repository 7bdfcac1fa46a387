"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.session import stage


def join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots after linking ``u`` with ``v``; a root is the smallest position of its group."""
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root[root] == root).all():
            root = root[root]


def _ranked(node: str):
    # A random order of the nodes: every round then removes a constant share of them, chains included.
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; one root per component.

    Each round every node joins the first of its neighbours in a random order (or stays) and the
    edges move to the nodes joined, so the graph shrinks geometrically. Minima are pre-added
    in the tasks, and the joins have an exchange on both sides, which lets a hub be split.
    Self links and repeated edges are harmless; no edges give no rows.
    """
    left = stage(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(_ranked("v")).alias("m"))
        joined = stage(
            first.select(F.col("u").alias("node"), F.least("m", _ranked("u"))["node"].alias("root")), "joined"
        )
        rounds.append(joined)
        to_u = joined.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = joined.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = left.join(to_u, "u").join(to_v, "v").where("ru <> rv")
        left = stage(
            moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges"
        )
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out

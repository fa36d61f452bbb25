"""Connected components of links between rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.store import HOT_ROWS, join_hot, materialize


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with links a-b, the smallest node that each can reach."""
    root = np.arange(n)
    while len(a):
        up_a, up_b = root[a], root[b]  # roots move, not their nodes: links that are closed by now hold through them
        low = np.minimum(up_a, up_b)
        np.minimum.at(root, up_a, low)
        np.minimum.at(root, up_b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` (written) with the columns of ``right``, a row per ``key``. Where one key can have more rows than a
    task should get, such keys are joined where their rows lie."""
    if left.limit(HOT_ROWS + 1).count() <= HOT_ROWS:
        return left.join(right, key)
    rows = left.groupBy(key).agg(F.count("*").alias("n"))
    return join_hot(left, materialize(right.join(rows, key)), [key])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (long columns a and b; nulls and loops do nothing):
    component is the smallest node reachable.

    Each round every node points to its smallest neighbour, pointers are doubled twice and the graph is
    contracted to the roots. Rounds grow with the logarithm of the longest path; what stays is only
    written tables, so lost executors cost one round at most. Popular nodes meet as a minimum, which is
    combined before the shuffle, and the rows that ask for a popular root are not sent to it.
    """
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    edges = materialize(links.where("a <> b").select(*pair("a", "b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        up = materialize(both.groupBy("node").agg(F.least("node", F.min("near")).alias("up")))
        for _ in range(2):
            further = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            up = materialize(_looked_up(up, further, "up").select("node", F.col("further").alias("up")))
        if labels is None:
            labels = up.withColumnRenamed("up", "component")
        else:
            moved = _looked_up(labels, up.withColumnRenamed("node", "component"), "component").select("node", F.col("up").alias("component"))
            labels = materialize(moved.union(labels.join(up.select("node").withColumnRenamed("node", "component"), "component", "left_anti").select("node", "component")))
        at = lambda end: up.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))  # noqa: E731, B023
        half = materialize(_looked_up(edges, at("a"), "a").select("b", "a_up"))
        edges = materialize(_looked_up(half, at("b"), "b").where("a_up <> b_up").select(*pair("a_up", "b_up")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels

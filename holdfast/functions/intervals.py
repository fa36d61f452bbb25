"""Joins of points and closed intervals of time by dyadic nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.tables import broadcast_if_small, written

LEVEL, NODE = "__level", "__node"


def covered(windows: DataFrame, bucket: int, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """``windows`` with a row for each node that covers its buckets: __level, and the node's number __node among those
    of 2**level buckets of ``bucket`` seconds. A window of n buckets has at most 2 log2(n) + 2 nodes, disjoint, however
    long it is; a window that ends before it starts, or has a null end, has none.

    On each level the buckets left to cover start at ceil(first / 2**level) and end at floor(end / 2**level); an odd
    start and an odd end are nodes of that level, the rest is left to the next.
    """
    first, end = F.floor(F.col(t0) / bucket), F.floor(F.col(t1) / bucket) + 1
    cut = windows.where(F.col(t1) >= F.col(t0)).withColumns({"__a": first.cast("long"), "__b": end.cast("long")})
    nodes = """flatten(transform(sequence(0, cast(ceil(log2(__b - __a)) as int) + 1), l -> filter(array(
        named_struct('level', l, 'node', if(pmod(-shiftright(-__a, l), 2L) = 1, -shiftright(-__a, l), null)),
        named_struct('level', l, 'node', if(pmod(shiftright(__b, l), 2L) = 1, shiftright(__b, l) - 1, null))),
        x -> x.node is not null and -shiftright(-__a, l) < shiftright(__b, l))))"""
    return cut.withColumn("__n", F.explode(F.expr(nodes))).withColumns({LEVEL: F.col("__n.level"), NODE: F.col("__n.node")}).drop("__a", "__b", "__n")


def points_in_windows(points: DataFrame, windows: DataFrame, keys: list[str], bucket: int, t: str = "t", t0: str = "t0", t1: str = "t1", small: bool = True) -> DataFrame:
    """Rows of ``points`` with those of ``windows`` of the same ``keys`` for which t0 <= t <= t1, each pair once.

    A window is a row for each of its nodes, a logarithm of its length; a point meets the one node of every level that
    any window uses. Windows of hours and of years mix without cutting the long ones into short pieces. ``small``: the
    windows may be a small table; they are cut and written first, and broadcast if they are small in bytes.
    """
    cut = covered(windows, bucket, t0, t1)
    cut = written(cut) if small else cut
    levels = cut.agg(F.collect_set(LEVEL).alias("__levels"))  # one row of at most 64 numbers
    placed = points.where(F.col(t).isNotNull()).join(F.broadcast(levels)).withColumn("__b", F.floor(F.col(t) / bucket).cast("long"))
    nodes = F.expr("transform(__levels, l -> named_struct('level', l, 'node', shiftright(__b, l)))")
    placed = placed.withColumn("__n", F.explode(nodes)).withColumns({LEVEL: F.col("__n.level"), NODE: F.col("__n.node")}).drop("__levels", "__b", "__n")
    both = placed.join(broadcast_if_small(cut) if small else cut, [*keys, LEVEL, NODE])
    return both.where(F.col(t).between(F.col(t0), F.col(t1))).drop(LEVEL, NODE)

"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.tables import broadcast_if_small, written


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: later uses neither recompute it nor depend on shuffle files
    of lost executors, and see the same rows even where the plan before was not deterministic."""
    return written(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key that a join may send to one task; keys with more are joined where their rows lie.
HOT_ROWS = 1 << 16


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` (a table read again alike) with the columns of ``right``, a row per key with ``n``, the number of rows
    that ``left`` has of it at most. The right rows of keys with more than ``hot_rows`` are few, a share of the left
    rows, and are broadcast if they are small in bytes; all others are joined by shuffle. ``n`` goes."""
    hot = broadcast_if_small(materialize(right.where(F.col("n") > hot_rows).drop("n")))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col("n") <= hot_rows).drop("n"), keys)
    return left.join(hot, keys).unionByName(cold)


__all__ = ["broadcast_if_small", "join_hot", "materialize", "shuffle_partitions"]

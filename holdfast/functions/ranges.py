"""Ordered work on keys of any size: rows are dealt by ranges of (keys, order), and what a range needs of the ranges
before it is carried over as a few rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from holdfast.functions.tables import broadcast_if_small, written

PART, PLACE = "__part", "__place"
#: Rows of one key that may be ordered in one task; keys with more are dealt by ranges.
KEY_ROWS = 1 << 16


def split_large(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without the keys that have more than ``rows`` rows, and the rows of these, None if there are none. Keys are
    counted before the shuffle; ``df`` is read again for each part, so it must be alike each time. Null keys are small."""
    large = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > rows).select(*keys)  # of the rows, one in ``rows`` at most
    if large.isEmpty():
        return df, None
    few = broadcast_if_small(large)
    return df.join(few, keys, "left_anti"), df.join(few, keys, "left_semi")


def ranged(df: DataFrame, keys: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """``df`` written in ``n`` ranges of (keys, order), else as many as there are shuffle partitions, each sorted: ``__part``
    numbers the ranges and ``__place`` orders all rows. A key with very many rows lies in many ranges."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn(PLACE, F.monotonically_increasing_id())
    return written(dealt.withColumn(PART, F.shiftright(PLACE, 33)))


def _earlier(placed: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Totals of ``sums`` (name -> SQL) over the earlier ranges of each key, for every range that continues a key: as many
    rows as ranges at most, since a border between ranges cuts one key."""
    totals = placed.groupBy(*keys, PART).agg(*[F.sum(F.expr(c)).alias(name) for name, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(PART)) == 1
    carried = totals.select(*keys, PART, first.alias("__first"), *[F.sum(name).over(before).alias(name) for name in sums])
    return carried.where("not __first").drop("__first")


def _upto(keys: list[str], order: list[str], peers: bool) -> WindowSpec:
    """The rows of the key up to and with the own one, or with all that are alike in the order."""
    rows = Window.partitionBy(*keys).orderBy(*order)
    return rows.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else rows.rowsBetween(Window.unboundedPreceding, 0)


def running(placed: DataFrame, keys: list[str], sums: dict[str, str], peers: list[str] | None = None) -> DataFrame:
    """``placed`` (from ``ranged`` by ``keys``) with running sums: for each name in ``sums`` the total of its SQL
    expression over the rows of the key up to and with the own one, 0 or null values counting as nothing. With ``peers``,
    the order of ``placed``, rows alike in it count together; they lie in one range.

    A window runs inside a range, and the totals of a key's earlier ranges come as one row per range, broadcast. So no
    task gets more than a range, even if one key has all rows. Null keys are a key.
    """
    inside = _upto([PART, *keys], peers or [PLACE], peers is not None)
    own = placed.withColumns({name: F.coalesce(F.sum(F.expr(c)).over(inside), F.lit(0)) for name, c in sums.items()})
    carried = _earlier(placed, keys, sums).withColumnsRenamed({c: f"__of_{c}" for c in [*keys, PART]} | {name: f"__before_{name}" for name in sums})
    same = F.col(PART) == F.col(f"__of_{PART}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    both = own.join(F.broadcast(carried), same, "left")  # a row per range at most
    added = {name: F.col(name) + F.coalesce(f"__before_{name}", F.lit(0)) for name in sums}
    return both.withColumns(added).drop(*carried.columns)


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], key_rows: int = KEY_ROWS, peers: bool = False) -> DataFrame:
    """``df`` with ``running`` sums in the order of ``order``. Keys of up to ``key_rows`` rows take one window each; larger
    ones are dealt by ranges. Both give the same sums of integers, and of doubles but for the last digits. With ``peers``
    rows of a key that are alike in ``order`` count together, so the sums do not depend on how such ties fall."""
    small, large = split_large(df, keys, key_rows)
    upto = _upto(keys, order, peers)
    out = small.withColumns({name: F.coalesce(F.sum(F.expr(c)).over(upto), F.lit(0)) for name, c in sums.items()})
    if large is None:
        return out
    return out.unionByName(running(ranged(large, keys, order), keys, sums, order if peers else None).drop(PART, PLACE))


def keyed_ranks(df: DataFrame, keys: list[str], order: list[str], name: str = "i", key_rows: int = KEY_ROWS) -> DataFrame:
    """``df`` with each row's place from 0 among those of its keys, in the order of ``order``."""
    return running_sums(df, keys, order, {name: "1"}, key_rows).withColumn(name, F.col(name) - 1)


def trailing(df: DataFrame, keys: list[str], order: list[str], n: int, columns: dict[str, Callable[[WindowSpec], Column]], key_rows: int = KEY_ROWS) -> DataFrame:
    """``df`` with ``columns``, each made of a window: the last ``n`` rows of the key up to and with the own one (fewer at
    the start), in the order of ``order``.

    Keys of up to ``key_rows`` rows are a window each. The rows of larger ones are ranked within their key (by ranges)
    and dealt in blocks of ``key_rows`` ranks, of ``n`` at least; every block also gets the last n - 1 rows before it, its
    halo, so a long series is spread over all tasks.
    """
    small, large = split_large(df, keys, key_rows)
    plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    out = small.withColumns({name: make(plain) for name, make in columns.items()})
    if large is None:
        return out
    ranked = running(ranged(large, keys, order), keys, {"__i": "1"}).drop(PART, PLACE)
    block = max(n, key_rows)
    home = F.floor((F.col("__i") - 1) / block)
    reached = F.floor((F.col("__i") - 1 + (n - 1)) / block)  # the block whose first rows look back to this one
    dealt = ranked.withColumn("__block", F.explode(F.array_distinct(F.array(home, reached)))).withColumn("__own", F.col("__block") == home)
    inside = Window.partitionBy(*keys, "__block").orderBy("__i").rowsBetween(-(n - 1), 0)
    blocks = dealt.withColumns({name: make(inside) for name, make in columns.items()}).where("__own")
    return out.unionByName(blocks.drop("__i", "__block", "__own"))

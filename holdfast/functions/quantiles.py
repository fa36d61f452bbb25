"""Exact quantiles of groups of any size, linear between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.ranges import KEY_ROWS, PART, PLACE, ranged, split_large
from holdfast.functions.tables import broadcast_if_small, written


def between(position: Column, low: Column, high: Column) -> Column:
    """The value at a position from 0 that lies between two neighbouring ranks."""
    lower = F.floor(position)
    return F.when((lower == position) | (low == high), low).otherwise((lower + 1 - position) * low + (position - lower) * high)


def _of_arrays(values: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    held = values.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("sorted"))
    both = positions.join(held, keys).withColumn("at", F.col("p") * (F.size("sorted") - 1))
    at = lambda i: F.get("sorted", i.cast("int"))
    return both.select(*keys, "p", between(F.col("at"), at(F.floor("at")), at(F.ceil("at"))).alias("quantile"))


def _by_ranges(values: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    """Selection without sorting a group in one place: ranges of (keys, value) are counted, only the ranges that hold one
    of the two ranks of a quantile are ranked, and their two values are interpolated."""
    placed = ranged(values.select(*keys, "value"), keys, ["value"])
    sizes = written(placed.groupBy(*keys, PART).agg(F.count("*").alias("n")))  # rows: keys and ranges together at most
    by = Window.partitionBy(*keys)
    starts = sizes.select(*keys, PART, "n", F.coalesce(F.sum("n").over(by.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by).alias("all"))
    wanted = starts.join(positions, keys).withColumn("at", F.col("p") * (F.col("all") - 1))
    wanted = wanted.select(*keys, PART, "p", "at", "n", "before", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    wanted = written(wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*keys, PART, "p", "at", "rank", (F.col("rank") - F.col("before") + 1).alias("__turn")))
    some = placed.join(broadcast_if_small(wanted.select(*keys, PART).distinct()), [*keys, PART], "left_semi")
    turn = F.row_number().over(Window.partitionBy(*keys, PART).orderBy(PLACE))
    found = some.withColumn("__turn", turn).join(wanted, [*keys, PART, "__turn"])
    pair = found.groupBy(*keys, "p", "at").agg(F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"))
    return pair.select(*keys, "p", between(F.col("at"), F.col("low"), F.col("high")).alias("quantile"))


def group_quantiles(values: DataFrame, keys: list[str], positions: DataFrame, group_rows: int = KEY_ROWS) -> DataFrame:
    """(keys, p, quantile) for each row of ``positions`` (keys, p from 0 to 1; each pair once) whose group has values.

    ``values``: keys, none of them null, and value; nulls are passed over, NaN is larger than any number. Groups of up to
    ``group_rows`` values are sorted as arrays, a group each; larger ones are spread over ranges and never gathered.
    Both ways give the same values. ``values`` is read twice or more; write it before if it is costly.
    """
    held = values.select(*keys, F.col("value").cast("double").alias("value")).where("value is not null")
    small, large = split_large(held, keys, group_rows)
    out = _of_arrays(small, keys, positions)
    return out if large is None else out.unionByName(_by_ranges(large, keys, positions))


def at_each(groups: DataFrame, ps: tuple[float, ...]) -> DataFrame:
    """Positions ``ps`` of every row of ``groups``."""
    return groups.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))

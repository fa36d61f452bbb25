"""Assertions, scopes and the evaluation of patterns.

A table of patterns has pattern_id, spec_ref and an assertion: kind (in_range, quantile_ge or sign) with lo, hi,
p, threshold and expected_sign. An assertion over no value, or over any that is not a finite number, is false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.quantiles import at_each, group_quantiles
from holdfast.functions.ranges import KEY_ROWS

ARGS = ["kind", "lo", "hi", "p", "threshold", "expected_sign"]
SIGNS = {"negative": -1, "zero": 0, "positive": 1}


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def usable(value: Column) -> Column:
    """Over a group: there are values and all are finite."""
    return F.coalesce(F.bool_and(finite(value)), F.lit(False))


def in_range(value: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(F.bool_and(value.between(lo, hi)), F.lit(False))


def sign(value: Column, expected: Column) -> Column:
    return F.coalesce(F.bool_and(F.signum(value) == expected), F.lit(False))


def quantile_ge(value: Column, p: float, threshold: Column) -> Column:
    """The quantile at ``p``, linear between neighbours, reaches the threshold; of groups whose different values fit into a
    task (``quantiles_reach`` takes any)."""
    return F.coalesce(F.percentile(value, F.lit(p)) >= threshold, F.lit(False))


def quantiles_reach(values: DataFrame, keys: list[str], p: float, threshold: float, group_rows: int = KEY_ROWS) -> DataFrame:
    """(keys, holds): whether each group's exact quantile at ``p`` reaches the threshold; false where a value is not finite.
    Groups of any size, none of them gathered (``group_quantiles``)."""
    groups = values.groupBy(*keys).agg(usable(F.col("value")).alias("usable"))
    found = group_quantiles(values.select(*keys, "value"), keys, at_each(groups.select(*keys), (p,)), group_rows)
    return groups.join(found, keys, "left").select(*keys, (F.col("usable") & F.coalesce(F.col("quantile") >= threshold, F.lit(False))).alias("holds"))


#: kind -> builder of an aggregate from the value and the distinct p in use. Arguments are columns that are
#: constant in a group.
ASSERTIONS: dict[str, Callable[[Column, list[float]], Column]] = {
    "in_range": lambda v, ps: in_range(v, F.col("lo"), F.col("hi")),
    "sign": lambda v, ps: sign(v, F.col("expected_sign")),
    "quantile_ge": lambda v, ps: F.coalesce(*[F.when(F.first("p") == p, quantile_ge(v, p, F.first("threshold"))) for p in ps], F.lit(False)),
}


def distinct_p(patterns: DataFrame) -> list[float]:
    """The quantile positions that a table of patterns uses: few, and needed as literals."""
    return sorted(r[0] for r in patterns.where("kind = 'quantile_ge' and p between 0 and 1").select("p").distinct().collect())


def verdict(value: Column, ps: list[float]) -> Column:
    """Aggregate over a group with the columns of one assertion."""
    chosen = None
    for kind, build in ASSERTIONS.items():
        is_kind = F.first("kind") == kind
        chosen = F.when(is_kind, build(value, ps)) if chosen is None else chosen.when(is_kind, build(value, ps))
    return usable(value) & F.coalesce(chosen, F.lit(False))


def scope_time_range(series: DataFrame, t0: int, t1: int) -> DataFrame:
    return series.where(F.col("t").between(t0, t1))


def scope_entity_set(series: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows whose entity is in the table ``entities``."""
    return series.join(entities.select("entity").distinct(), "entity", "left_semi")


def scope_partition(series: DataFrame, assignment: DataFrame, partition_id: str) -> DataFrame:
    """Rows at times that the assignment tags with ``partition_id``."""
    return series.join(assignment.where(F.col("partition_id") == partition_id).select("t").distinct(), "t", "left_semi")


SCOPES: dict[str, Callable[..., DataFrame]] = {"all": lambda series: series, "time_range": scope_time_range, "entity_set": scope_entity_set, "partition": scope_partition}


SCOPE_COLUMNS = ("scope_kind", "scope_t0", "scope_t1", "scope_entities", "scope_partition")


def in_scope(columns: list[str]) -> Column:
    """Whether a point counts for a pattern, of the scope columns that a table has: scope_kind all (or null),
    time_range (scope_t0 to scope_t1, null: no bound), entity_set (``entity`` in the array scope_entities) or partition
    (``partition_id`` of the point's time is scope_partition). An unknown kind admits nothing."""
    has, kind = set(columns), F.coalesce("scope_kind", F.lit("all")) if "scope_kind" in columns else F.lit("all")
    no = F.lit(False)
    from_, to = (F.coalesce(c, F.lit(True)) for c in (F.col("t") >= F.col("scope_t0"), F.col("t") <= F.col("scope_t1"))) if {"scope_t0", "scope_t1"} <= has else (no, no)
    member = F.coalesce(F.array_contains("scope_entities", F.col("entity")), no) if {"scope_entities", "entity"} <= has else no
    tagged = F.coalesce(F.col("partition_id") == F.col("scope_partition"), no) if {"scope_partition", "partition_id"} <= has else no
    return F.when(kind == "all", True).when(kind == "time_range", from_ & to).when(kind == "entity_set", member).when(kind == "partition", tagged).otherwise(no)


def tagged_points(points: DataFrame, assignment: DataFrame | None) -> DataFrame:
    """``points`` with the partition_id of their times, if there is an assignment (a row per time)."""
    return points if assignment is None else points.join(assignment.select("t", "partition_id"), "t", "left")


def point_verdict(value: Column, patterns_value: Callable[[str], Column]) -> Column:
    """The assertion on one value."""
    at = patterns_value
    held = F.when(at("kind") == "in_range", value.between(at("lo"), at("hi"))).when(at("kind") == "sign", F.signum(value) == at("expected_sign")).when(at("kind") == "quantile_ge", value >= at("threshold"))
    return finite(value) & F.coalesce(held, F.lit(False))


def evaluate(patterns: DataFrame, series: DataFrame, assignment: DataFrame | None = None) -> DataFrame:
    """(pattern_id, t, holds) for every pattern and point of its spec: false outside the pattern's scope (``in_scope``;
    without scope_kind, bounds are those of a time scope), else the assertion on the value. Patterns are broadcast if
    they are small in bytes."""
    from holdfast.functions.tables import broadcast_if_small

    scope = [c for c in SCOPE_COLUMNS if c in patterns.columns]
    narrow = patterns.select("pattern_id", "spec_ref", *ARGS, *scope)
    if scope and "scope_kind" not in scope:
        narrow = narrow.withColumn("scope_kind", F.lit("time_range"))
    both = tagged_points(series, assignment).join(broadcast_if_small(narrow), "spec_ref")
    inside = in_scope(both.columns)
    return both.select("pattern_id", "t", (inside & point_verdict(F.col("value"), F.col)).alias("holds"))

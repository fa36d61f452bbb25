"""Mixing sources to target weights by exact token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.arrow import free_name
from holdfast.llm.store import broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Rows of one source that are sorted together; a source has as many key ranges as it needs.
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    """Words of ``text``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size; a row per source) with target.

    Targets share the sum of sizes by weight. A target above ``most`` times its source's size stops there
    and the excess goes to the others by weight, until none is above: the stopped sources are those with
    the smallest ``most * size / weight``, so one running sum in that order finds the level of the others.
    The definition ranks all sources, so one task orders them: a row per source, whatever the documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", rest / shares)
    levels = levels.withColumn("level", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    return levels.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def _keys(doc_id: Column, text: Column, seed: int) -> list[Column]:
    """Two hash-random keys of a row, of its doc_id and text together, so that rows which share one of them part."""
    return [F.xxhash64(doc_id, text, F.lit(seed)).alias("k1"), F.xxhash64(text, F.lit(seed + 1), doc_id).alias("k2")]


def _plan(rows: DataFrame, weights: tuple[float, ...], most: int, range_rows: int) -> DataFrame:
    """A row per source of ``rows`` (source, size, k1, k2): source_size, target, the whole ``passes`` over it, and
    where its last pass ends: rows of keys below (cut1, cut2) are taken whole, rows of these keys give ``inside``
    words each."""
    units = rows.groupBy("source", "k1", "k2").agg(F.first("size").alias("size"), F.count("*").alias("copies"))
    units = materialize(units)
    sums = materialize(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.ceil(F.sum("copies") / range_rows).alias("ranges")))
    plan = targets(sums, weights, most).join(sums.select(F.col("source").alias("same"), "ranges"), F.col("source").eqNullSafe(F.col("same"))).drop("same")
    budget = F.floor(F.col("target") + 1e-6)
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("floor(target + 1e-6) div source_size")).otherwise(0))
    plan = materialize(plan.withColumn("last", budget - F.col("passes") * F.col("source_size")).select(F.col("source").alias("of"), "source_size", "target", "ranges", "passes", "last"))
    narrow = broadcast_if_small(plan.select("of", "ranges", "last"))

    share = F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.lit(-(1 << 63))), 11) * F.lit(2.0**-53)  # in the order of k1 as a signed number
    placed = units.join(narrow, F.col("source").eqNullSafe(F.col("of"))).where("size > 0").withColumn("range", F.floor(share * F.col("ranges")))
    words = F.col("size") * F.col("copies")
    ahead = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("of", "range", "last").agg(F.sum(words).alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    ends = ranges.where("ahead <= last and last < ahead + words").select(F.col("of").alias("at"), F.col("range").alias("in"), "ahead")  # a row per source
    inside = Window.partitionBy("of").orderBy("k1", "k2")
    one = placed.join(broadcast_if_small(materialize(ends)), F.col("of").eqNullSafe(F.col("at")) & (F.col("range") == F.col("in")))
    one = one.withColumn("before", F.col("ahead") + F.coalesce(F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cuts = one.where(F.col("before").between(F.col("last") - words + 1, F.col("last")))
    cuts = cuts.select(F.col("of").alias("cut"), F.col("k1").alias("cut1"), F.col("k2").alias("cut2"), F.expr("(last - before) div copies").alias("inside"))
    return plan.join(cuts, F.col("of").eqNullSafe(F.col("cut")), "left").select("of", "source_size", "target", "passes", "cut1", "cut2", "inside")


#: Words of a row's last pass: all, some or none.
_LAST = """case when size = 0 or cut1 is null then 0 when k1 < cut1 or (k1 = cut1 and k2 < cut2) then size when k1 = cut1 and k2 = cut2 then inside else 0 end"""


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``.

    Each source's documents stand in the order of hash-random keys. Whole passes over the source repeat
    while the budget (the target, rounded down) lasts; the last pass ends inside the document where the
    budget is used up. Each source is cut into ranges of keys of about ``range_rows`` rows; prefix sums of the
    ranges find the one where the budget ends, and only this is sorted, so no task sees a whole source.
    Keys are of doc_id and text together; rows alike in both are one unit and take equal shares, so reruns
    agree whatever the order of rows. Null texts have size 0; a source without words takes none; an empty
    table gives no rows; other columns are unread.
    """
    columns = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *_keys(F.col(doc_id), F.col(text), seed)]
    rows = materialize(docs.select(*columns))
    plan = broadcast_if_small(materialize(_plan(rows, weights, most, range_rows)))
    both = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.expr(_LAST)).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of ``docs`` as ``mix`` takes them: one for each whole pass, then one with the first words
    of the text where the budget ends inside it. Documents of which nothing is taken go; a text without
    words costs nothing and stays once. Rows are read where they lie: only the plan of the sources is joined."""
    unit = [F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *_keys(F.col(doc_id), F.col(text), seed)]
    plan = broadcast_if_small(materialize(_plan(materialize(docs.select(*unit)), weights, most, range_rows)))
    row = free_name("row", ["source", "k1", "k2", "copy", *plan.columns])
    bare = F.coalesce(~F.col(text).rlike(WORD), F.lit(True))
    placed = docs.select(F.struct("*").alias(row), F.col(source).alias("source"), F.when(bare, 0).otherwise(1).alias("size"), *_keys(F.col(doc_id), F.col(text), seed))
    both = placed.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("last", F.expr(_LAST.replace("then inside", "then -inside")))
    full = F.when(F.col("size") > 0, F.col("passes") + F.greatest("last", F.lit(0))).otherwise(1)
    part = F.greatest(-F.col("last"), F.lit(0))
    many = both.withColumns({"full": full, "part": part}).where("full > 0 or part > 0").withColumn("copy", F.explode(F.expr("sequence(1L, full + least(part, 1))")))
    own = lambda c: F.col(f"{row}.`{c}`")
    cut = F.when(F.col("copy") > F.col("full"), first_words(own(text), F.col("part"))).otherwise(own(text))
    return many.select(*((cut if c == text else own(c)).alias(c) for c in docs.columns))

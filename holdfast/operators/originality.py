"""Subtractive originality filter: pattern fingerprints against a bounded list of known reductions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.canonical import canonical_digest
from holdfast.functions.tables import broadcast_if_small, written

MOST_ENTRIES = 32


def fingerprints(patterns: DataFrame, body: Column, observation_hash: Column | None = None) -> DataFrame:
    """``patterns`` with the canonical digest of a JSON body, an object; with ``observation_hash``, a digest or null, as its
    field observation_fingerprint_hash. Another text there is an error."""
    if observation_hash is not None:
        good = F.when(observation_hash.isNull(), "null").when(observation_hash.rlike("^[0-9a-f]{64}$"), F.concat(F.lit('"'), observation_hash, F.lit('"')))
        proved = F.coalesce(good, F.raise_error(F.lit("an observation hash is no digest")))
        body = F.concat(F.regexp_replace(body, r"\}\s*$", ""), F.lit(',"observation_fingerprint_hash":'), proved, F.lit("}"))
    return patterns.withColumn("fingerprint_hash", canonical_digest(body))


def projection(paths: list[str], fields: dict[str, Column]) -> Column:
    """Digest of the named dotted paths of a fingerprint, in order; an unknown path is an error."""
    chosen = sorted(set(paths))
    if unknown := [p for p in chosen if p not in fields]:
        raise ValueError(f"unknown paths {unknown}")
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(p + "="), F.coalesce(fields[p], F.lit("null"))) for p in chosen]), 256)


def _paths(entry_paths: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(entry_paths)), ",")


@dataclass(frozen=True)
class Matcher:
    """A kind of matcher. ``config``: what a pattern must be asked, of an entry's columns; ``probe``: the answer of a
    pattern to one config, from its fields; ``keys``: the answers that an entry matches, of its columns, an array. A
    pattern matches an entry if its answer to the entry's config is among the entry's keys."""

    config: Callable[[], Column]
    probe: Callable[[str, dict[str, Column]], Column]
    keys: Callable[[], Column]


def _field(path: str, fields: dict[str, Column]) -> Column:
    if path not in fields:
        raise ValueError(f"unknown paths {[path]}")
    return fields[path]


#: kind -> matcher: the projection on a set of paths has a digest; a field has one of some values. More can be added.
MATCHERS: dict[str, Matcher] = {
    "reduction": Matcher(lambda: _paths(F.col("paths")), lambda config, fields: projection(config.split(","), fields), lambda: F.array("projection_hash")),
    "field_in": Matcher(lambda: F.element_at("paths", 1), _field, lambda: F.col("field_values")),
}


def matches(patterns: DataFrame, entries: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(pattern_id, position, anti_pattern_id) for every entry that a pattern matches.

    ``entries``: position, anti_pattern_id, matcher (a kind of ``MATCHERS``; without that column all are reductions) and
    the columns its kind reads: paths array, projection_hash, field_values array. They are at most MOST_ENTRIES, so at
    most that many different questions: one pass over ``patterns`` answers them all, and one join with the entries'
    keys, a small table, finds the matches. An unknown kind or path is an error.
    """
    if "matcher" not in entries.columns:
        entries = entries.withColumn("matcher", F.lit("reduction"))
    entries = written(entries)
    kinds = [r[0] for r in entries.groupBy("matcher").agg(F.count("*")).collect()]
    if entries.count() > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries")
    if unknown := sorted(set(kinds) - MATCHERS.keys(), key=str):
        raise ValueError(f"unknown matchers {unknown}")
    keyed = None
    for kind in sorted(kinds):
        m = MATCHERS[kind]
        mine = entries.where(F.col("matcher") == kind).select("position", "anti_pattern_id", F.lit(kind).alias("matcher"), m.config().alias("config"), F.explode(m.keys()).alias("key"))
        keyed = mine if keyed is None else keyed.union(mine)
    if keyed is None:
        return patterns.sparkSession.createDataFrame([], T.StructType([patterns.schema["pattern_id"], *entries.select("position", "anti_pattern_id").schema]))
    keyed = written(keyed.distinct())
    asked = keyed.select("matcher", "config").distinct().orderBy("matcher", "config").collect()
    answers = F.array(*[F.struct(F.lit(r["matcher"]).alias("matcher"), F.lit(r["config"]).alias("config"), MATCHERS[r["matcher"]].probe(r["config"], fields).alias("key")) for r in asked])
    probes = patterns.select("pattern_id", F.explode(answers).alias("a")).select("pattern_id", "a.*")
    return probes.join(broadcast_if_small(keyed), ["matcher", "config", "key"]).select("pattern_id", "position", "anti_pattern_id")


def decisions(patterns: DataFrame, found: DataFrame) -> DataFrame:
    """(pattern_id, decision, anti_pattern_id): the first entry in list order rejects, else pass."""
    first = found.groupBy("pattern_id").agg(F.min_by("anti_pattern_id", "position").alias("anti_pattern_id"))
    both = patterns.select("pattern_id").join(first, "pattern_id", "left")
    return both.select("pattern_id", F.when(F.col("anti_pattern_id").isNull(), "pass").otherwise("reject").alias("decision"), "anti_pattern_id")


def append_entries(entries: DataFrame, new: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """``new`` entries (positions differ) with outcome: duplicate (an id that is there or came before), full, or added.
    The place from which the list is full is found by a limit, so no task orders all entries."""
    held = entries.select("anti_pattern_id").distinct().withColumn("there", F.lit(True))
    firsts = new.groupBy("anti_pattern_id").agg(F.min("position").alias("first"))
    fresh = written(firsts.join(held, "anti_pattern_id", "left").where("there is null").select("anti_pattern_id", F.col("first").alias("position"), F.lit(True).alias("fresh")))
    room = max(0, most - entries.count())
    last = fresh.orderBy("position").limit(room).agg(F.max("position")).first()[0] if room else None  # a few rows of each task
    fits = F.col("position") <= last if last is not None else F.lit(False)
    both = new.join(fresh, ["anti_pattern_id", "position"], "left")
    outcome = F.when(F.col("fresh").isNull(), "duplicate").when(fits, "added").otherwise("full")
    return both.select(*new.columns, outcome.alias("outcome"))


def remove_entries(entries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``entries`` left without those of ``ids`` (anti_pattern_id), in their order, and (anti_pattern_id, outcome) of each
    different id: removed or unknown."""
    asked = ids.select("anti_pattern_id").distinct()
    held = entries.select("anti_pattern_id").distinct().withColumn("held", F.lit(True))
    outcome = asked.join(held, "anti_pattern_id", "left").select("anti_pattern_id", F.when(F.col("held"), "removed").otherwise("unknown").alias("outcome"))
    return entries.join(asked, "anti_pattern_id", "left_anti").select(*entries.columns), outcome


def clear_entries(entries: DataFrame) -> DataFrame:
    """No entries, of the same columns."""
    return entries.where(F.lit(False))


def list_version(entries: DataFrame) -> DataFrame:
    """One row: digest of the ordered list, of at most MOST_ENTRIES entries."""
    rows = F.sort_array(F.collect_list(F.struct("position", "anti_pattern_id", "projection_hash")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["position"].cast("string"), r["anti_pattern_id"], r["projection_hash"])), ",")
    return entries.agg(F.sha2(text, 256).alias("version"))

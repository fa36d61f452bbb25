"""Chat formatting: calls of tools linked with their results, ordered, validated and serialised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.ranges import keyed_ranks
from holdfast.llm.arrow import mapped, sorted_groups
from holdfast.llm.store import broadcast_if_small, materialize

#: JSON types of schemas and the VARIANT types that satisfy them.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def canonical_json(pairs: list[tuple[str, Column]]) -> Column:
    """JSON object of the named columns, keys in order of code points; nulls are written as null."""
    parts = []
    for name, value in sorted(pairs, key=lambda x: x[0]):
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def quoted(text: Column) -> Column:
    """JSON string of ``text``."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


#: Calls of one conversation that one task orders; larger conversations are ordered by ranges of positions.
LARGEST = 1 << 17


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, call_id and level of the calls of whole groups, sorted by ``part``. Calls are taken in layers: those that
    wait for nothing, then those that waited for these alone, and so on; all groups of a table at once. ``base``: the
    least level that a call has by those it no longer waits for; ``blocked``: whether it waits for one of another group."""
    for table, _ in sorted_groups(batches, 1):
        n = table.num_rows
        names, deps = table.column("name").combine_chunks(), table.column("deps").combine_chunks()
        codes = pa.concat_arrays([names, deps.flatten()]).dictionary_encode().indices.to_numpy()
        node = np.full(int(codes.max()) + 1, -1)
        node[codes[:n]] = np.arange(n)
        waits, dep = np.repeat(np.arange(n), np.diff(np.asarray(deps.offsets))), node[codes[n:]]
        waits, dep = waits[dep >= 0], dep[dep >= 0]
        order = np.argsort(dep, kind="stable")
        waits, at = waits[order], np.searchsorted(dep[order], np.arange(n + 1))
        open_ = np.bincount(waits, minlength=n) + table.column("blocked").to_numpy().astype(np.int64)
        level, done = table.column("base").to_numpy().astype(np.int64), np.zeros(n, bool)
        free = np.flatnonzero(open_ == 0)
        while len(free):
            done[free] = True
            many = at[free + 1] - at[free]
            hit = waits[np.repeat(at[free] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            np.maximum.at(level, hit, np.repeat(level[free] + 1, many))
            np.subtract.at(open_, hit, 1)
            free = np.unique(hit[open_[hit] == 0])
        yield pa.RecordBatch.from_arrays([table.column("conv_id").combine_chunks(), table.column("call_id").combine_chunks(), pa.array(level.astype(np.int32), mask=~done)], ["conv_id", "call_id", "level"])


def _name(call: Column) -> Column:
    return F.to_json(F.array(F.col("conv_id").cast("string"), call))


def _in_tasks(rows: DataFrame, part: list[str]) -> DataFrame:
    """(conv_id, call_id, level) of ``rows`` (conv_id, call_id, deps, base, blocked), the groups of ``part`` ordered each by
    itself; null where a call waits for one that is not."""
    named = rows.select(F.xxhash64(*part).alias("part"), "conv_id", "call_id", _name(F.col("call_id")).alias("name"), F.transform("deps", _name).alias("deps"), "base", "blocked")
    schema = T.StructType([*rows.select("conv_id", "call_id").schema.fields, T.StructField("level", T.IntegerType())])
    return mapped(named.repartition("part").sortWithinPartitions("part"), _levels, schema)


def _by_ranges(calls: DataFrame, largest: int) -> DataFrame:
    """conv_id, call_id and level of conversations of any size, in ranges of ``largest`` calls by position.

    Each round orders every range in a task as far as what it waits for is known, and hands the new levels to the calls
    of other ranges that wait for them. So rounds are the borders that a chain of calls crosses, not its levels: a
    chain in order of positions, either way, takes a round a range. What is left when a round adds nothing stands in or
    behind circles. Only written tables pass between rounds.
    """
    keys = ["conv_id", "call_id"]
    order = [c for c in ("position", "call_id") if c in calls.columns]
    ranked = keyed_ranks(calls.select("conv_id", *order), ["conv_id"], order, "i")
    waiting = materialize(ranked.select(*keys, F.floor(F.col("i") / largest).alias("range"), F.lit(0).alias("base")))
    deps = calls.select(*keys, F.explode("after").alias("dep")).where("dep is not null").distinct()
    ranges = waiting.select("conv_id", F.col("call_id").alias("dep"), F.col("range").alias("of"))
    edges = materialize(deps.join(ranges, ["conv_id", "dep"]))  # of calls that wait, to calls that do
    parts = []
    while True:
        own = waiting.join(edges, keys, "left").groupBy(*keys, "range", "base").agg(F.collect_list(F.when(F.col("of") == F.col("range"), F.col("dep"))).alias("deps"), F.coalesce(F.bool_or(F.col("of") != F.col("range")), F.lit(False)).alias("blocked"))
        new = materialize(_in_tasks(own, ["conv_id", "range"]).where("level is not null"))
        if new.isEmpty():
            break
        parts.append(new)
        known = new.select("conv_id", F.col("call_id").alias("dep"), (F.col("level") + 1).alias("more"))
        told = edges.join(known, ["conv_id", "dep"]).groupBy(*keys).agg(F.max("more").alias("more"))
        rest = waiting.join(new, keys, "left_anti").join(told, keys, "left")
        waiting = materialize(rest.select(*keys, "range", F.greatest("base", F.coalesce("more", F.lit(0))).alias("base")))
        edges = materialize(edges.join(known, ["conv_id", "dep"], "left_anti").join(waiting, keys, "left_semi"))
    out = waiting.select(*keys, F.lit(None).cast("int").alias("level"))
    for part in parts:
        out = out.union(part)
    return out


def ordered(calls: DataFrame, largest: int = LARGEST) -> DataFrame:
    """``calls`` (a row per conv_id and call_id) with ``level``: 0 without a known dependency, else one more than the
    latest of those; null in and behind circles. Conversations of up to ``largest`` calls are ordered whole in tasks
    that take many each, larger ones by ranges of positions (``_by_ranges``)."""
    keys = ["conv_id", "call_id"]
    big = materialize(calls.groupBy("conv_id").count().where(F.col("count") > largest).select("conv_id"))
    small, levels = calls, None
    if not big.isEmpty():
        levels = _by_ranges(materialize(calls.join(big, "conv_id", "left_semi").select(*[c for c in ("conv_id", "call_id", "position", "after") if c in calls.columns])), largest)
        small = calls.join(big, "conv_id", "left_anti")
    rows = small.select(*keys, F.array_distinct(F.array_compact("after")).alias("deps"), F.lit(0).alias("base"), F.lit(False).alias("blocked"))
    found = _in_tasks(rows, ["conv_id"])
    levels = found if levels is None else found.union(levels)
    return calls.join(levels, keys, "left").select(*calls.columns, "level")


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, problems): what the arguments of calls lack against ``schemas`` (tool, field, type,
    required), sorted; unknown tools and arguments that are no JSON object are problems of their own."""
    fields = broadcast_if_small(schemas.groupBy("tool").agg(F.collect_set(F.struct("field", "type", "required")).alias("fields")))
    parsed = calls.select("conv_id", "call_id", "tool", F.expr("try_parse_json(arguments)").alias("v")).join(fields, "tool", "left")
    is_object = F.coalesce(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.lit(False))
    held = parsed.withColumn("args", F.when(is_object, F.expr("cast(v as map<string, variant>)")))
    fits = " or ".join(f"(f.type = '{t}' and ({' or '.join(f'''k like '{x}%' ''' for x in types)}))" for t, types in _TYPES.items())
    each = F.expr(f"transform(fields, f -> transform(array(schema_of_variant(args[f.field])), k -> case when k is null or k = 'VOID' then case when f.required then concat('missing ', f.field) end when not ({fits}) then concat('type of ', f.field) end)[0])")
    found = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))).when(F.col("args").isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.array_compact(each)))
    return held.select("conv_id", "call_id", found.alias("problems"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result without call: conv_id, call_id, position, level, status, valid, problems,
    message.

    ``calls``: conv_id, call_id, position, tool, arguments (JSON), after (array of call_ids that it waits for).
    ``results``: conv_id, call_id, position, content. Both are joined by hash of (conv_id, call_id), the first
    row of each by position; status is linked, no result or no call. A null identifier links with nothing. The
    message is canonical JSON: keys sorted, no spaces, missing values null. Empty tables give no rows.
    """
    def first(df, *columns):  # combined before the shuffle, so that an identifier may be repeated without end
        one = df.groupBy("conv_id", "call_id").agg(F.min(F.struct(*columns)).alias("first"))
        return one.select("conv_id", "call_id", "first.*")

    named = calls.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", F.col("position").cast("long").alias("position"), "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    one = materialize(first(named, "position", "tool", "arguments", "after"))
    answers = first(results.select("conv_id", "call_id", F.col("position").cast("long").alias("position"), "content").where("conv_id is not null and call_id is not null"), "position", "content").select("conv_id", "call_id", F.col("position").alias("answered"), "content")
    placed = ordered(one).join(problems(one, schemas), ["conv_id", "call_id"])
    both = placed.join(answers, ["conv_id", "call_id"], "full")
    status = F.when(F.col("tool").isNull() & F.col("position").isNull(), "no call").when(F.col("answered").isNull(), "no result").otherwise("linked")
    arguments = F.expr("to_json(try_parse_json(arguments))")
    message = canonical_json([("arguments", F.coalesce(arguments, quoted(F.col("arguments")))), ("call_id", quoted(F.col("call_id"))), ("content", quoted(F.col("content"))), ("level", F.col("level").cast("string")), ("tool", quoted(F.col("tool")))])
    return both.select("conv_id", "call_id", F.coalesce("position", "answered").alias("position"), F.col("level").cast("long").alias("level"), status.alias("status"), (F.coalesce(F.size("problems"), F.lit(1)) == 0).alias("valid"), F.array_join("problems", "; ").alias("problems"), message.alias("message"))


SCHEMAS = [
    ("search", "query", "string", True), ("search", "limit", "integer", True),
    ("count", "text", "string", True), ("count", "words", "integer", True),
    ("rate", "text", "string", True), ("rate", "score", "number", True), ("rate", "strict", "boolean", False),
]


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that stand in plain conversations (conv_id, turn, role, text).

    Every user turn is a call of a tool that its number of words chooses (one in 17 of a tool without schema), with
    arguments made of the text; some lack a field or have one of another type. Of a conversation's calls, numbered
    from 0, every fourth waits for the next one, the one after it for the second before, the others for the one
    before and either the second before or the first. Every third call is repeated, a turn later and without
    arguments. An assistant turn is the result of the user turn before it, every thirteenth turn of a call that
    nobody made. Identifiers are made of turns; repeated rows count once, and rows without conversation or turn
    take no part.
    """
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    user = rows.where("role = 'user'").withColumns({"i": F.row_number().over(order) - 1, "words": words, "size": F.coalesce(F.length("text"), F.lit(0))})
    near = {k: F.lag("turn", k).over(order) for k in (1, 2)} | {-1: F.lead("turn").over(order), 0: F.first("turn").over(order)}
    text, short = quoted(F.col("text")), F.col("size") % 5 == 0
    search = canonical_json([("query", text), ("limit", F.when(short, F.lit('"many"')).otherwise(F.col("words").cast("string")))])
    count = F.when(short, canonical_json([("text", text)])).otherwise(canonical_json([("text", text), ("words", F.col("words").cast("string"))]))
    rate = canonical_json([("text", text), ("score", F.concat(F.col("size").cast("string"), F.lit(".5"))), ("strict", F.when(short, F.lit("true")).otherwise("false"))])
    kind = F.col("words") % 3
    tool = F.when(F.col("words") % 17 == 16, "browse").when(kind == 0, "search").when(kind == 1, "count").otherwise("rate")
    arguments = F.when(kind == 0, search).when(kind == 1, count).otherwise(rate)
    own = F.col("i") % 4
    waits = F.when(own == 0, F.array(near[-1])).when(own == 1, F.array(near[2])).when(own == 2, F.array(near[1], near[2])).otherwise(F.array(near[1], near[0]))
    after = F.transform(F.array_distinct(F.array_compact(waits)), name)
    made = user.select("conv_id", "turn", "i", name(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), tool.alias("tool"), arguments.alias("arguments"), after.alias("after"))
    columns = ["conv_id", "call_id", "position", "tool", "arguments", "after"]
    repeated = made.where("i % 3 = 2").select("conv_id", "call_id", (F.col("position") + 1).alias("position"), F.lit("search").alias("tool"), F.lit("{}").alias("arguments"), F.array().cast("array<string>").alias("after"))
    latest = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    answered = F.when(F.col("turn") % 13 == 12, F.concat(F.lit("lost-"), F.col("turn").cast("string"))).otherwise(name(F.coalesce("latest", F.col("turn") - 1)))
    results = rows.withColumn("latest", latest).where("role = 'assistant'").select("conv_id", answered.alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    schemas = turns.sparkSession.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    return made.select(*columns).union(repeated), results, schemas

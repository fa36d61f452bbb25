"""Feature tables: lineage, declared dependencies, schema checks and costs of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import canonical as can
from holdfast.functions import features as fn
from holdfast.functions.tables import broadcast_if_small
from holdfast.operators import pit

NODE_USD = 1e-6


def raw_get(requests: DataFrame, blobs: DataFrame, provenance: DataFrame, row: Column | None = None) -> DataFrame:
    """Requests with outcome and, where admissible, the text; bytes are joined last and once per hash. ``row``, which tells
    requests apart, deals those without a hash."""
    checked = pit.admissible(requests, provenance, row)
    held = blobs.select("hash", F.col("text").alias("content")).dropDuplicates(["hash"])
    both = pit.looked_up(checked, held, ["hash"], row)
    return both.withColumn("content", F.when(F.col("outcome") == "ok", F.col("content")))


def from_cache(prompts: DataFrame, cache: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses of prompts (model_id, prompt, params_hash) found in the cache, and the work list of the others.
    Bodies are JSON with text and token counts."""
    keys = ["model_id", "prompt_hash", "params_hash"]
    asked = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    found = asked.join(cache.select(*keys, "bytes_hash"), keys).join(bodies.select(F.col("hash").alias("bytes_hash"), "body"), "bytes_hash")
    parsed = F.from_json("body", "text string, input_tokens bigint, output_tokens bigint")
    hits = found.withColumn("r", parsed).select(*keys, "r.text", "r.input_tokens", "r.output_tokens")
    return hits, asked.join(cache.select(*keys), keys, "left_anti").select(*keys).distinct()


def run_graph(runs: DataFrame, graph: dict, sources: dict[str, Column], blobs: DataFrame, provenance: DataFrame, cache: DataFrame, bodies: DataFrame, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """A graph with reads and model calls over ``runs`` (key, query_time, deps, columns of ``sources``), one per run.

    ``raw_get`` brings the content of ``args.hash`` or of its input; ``llm_call`` renders ``prompt_template`` with its
    inputs, named by ``input_names``, and takes the answer of ``model`` with ``params`` from the cache, whose bodies are
    JSON of model, prompt_hash, params_hash and response. Both obey the run's query_time. All other nodes are columns
    between these joins. Only nodes that the output needs are run, each once.

    Results (key, value, error, read_hashes, data_reads): the first failure of a run ends its reads and is its error
    (undeclared, unknown, future_denied, no content, null input, miss, mismatch, no response, no value), and its value is
    null. Calls (key, node, model_id, prompt_hash, params_hash, outcome, input_tokens, output_tokens): misses are the work list.
    """
    names = {n: fn.free_name(f"__{n}", runs.columns) for n in ("error", "reads", "count")}
    state = runs.withColumns({names["error"]: F.lit(None).cast("string"), names["reads"]: F.array().cast("array<string>"), names["count"]: F.lit(0)})
    error, made, calls = F.col(names["error"]), [], []

    def keep(found: DataFrame, name: str, value: Column, problem: Column, read: Column, reads: Column) -> None:
        """The rows with the node's value; failures end a run."""
        nonlocal state
        old = {n: F.col(f"row.{c}") for n, c in names.items()}
        others = [F.col(f"row.`{c}`") for c in state.columns if c not in names.values()]
        now = F.when(old["error"].isNull(), problem)
        hashes = F.when(old["error"].isNull() & read.isNotNull(), F.array_union(old["reads"], F.array(read))).otherwise(old["reads"])
        count = old["count"] + F.when(old["error"].isNull(), reads).otherwise(0)
        state = found.select(*others, F.coalesce(old["error"], now).alias(names["error"]), hashes.alias(names["reads"]), count.alias(names["count"]), F.when(F.coalesce(old["error"], now).isNull(), value).alias(name))

    def read(args: dict, *inputs: Column) -> Column:
        name = fn.free_name(f"__node{len(made)}", runs.columns)
        made.append(name)
        asked = F.when(error.isNull(), inputs[0] if inputs else F.lit(args["hash"]))
        declared = F.coalesce(F.array_contains("deps", asked), F.lit(False))
        packed = state.select(F.struct("*").alias("row"), "query_time", F.when(declared, asked).alias("hash"), declared.alias("declared"))
        found = raw_get(packed, blobs, provenance, F.col(f"row.{key}"))
        ok = F.col("outcome") == "ok"
        problem = F.when(~F.col("declared"), "undeclared").when(~ok, F.col("outcome")).when(F.col("content").isNull(), "no content")
        keep(found, name, F.col("content"), problem, F.when(ok, F.col("hash")), F.col("declared").cast("int"))
        return F.col(name)

    def ask(args: dict, *inputs: Column) -> Column:
        name = fn.free_name(f"__node{len(made)}", runs.columns)
        made.append(name)
        if len(inputs) != len(args["input_names"]):
            raise ValueError("llm_call takes an input for each of its names")
        prompt = F.when(error.isNull(), fn.render(args["prompt_template"], dict(zip(args["input_names"], [i.cast("string") for i in inputs]))))
        params = can.params_hash(F.lit(args["model"]), F.lit(can.canonical(args.get("params", {}))))
        packed = state.select(F.struct("*").alias("row"), "query_time", F.lit(args["model"]).alias("model_id"), can.prompt_hash(prompt).alias("prompt_hash"), params.alias("params_hash"))
        held = bodies.select("hash", "body").dropDuplicates(["hash"])
        found = pit.cache_lookup(packed, cache, provenance, F.col(f"row.{key}"), held)
        found = found.withColumn("r", F.from_json("body", "model string, prompt_hash string, params_hash string, response struct<text: string, input_tokens: bigint, output_tokens: bigint>"))
        same = F.col("r.model").eqNullSafe(F.col("model_id"))
        for c in ("prompt_hash", "params_hash"):
            same = same & F.col(f"r.{c}").eqNullSafe(F.col(c))
        answer = F.col("r.response.text")
        hit = F.col("outcome") == "hit"
        problem = F.when(F.col("prompt_hash").isNull(), "null input").when(~hit, F.col("outcome")).when(F.col("body").isNull(), "no content").when(~same, "mismatch").when(answer.isNull(), "no response")
        asked = found.where(F.col(f"row.{names['error']}").isNull() & F.col("prompt_hash").isNotNull())
        tokens = [F.when(hit & same, F.col(f"r.response.{c}")).alias(c) for c in ("input_tokens", "output_tokens")]
        calls.append(asked.select(F.col(f"row.{key}").alias(key), F.lit(len(calls)).alias("node"), "model_id", "prompt_hash", "params_hash", F.when(hit & ~same, "mismatch").otherwise(F.col("outcome")).alias("outcome"), *tokens))
        reads = F.when(F.col("prompt_hash").isNull(), 0).otherwise(F.when(F.col("hash").isNull(), 1).otherwise(2))
        keep(found, name, answer, problem, F.when(hit, F.col("hash")), reads)
        return F.col(name)

    ops = {**fn.OPS, "raw_get": fn.Op(read, 0, 1), "llm_call": fn.Op(ask, 0, None)}
    value = fn.compile_spec(graph, sources, ops)
    out = state.select(key, value.alias("value"), *(F.col(c).alias(n) for n, c in names.items()))
    failure = F.coalesce("error", F.when(F.col("value").isNull(), "no value"))
    results = out.select(key, F.when(failure.isNull(), F.col("value")).alias("value"), failure.alias("error"), F.sort_array("reads").alias("read_hashes"), F.col("count").alias("data_reads"))
    none = runs.sparkSession.createDataFrame([], f"{key} {runs.schema[key].dataType.simpleString()}, node int, model_id string, prompt_hash string, params_hash string, outcome string, input_tokens long, output_tokens long")
    for c in calls:
        none = none.union(c)
    return results, none


def undeclared(reads: DataFrame, deps: DataFrame) -> DataFrame:
    """Reads (run_id, hash) that are not among the declared deps of their run."""
    return reads.select("run_id", "hash").distinct().join(deps.select("run_id", "hash"), ["run_id", "hash"], "left_anti")


def lineage(reads: DataFrame) -> DataFrame:
    """Different hashes read by each run, in order, one value as long as they are many."""
    return reads.groupBy("run_id").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))


def schema_errors(outputs: DataFrame, rows: int | str | None, columns: int | str | None, dtype: str = "double") -> DataFrame:
    """Outputs whose two-dimensional ``value`` breaks the declared type or shape. A size is a number, a name (sizes of
    one name are equal) or None (free); a row's width is that of all rows."""
    kind = outputs.schema["value"].dataType.simpleString()
    wrong = F.lit("dtype") if kind != f"array<array<{dtype}>>" else F.lit(None).cast("string")
    one = F.lit(None).cast("string")
    if isinstance(rows, str) and rows == columns:
        one = F.when(F.size("value") != F.array_max(F.transform("value", lambda r: F.size(r))), f"size {rows}")
    rows, columns = (None if isinstance(x, str) else x for x in (rows, columns))
    n, widths = F.size("value"), F.transform("value", lambda r: F.size(r))
    ragged = F.array_max(widths) != F.array_min(widths)
    bad = F.array_compact(F.array(wrong, one, F.when(ragged, "ragged"), F.when(n != rows, "rows") if rows is not None else F.lit(None), F.when(F.array_max(widths) != columns, "columns") if columns is not None else F.lit(None)))
    return outputs.withColumn("errors", bad).where(F.size("errors") > 0)


def cost_drift(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls whose realized cost is over declared * (1 + tolerance): prices are per million tokens."""
    both = calls.join(broadcast_if_small(prices), "model")
    realized = (F.col("input_tokens") * F.col("input_usd") + F.col("output_tokens") * F.col("output_usd")) / 1e6
    return both.withColumn("realized_usd", realized).where(F.col("realized_usd") / F.col("declared_usd") > 1 + F.col("tolerance"))


def run_cost(nodes: DataFrame) -> DataFrame:
    """Per run: compute by nodes, model usd, reads and bytes."""
    return nodes.groupBy("run_id").agg((F.count("*") * NODE_USD).alias("compute_usd"), F.sum("llm_usd").alias("llm_usd"), F.sum("reads").alias("data_reads"), F.sum("bytes").alias("storage_bytes"))

"""Tables of discovery cycles: inputs, tool calls, budgets, submissions and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.canonical import canonical_text, streamed_digest
from holdfast.functions.quantiles import between
from holdfast.functions.ranges import KEY_ROWS, running_sums
from holdfast.functions.spans import BLOCK_ROWS, window_orders
from holdfast.functions.tables import broadcast_if_small, written
from holdfast.operators.patterns import finite

DAY = 86400

# Words that decide how an operator's input is classified.
TARGETING = ["what about", "have you checked", "look at", "focus on"]
CONTENT_TERMS = ["momentum", "reversion", "earnings", "revenue", "profit", "volatility", "sentiment", "macro", "inflation", "rates", "yield", "sector", "industry", "size", "value", "growth", "quality", "liquidity", "news", "filing"]
TOOL_WORDS = ["compute", "run", "inspect", "show", "distribution", "window", "different", "same", "stratified", "partition", "that", "this", "again", "sample"]
RED_TEAM_WORDS = ["falsify", "falsification", "simplest", "non-pattern", "explanation", "shuffled", "shuffle", "control", "reproduce", "replicate", "fail", "failure", "alternative"]
# Terms that make a prompt template open-ended.
OPEN_ENDED = ["discover", "find", "suggest", "explore", "hypothesis", "what about"]
# Tools of a cycle and the phases that may call them.
TOOL_PHASES = [("inspect_spec", "cheap"), ("compute", "cheap"), ("propose_spec", "cheap"), ("test_assertion", "cheap"), ("submit_pattern", "frontier")]


def classify(text: Column) -> tuple[Column, Column]:
    """Class and reason of an operator's input; reasons only of flagged ones."""
    plain = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+", " "))
    has = lambda words, pattern: F.arrays_overlap(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), F.array(*map(F.lit, words)))
    targeting = plain.rlike("|".join(rf"\b{t.replace(' ', ' +')}\b" for t in TARGETING))
    reason = F.when(plain == "", "empty input").when(targeting, "targeting phrase").when(has(CONTENT_TERMS, "[a-z]+"), "content term")
    hyphened = "[a-z]+(?:-[a-z]+)?"
    kind = F.when(reason.isNotNull(), "flagged").when(has(RED_TEAM_WORDS, hyphened), "red_team_request").when(has(TOOL_WORDS, hyphened), "tool_request").otherwise("flagged")
    return kind, F.when(kind == "flagged", F.coalesce(reason, F.lit("unrecognized")))


def open_ended(template: Column) -> Column:
    folded = F.lower(template)
    out = F.lit(False)
    for term in OPEN_ENDED:
        out = out | folded.contains(term)
    return out


def specs_without_open_prompts(nodes: DataFrame) -> DataFrame:
    """Different spec_ids of ``nodes`` (spec_id, op, template) none of whose model calls is open-ended."""
    bad = nodes.where((F.col("op") == "llm_call") & open_ended(F.col("template"))).select("spec_id").distinct()
    return nodes.select("spec_id").distinct().join(bad, "spec_id", "left_anti")


def compute_summary(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys``: size, finite values, extremes, mean, the first five values by time and the number
    of source hashes. Not rounded."""
    v = F.when(finite(F.col("value")), F.col("value"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "value"))
    head = F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") <= 5, F.struct("t", "value")))), lambda x: x["value"])
    return values.withColumn("turn", turn).groupBy(*keys).agg(F.count("*").alias("size"), F.count(v).alias("finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), head.alias("sample"), F.count_distinct("source_hash").alias("sources"))


def test_assertions(drafts: DataFrame, series: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cycle_id, step, fingerprint, n) of the drafts whose assertion holds on the values of their window.

    ``drafts``: cycle_id, step, spec_ref, the arguments of an assertion and its JSON (``assertion``), and the window t0
    to t1, closed. A window without values, or with any that is not a finite number, does not pass. Each draft has a
    window of its own, so windows are answered from blocks of the series (``window_orders``) and values are never
    paired with drafts: extremes decide ranges and signs; a quantile reaches its threshold by the number of values
    below it, and by the two values next to it where it lies between the quantile's two ranks. The fingerprint is the
    digest of spec, assertion and window, which a submission must name again.
    """
    named = written(drafts.withColumn("id", F.monotonically_increasing_id()))
    found = window_orders(series, named.select("id", "spec_ref", "t0", "t1", F.col("threshold").alias("bound")), "spec_ref", block_rows)
    at = F.col("p") * (F.col("n") - 1)
    reached = F.when(F.col("less") <= F.floor(at), True).when(F.col("less") > F.ceil(at), False).otherwise(between(at, F.col("below"), F.col("above")) >= F.col("threshold"))
    kind = F.col("kind")
    held = F.when(kind == "in_range", (F.col("low") >= F.col("lo")) & (F.col("high") <= F.col("hi"))).when(kind == "quantile_ge", F.col("p").between(0, 1) & reached)
    held = held.when(kind == "sign", (F.signum("low") == F.col("expected_sign")) & (F.signum("high") == F.col("expected_sign")))
    body = F.concat(F.lit('{"assertion":'), "assertion", F.lit(',"spec_ref":"'), "spec_ref", F.lit('","window":{"t0":'), F.col("t0").cast("string"), F.lit(',"t1":'), F.col("t1").cast("string"), F.lit("}}"))
    passed = named.join(found, "id").where((F.col("unusable") == 0) & held)
    return passed.select("cycle_id", "step", F.sha2(body, 256).alias("fingerprint"), "n")


def submission_gate(submissions: DataFrame, tests: DataFrame) -> DataFrame:
    """Submissions with accepted, and the steps of the successful tests in the same cycle of the same
    fingerprint (spec, assertion and window), one value as long as they are many."""
    good = tests.where("passed").groupBy("cycle_id", "fingerprint").agg(F.sort_array(F.collect_list("step")).alias("sources"))
    both = submissions.join(good, ["cycle_id", "fingerprint"], "left")
    return both.withColumn("accepted", F.col("sources").isNotNull())


def touched_windows(observed: DataFrame, touched: DataFrame) -> DataFrame:
    """Different windows (cycle_id, pattern_id, t0, t1) to reserve: each submission's own and all that its cycle
    touched."""
    keys = ["cycle_id", "pattern_id", "t0", "t1"]
    more = touched.select("cycle_id", "t0", "t1").distinct().join(observed.select("cycle_id", "pattern_id").distinct(), "cycle_id")
    return observed.select(*keys).union(more.select(*keys)).distinct()


def tool_rules(calls: DataFrame) -> DataFrame:
    """``calls`` (tool_name, phase, ...) with rule: unknown tool, not allowed in the phase, or ok."""
    spark = calls.sparkSession
    known = F.broadcast(spark.createDataFrame(TOOL_PHASES, "tool_name string, allowed string"))
    rule = F.when(F.col("allowed").isNull(), "unknown tool").when(F.col("allowed") != F.col("phase"), "not allowed in phase").otherwise("ok")
    return calls.join(known, "tool_name", "left").withColumn("rule", rule).drop("allowed")


def tool_cost(calls: DataFrame, specs: DataFrame, inspect_usd: float, propose_usd: float, submit_usd: float) -> DataFrame:
    """``calls`` with estimated usd: fixed for three tools; for two, the spec's cost and its reads, doubled for a test."""
    both = calls.join(broadcast_if_small(specs.select("spec_id", "spec_usd", "n_deps")), "spec_id", "left")
    run = F.col("spec_usd") + F.col("n_deps") * inspect_usd
    name = F.col("tool_name")
    usd = F.when(name == "inspect_spec", inspect_usd).when(name == "propose_spec", propose_usd).when(name == "submit_pattern", submit_usd).when(name == "compute", run).when(name == "test_assertion", 2 * run)
    return both.withColumn("estimated_usd", usd).drop("spec_usd", "n_deps")


def budget_ledger(steps: DataFrame, cap: float, key_rows: int = KEY_ROWS) -> DataFrame:
    """``steps`` (cycle_id, step, different within a cycle, reserved_usd, realized_usd) with remaining before the step and
    status: ok, killed (the reservation, or the overrun once it is released, exceeds what remains) or not run, after a
    kill.

    Sums of what was spent are those without kills; they are used up to the first kill only, where they agree. A cycle
    of more than ``key_rows`` steps is dealt by ranges (``running_sums``); its first kill is a minimum.
    """
    out = running_sums(steps, ["cycle_id"], ["step"], {"__spent": "realized_usd"}, key_rows)
    out = out.withColumn("remaining_usd", F.lit(cap) - (F.col("__spent") - F.coalesce("realized_usd", F.lit(0.0)))).drop("__spent")
    over = F.greatest(F.lit(0.0), F.col("realized_usd") - F.col("reserved_usd"))
    kill = (F.col("reserved_usd") > F.col("remaining_usd")) | (over > F.col("remaining_usd"))
    first = out.where(kill).groupBy("cycle_id").agg(F.min("step").alias("__killed"))
    status = F.when(F.col("step") > F.col("__killed"), "not run").when(F.col("step") == F.col("__killed"), "killed").otherwise("ok")
    return out.join(first, "cycle_id", "left").withColumn("status", status).drop("__killed")


_ACTION = "struct<tool:string,name:string,args:string>"


def parse_decisions(outputs: DataFrame) -> DataFrame:
    """One row per action of each model output (text): position, tool, args, final and error; NO_PATTERN and
    outputs without actions give one row without tool."""
    body = F.trim("text")
    parsed = F.from_json(body, f"actions array<{_ACTION}>, tool_calls array<{_ACTION}>, tool string, name string, args string, final string, status string", {"mode": "PERMISSIVE"})
    good = F.try_parse_json(body).isNotNull() & body.startswith("{")
    one = outputs.withColumn("p", F.when(good, parsed))
    single = F.coalesce("p.tool", "p.name")
    actions = F.when(single.isNotNull(), F.array(F.struct(single.alias("tool"), F.lit(None).cast("string").alias("name"), F.col("p.args").alias("args")))).otherwise(F.coalesce("p.actions", "p.tool_calls"))
    none = body == "NO_PATTERN"
    rows = one.withColumn("error", F.when(~none & ~good, "not JSON")).withColumn("final", F.when(none, "NO_PATTERN").otherwise(F.coalesce("p.final", "p.status")))
    return rows.select(*outputs.columns, "final", "error", F.posexplode_outer(actions).alias("position", "a")).select(*outputs.columns, "final", "error", "position", F.coalesce("a.tool", "a.name").alias("tool"), F.col("a.args").alias("args"))


def realized_cost(realized: Column, cost: Column, reserved: Column) -> Column:
    """The first of realized and cost that is not negative, else what was reserved."""
    return F.coalesce(F.when(realized >= 0, realized), F.when(cost >= 0, cost), reserved)


def trace_hash(calls: DataFrame) -> DataFrame:
    """(cycle_id, trace_hash): digest of the canonical JSON list of each cycle's calls in order of steps, without record
    hashes; a missing field is null. Calls are hashed as they pass, so a long cycle is not gathered."""
    names = ["step_index", "phase", "tool_name", "args_hash", "result_hash", "outcome"]
    text = canonical_text(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    parts = calls.select("cycle_id", *names, F.lit(0).alias("place"), text.alias("text"))
    return streamed_digest(parts, ["cycle_id"], names, "[", "]").withColumnRenamed("digest", "trace_hash")


def cycle_outcome(ledger: DataFrame, decisions: DataFrame, cap: float, most_patterns: int, tests: DataFrame | None = None, finals: DataFrame | None = None) -> DataFrame:
    """Per cycle: outcome (killed_budget, error, submitted or no_pattern), reason, steps run, patterns, cost and checks.

    ``decisions``: cycle_id, accepted (boolean), error. ``tests``: cycle_id, passed; ``finals``: cycle_id and the phase
    (cheap or frontier) in which a model returned that there is no pattern. The reason of no_pattern is the first that
    holds, in the order of a cycle's phases; a killed cycle has exhausted its budget; others have none.
    """
    ran = ledger.groupBy("cycle_id").agg(F.count_if(F.col("status") == "ok").alias("steps"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("realized_usd"))), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.bool_or(F.col("status") == "killed"), F.lit(False)).alias("killed"))
    made = decisions.groupBy("cycle_id").agg(F.count_if("accepted").alias("patterns"), F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("failed"))
    both = ran.join(made, "cycle_id", "left").withColumns({"patterns": F.coalesce("patterns", F.lit(0)), "failed": F.coalesce("failed", F.lit(False))})
    flags = [(tests, F.bool_or("passed"), "tested"), (finals, F.bool_or(F.col("phase") == "cheap"), "cheap_final"), (finals, F.bool_or(F.col("phase") == "frontier"), "frontier_final")]
    for df, flag, name in flags:
        both = both.withColumn(name, F.lit(None).cast("boolean")) if df is None else both.join(df.groupBy("cycle_id").agg(flag.alias(name)), "cycle_id", "left")
        both = both.withColumn(name, F.coalesce(name, F.lit(False)))
    outcome = F.when(F.col("killed"), "killed_budget").when(F.col("failed"), "error").when(F.col("patterns") > 0, "submitted").otherwise("no_pattern")
    why = F.when(F.lit(most_patterns == 0), "max_patterns_is_zero").when(F.col("cheap_final"), "cheap_model_returned_no_pattern").when(~F.col("tested"), "no_successful_test_assertion").when(F.col("frontier_final"), "frontier_model_returned_no_pattern").otherwise("frontier_did_not_submit")
    reason = F.when(outcome == "no_pattern", why).when(outcome == "killed_budget", "budget_exhausted")
    return both.select("cycle_id", outcome.alias("outcome"), reason.alias("reason"), "steps", "patterns", "cost_usd", ((F.col("patterns") <= most_patterns) & (F.col("cost_usd") <= cap)).alias("holds"))

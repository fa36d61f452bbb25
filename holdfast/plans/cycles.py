"""Queries over originality, discovery cycles, audit logs, incremental runs and the council."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.operators import audit, council, discovery, incremental, originality
from holdfast.plans.fixtures import DAY, START, oracle, sql, view

Q: dict = {}
SQL: dict = {}


def query(name: str, oracle_text: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle_text:
            SQL[name] = oracle(oracle_text)
        return f

    return keep


# originality

def _fields():
    return {"assertion.kind": F.col("kind"), "spec_ref": F.col("spec_ref"), "scope.kind": F.lit("all")}


_HASH = {
    "kind": "SHA('assertion.kind=' || kind)",
    "both": "SHA('assertion.kind=' || kind || '|spec_ref=' || spec_ref)",
}
_MANY = "(select cast(user_id as string) || ':' || k.kind as pattern_id, k.kind, event_type as spec_ref from (select distinct user_id, event_type from {events}) cross join (values ('in_range'), ('quantile_ge'), ('sign')) as k(kind))"
_ONE = _MANY.replace("cast(user_id as string) || ':' || k.kind", "cast(user_id as string) || ':' || event_type || ':' || k.kind")
_ENTRIES = f"""(select cast(row_number() over (order by paths_, projection_hash) as int) as position, 'ap' || cast(row_number() over (order by paths_, projection_hash) as string) as anti_pattern_id, paths_, projection_hash from (
    select distinct 'assertion.kind' as paths_, {_HASH["kind"]} as projection_hash from {_ONE} where kind = 'sign'
    union all select distinct 'assertion.kind,spec_ref', {_HASH["both"]} from {_ONE} where kind <> 'in_range' and spec_ref in (select min(event_type) from {{events}})))"""


def _entries(spark, d):
    return sql(spark, d, f"select position, anti_pattern_id, split(paths_, ',') as paths, projection_hash from {_ENTRIES}")


def _many(spark, d):
    return sql(spark, d, f"select * from {_ONE}")


_FOUND = f"""(select p.pattern_id, e.position, e.anti_pattern_id from {_ONE} p join {_ENTRIES} e on e.projection_hash = case e.paths_ when 'assertion.kind' then {_HASH["kind"]} else {_HASH["both"]} end)"""


@query("pattern_fingerprints", "select pattern_id, SHA('{\"assertion\":{\"kind\":\"' || kind || '\"},\"spec_ref\":\"' || spec_ref || '\"}') as fingerprint_hash from __ONE__".replace("__ONE__", _ONE))
def _(spark, d):
    body = F.concat(F.lit('{"spec_ref": "'), "spec_ref", F.lit('", "assertion": {"kind": "'), "kind", F.lit('"}}'))
    return originality.fingerprints(_many(spark, d), body).select("pattern_id", "fingerprint_hash")


@query("project_paths", f"select pattern_id, {_HASH['both']} as projection_hash from {_ONE}")
def _(spark, d):
    return _many(spark, d).select("pattern_id", originality.projection(["spec_ref", "assertion.kind"], _fields()).alias("projection_hash"))


@query("reduction_match", f"select * from {_FOUND}")
def _(spark, d):
    return originality.matches(_many(spark, d), _entries(spark, d), _fields())


@query("originality_decision", f"select p.pattern_id, case when f.pattern_id is null then 'pass' else 'reject' end as decision, f.anti_pattern_id from {_ONE} p left join (select pattern_id, min_by(anti_pattern_id, position) as anti_pattern_id from {_FOUND} group by 1) f on f.pattern_id = p.pattern_id")
def _(spark, d):
    p = _many(spark, d)
    return originality.decisions(p, originality.matches(p, _entries(spark, d), _fields()))


_NEW = "(select cast(c_custkey as int) as position, 'ap' || cast(c_custkey % 60 as string) as anti_pattern_id from {customer})"
_FRESH = f"(select *, case when anti_pattern_id in (select anti_pattern_id from {_ENTRIES}) or row_number() over (partition by anti_pattern_id order by position) > 1 then 0 else 1 end as fresh from {_NEW})"


@query("anti_list_maintenance", f"select position, anti_pattern_id, case when fresh = 0 then 'duplicate' when sum(fresh) over (order by position) + (select count(*) from {_ENTRIES}) > 32 then 'full' else 'added' end as outcome from {_FRESH}")
def _(spark, d):
    return originality.append_entries(_entries(spark, d), sql(spark, d, f"select * from {_NEW}"))


_KINDS = f"""(select position, anti_pattern_id, 'reduction' as matcher, paths_, projection_hash, null as values_ from {_ENTRIES}
    union all select 20, 'types', 'field_in', 'spec_ref', null, 'click,view,purchase' union all select 21, 'kinds', 'field_in', 'assertion.kind', null, 'in_range,none')"""


@query("matcher_kinds", f"""select p.pattern_id, e.position, e.anti_pattern_id from {_ONE} p join {_KINDS} e on
    case when e.matcher = 'reduction' then e.projection_hash = case e.paths_ when 'assertion.kind' then {_HASH["kind"]} else {_HASH["both"]} end
    else list_contains(string_split(e.values_, ','), case e.paths_ when 'spec_ref' then p.spec_ref else p.kind end) end""")
def _(spark, d):
    """Two kinds of matcher in one pass."""
    entries = sql(spark, d, f"select position, anti_pattern_id, matcher, split(paths_, ',') as paths, projection_hash, split(values_, ',') as field_values from {_KINDS}")
    return originality.matches(_many(spark, d), entries, _fields())


_GONE = "(select distinct 'ap' || cast(c_custkey % 60 as string) as anti_pattern_id from {customer} where c_custkey % 7 > 0)"


@query("anti_list_removal", f"""select coalesce(g.anti_pattern_id, e.anti_pattern_id) as anti_pattern_id, e.position, case when g.anti_pattern_id is null then 'left' when e.anti_pattern_id is null then 'unknown' else 'removed' end as outcome
    from {_GONE} g full join {_ENTRIES} e on e.anti_pattern_id = g.anti_pattern_id""")
def _(spark, d):
    entries = _entries(spark, d)
    left, outcome = originality.remove_entries(entries, sql(spark, d, f"select * from {_GONE}"))
    gone = outcome.join(entries.select("anti_pattern_id", "position"), "anti_pattern_id", "left").select("anti_pattern_id", "position", "outcome")
    return gone.union(left.select("anti_pattern_id", "position", F.lit("left")))


@query("observed_fingerprints", "select pattern_id, SHA('{\"assertion\":{\"kind\":\"' || kind || '\"},\"observation_fingerprint_hash\":' || case when kind = 'sign' then 'null' else '\"' || SHA(spec_ref) || '\"' end || ',\"spec_ref\":\"' || spec_ref || '\"}') as fingerprint_hash from __ONE__".replace("__ONE__", _ONE))
def _(spark, d):
    body = F.concat(F.lit('{"spec_ref": "'), "spec_ref", F.lit('", "assertion": {"kind": "'), "kind", F.lit('"}} '))
    seen = F.when(F.col("kind") != "sign", F.sha2("spec_ref", 256))
    return originality.fingerprints(_many(spark, d), body, seen).select("pattern_id", "fingerprint_hash")


@query("anti_list_version", f"select SHA(string_agg(cast(position as string) || ':' || anti_pattern_id || ':' || projection_hash, ',' order by position)) as version from {_ENTRIES}")
def _(spark, d):
    return originality.list_version(_entries(spark, d))


# discovery cycles

_PLAIN = "(select seq, lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s+', ' ', 'g')) as s from {phrases})"


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("classify_inputs", f"""select seq, case when reason is not null then 'flagged' when red then 'red_team_request' when tool then 'tool_request' else 'flagged' end as kind,
    case when reason is not null then reason when red or tool then null else 'unrecognized' end as reason from (
    select seq, case when s = '' then 'empty input' when regexp_matches(s, '\\bwhat +about\\b|\\bhave +you +checked\\b|\\blook +at\\b|\\bfocus +on\\b') then 'targeting phrase'
      when list_has_any(regexp_extract_all(s, '[a-z]+'), {_words(discovery.CONTENT_TERMS)}) then 'content term' end as reason,
    list_has_any(regexp_extract_all(s, '[a-z]+(?:-[a-z]+)?'), {_words(discovery.RED_TEAM_WORDS)}) as red, list_has_any(regexp_extract_all(s, '[a-z]+(?:-[a-z]+)?'), {_words(discovery.TOOL_WORDS)}) as tool from {_PLAIN})""")
def _(spark, d):
    kind, reason = discovery.classify(F.col("text"))
    return view(spark, d, "phrases").select("seq", kind.alias("kind"), reason.alias("reason"))


_NODES = "(select 's' || cast(event_id % 700 as string) as spec_id, case when event_id % 3 = 0 then 'llm_call' else 'mean' end as op, case event_id % 5 when 0 then 'Please FIND the cause' when 1 then 'What about it' else 'Rate the tone' end as template from {events})"


@query("open_ended_prompt_filter", f"select distinct spec_id from {_NODES} n where not exists (select 1 from {_NODES} b where b.spec_id = n.spec_id and b.op = 'llm_call' and (lower(b.template) like '%find%' or lower(b.template) like '%what about%'))")
def _(spark, d):
    return discovery.specs_without_open_prompts(sql(spark, d, f"select * from {_NODES}"))


_DAYS = "(select spec_ref, cast(floor(t / 86400) as bigint) as day, t, value, source_hash from {series})"


@query("window_compute_summary", f"""select spec_ref, day, count(*) as size, count(value) as finite, min(value) as min, max(value) as max, round(avg(value), 9) as mean,
    string_agg(cast(cast(round(value * 100) as bigint) as string), ',' order by t, value) filter (turn <= 5) as sample, count(distinct source_hash) as sources
    from (select *, row_number() over (partition by spec_ref, day order by t, value) as turn from {_DAYS}) group by 1, 2""")
def _(spark, d):
    out = discovery.compute_summary(sql(spark, d, f"select * from {_DAYS}"), ["spec_ref", "day"])
    sample = F.array_join(F.transform("sample", lambda v: F.round(v * 100).cast("long").cast("string")), ",")
    return out.select("spec_ref", "day", "size", "finite", "min", "max", F.round("mean", 9).alias("mean"), sample.alias("sample"), "sources")


_DRAFTS = "(select user_id as cycle_id, event_id as step, SHA(event_type || ':' || cast(event_id % 4 as string)) as fingerprint, value > 60 as passed from {events})"
_SUBS = "(select distinct user_id as cycle_id, SHA(event_type || ':' || cast(event_id % 4 as string)) as fingerprint from {events} where event_id % 3 = 0)"


_TRIED = f"""(select user_id as cycle_id, event_id as step, event_type as spec_ref, case event_id % 3 when 0 then 'in_range' when 1 then 'quantile_ge' else 'sign' end as kind, 0.0e0 as lo, 90.0e0 + event_id % 60 as hi, 0.5e0 as p, 20.0e0 + event_id % 60 as threshold,
    cast(1 as int) as expected_sign, EPOCH(ts) as t0, EPOCH(ts) + 3600 * (event_id % 12) as t1 from {{events}})"""
_TRIED_HASH = """SHA('{"assertion":{"kind":"' || kind || '",' || case kind when 'in_range' then '"lo":0,"hi":' || cast(cast(hi as bigint) as string) when 'sign' then '"expected_sign":1' else '"p":5,"threshold":' || cast(cast(threshold as bigint) as string) end
    || '},"spec_ref":"' || spec_ref || '","window":{"t0":' || cast(t0 as string) || ',"t1":' || cast(t1 as string) || '}}')"""


@query("test_assertions", f"""select cycle_id, step, {_TRIED_HASH} as fingerprint, n from (select a.cycle_id, a.step, a.spec_ref, a.kind, a.hi, a.threshold, a.t0, a.t1, count(*) as n,
    bool_and(not isnan(s.value)) and case any_value(a.kind) when 'in_range' then bool_and(s.value between lo and hi) when 'sign' then bool_and(sign(s.value) = expected_sign) else quantile_cont(s.value, 0.5) >= any_value(a.threshold) end as passed
    from {_TRIED} a join {{series}} s on s.spec_ref = a.spec_ref and s.t between a.t0 and a.t1 group by 1, 2, 3, 4, 5, 6, 7, 8) where passed""")
def _(spark, d):
    # the assertion's own JSON, with whole numbers (p in tenths), so that both engines write it alike
    whole = lambda c: F.col(c).cast("long").cast("string")
    args = F.when(F.col("kind") == "in_range", F.concat(F.lit('"lo":0,"hi":'), whole("hi"))).when(F.col("kind") == "sign", F.lit('"expected_sign":1')).otherwise(F.concat(F.lit('"p":5,"threshold":'), whole("threshold")))
    drafts = sql(spark, d, f"select * from {_TRIED}").withColumn("assertion", F.concat(F.lit('{"kind":"'), "kind", F.lit('",'), args, F.lit("}")))
    return discovery.test_assertions(drafts, view(spark, d, "series"))


@query("submission_gate", f"select s.cycle_id, s.fingerprint, t.sources is not null as accepted, t.sources from {_SUBS} s left join (select cycle_id, fingerprint, string_agg(cast(step as string), ',' order by step) as sources from {_DRAFTS} where passed group by 1, 2) t on t.cycle_id = s.cycle_id and t.fingerprint = s.fingerprint")
def _(spark, d):
    out = discovery.submission_gate(sql(spark, d, f"select * from {_SUBS}"), sql(spark, d, f"select * from {_DRAFTS}"))
    return out.select("cycle_id", "fingerprint", "accepted", F.array_join("sources", ",").alias("sources"))


_OBSERVED = f"(select distinct cycle_id, fingerprint as pattern_id, cast({START} as bigint) as t0, cast({START + 3 * DAY} as bigint) as t1 from {_SUBS})"
_TOUCHED = f"(select distinct user_id as cycle_id, {START} + event_id % 5 * {DAY} as t0, {START} + event_id % 5 * {DAY} + 3600 as t1 from {{events}})"


@query("touched_windows", f"select * from {_OBSERVED} union select t.cycle_id, o.pattern_id, t.t0, t.t1 from {_TOUCHED} t join {_OBSERVED} o on o.cycle_id = t.cycle_id")
def _(spark, d):
    return discovery.touched_windows(sql(spark, d, f"select * from {_OBSERVED}"), sql(spark, d, f"select * from {_TOUCHED}"))


_TOOLS = "(select event_id, case event_id % 6 when 0 then 'inspect_spec' when 1 then 'compute' when 2 then 'propose_spec' when 3 then 'test_assertion' when 4 then 'submit_pattern' else 'browse' end as tool_name, case when user_id % 3 = 0 then 'frontier' else 'cheap' end as phase, 's' || cast(user_id as string) as spec_id from {events})"


@query("tool_rule_check", f"select event_id, case when tool_name = 'browse' then 'unknown tool' when (tool_name = 'submit_pattern') <> (phase = 'frontier') then 'not allowed in phase' else 'ok' end as rule from {_TOOLS}")
def _(spark, d):
    return discovery.tool_rules(sql(spark, d, f"select * from {_TOOLS}")).select("event_id", "rule")


_SPECS = "(select 's' || cast(p_partkey as string) as spec_id, p_retailprice / 1e6 as spec_usd, p_size as n_deps from {part})"


@query("tool_cost_estimate", f"""select event_id, round(case tool_name when 'inspect_spec' then 0.001e0 when 'propose_spec' then 0.002e0 when 'submit_pattern' then 0.003e0 when 'compute' then spec_usd + n_deps * 0.001e0 when 'test_assertion' then 2 * (spec_usd + n_deps * 0.001e0) end, 9) as estimated_usd
    from {_TOOLS} t left join {_SPECS} s on s.spec_id = t.spec_id""")
def _(spark, d):
    out = discovery.tool_cost(sql(spark, d, f"select * from {_TOOLS}"), sql(spark, d, f"select * from {_SPECS}"), 0.001, 0.002, 0.003)
    return out.select("event_id", F.round("estimated_usd", 9).alias("estimated_usd"))


_CAP = 1.5
_SUMS = f"(select *, {_CAP}e0 - coalesce(sum(realized_usd) over (partition by cycle_id order by step rows between unbounded preceding and 1 preceding), 0) as remaining from {{steps}})"
_KILLS = f"(select *, reserved_usd > remaining or greatest(0, realized_usd - reserved_usd) > remaining as kill from {_SUMS})"
_LEDGER = f"(select *, case when coalesce(max(cast(kill as int)) over (partition by cycle_id order by step rows between unbounded preceding and 1 preceding), 0) = 1 then 'not run' when kill then 'killed' else 'ok' end as status from {_KILLS})"


@query("budget_ledger", f"select cycle_id, step, status from {_LEDGER}")
def _(spark, d):
    return discovery.budget_ledger(view(spark, d, "steps"), _CAP).select("cycle_id", F.col("step").cast("long").alias("step"), "status")


@query("parse_decisions", """select event_id, case event_id % 5 when 0 then 'NO_PATTERN' when 1 then 'done' end as final, case when event_id % 5 = 4 then 'not JSON' end as error,
    cast(p as int) as position, case when event_id % 5 in (1, 3) then event_type when event_id % 5 = 2 then case p when 0 then 'inspect_spec' else event_type end end as tool from {events}
    join (values (0, 1), (0, 2), (1, 2), (0, 3), (null, 0), (null, 4)) as k(p, m) on k.m = event_id % 5""")
def _(spark, d):
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, "NO_PATTERN").when(kind == 1, F.concat(F.lit('{"final":"done","actions":[{"tool":"'), "event_type", F.lit('","args":{"a":1}}]}')))
    text = text.when(kind == 2, F.concat(F.lit('{"tool_calls":[{"name":"inspect_spec"},{"tool":"'), "event_type", F.lit('"}]}'))).when(kind == 3, F.concat(F.lit('{"tool":"'), "event_type", F.lit('","args":{}}'))).otherwise("{oops")
    return discovery.parse_decisions(view(spark, d, "events").select("event_id", text.alias("text"))).select("event_id", "final", "error", "position", "tool")


@query("realized_model_cost", "select event_id, case when event_id % 3 = 0 then value when event_id % 3 = 1 then value / 2 else 7.0e0 end as usd from {events}")
def _(spark, d):
    v, k = F.col("value"), F.col("event_id") % 3
    return view(spark, d, "events").select("event_id", discovery.realized_cost(F.when(k == 0, v).otherwise(-1.0), F.when(k == 1, v / 2), F.lit(7.0)).alias("usd"))


@query("tool_trace_hash", """select user_id as cycle_id, SHA('[' || string_agg('{"args_hash":"' || SHA(props) || '","outcome":"ok","phase":"cheap","result_hash":"' || SHA(cast(user_id as string)) || '","step_index":' || cast(event_id as string) || ',"tool_name":"' || event_type || '"}', ',' order by event_id) || ']') as trace_hash
    from {events} group by 1""")
def _(spark, d):
    calls = sql(spark, d, "select user_id as cycle_id, event_id as step_index, 'cheap' as phase, event_type as tool_name, SHA(props) as args_hash, SHA(cast(user_id as string)) as result_hash, 'ok' as outcome from {events}")
    return discovery.trace_hash(calls)


_DECIDED = f"(select cycle_id, accepted, case when cycle_id % 10 = 3 then 'bad' end as error from (select s.cycle_id, exists (select 1 from {_DRAFTS} t where t.passed and t.cycle_id = s.cycle_id and t.fingerprint = s.fingerprint) as accepted from {_SUBS} s))"


_FINALS = "(select distinct cast(user_id as bigint) as cycle_id, case when user_id % 4 = 0 then 'cheap' else 'frontier' end as phase from {events} where user_id % 4 < 2)"


@query("cycle_outcome", f"""select l.cycle_id, case when killed then 'budget_exhausted' when coalesce(failed, false) or coalesce(patterns, 0) > 0 then null when exists (select 1 from {_FINALS} f where f.cycle_id = l.cycle_id and f.phase = 'cheap') then 'cheap_model_returned_no_pattern'
    when not exists (select 1 from {_DRAFTS} t where t.passed and t.cycle_id = l.cycle_id) then 'no_successful_test_assertion' when exists (select 1 from {_FINALS} f where f.cycle_id = l.cycle_id and f.phase = 'frontier') then 'frontier_model_returned_no_pattern' else 'frontier_did_not_submit' end as reason, case when killed then 'killed_budget' when coalesce(failed, false) then 'error' when coalesce(patterns, 0) > 0 then 'submitted' else 'no_pattern' end as outcome, steps, coalesce(patterns, 0) as patterns, round(cost_usd, 9) as cost_usd,
    coalesce(patterns, 0) <= 5 and cost_usd <= {_CAP} as holds from (select cycle_id, cast(count_if(status = 'ok') as bigint) as steps, coalesce(sum(realized_usd) filter (status = 'ok'), 0) as cost_usd, bool_or(status = 'killed') as killed from {_LEDGER} group by 1) l
    left join (select cycle_id, cast(count_if(accepted) as bigint) as patterns, bool_or(error is not null) as failed from {_DECIDED} group by 1) m on m.cycle_id = l.cycle_id""")
def _(spark, d):
    gate = discovery.submission_gate(sql(spark, d, f"select * from {_SUBS}"), sql(spark, d, f"select * from {_DRAFTS}"))
    decided = gate.select("cycle_id", "accepted", F.when(F.col("cycle_id") % 10 == 3, "bad").alias("error"))
    out = discovery.cycle_outcome(discovery.budget_ledger(view(spark, d, "steps"), _CAP), decided, _CAP, 5, sql(spark, d, f"select * from {_DRAFTS}"), sql(spark, d, f"select * from {_FINALS}"))
    return out.withColumn("cost_usd", F.round("cost_usd", 9))


# audit logs

_RECORDS = "select event_id, case when event_id % 7 = 0 then '' else event_type end as category, case when event_id % 11 = 0 then null else 's' end as stage, event_id % 5 = 0 as odd, event_id % 13 = 0 as set_by_caller, event_id % 4 as zone from {events}"


@query("validate_records", f"select event_id, concat_ws(',', case when category = '' then 'category' end, case when stage is null then 'stage' end, case when odd then 'envelope' end, case when set_by_caller then 'caller set hashes' end, case when zone in (1, 2) then 'timestamp' end) as errors from ({_RECORDS})")
def _(spark, d):
    rows = sql(spark, d, _RECORDS)
    key = F.when(F.col("odd"), "other").otherwise("cycle_id")
    rows = rows.withColumns({"envelope": F.create_map(key, F.lit("x")), "record_hash": F.when(F.col("set_by_caller"), "h"), "prev_hash": F.lit(None).cast("string")})
    zone, plain = F.col("zone"), F.lit("2024-01-05T06:07:08")
    at = F.when(zone == 0, F.concat(plain, F.lit("+01:00"))).when(zone == 1, plain).when(zone == 2, F.lit("2024-13-05T06:07:08Z"))
    return audit.validate(rows.withColumn("timestamp", at)).select("event_id", "errors")


def _to_append(spark, d):
    return sql(spark, d, "select cast(user_id % 20 as string) as log_id, event_id as seq, EPOCH(ts) as ts, event_type, props from {events}").select("log_id", "seq", "ts", F.concat(F.lit('{"category":"'), "event_type", F.lit('","props":'), "props", F.lit("}")).alias("payload"))


def _lines(spark, d):
    """A log of chained records by user group, in order of time, with some lines tampered with."""
    rows = _to_append(spark, d).withColumn("seq", F.col("ts") * 1000000 + F.col("seq"))
    made = audit.chained(rows).where("not rejected")
    day = F.floor(F.col("ts") / 86400).cast("long")
    line = F.when(F.col("seq") % 997 == 0, F.regexp_replace("line", "category", "kategory")).otherwise(F.col("line"))
    return audit.check_digests(made.select("log_id", "ts", day.alias("day"), F.col("seq").alias("line_no"), "prev_hash", "record_hash", line.alias("line")))


@query("record_digests")
def _(spark, d):
    return _lines(spark, d).select("log_id", "line_no", "digest_ok")


@query("append_chain")
def _(spark, d):
    return audit.append_chain(_to_append(spark, d)).select("log_id", "seq", "prev_hash", "record_hash", "rejected")


_STORED = """(select cast(user_id % 20 as string) as log_id, EPOCH(ts) as ts, cast(floor(EPOCH(ts) / 86400) as bigint) as day, EPOCH(ts) * 1000000 + event_id as line_no, SHA(cast(event_id as string)) as record_hash, event_id % 101 > 0 as digest_ok, event_id,
    case when event_id % 89 = 0 then 'x' else coalesce(lag(SHA(cast(event_id as string))) over (partition by user_id % 20 order by EPOCH(ts) * 1000000 + event_id), '__Z__') end as prev_hash from {events})""".replace("__Z__", "0" * 64)


@query("verify_day", f"select log_id, day, count(*) as n, bool_and(digest_ok and event_id % 89 > 0) as valid from {_STORED} group by 1, 2")
def _(spark, d):
    return audit.verify_days(sql(spark, d, f"select * from {_STORED}"))


@query("verify_appended", f"select log_id, day, count(*) as n, bool_and((t * 1000000 + event_id) % 997 > 0) as valid from (select cast(user_id % 20 as string) as log_id, EPOCH(ts) as t, cast(floor(EPOCH(ts) / 86400) as bigint) as day, event_id from {{events}}) group by 1, 2")
def _(spark, d):
    """Records appended to chains, some tampered with afterwards, and verified by their own digests."""
    return audit.verify_days(_lines(spark, d))


@query("verify_range", f"select log_id, count(distinct day) as days, bool_and(digest_ok and event_id % 89 > 0) as valid from {_STORED} where day between {START // DAY + 5} and {START // DAY + 8} group by 1")
def _(spark, d):
    return audit.verify_range(sql(spark, d, f"select * from {_STORED}"), START // DAY + 5, START // DAY + 8)


@query("chain_tail", f"select log_id, max_by(record_hash, line_no) as tail_hash, max_by(ts, line_no) as tail_ts, max(day) as tail_day from {_STORED} where day < {START // DAY + 9} group by 1")
def _(spark, d):
    return audit.chain_tail(sql(spark, d, f"select * from {_STORED}"), START // DAY + 9)


# incremental runs

_RUNS = "(select o_orderkey, 'st' || cast(o_custkey % 5 as string) as stage_name, '1' as stage_version, SHA(cast(o_custkey as string)) as inputs_hash, SHA(o_orderstatus || cast(o_custkey as string)) as output_hash from {orders})"
_KEYED = f"(select *, SHA('{{\"inputs_hash\":\"' || inputs_hash || '\",\"name\":\"' || stage_name || '\",\"version\":\"' || stage_version || '\"}}') as fingerprint from {_RUNS})".replace("{{", "{").replace("}}", "}")


def _keyed(spark, d):
    rows = sql(spark, d, f"select * from {_RUNS}")
    return rows.withColumn("fingerprint", incremental.stage_fingerprint(F.col("stage_name"), F.col("stage_version"), F.col("inputs_hash")))


@query("stage_fingerprint", f"select o_orderkey, fingerprint from {_KEYED}")
def _(spark, d):
    return _keyed(spark, d).select("o_orderkey", "fingerprint")


@query("skip_unchanged", f"select o_orderkey from {_KEYED} k where not exists (select 1 from {_KEYED} f where f.o_orderkey % 2 = 0 and f.fingerprint = k.fingerprint and f.output_hash in (select output_hash from {_KEYED} where o_orderkey % 3 = 0))")
def _(spark, d):
    rows = _keyed(spark, d)
    return incremental.work_list(rows, rows.where("o_orderkey % 2 = 0").select("fingerprint", "output_hash"), rows.where("o_orderkey % 3 = 0").select(F.col("output_hash").alias("hash"))).select("o_orderkey")


_LATE = f"(select distinct fingerprint, output_hash from {_KEYED} where o_orderkey % 4 = 1)"
_EARLY = f"(select distinct fingerprint, output_hash from {_KEYED} where o_orderkey % 8 = 0)"


@query("fingerprint_conflicts", f"""select n.fingerprint, n.output_hash, case when n.output_hash not in (select output_hash from {_KEYED} where o_orderkey % 3 > 0) then 'missing artifact'
    when (select count(distinct output_hash) from (select * from {_LATE} union select * from {_EARLY}) a where a.fingerprint = n.fingerprint) > 1 then 'conflict' when exists (select 1 from {_EARLY} e where e.fingerprint = n.fingerprint) then 'known' else 'recorded' end as outcome from {_LATE} n""")
def _(spark, d):
    rows = _keyed(spark, d)
    pick = lambda cond: rows.where(cond).select("fingerprint", "output_hash").distinct()
    return incremental.record(pick("o_orderkey % 4 = 1"), pick("o_orderkey % 8 = 0"), rows.where("o_orderkey % 3 > 0").select(F.col("output_hash").alias("hash")))


_CHARGES = "(select cast(user_id as string) as invocation_id, 'st' || cast(user_id % 3 as string) as stage_name, event_id as seq, value / 1000 as compute_usd, value / 2000 as llm_usd, cast(event_id % 3 as bigint) as data_reads from {events})"
_RUN = f"(select invocation_id, stage_name, seq, sum(compute_usd) over w as c, sum(llm_usd) over w as l, sum(data_reads) over w as r from {_CHARGES} window w as (partition by invocation_id order by seq))"
_OVER = f"(select *, case when c > case stage_name when 'st0' then 1 when 'st1' then 2 else 100 end then 'compute_usd' when l > 1.5 then 'llm_usd' when r > 60 then 'data_reads' end as over_ from {_RUN})"


@query("cost_ceilings", f"select a.invocation_id, f.failed_at, f.ceiling from (select distinct invocation_id from {_CHARGES}) a left join (select invocation_id, min(seq) as failed_at, min_by(over_, seq) as ceiling from {_OVER} where over_ is not null group by 1) f on f.invocation_id = a.invocation_id")
def _(spark, d):
    ceilings = spark.sql("select * from values ('st0', 1D, 1.5D, 60L), ('st1', 2D, 1.5D, 60L), ('st2', 100D, 1.5D, 60L), ('st-1', 100D, 1.5D, 60L), ('st-2', 100D, 1.5D, 60L) as c(stage_name, max_compute_usd, max_llm_usd, max_data_reads)")
    return incremental.cost_ceilings(sql(spark, d, f"select * from {_CHARGES}"), ceilings)


@query("artifact_put_get", "select SHA(text) as hash, cast(max(strlen(text)) as bigint) as bytes_size from {documents} a where not exists (select 1 from {documents} e where e.doc_id % 4 = 0 and e.text = a.text) group by 1")
def _(spark, d):
    rows = view(spark, d, "documents").select(F.col("text").alias("content"), "doc_id")
    held = rows.where("doc_id % 4 = 0").select(F.sha2("content", 256).alias("hash"))
    return incremental.put_artifacts(rows, held).select("hash", "bytes_size")


# council and archive

@query("council_decision", "select pattern_id, count(distinct independence_group) filter (vote = 'approve') as approving_groups, cast(count_if(vote = 'reject') as bigint) as rejects, count(distinct independence_group) filter (vote = 'approve') >= 2 and count_if(vote = 'reject') = 0 as archived from {votes} group by 1")
def _(spark, d):
    return council.decisions(view(spark, d, "votes"))


@query("independence_audit", "select a.member as a, b.member as b, count(*) as patterns, round(1 - avg(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))), 6) as independence from {votes} a join {votes} b on a.pattern_id = b.pattern_id and a.member < b.member group by 1, 2")
def _(spark, d):
    return council.independence(view(spark, d, "votes")).withColumn("independence", F.round("independence", 6))


_THETA = 0.995


@query("independent_decisions", f"""with recursive pairs as (select a.member as a, b.member as b from {{votes}} a join {{votes}} b on a.pattern_id = b.pattern_id and a.member < b.member group by 1, 2
        having 1 - avg(list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))) < {_THETA}),
    links as (select a, b from pairs union select b, a from pairs), reach as (select distinct member, member as other from {{votes}} union select r.member, l.b from reach r join links l on l.a = r.other),
    own as (select member, min(other) as grp from reach group by 1)
    select pattern_id, count(distinct grp) filter (vote = 'approve') as approving_groups, cast(count_if(vote = 'reject') as bigint) as rejects, count(distinct grp) filter (vote = 'approve') >= 2 and count_if(vote = 'reject') = 0 as archived
    from {{votes}} join own using (member) group by 1""")
def _(spark, d):
    votes = view(spark, d, "votes")
    return council.decisions(council.regrouped(votes, council.independence(votes), _THETA))


_ARCHIVE = f"(select distinct pattern_id, {START} + pattern_id % 25 * {DAY} as archived_at, pattern_id % 3 > 0 as re_replicated from {{votes}})"


@query("calibration", f"select member, count(*) as approvals, round(avg(cast(re_replicated as int)), 9) as rate, avg(cast(re_replicated as int)) < 0.66 as flagged from {{votes}} v join {_ARCHIVE} a on a.pattern_id = v.pattern_id where vote = 'approve' group by 1")
def _(spark, d):
    out = council.calibration(view(spark, d, "votes"), sql(spark, d, f"select * from {_ARCHIVE}"), 0.66)
    return out.withColumn("rate", F.round("rate", 9))


_RESULTS = "(select o_orderpriority as protocol, o_custkey % 3 = 0 as verdict, o_orderkey % 4 < 2 as re_replicated from {orders})"


@query("meta_validation", f"select protocol, round(avg(cast(re_replicated as int)) filter (verdict), 9) as after_pass, round(avg(cast(re_replicated as int)) filter (not verdict), 9) as after_fail, round(avg(cast(re_replicated as int)) filter (verdict) - avg(cast(re_replicated as int)) filter (not verdict), 9) as discrimination from {_RESULTS} group by 1")
def _(spark, d):
    out = council.meta_validation(sql(spark, d, f"select * from {_RESULTS}"))
    return out.withColumns({c: F.round(c, 9) for c in ("after_pass", "after_fail", "discrimination")})


_NOTES = f"(select pattern_id, {START} + cast(member_no as bigint) * {DAY} as annotated_at, member_no % 2 = 0 as re_replicated from (select pattern_id, cast(substr(member, 2) as int) as member_no from {{votes}}) where pattern_id % 4 > 0)"


@query("archive_append", f"select a.pattern_id, a.archived_at, n.annotated_at, n.re_replicated from (select pattern_id, archived_at from {_ARCHIVE}) a left join (select pattern_id, max(annotated_at) as annotated_at, max_by(re_replicated, annotated_at) as re_replicated from {_NOTES} group by 1) n on n.pattern_id = a.pattern_id")
def _(spark, d):
    return council.archive_status(sql(spark, d, f"select pattern_id, archived_at from {_ARCHIVE}"), sql(spark, d, f"select * from {_NOTES}"))


_CYCLES = "(select EPOCH(ts) as t, cast(event_id % 3 as bigint) as proposals, event_id % 50 = 0 as archived, event_id % 100 = 0 as re_replicated, value / 1000 as usd from {events})"


@query("cycle_log", f"select week, cycles, proposals, archived, round(usd, 6) as usd, round(sum(usd) over (order by week) / 15000, 9) as budget_share from (select cast(floor((t - {START}) / 604800.0) as bigint) as week, count(*) as cycles, cast(sum(proposals) as bigint) as proposals, cast(count_if(archived) as bigint) as archived, sum(usd) as usd from {_CYCLES} group by 1)")
def _(spark, d):
    out = council.cycle_log(sql(spark, d, f"select * from {_CYCLES}"), 15000.0, START)
    return out.withColumns({"usd": F.round("usd", 6), "budget_share": F.round("budget_share", 9)})


@query("clock_accounting", f"""select day, round((day + 1) * 86400 / 47304000.0e0, 9) as time_share, round(sum(usd) over (order by day) / 15000, 9) as budget_share, cast(sum(a) over (order by day) as bigint) as archived, cast(sum(r) over (order by day) as bigint) as re_replicated,
    round(sum(a) over (order by day) / ((day + 1) * 86400 / 47304000.0e0), 6) as projected from (select cast(floor((t - {START}) / 86400.0) as bigint) as day, sum(usd) as usd, count_if(archived) as a, count_if(re_replicated) as r from {_CYCLES} group by 1)""")
def _(spark, d):
    out = council.clock(sql(spark, d, f"select * from {_CYCLES}"), START, 47304000, 15000.0)
    return out.withColumns({"time_share": F.round("time_share", 9), "budget_share": F.round("budget_share", 9), "projected": F.round("projected", 6)})


@query("rereplication_due", f"select pattern_id, archived_at from {_ARCHIVE} a where archived_at <= {START + 20 * DAY} and not exists (select 1 from {_NOTES} n where n.pattern_id = a.pattern_id and n.annotated_at > a.archived_at)")
def _(spark, d):
    return council.rereplication_due(sql(spark, d, f"select pattern_id, archived_at from {_ARCHIVE}"), sql(spark, d, f"select pattern_id, annotated_at as tested_at from {_NOTES}"), START + 30 * DAY, 10 * DAY)

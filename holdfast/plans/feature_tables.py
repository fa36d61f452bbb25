"""Queries over feature operations, content addresses and feature runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import canonical as can
from holdfast.functions import features as fn
from holdfast.operators import features as rep
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


def _vectors(spark, d):
    return view(spark, d, "embeddings").select("vec_id", fn.cast_float64(F.col("embedding"), array=True).alias("x"))


_VEC = "(select vec_id, list_transform(embedding, lambda v: v::double) as x from {embeddings})"


@query("op_raw_get", """select r.seq, case when e.earliest <= r.query_time then 'ok' when e.earliest is null then 'unknown' else 'future_denied' end as outcome,
    case when e.earliest <= r.query_time then cast(strlen(b.text) as bigint) end as bytes from {read_requests} r left join (select hash, min(vendor_timestamp) as earliest from {provenance} group by 1) e on e.hash = r.hash
    left join (select hash, any_value(text) as text from {fetched} group by 1) b on b.hash = r.hash""")
def _(spark, d):
    out = rep.raw_get(view(spark, d, "read_requests"), view(spark, d, "fetched").select("hash", "text"), view(spark, d, "provenance"))
    return out.select("seq", "outcome", F.octet_length("content").cast("long").alias("bytes"))


@query("op_literal", "select event_id, 2.5e0 as scale from {events}")
def _(spark, d):
    return view(spark, d, "events").select("event_id", fn.OPS["literal"].build({"value": 2.5}).alias("scale"))


@query("op_decode_json", "select event_id, props as json, true as good from {events} where event_id % 3 > 0 union all select event_id, null, false from {events} where event_id % 3 = 0")
def _(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{bad")).otherwise(F.col("props"))
    v = fn.decode_json(text)
    return view(spark, d, "events").select("event_id", F.when(v.isNotNull(), text).alias("json"), v.isNotNull().alias("good"))


@query("op_decode_text", "select doc_id, text from {documents}")
def _(spark, d):
    return view(spark, d, "documents").select("doc_id", fn.decode_text(F.encode("text", "UTF-8")).alias("text"))


@query("op_json_get", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) + 1 as last from {events}")
def _(spark, d):
    listed = fn.decode_json(F.concat(F.lit('{"a":[0,'), (fn.json_get(fn.decode_json(F.col("props")), ["k"], "bigint") + 1).cast("string"), F.lit("]}")))
    return view(spark, d, "events").select("event_id", fn.json_get(fn.decode_json(F.col("props")), ["k"], "bigint").alias("k"), fn.json_get(listed, ["a", -1], "bigint").alias("last"))


@query("op_cast_float64", "select o_orderkey, cast(o_custkey as double) as x from {orders}")
def _(spark, d):
    return view(spark, d, "orders").select("o_orderkey", fn.cast_float64(F.col("o_custkey")).alias("x"))


@query("op_stack", f"select vec_id, x[1] as first, x[2] as second, cast(2 as int) as rows from {_VEC}")
def _(spark, d):
    s = fn.stack(F.col("x"), F.reverse("x"))
    t = fn.stack(F.col("x"), F.reverse("x"), axis=1)
    return _vectors(spark, d).select("vec_id", t[0][0].alias("first"), s[0][1].alias("second"), F.size(s).alias("rows"))


@query("op_concatenate", f"select vec_id, cast(2 * len(x) as int) as n, x[1] as head, x[-1] as tail, cast(2 as int) as width from {_VEC}")
def _(spark, d):
    c = fn.concatenate(F.col("x"), F.col("x"))
    pairs = fn.concatenate(F.array(F.col("x")), F.array(F.col("x")), axis=1)
    return _vectors(spark, d).select("vec_id", F.size(c).alias("n"), c[0].alias("head"), F.element_at(c, -1).alias("tail"), (F.size(pairs[0]) / F.size("x")).cast("int").alias("width"))


@query("op_mean", f"select vec_id, round(list_sum(x) / len(x), 9) as mean from {_VEC}")
def _(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(fn.mean(F.col("x")), 9).alias("mean"))


@query("op_sum", f"select vec_id, round(list_sum(x), 9) as total, round(list_sum(x), 9) as rows_total from {_VEC}")
def _(spark, d):
    rows = fn.along(F.array(F.col("x"), F.col("x")), fn.total)
    return _vectors(spark, d).select("vec_id", F.round(fn.total(F.col("x")), 9).alias("total"), F.round(rows[1], 9).alias("rows_total"))


@query("op_z_score", f"select vec_id, i, round((v - m) / greatest(s, 1e-12), 7) as z from (select vec_id, unnest(x) as v, cast(unnest(range(len(x))) as int) as i from {_VEC}) join (select vec_id, avg(v) as m, stddev_pop(v) as s from (select vec_id, unnest(x) as v from {_VEC}) group by 1) using (vec_id)")
def _(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(fn.z_score(F.col("x"))).alias("i", "z")).withColumn("z", F.round("z", 7))


_TEMPLATE = "Rate {kind} of user {user}: {value}"


@query("render_prompts", "select event_id, 'Rate ' || event_type || ' of user ' || cast(user_id as string) || ': ' || cast(event_id % 7 as string) as prompt, SHA('Rate ' || event_type || ' of user ' || cast(user_id as string) || ': ' || cast(event_id % 7 as string)) as prompt_hash from {events}")
def _(spark, d):
    prompt = fn.render(_TEMPLATE, {"kind": F.col("event_type"), "user": F.col("user_id").cast("string"), "value": (F.col("event_id") % 7).cast("string")})
    return view(spark, d, "events").select("event_id", prompt.alias("prompt"), can.prompt_hash(prompt).alias("prompt_hash"))


_PROMPTS = "select 'm' as model_id, text as prompt, SHA('p') as params_hash, doc_id from {documents}"


@query("llm_feature_from_cache", "select SHA(text) as prompt_hash, 'r' || cast(min(doc_id) as string) as text, min(doc_id) as input_tokens, cast(3 as bigint) as output_tokens from {documents} group by 1 having min(doc_id) % 2 = 0")
def _(spark, d):
    p = sql(spark, d, _PROMPTS)
    first = p.groupBy(F.sha2("prompt", 256).alias("prompt_hash"), "params_hash", "model_id").agg(F.min("doc_id").alias("doc_id")).where("doc_id % 2 = 0").withColumn("bytes_hash", F.sha2(F.col("doc_id").cast("string"), 256))
    body = F.concat(F.lit('{"text":"r'), F.col("doc_id").cast("string"), F.lit('","input_tokens":'), F.col("doc_id").cast("string"), F.lit(',"output_tokens":3}'))
    hits, _ = rep.from_cache(p, first, first.select(F.col("bytes_hash").alias("hash"), body.alias("body")))
    return hits.select("prompt_hash", "text", "input_tokens", "output_tokens").distinct()


_SPEC = {"nodes": [{"id": "j", "op": "decode_json", "inputs": ["props"]}, {"id": "k", "op": "json_get", "args": {"path": ["k"], "type": "double"}, "inputs": ["j"]}, {"id": "v", "op": "cast_float64", "inputs": ["value"]}, {"id": "s", "op": "stack", "args": {"scalars": True}, "inputs": ["k", "v"]}, {"id": "m", "op": "mean", "inputs": ["s"]}, {"id": "unused", "op": "literal", "args": {"value": 1}}], "output": "m"}


@query("run_spec", "select event_id, round((cast(json_extract(props, '$.k') as double) + value) / 2, 9) as feature from {events}")
def _(spark, d):
    out = fn.compile_spec(_SPEC, {"props": F.col("props"), "value": F.col("value")})
    return view(spark, d, "events").select("event_id", F.round(out, 9).alias("feature"))


_ASKED_AT = START + 20 * DAY
_RUNS = f"select doc_id, hash, {_ASKED_AT} as query_time, case when doc_id % 13 = 0 then array(SHA(lang)) else array(hash) end as deps from {{fetched}}"
_ANSWERS = f"select hash, text, min(doc_id) as m, {START} + min(doc_id) % 40 * {DAY} as vendor_timestamp from {{fetched}} group by hash, text having min(doc_id) % 2 = 0"
_GRAPH = {"nodes": [
    {"id": "raw", "op": "raw_get", "inputs": ["hash"]}, {"id": "text", "op": "decode_text", "inputs": ["raw"]},
    {"id": "ask", "op": "llm_call", "inputs": ["text"], "args": {"model": "m", "params": {"n": 1}, "prompt_template": "Rate {text}", "input_names": ["text"]}},
    {"id": "json", "op": "decode_json", "inputs": ["ask"]}, {"id": "score", "op": "json_get", "args": {"path": [0], "type": "double"}, "inputs": ["json"]},
    {"id": "base", "op": "literal", "args": {"value": 2.5}}, {"id": "both", "op": "stack", "args": {"scalars": True}, "inputs": ["score", "base"]},
    {"id": "out", "op": "mean", "inputs": ["both"]}, {"id": "unused", "op": "raw_get", "args": {"hash": "0"}}], "output": "out"}


@query("run_feature_graph", f"""with earliest as (select hash, min(vendor_timestamp) as t from {{provenance}} group by 1),
    answers as (select hash, m, vendor_timestamp, SHA('{{"model":"m","params_hash":"' || SHA('{{"model":"m","params":{{"n":1}}}}') || '","prompt_hash":"' || case when m % 10 = 0 then 'other' else SHA('Rate ' || text) end
        || '","response":{{"input_tokens":1,"output_tokens":2,"text":"[' || cast(m as string) || ']"}}}}') as bytes_hash from ({_ANSWERS})),
    linked as (select doc_id, hash, m, bytes_hash, case when doc_id % 13 = 0 then 'undeclared' when t > {_ASKED_AT} then 'future_denied' end as e1,
        case when m is null then 'miss' when written > {_ASKED_AT} then 'future_denied' when m % 10 = 0 then 'mismatch' end as e2 from {{fetched}} join earliest using (hash) left join (select hash, m, vendor_timestamp as written, bytes_hash from answers) using (hash))
    select doc_id, case when e1 is null and e2 is null then (m + 2.5e0) / 2 end as value, coalesce(e1, e2) as error,
        case when e1 is not null then '' when e2 is null or e2 = 'mismatch' then least(hash, bytes_hash) || ',' || greatest(hash, bytes_hash) else hash end as read_hashes,
        cast(case when e1 = 'undeclared' then 0 when e1 is not null then 1 when m is null then 2 else 3 end as int) as data_reads from linked""")
def _(spark, d):
    answers = sql(spark, d, _ANSWERS)
    stated = F.when(F.col("m") % 10 == 0, "other").otherwise(can.prompt_hash(F.concat(F.lit("Rate "), "text")))
    params = can.params_hash(F.lit("m"), F.lit('{"n":1}'))
    body = F.concat(F.lit('{"model":"m","params_hash":"'), params, F.lit('","prompt_hash":"'), stated, F.lit('","response":{"input_tokens":1,"output_tokens":2,"text":"['), F.col("m").cast("string"), F.lit(']"}}'))
    answers = answers.withColumn("body", body).withColumn("bytes_hash", F.sha2("body", 256))
    cache = answers.select(F.lit("m").alias("model_id"), can.prompt_hash(F.concat(F.lit("Rate "), "text")).alias("prompt_hash"), params.alias("params_hash"), "bytes_hash", F.col("vendor_timestamp").alias("first_written"))
    provenance = view(spark, d, "provenance").select("hash", "vendor_timestamp").union(answers.select("bytes_hash", "vendor_timestamp"))
    blobs = view(spark, d, "fetched").select("hash", "text")
    found, _ = rep.run_graph(sql(spark, d, _RUNS), _GRAPH, {"hash": F.col("hash")}, blobs, provenance, cache, answers.select(F.col("bytes_hash").alias("hash"), "body"), key="doc_id")
    return found.withColumn("read_hashes", F.array_join("read_hashes", ","))


_READS = "select cast(user_id as string) as run_id, SHA(cast(event_id % 40 as string)) as hash, event_id from {events}"
_DEPS = "select distinct cast(user_id as string) as run_id, SHA(cast(event_id % 40 as string)) as hash from {events} where event_id % 40 < 30"


@query("deps_envelope", f"select distinct run_id, hash from ({_READS}) r where not exists (select 1 from ({_DEPS}) d where d.run_id = r.run_id and d.hash = r.hash)")
def _(spark, d):
    return rep.undeclared(sql(spark, d, _READS), sql(spark, d, _DEPS))


@query("feature_lineage", f"select run_id, string_agg(hash, ',' order by hash) as hashes from (select distinct run_id, hash from ({_READS})) group by 1")
def _(spark, d):
    return rep.lineage(sql(spark, d, _READS)).select("run_id", F.array_join("hashes", ",").alias("hashes"))


@query("output_schema_check", "select vec_id, case when vec_id % 5 = 0 then 'ragged' when vec_id % 7 = 0 then 'rows' end as errors from {embeddings} where vec_id % 5 = 0 or vec_id % 7 = 0")
def _(spark, d):
    x = F.col("x")
    value = F.when(F.col("vec_id") % 5 == 0, F.array(x, F.slice(x, 1, 3))).when(F.col("vec_id") % 7 == 0, F.array(x)).otherwise(F.array(x, x))
    return rep.schema_errors(_vectors(spark, d).withColumn("value", value), 2, 64).select("vec_id", F.array_join("errors", ",").alias("errors"))


_CALLS = "select event_id, 'm' || cast(event_id % 2 as string) as model, 0.001e0 * (1 + event_id % 4) as declared_usd, 0.1e0 as tolerance, 500 + event_id % 900 as input_tokens, user_id * 10 as output_tokens from {events}"


@query("cost_drift", f"select event_id, round((input_tokens * (case model when 'm0' then 0.8e0 else 3 end) + output_tokens * (case model when 'm0' then 2e0 else 15 end)) / 1e6, 9) as realized_usd from ({_CALLS}) where (input_tokens * (case model when 'm0' then 0.8e0 else 3 end) + output_tokens * (case model when 'm0' then 2e0 else 15 end)) / 1e6 / declared_usd > 1 + tolerance")
def _(spark, d):
    prices = spark.sql("select * from values ('m0', 0.8D, 2D), ('m1', 3D, 15D) as p(model, input_usd, output_usd)")
    return rep.cost_drift(sql(spark, d, _CALLS), prices).select("event_id", F.round("realized_usd", 9).alias("realized_usd"))


@query("run_cost", "select cast(user_id as string) as run_id, round(count(*) * 1e-6, 9) as compute_usd, round(sum(value / 1000), 6) as llm_usd, cast(sum(event_id % 3) as bigint) as data_reads, cast(sum(length(props)) as bigint) as storage_bytes from {events} group by 1")
def _(spark, d):
    nodes = view(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), (F.col("value") / 1000).alias("llm_usd"), (F.col("event_id") % 3).alias("reads"), F.length("props").alias("bytes"))
    out = rep.run_cost(nodes)
    return out.select("run_id", F.round("compute_usd", 9).alias("compute_usd"), F.round("llm_usd", 6).alias("llm_usd"), "data_reads", "storage_bytes")


@query("canonical_digest", "select event_id, SHA('{\"event\":' || cast(event_id as string) || ',\"props\":{\"k\":' || cast(json_extract(props, '$.k') as string) || '},\"type\":\"' || event_type || '\"}') as digest from {events}".replace('{"event', '{"event'))
def _(spark, d):
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit(', "event": '), F.col("event_id").cast("string"), F.lit(', "prev": 1}'))
    return view(spark, d, "events").select("event_id", can.canonical_digest(text, ("prev",)).alias("digest"))


def _spec_bodies(spark, d):
    """Spec documents from documents, with circles, unknown inputs and repeated nodes among them."""
    second = F.when(F.col("doc_id") % 7 == 0, '{"id":"b","op":"mean","inputs":["b"]}').when(F.col("doc_id") % 5 == 0, '{"id":"b","op":"mean","inputs":["zz"]}').when(F.col("doc_id") % 11 == 0, '{"id":"a","op":"mean","inputs":["a"]}').otherwise('{"id":"b","op":"mean","inputs":["a"]}')
    body = F.concat(F.lit('{"schema_version":1,"name":"s'), (F.col("doc_id") % 50).cast("string"), F.lit('","graph":{"nodes":['), second, F.lit(',{"id":"a","op":"literal","args":{"value":1},"inputs":[]}],"output":"a"},"deps":["'), F.sha2("text", 256), F.lit('"],"cost":{},"output_schema":{}}'))
    return view(spark, d, "documents").select("doc_id", body.alias("body"))


@query("spec_ids")
def _(spark, d):
    return _spec_bodies(spark, d).select("doc_id", can.spec_ids(F.col("body")).alias("s")).select("doc_id", "s.*")


@query("pattern_ids")
def _(spark, d):
    body = F.concat(F.lit('{"spec_ref":"'), F.sha2("spec_ref", 256), F.lit('","assertion":{"kind":"'), "kind", F.lit('"},"scope":{"kind":"all"},"observation_window":['), F.col("obs_t0").cast("string"), F.lit(","), F.col("obs_t1").cast("string"), F.lit('],"replication_protocol":{"window_count":'), F.col("window_count").cast("string"), F.lit("}}"))
    return view(spark, d, "patterns").select(F.col("pattern_id").alias("row"), can.pattern_ids(body).alias("p")).select("row", "p.*")


@query("prompt_params_hash", "select conv_id, turn, SHA(text) as prompt_hash, SHA('{\"model\":\"' || role || '\",\"params\":{\"n\":' || cast(turn as string) || '}}') as params_hash from {conversations}")
def _(spark, d):
    params = F.concat(F.lit('{"n":'), F.col("turn").cast("string"), F.lit("}"))
    return view(spark, d, "conversations").select("conv_id", "turn", can.prompt_hash(F.col("text")).alias("prompt_hash"), can.params_hash(F.col("role"), params).alias("params_hash"))


_BODIES = "select SHA(cast(o_custkey as string)) as spec_id, case when o_custkey % 9 = 0 then o_orderpriority else 'body' end as body, o_orderkey from {orders}"


@query("dedup_registry", f"select spec_id, any_value(body) as body from ({_BODIES}) group by 1 having count(distinct body) = 1 and not bool_or(o_orderkey % 50 = 0)")
def _(spark, d):
    rows = sql(spark, d, _BODIES)
    return can.register(rows, rows.where("o_orderkey % 50 = 0").select("spec_id", "body").distinct())[0]

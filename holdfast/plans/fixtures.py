"""Input shapes derived from the driver tables, by one expression for Spark and for DuckDB.

Times are epoch seconds in UTC (BIGINT). A view is SQL over base tables and other views, which it names in
braces; ``SHA`` and ``EPOCH`` stand for the functions that the two engines spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DAY = 86400
START = 1704067200  # 2024-01-01

VIEWS = {
    "fetched": f"""select doc_id, SHA(text) as hash, text, source as source_id, lang,
        {START} + (doc_id % 30) * {DAY} as vendor_timestamp, {START} + (doc_id % 30) * {DAY} + 3600 as fetch_time from {{documents}}""",
    "provenance": "select distinct hash, source_id, fetch_time, vendor_timestamp from {fetched}",
    "corrections": """select distinct correction_hash, original_hash from (
        select hash as original_hash, lead(hash) over (partition by source_id order by doc_id) as correction_hash from {fetched})
        where correction_hash is not null and correction_hash <> original_hash""",
    "read_requests": f"""select lang as cycle_id, doc_id as seq, {START} + 14 * {DAY} as query_time,
        case doc_id % 4 when 0 then 'provenance' when 1 then 'corrections' else 'get' end as kind,
        case when doc_id % 11 = 0 then '{"0" * 64}' else hash end as hash from {{fetched}}""",
    "series": """select event_type as spec_ref, cast(user_id as string) as entity, EPOCH(ts) as t, value, event_id,
        SHA(cast(cast(floor(event_id / 50) as bigint) as string)) as source_hash from {events}""",
    "bars": "select spec_ref, cast(floor(t / 3600) as bigint) * 3600 as t, avg(value) as value from {series} group by 1, 2",
    "patterns": f"""select SHA(spec_ref || ':' || kind) as pattern_id, spec_ref, kind, 0.0 * 1e0 as lo, 150.0 * 1e0 as hi, 0.5e0 as p, 40.0 * 1e0 as threshold,
        cast(1 as int) as expected_sign, cast({START} as bigint) as obs_t0, cast({START + 3 * DAY} as bigint) as obs_t1,
        cast({START + 3 * DAY} as bigint) as search_t0, cast({START + 30 * DAY} as bigint) as search_t1, cast({DAY} as bigint) as window_seconds,
        cast({DAY} as bigint) as step_seconds, cast(7 as bigint) as window_count, cast(3600 as bigint) as gap_seconds, 0.7e0 as pass_threshold,
        0.5e0 as partition_pass_threshold, 0.05e0 as band
        from (select distinct event_type as spec_ref from {{events}}) cross join (values ('in_range'), ('quantile_ge'), ('sign')) as k(kind)""",
    "reservations": f"""select 'p' || cast(o_custkey % 50 as string) as pattern_id, case when o_orderkey % 2 = 0 then 'Discover' else 'EmpiricalTest' end as stage,
        EPOCH(o_orderdate) as t0, EPOCH(o_orderdate) + (o_orderkey % 5) * {DAY} as t1, 'c' || cast(o_orderkey % 7 as string) as cycle_id, o_orderkey as created from {{orders}}""",
    "window_requests": f"""select o_orderkey as request_id, 'p' || cast(o_custkey % 50 as string) as pattern_id,
        case when o_orderkey % 3 = 0 then 'Discover' else 'EmpiricalTest' end as stage, EPOCH(o_orderdate) + 2 * {DAY} as t0,
        EPOCH(o_orderdate) + 2 * {DAY} + (o_orderkey % 3) * 3600 as t1, 'r' as cycle_id from {{orders}}""",
    "llm_cache": """select 'm' || cast(doc_id % 3 as string) as model_id, hash as prompt_hash, SHA('params') as params_hash, hash as bytes_hash, fetch_time as first_written
        from {fetched} where doc_id % 2 = 0""",
    "steps": """select user_id as cycle_id, row_number() over (partition by user_id order by ts, event_id) as step, event_type as kind, value / 1000 as reserved_usd,
        value / 1000 * (0.5e0 + (event_id % 3) * 0.4e0) as realized_usd, event_id from {events}""",
    "votes": """select cast(floor(vec_id / 5) as bigint) as pattern_id, 'm' || cast(vec_id % 5 as string) as member, case when label % 2 = 0 then 'approve' else 'reject' end as vote,
        embedding, 'g' || cast(vec_id % 5 % 3 as string) as independence_group from {embeddings}""",
    "phrases": """select conv_id * 1000 + turn as seq, text from {conversations} where role = 'user'
        union all select 900000000 + e.event_id * 100 + p.k as seq, p.text from {events} e cross join (values
          (1, 'What about momentum?'), (2, 'Compute that on a different window.'), (3, '  '), (4, 'Try to break this claim'), (5, 'focus on value stocks'),
          (6, 'Please compute the summary'), (7, 'hello there'), (8, 'look at   earnings reports')) as p(k, text)""",
}


def _spell(sql: str, duck: bool) -> str:
    """SHA and EPOCH, whose arguments may hold brackets, in the engine's own functions."""
    for name, spark, own in (("SHA", "sha2({}, 256)", "sha256({})"), ("EPOCH", "unix_seconds(cast({} as timestamp))", "cast(floor(epoch({})) as bigint)")):
        while (at := sql.find(name + "(")) >= 0:
            depth, end = 1, at + len(name) + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[:at] + (own if duck else spark).format(sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables and views that ``text`` names in braces."""
    return spark.sql(_spell(text, False), **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def oracle(text: str) -> str:
    """``text`` for DuckDB, with the views it names in braces as common tables."""
    order: list[str] = []

    def need(part: str) -> None:
        for n in re.findall(r"\{(\w+)\}", part):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda part: _spell(re.sub(r"\{(\w+)\}", r"\1", part), True)
    head = ", ".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not head:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"

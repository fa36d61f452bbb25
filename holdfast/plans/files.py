"""Queries over sources, sinks and streams: each writes what it is given and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from holdfast.functions.tables import shared_dir, written
from holdfast.operators import audit
from holdfast.plans.cycles import _to_append
from holdfast.plans.fixtures import DAY, START, oracle, sql, view
from holdfast.plans.reads import _raw_fetches
from holdfast.sources import tables
from holdfast.streaming import jobs

Q: dict = {}
SQL: dict = {}


def query(name: str, oracle_text: str | None = None):
    def keep(f):
        Q[name] = f
        if oracle_text:
            SQL[name] = oracle(oracle_text)
        return f

    return keep


def _place(spark) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


@query("read_raw_fetches", "select cast(doc_id as string) as entity_id, cast(1 as int) as n_headers, fetch_time from {fetched}")
def _(spark, d):
    rows = _raw_fetches(spark, d).join(view(spark, d, "fetched").select("doc_id", "fetch_time"), "doc_id")
    at = _place(spark)
    rows.select(F.col("doc_id").cast("string").alias("entity_id"), F.lit("u").alias("url"), F.lit(200).alias("status"), "headers", F.encode("body", "UTF-8").alias("body"), "fetch_time").write.parquet(at)
    return tables.read_raw_fetches(spark, at).select("entity_id", F.size("headers").alias("n_headers"), "fetch_time")


@query("blob_layout", f"select hash, substr(hash, 1, 2) as prefix, cast(floor(fetch_time / {DAY}.0) as bigint) as day, cast(strlen(text) as bigint) as bytes from (select hash, min(fetch_time) as fetch_time, any_value(text) as text from {{fetched}} group by 1)")
def _(spark, d):
    at = _place(spark)
    one = view(spark, d, "fetched").groupBy("hash").agg(F.min("fetch_time").alias("first_seen"), F.min("text").alias("content"))
    tables.write_blobs(one, at)
    return tables.read_blobs(spark, at).select("hash", "prefix", F.unix_date("day").cast("long").alias("day"), F.octet_length("content").cast("long").alias("bytes"))


@query("index_tables", "select * from {provenance}")
def _(spark, d):
    rows, at = view(spark, d, "provenance"), _place(spark)
    tables.append_index(rows.where("vendor_timestamp % 172800 < 86400"), at, tables.PROVENANCE)
    return tables.append_index(rows.where("vendor_timestamp % 172800 >= 86400"), at, tables.PROVENANCE)


@query("corrections_table", "select correction_hash, original_hash from {corrections}")
def _(spark, d):
    return tables.append_index(view(spark, d, "corrections"), _place(spark), tables.CORRECTIONS)


@query("cache_table", "select model_id, prompt_hash, params_hash, bytes_hash, first_written from {llm_cache}")
def _(spark, d):
    return tables.append_index(view(spark, d, "llm_cache"), _place(spark), tables.CACHE)


@query("reservation_table", "select distinct pattern_id, stage, t0, t1, cycle_id from {reservations}")
def _(spark, d):
    return tables.write_reservations(view(spark, d, "reservations").select("pattern_id", "stage", "t0", "t1", "cycle_id").distinct(), _place(spark))


_LINES = "select event_id as seq, EPOCH(ts) as ts, '{\"event\":' || cast(event_id as string) || '}' as line from {events}"


def _audit_lines(spark, d):
    line = F.concat(F.lit('{"event":'), F.col("seq").cast("string"), F.lit("}"))
    return sql(spark, d, "select event_id as seq, EPOCH(ts) as ts from {events}").withColumn("line", line)


@query("audit_write", f"select cast(floor(ts / {DAY}.0) as bigint) as day, line from ({_LINES})")
def _(spark, d):
    at = _place(spark)
    tables.write_audit(_audit_lines(spark, d), at)
    return tables.read_audit(spark, at).select(F.unix_date("day").cast("long").alias("day"), "line")


@query("audit_read", f"select cast(floor(ts / {DAY}.0) as bigint) as day, row_number() over (partition by cast(floor(ts / {DAY}.0) as bigint) order by seq) as line_no, line from ({_LINES})")
def _(spark, d):
    from pyspark.sql import Window

    at = _place(spark)
    tables.write_audit(_audit_lines(spark, d), at)
    number = F.row_number().over(Window.partitionBy("day").orderBy("file", "place"))
    return tables.read_audit(spark, at).select(F.unix_date("day").cast("long").alias("day"), number.cast("long").alias("line_no"), "line")


@query("assignment_roundtrip", "select distinct t, 'partition_' || cast(cast(floor(t / 25200) as bigint) % 3 as string) as partition_id from {bars}")
def _(spark, d):
    rows = sql(spark, d, "select distinct t, 'partition_' || cast(cast(floor(t / 25200) as bigint) % 3 as string) as partition_id from {bars}")
    return tables.load_assignment(written(tables.assignment_json(rows)))


def _events(spark, d):
    return jobs.read_files(spark, d, "events", view(spark, d, "events").schema).withColumn("at", F.col("ts").cast("timestamp"))



@query("stream_bars", """select event_type, t0, t0 + 21600 as t1, count(*) as n, round(avg(value), 9) as value from (select spec_ref as event_type, cast(floor(t / 21600.0) as bigint) * 21600 as t0, value from {series})
    where t0 + 21600 <= (select max(epoch(ts)) - 600 from {events}) group by 1, 2""")
def _(spark, d):
    at = _place(spark)
    jobs.run_once(jobs.bars(_events(spark, d), "event_type", "at", "value", "6 hours", "6 hours", "10 minutes"), f"{at}/out", f"{at}/log")
    return spark.read.parquet(f"{at}/out").withColumn("value", F.round("value", 9))


@query("stream_ingest_dedup", "select distinct SHA(props) as hash from {events}")
def _(spark, d):
    at = _place(spark)
    rows = jobs.ingest_dedup(_events(spark, d).select(F.sha2("props", 256).alias("hash"), "at"), "at", "1 hour")
    jobs.run_batches(rows, jobs.append_new(f"{at}/out", "hash string, at timestamp"), f"{at}/log")
    return spark.read.parquet(f"{at}/out/data").select("hash")


@query("stream_audit_append")
def _(spark, d):
    at = _place(spark)
    rows = _events(spark, d).select((F.col("user_id") % 20).cast("string").alias("log_id"), F.col("event_id").alias("seq"), F.unix_seconds("at").alias("ts"), F.concat(F.lit('{"props":'), "props", F.lit("}")).alias("payload"))
    jobs.run_batches(rows, jobs.audit_append(f"{at}/out"), f"{at}/log")
    return audit.stored_lines(spark, f"{at}/out").select("log_id", "seq", "prev_hash", "record_hash", "rejected")


@query("verify_continued", f"select log_id, day, count(*) as n, true as valid from (select cast(user_id % 20 as string) as log_id, cast(floor(EPOCH(ts) / 86400) as bigint) as day from {{events}}) group by 1, 2")
def _(spark, d):
    """The same records stored in three appends, each going on from the tails of the one before, and verified."""
    at = _place(spark)
    rows = _to_append(spark, d).withColumn("seq", F.col("ts") * 1000000 + F.col("seq"))
    third = F.floor((F.col("ts") - START) / (10 * DAY))
    for i in range(3):
        part = third <= i if i == 0 else third >= i if i == 2 else third == i
        audit.append_stored(rows.where(part), at, i)
    lines = audit.stored_lines(spark, at).where("not rejected").withColumnRenamed("seq", "line_no")
    return audit.verify_days(audit.check_digests(lines))

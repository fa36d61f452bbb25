"""Audit chains stored append by append, and sinks of streams, against plain forms and replays."""

import hashlib
import json

from pyspark.sql import functions as F

from holdfast.operators import audit, originality
from holdfast.streaming import jobs

BATCHES = [
    [("a", 1, 100, '{"category":"x"}'), ("a", 2, 90, '{"category":"late"}'), ("b", 3, 50, '{"n":1.5}')],
    [("a", 4, 100, '{"category":"y","z":{"k":[1,2]}}'), ("c", 5, 200000, '{"é":"ü"}')],
    [("a", 6, 99, '{"category":"before the last batch"}'), ("b", 7, 86400 * 3, '{"n":2}'), ("a", 8, 86400, '{"n":3}')],
]
KIND = "log_id string, seq long, ts long, payload string"


def chained(records):
    """seq -> (previous hash, own hash), both None if rejected."""
    tails, out = {}, {}
    for log, seq, ts, payload in sorted(records, key=lambda r: (r[0], r[1])):
        prev, last = tails.get(log, ("0" * 64, float("-inf")))
        if ts < last:
            out[seq] = (None, None)
            continue
        text = json.dumps({**json.loads(payload), "timestamp": ts, "prev_hash": prev}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        own = hashlib.sha256(text.encode()).hexdigest()
        out[seq], tails[log] = (prev, own), (own, ts)
    return out


WANT = chained([r for batch in BATCHES for r in batch])


def found(lines):
    return {r["seq"]: (r["prev_hash"], r["record_hash"]) for r in lines.collect()}


def test_appends_go_on_from_stored_tails(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    for i, batch in enumerate(BATCHES):
        audit.append_stored(spark.createDataFrame(batch, KIND), at, i)
    lines = audit.stored_lines(spark, at)
    assert found(lines) == WANT == found(audit.append_chain(spark.createDataFrame([r for b in BATCHES for r in b], KIND)))
    assert {s for s, h in WANT.items() if h[0] is None} == {2, 6} == {r["seq"] for r in lines.where("rejected").collect()}
    good = lines.where("not rejected").withColumnRenamed("seq", "line_no")
    assert all(r["valid"] for r in audit.verify_days(audit.check_digests(good)).collect())
    audit.append_stored(spark.createDataFrame(BATCHES[2], KIND), at, 2)  # again
    lines = audit.stored_lines(spark, at)
    assert found(lines) == WANT and lines.count() == len(WANT)
    good = lines.where("not rejected").withColumnRenamed("seq", "line_no")
    tails = {r["log_id"]: (r["tail_hash"], r["tail_ts"]) for r in audit.stored_tails(spark, at).collect()}
    assert tails == {"a": (WANT[8][1], 86400), "b": (WANT[7][1], 86400 * 3), "c": (WANT[5][1], 200000)}
    assert {r["log_id"]: (r["tail_hash"], r["tail_ts"], r["tail_day"]) for r in audit.chain_tail(good, logs=spark.createDataFrame([("a",), ("none",)], "log_id string")).collect()} == {"a": (WANT[8][1], 86400, 1), "none": ("0" * 64, None, None)}
    assert audit.stored_tails(spark, f"file://{tmp_path}/nowhere").count() == 0


def test_stream_of_three_batches_is_one_chain(spark, tmp_path):
    for batch in BATCHES:  # a file a run, so a batch a run, from one checkpoint
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_batches(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), jobs.audit_append(f"file://{tmp_path}/out"), f"{tmp_path}/log")
    assert found(audit.stored_lines(spark, f"file://{tmp_path}/out")) == WANT


def test_sink_reads_touched_folders_and_ignores_replays(spark, tmp_path):
    at = f"file://{tmp_path}/sink"
    sink = jobs.append_new(at, "hash string, n long")
    batch = lambda a, b: spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(), i) for i in range(a, b)] * 2, "hash string, n long")
    held = lambda: sorted(r["n"] for r in spark.read.parquet(f"{at}/data").collect())
    sink(batch(0, 300), 0)
    sink(batch(200, 400), 1)
    assert held() == list(range(400))
    sink(batch(200, 500), 1)  # a batch that is done comes again, whatever it holds
    assert held() == list(range(400))
    few = batch(390, 393).withColumn("prefix", F.substring("hash", 1, 2))
    digits = {r["prefix"] for r in few.collect()}
    scan = jobs.held_hashes(few, at, "hash string, n long", 2)
    plan = next(line for line in scan._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "prefix" in filters and all(d in filters for d in digits) and {r["prefix"] for r in scan.collect()} == digits
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/sink/batches/broken/_temporary")  # no finished batch
    (tmp_path / "sink/batches/1/_SUCCESS").unlink()  # broken off before its end
    sink(batch(200, 400), 1)
    assert held() == list(range(400))


def test_entries_of_unknown_kinds_and_none(spark):
    patterns = spark.createDataFrame([("p", "sign")], "pattern_id string, kind string")
    entries = spark.createDataFrame([(1, "x", "field_in", ["kind"], None, ["sign", "sign"]), (2, "y", "field_in", ["kind"], None, [])], "position int, anti_pattern_id string, matcher string, paths array<string>, projection_hash string, field_values array<string>")
    fields = {"kind": F.col("kind")}
    assert [tuple(r) for r in originality.matches(patterns, entries, fields).collect()] == [("p", 1, "x")]
    assert originality.matches(patterns, originality.clear_entries(entries), fields).count() == 0
    for wrong in (entries.withColumn("matcher", F.lit("other")), entries.withColumn("paths", F.array(F.lit("nowhere")))):
        try:
            originality.matches(patterns, wrong, fields)
        except ValueError as e:
            assert "unknown" in str(e)
        else:
            raise AssertionError

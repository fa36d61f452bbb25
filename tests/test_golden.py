"""Cases with known results, and properties under repeated and permuted input."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.functions import canonical, features
from holdfast.operators import audit, discovery, incremental, ingest, originality, partitions, patterns, pit, replication

DAY = 86400


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def one_value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,seconds", [("Thu, 23 Apr 2026 11:59:00 GMT", 1776945540), ("23 Apr 2026 11:59:00", 1776945540), ("Thu, 23 Apr 2026 13:59:00 +0200", 1776945540), ("nonsense", None)])
def test_http_dates(spark, text, seconds):
    assert one_value(spark, ingest.parse_http_date(F.lit(text))) == seconds


@pytest.mark.parametrize("raw,out", [(" 42 ", "0000000042"), ("12345678901", None), ("4x", None), ("", None)])
def test_entity_ids(spark, raw, out):
    assert one_value(spark, ingest.normalize_entity_id(F.lit(raw))) == out


def test_vendor_time_prefers_the_header_and_never_falls_back_from_a_bad_one(spark):
    body = '{"filings":{"recent":{"filingDate":["2026-04-20"]}}}'
    df = spark.createDataFrame([(1, {"LAST-modified": "Thu, 23 Apr 2026 11:59:00 GMT"}, body), (2, {}, body), (3, {"Last-Modified": "x"}, body), (4, {}, '{"filings":{"recent":{"filingDate":[]}}}')], "i int, h map<string,string>, b string")
    at, error = ingest.vendor_time(F.col("h"), F.col("b"))
    assert rows(df.select("i", at.alias("t"), F.coalesce(error, F.lit("")).alias("e")), "i", "e") == [(1, ""), (2, ""), (3, "bad header"), (4, "no vendor time")]
    assert rows(df.select("i", F.coalesce(at, F.lit(0)).alias("t")), "i", "t")[:2] == [(1, 1776945540), (2, 1776643200)]


def test_touching_windows_overlap(spark):
    held = spark.createDataFrame([("p", "Discover", 100, 200, "c")], "pattern_id string, stage string, t0 long, t1 long, cycle_id string")
    asked = spark.createDataFrame([(1, "p", "EmpiricalTest", 150, 300), (2, "p", "EmpiricalTest", 200, 300), (3, "p", "EmpiricalTest", 201, 300), (4, "q", "EmpiricalTest", 150, 300), (5, "p", "Discover", 150, 300)], "request_id long, pattern_id string, stage string, t0 long, t1 long").withColumn("cycle_id", F.lit("r"))
    for bucket in (7, 100, 10000):
        assert rows(pit.availability(asked, held, bucket), "request_id", "outcome") == [(1, "refused"), (2, "refused"), (3, "available"), (4, "available"), (5, "available")]


def test_budget_counts_successes_only(spark):
    attempts = spark.createDataFrame([("a", 1, "get", "unknown"), ("a", 2, "get", "ok"), ("a", 3, "provenance", "ok"), ("a", 4, "get", "ok"), ("b", 1, "get", "ok")], "cycle_id string, seq long, kind string, outcome string")
    assert rows(pit.read_budget(attempts, 2), "cycle_id", "seq", "outcome") == [("a", 1, "unknown"), ("a", 2, "ok"), ("a", 3, "ok"), ("a", 4, "rate_limited"), ("b", 1, "ok")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20)), min_size=1, max_size=12), st.integers(0, 20))
def test_admission_is_by_the_earliest_vendor_time(spark, triples, query_time):
    prov = spark.createDataFrame([(str(h), t) for h, t in triples], "hash string, vendor_timestamp long")
    asked = spark.createDataFrame([(str(h), query_time) for h in range(5)], "hash string, query_time long")
    earliest = {str(h): min(t for g, t in triples if g == h) for h, _ in triples}
    for r in pit.admissible(asked, prov).collect():
        e = earliest.get(r["hash"])
        assert r["outcome"] == ("unknown" if e is None else "ok" if e <= query_time else "future_denied")


def test_puts_are_idempotent(spark):
    new = spark.createDataFrame([("a" * 64, "s", 1, 1), ("a" * 64, "s", 1, 1), ("a" * 64, "t", 1, 1), ("b" * 64, " ", 1, 1)], "hash string, source_id string, fetch_time long, vendor_timestamp long")
    once = ingest.put_provenance(new)
    assert once.count() == 2 and ingest.put_provenance(new, once).count() == 0
    blobs = new.select("hash", F.col("fetch_time").alias("first_seen"), F.lit(1).alias("bytes_size"))
    held = ingest.put_blobs(blobs)
    assert held.count() == 2 and ingest.put_blobs(blobs, held).count() == 0


@pytest.mark.parametrize("values,holds", [([1.25, 2.5], True), ([1.25, 4.0], False), ([float("nan")], False), ([1.5, None], False)])
def test_in_range(spark, values, holds):
    df = spark.createDataFrame([(v,) for v in values], "value double")
    assert df.agg((patterns.usable(F.col("value")) & patterns.in_range(F.col("value"), F.lit(1), F.lit(3))).alias("x")).first()["x"] is holds


def test_empty_and_sign(spark):
    empty = spark.createDataFrame([], "value double")
    assert empty.agg(patterns.usable(F.col("value")).alias("x")).first()["x"] is False
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "value double")
    assert zeros.agg(patterns.sign(F.col("value"), F.lit(0)).alias("x")).first()["x"] is True


@pytest.mark.parametrize("n,threshold,need", [(0, 0.5, 1), (2, 0.5, 2), (3, 0.5, 2), (4, 1.0, 4), (10, 0.7, 7)])
def test_required_passes(spark, n, threshold, need):
    assert one_value(spark, replication.required_passes(F.lit(n), F.lit(threshold))) == need


def _pattern(spark, **more):
    base = {"pattern_id": "p" * 64, "spec_ref": "s", "kind": "quantile_ge", "lo": 0.0, "hi": 1.0, "p": 0.5, "threshold": 1.0, "expected_sign": 1, "obs_t0": 0, "obs_t1": 100, "search_t0": 100, "search_t1": 5 * DAY, "window_seconds": DAY, "step_seconds": DAY, "window_count": 2, "gap_seconds": DAY, "pass_threshold": 0.5, "partition_pass_threshold": 0.5, "band": 0.05}
    kinds = "pattern_id string, spec_ref string, kind string, lo double, hi double, p double, threshold double, expected_sign int, obs_t0 long, obs_t1 long, search_t0 long, search_t1 long, window_seconds long, step_seconds long, window_count long, gap_seconds long, pass_threshold double, partition_pass_threshold double, band double"
    return spark.createDataFrame([{**base, **more}], kinds)


NONE_HELD = "pattern_id string, stage string, t0 long, t1 long, cycle_id string"


def _report(spark, value, shared=False, controls=True, **more):
    p = _pattern(spark, **more)
    held = replication.select_heldout(replication.grid_windows(p), p).collect()
    points = [("s", 10, 1.5, "o"), ("s", 20, 2.0, "o")] + [("s", w["t0"] + 10 + i, value + i, "o" if shared else w["window_id"]) for w in held for i in range(3)]
    series = spark.createDataFrame(points, "spec_ref string, t long, value double, source_hash string")
    own = spark.createDataFrame([("p" * 64, w["window_id"], c, 0.0) for w in held for c in ("time_shuffled", "scope_randomized")], "pattern_id string, window_id string, control string, value double") if controls else None
    return replication.replication_report(p, series, spark.createDataFrame([], NONE_HELD), None, own).first()


def test_replication_report(spark):
    good = _report(spark, 2.0)
    assert good["verdict"] is True and good["windows"] == 2 and good["passes"] == 2 and good["observed"] is True
    assert _report(spark, 2.0, shared=True)["disjoint"] is False
    assert _report(spark, 2.0, controls=False)["time_shuffled"] is False  # order-free assertions survive a shuffle
    assert _report(spark, 0.0, threshold=1.0)["threshold_perturbed"] is False  # medians of 1 miss 1.05
    assert _report(spark, -9.0)["replicated"] is False


def test_partitions_of_two_levels(spark):
    bars = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, 0.0, 0.0, 10.0, 10.0, 10.0])], "spec_ref string, t long, value double")
    m = partitions.state_matrix(partitions.trailing_summaries(bars, 1), ["s"], ["last"])
    labels, centers = partitions.cluster(partitions.standardize(m), 2)
    got = partitions.partition_assignment(labels)
    assert rows(got, "t", "partition_id") == [(i, f"partition_{i // 3}") for i in range(6)]
    prints = partitions.partition_fingerprints(m, got, (0.0, 0.5, 1.0))
    assert rows(prints, "partition_id", "count", "centroid") == [("partition_0", 3, 0.0), ("partition_1", 3, 10.0)]
    assert len(centers) == 2 and got.count() == 6
    assert partitions.assignment_errors(got).first().asDict() == {"repeated_times": 0, "malformed": 0, "gaps": 0}


def test_rank_is_global_whatever_the_partitions(spark):
    from holdfast.functions.tables import with_rank

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["x"] == r["rank"] for r in with_rank(df.repartition(7), "x").collect())


def test_feature_graph(spark):
    graph = {"nodes": [{"id": "a", "op": "mean", "inputs": ["x"]}, {"id": "b", "op": "mean", "inputs": ["b"]}], "output": "a"}
    assert one_value(spark, features.compile_spec(graph, {"x": F.array(F.lit(1.0), F.lit(3.0))})) == 2.0
    with pytest.raises(ValueError, match="circle"):
        features.compile_spec({**graph, "output": "b"}, {"x": F.lit(1)})
    with pytest.raises(ValueError, match="placeholders"):
        features.render("{a} {b}", {"a": F.lit("x")})


def test_canonical_digest(spark):
    text = '{"b": 1, "a": {"d": "é", "c": [1, 2]}}'
    want = hashlib.sha256('{"a":{"c":[1,2],"d":"é"},"b":1}'.encode()).hexdigest()
    assert one_value(spark, canonical.canonical_digest(F.lit(text))) == want == canonical.digest(json.loads(text))
    assert one_value(spark, canonical.canonical_digest(F.lit("{bad"))) is None


@pytest.mark.parametrize("text,kind", [("What about momentum?", "flagged"), ("Compute that on a different window.", "tool_request"), ("", "flagged"), ("try to falsify it", "red_team_request"), ("hello", "flagged")])
def test_input_shapes(spark, text, kind):
    assert one_value(spark, discovery.classify(F.lit(text))[0]) == kind


def test_ledger_kills_before_the_first_call(spark):
    steps = spark.createDataFrame([("c", 1, 0.001, 0.0), ("c", 2, 0.0001, 0.0)], "cycle_id string, step long, reserved_usd double, realized_usd double")
    assert rows(discovery.budget_ledger(steps, 0.0005), "step", "status") == [(1, "killed"), (2, "not run")]


def test_chain_detects_any_change(spark):
    records = spark.createDataFrame([("l", i, i * 40000 - (10**6 if i == 3 else 0), json.dumps({"n": i})) for i in range(6)], "log_id string, seq long, ts long, payload string")
    made = audit.append_chain(records).cache()
    got = {r["seq"]: r for r in made.collect()}
    assert got[0]["prev_hash"] == audit.ZEROS and got[3]["rejected"] and got[4]["prev_hash"] == got[2]["record_hash"]
    lines = made.where("not rejected").join(records.select("seq", "ts"), "seq").select("log_id", F.floor(F.col("ts") / DAY).alias("day"), F.col("seq").alias("line_no"), "ts", "prev_hash", "record_hash", "line")
    assert all(r["valid"] for r in audit.verify_days(audit.check_digests(lines)).collect())
    broken = lines.withColumn("line", F.when(F.col("line_no") == 2, F.regexp_replace("line", '"n":2', '"n":9')).otherwise(F.col("line")))
    assert not audit.verify_range(audit.check_digests(broken), 0, 9).first()["valid"]


def test_originality(spark):
    p = spark.createDataFrame([("a", "k1", "s1"), ("b", "k2", "s1")], "pattern_id string, kind string, spec_ref string")
    fields = {"kind": F.col("kind"), "spec": F.col("spec_ref")}
    digest = p.where("pattern_id = 'a'").select(originality.projection(["spec", "kind"], fields).alias("h")).first()["h"]
    entries = spark.createDataFrame([(1, "ap1", ["kind", "spec"], digest), (2, "ap2", ["spec", "kind"], digest)], "position int, anti_pattern_id string, paths array<string>, projection_hash string")
    assert rows(originality.decisions(p, originality.matches(p, entries, fields)).na.fill(""), "pattern_id", "decision", "anti_pattern_id") == [("a", "reject", "ap1"), ("b", "pass", "")]
    with pytest.raises(ValueError):
        originality.projection(["nothing"], fields)


def test_changed_outputs_are_conflicts(spark):
    new = spark.createDataFrame([("f", "x"), ("g", "y"), ("h", "z")], "fingerprint string, output_hash string")
    old = spark.createDataFrame([("f", "w"), ("g", "y")], "fingerprint string, output_hash string")
    held = spark.createDataFrame([("x",), ("y",)], "hash string")
    assert rows(incremental.record(new, old, held), "fingerprint", "outcome") == [("f", "conflict"), ("g", "known"), ("h", "missing artifact")]


def test_spec_ids_are_digests_of_normal_forms(spark):
    nodes = [{"id": "b", "op": "mean", "inputs": ["a"]}, {"id": "a", "op": "literal", "args": {"value": 1}, "inputs": []}]
    body = {"schema_version": 1, "name": "é", "graph": {"nodes": nodes, "output": "b"}, "deps": ["2", "1", "2"], "cost": {}, "output_schema": {}}
    normal = '{"cost":{},"deps":["1","2"],"graph":{"nodes":[{"args":{"value":1},"id":"a","inputs":[],"op":"literal","version":"1"},{"id":"b","inputs":["a"],"op":"mean","version":"1"}],"output":"b"},"name":"é","output_schema":{},"schema_version":1}'
    own = hashlib.sha256(normal.encode()).hexdigest()
    circle = {**body, "graph": {"nodes": [{"id": "b", "op": "mean", "inputs": ["b"]}], "output": "b"}}
    cases = [(body, own, None), ({**body, "spec_id": own}, own, None), ({**body, "spec_id": "x"}, None, "other id"), ({**body, "more": 1}, None, "keys"), (circle, None, "circle"), ({**body, "graph": {"nodes": nodes, "output": "z"}}, None, "unknown output")]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _, _) in enumerate(cases)], "i int, body string").union(spark.createDataFrame([(6, None)], "i int, body string"))
    got = {r["i"]: tuple(r["s"]) for r in df.select("i", canonical.spec_ids(F.col("body")).alias("s")).collect()}
    assert [got[i] for i in range(6)] == [c[1:] for c in cases] and got[6][0] is None and got[6][1]


def test_pattern_ids_are_digests_with_versions(spark):
    body = {"spec_ref": "a" * 64, "assertion": {"kind": "sign"}, "scope": {"kind": "all"}, "observation_window": [0, 1], "replication_protocol": {"window_count": 7}}
    normal = '{"assertion":{"kind":"sign"},"observation_window":[0,1],"replication_protocol":{"window_count":7},"scope":{"kind":"all"},"spec_ref":"' + "a" * 64 + '","versions":{"assertion":"1","scope":"1"}}'
    own = hashlib.sha256(normal.encode()).hexdigest()
    cases = [(body, own, None), ({**body, "pattern_id": own}, own, None), ({**body, "pattern_id": "x"}, None, "other id"), ({**body, "spec_ref": "a"}, None, "spec or assertion"), ({**body, "assertion": {"kind": "none"}}, None, "spec or assertion")]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _, _) in enumerate(cases)], "i int, body string")
    got = {r["i"]: tuple(r["p"]) for r in df.select("i", canonical.pattern_ids(F.col("body")).alias("p")).collect()}
    assert [got[i] for i in range(5)] == [c[1:] for c in cases]

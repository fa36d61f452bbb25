"""Point values, declared lineage and streamed digests of windows against plain forms."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import canonical
from holdfast.operators import discovery, replication
from tests.test_golden import _pattern

P = "p" * 64
WINDOWS = [(P, "a", 0, 10), (P, "b", 10, 20), (P, "c", 50, 60)]
POINTS = [("s", 1, 2.5, "f" * 64), ("s", 1, 4.0, "e" * 64), ("s", 10, 7.0, None), ("s", 17, float("nan"), None), ("s", 19, 1e-7, "e" * 64)]


def tables(spark):
    windows = spark.createDataFrame(WINDOWS, "pattern_id string, window_id string, t0 long, t1 long")
    return windows, spark.createDataFrame(POINTS, "spec_ref string, t long, value double, source_hash string")


def test_points_are_as_of_and_in_scope(spark):
    windows, series = tables(spark)
    p = _pattern(spark, step_seconds=5)
    got = {(r["window_id"], r["t"]): r["value"] for r in replication.point_values(series.where("not isnan(value)"), windows, p, bucket=7).collect()}
    want = {(w, t): next((v for _, u, v, _ in sorted((x for x in POINTS if x[2] == x[2]), key=lambda x: (-x[1], -x[2])) if u <= t), None) for _, w, t0, t1 in WINDOWS for t in range(t0, t1 + 1, 5)}
    assert got == want and got[("a", 0)] is None and got[("a", 5)] == 4.0
    scoped = p.withColumns({"scope_kind": F.lit("time_range"), "scope_t0": F.lit(10), "scope_t1": F.lit(15)})
    assert sorted((r["window_id"], r["t"]) for r in replication.point_values(series, windows, scoped).collect()) == [("a", 10), ("b", 10), ("b", 15)]
    long = replication.point_values(series, windows, _pattern(spark).withColumn("step_seconds", F.lit(None).cast("long")))
    assert sorted(r["t"] for r in long.collect()) == [0, 10, 10, 20, 50, 60]
    assert replication.point_values(series.limit(0), windows, p).where("value is not null").count() == 0


def test_declared_deps_stand_in_for_missing_hashes(spark):
    windows, series = tables(spark)
    p = _pattern(spark)
    values = replication.window_values(series, windows, p)
    deps = spark.createDataFrame([("s", "d" * 64), ("s", "d" * 64), ("t", "0" * 64)], "spec_ref string, hash string")
    got = sorted((r["window_id"], r["hash"][0]) for r in replication.window_lineage(values, windows, p, deps).collect())
    assert got == [("a", "e"), ("a", "f"), ("b", "e"), ("c", "d")]
    with pytest.raises(Exception, match="neither source hashes"):
        replication.window_lineage(values, windows, p, deps.where("spec_ref = 't'")).collect()


@pytest.mark.parametrize("kind,args", [("in_range", ["lo", "hi"]), ("quantile_ge", ["p", "threshold"]), ("sign", ["expected_sign"])])
def test_fingerprints_are_digests_of_whole_records(spark, kind, args):
    windows, series = tables(spark)
    p = _pattern(spark, kind=kind)
    values = replication.window_values(series, windows, p)
    verdicts = replication.window_verdicts(values, windows, p)
    row = p.first().asDict()
    passed = {r["window_id"]: r["passed"] for r in verdicts.collect()}
    got = {r["window_id"]: r["fingerprint"] for r in replication.window_fingerprints(values, verdicts, replication.window_lineage(values), windows, p).collect()}
    for _, w, t0, t1 in WINDOWS:
        mine = [x for x in POINTS if t0 <= x[1] <= t1]
        v = np.array([x[2] for x in mine if x[2] == x[2]])
        summary = {"dtype": "float64", "shape": [len(mine)], "size": len(mine), "numeric": True, "finite_count": len(v)}
        if len(v):
            summary |= {k: round(float(x), 12) for k, x in (("min", v.min()), ("max", v.max()), ("mean", v.mean()), ("q50", np.median(v)))}
        record = {"spec_ref": "s", "assertion": {"kind": kind, "args": {a: row[a] for a in args}}, "window": {"window_id": w, "t0": t0, "t1": t1}, "result": passed[w], "summary": summary, "lineage_hashes": sorted({x[3] for x in mine if x[3]})}
        assert got[w] == canonical.digest(record)


def test_trace_hash_keeps_nulls_and_odd_text(spark):
    calls = [(c, i, "cheap", "compute", None, "é\n\"", "ok") for c in (None, 1, 2) for i in (3, 1, 2)]
    df = spark.createDataFrame(calls, "cycle_id long, step_index long, phase string, tool_name string, args_hash string, result_hash string, outcome string")
    names = df.columns[1:]
    want = hashlib.sha256(json.dumps([dict(zip(names, c[1:])) for c in sorted(calls[:3], key=lambda c: c[1])], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert {r["cycle_id"]: r["trace_hash"] for r in discovery.trace_hash(df).collect()} == {None: want, 1: want, 2: want}
    assert discovery.trace_hash(df.limit(0)).count() == 0


def test_members_of_dependent_pairs_count_once(spark):
    from holdfast.operators import council

    votes = spark.createDataFrame([(p, m, "approve", e, m) for p in (1, 2) for m, e in (("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])) if (p, m) != (2, "c")], "pattern_id int, member string, vote string, embedding array<double>, independence_group string")
    folded = council.regrouped(votes, council.independence(votes), 0.1)
    assert {r["member"]: r["independence_group"] for r in folded.collect()} == {"a": "a", "b": "a", "c": "c"}
    assert {r["pattern_id"]: (r["approving_groups"], r["archived"]) for r in council.decisions(folded).collect()} == {1: (2, True), 2: (1, False)}
    assert council.regrouped(votes.limit(0), council.independence(votes.limit(0)), 0.1).count() == 0

"""Axes of statistics, output schemas, and protocols against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import features as fn
from holdfast.operators import features as rep
from holdfast.operators import partitions, pit, replication

X = np.array([[1.0, 2.0, 4.0], [8.0, 16.0, 33.0]])


@pytest.mark.parametrize("axis", [None, 0, 1, -1])
@pytest.mark.parametrize("keep", [False, True])
def test_axes(spark, axis, keep):
    df = spark.createDataFrame([(X.tolist(),)], "x array<array<double>>")
    args = {"dims": 2, "axis": axis, "keepdims": keep}
    for name, plain in (("mean", np.mean), ("sum", np.sum)):
        got = df.select(fn.OPS[name].build(args, F.col("x"))).first()[0]
        assert np.allclose(got, plain(X, axis=axis, keepdims=keep)) and np.shape(got) == np.shape(plain(X, axis=axis, keepdims=keep))
    z = df.select(fn.OPS["z_score"].build(args, F.col("x"))).first()[0]
    assert np.allclose(z, (X - X.mean(axis, keepdims=True)) / X.std(axis, keepdims=True))


def test_unknown_axes_are_errors():
    with pytest.raises(ValueError):
        fn.reduced(F.lit(1), fn.mean, 1, 1)


def test_output_schemas(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0], [2.0]]), (3, [[1.0, 2.0], [3.0]])], "id int, value array<array<double>>")
    errors = lambda *a, **k: {r["id"]: r["errors"] for r in rep.schema_errors(df, *a, **k).collect()}
    assert errors("n", "n") == {2: ["size n"], 3: ["ragged"]}
    assert errors(2, "m") == {3: ["ragged"]}
    assert set(errors(None, None, dtype="float")) == {1, 2, 3}


def test_more_windows_than_there_are_is_an_error(spark):
    p = spark.createDataFrame([("p", '[{"t0":0,"t1":1}]', 2)], "pattern_id string, windows string, window_count long")
    with pytest.raises(Exception, match="window_count"):
        replication.select_heldout(replication.fixed_windows(p).select("pattern_id", "t0", "t1"), p).collect()


def test_protocol_is_part_of_the_choice(spark):
    c = spark.createDataFrame([("p", i, i + 1) for i in range(50)], "pattern_id string, t0 long, t1 long")
    pick = lambda protocol: {r["t0"] for r in replication.select_heldout(c, spark.createDataFrame([("p", 5, protocol)], "pattern_id string, window_count long, protocol_json string")).collect()}
    import hashlib

    one = r'{"kind":"$1\\grid"}'
    want = sorted(range(50), key=lambda t: hashlib.sha256(f'{{"pattern_id":"p","replication_protocol":{one},"window":{{"t0":{t},"t1":{t + 1}}}}}'.encode()).hexdigest())[:5]
    assert pick(one) == set(want) and pick("{}") != pick(one)


def test_provenance_counts_without_pairs(spark):
    rng = np.random.default_rng(4)
    triples = [("h", int(t)) for t in rng.integers(0, 500, 200)] + [("g", None)]
    asked = [(i, str(rng.choice(["h", "g", "none"])), int(t)) for i, t in enumerate(rng.integers(-50, 600, 60))] + [(100, None, 5)]
    got = {r["seq"]: (r["returned"], r["suppressed"]) for r in pit.visible_provenance(spark.createDataFrame(asked, "seq long, hash string, query_time long"), spark.createDataFrame(triples, "hash string, vendor_timestamp long"), bucket=50).collect()}
    assert got == {s: (sum(x == h and t is not None and t <= q for x, t in triples), sum(x == h and t is not None and t > q for x, t in triples)) for s, h, q in asked}


def test_latest_values_carry_over_buckets(spark):
    points = [("a", 5, 1.0), ("a", 5, 2.0), ("a", 130, None), ("a", 131, 7.0), ("b", 400, 3.0)]
    grid = spark.createDataFrame([(t,) for t in (0, 5, 100, 130, 131, 500)], "t long")
    got = {(r["spec_ref"], r["t"]): r["value"] for r in partitions.latest_on_grid(spark.createDataFrame(points, "spec_ref string, t long, value double"), grid, bucket=60).collect()}
    assert got == {("a", 0): None, ("a", 5): 2.0, ("a", 100): 2.0, ("a", 130): 2.0, ("a", 131): 7.0, ("a", 500): 7.0, **{("b", t): None for t in (0, 5, 100, 130, 131)}, ("b", 500): 3.0}

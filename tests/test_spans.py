"""Windows answered from blocks of a series, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions.spans import window_orders
from holdfast.operators import discovery


@pytest.mark.parametrize("block_rows", [9, 1000])
def test_windows_of_any_length_in_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    points = [(f"s{rng.integers(0, 3)}", int(rng.integers(0, 60)), float(rng.integers(-9, 9)) / 4) for _ in range(300)]
    points += [("s0", 5, None), ("s1", 30, float("nan")), ("s2", 50, float("inf")), ("s0", None, 1.0), (None, 3, 1.0)] + [("s3", 7, 1.0)] * 40
    windows = [(i, f"s{rng.integers(0, 5)}", int(a), int(a + rng.integers(-2, 50)), float(rng.integers(-9, 9)) / 4) for i, a in enumerate(rng.integers(-5, 65, 200))] + [(200, "s3", 7, 7, 1.0), (201, "s3", 0, 9, None)]
    frame = spark.createDataFrame(points, "spec string, t long, value double")
    asked = spark.createDataFrame(windows, "id long, spec string, t0 long, t1 long, bound double")
    got = {r["id"]: tuple(r)[1:] for r in window_orders(frame, asked, "spec", block_rows).collect() if r["n"]}
    want = {}
    for i, spec, t0, t1, bound in windows:
        inside = [v for s, t, v in points if s == spec and t is not None and t0 <= t <= t1]
        v = sorted(x for x in inside if x is not None and np.isfinite(x))
        less = [x for x in v if bound is None or x < bound]
        if inside:
            want[i] = (len(inside), len(inside) - len(v), v[0] if v else None, v[-1] if v else None, len(less), less[-1] if less else None, v[len(less)] if len(less) < len(v) else None)
    assert got == want and len(want) > 100


def test_drafts_of_one_step_are_tested_each(spark):
    series = spark.createDataFrame([("s", t, float(t)) for t in range(10)], "spec_ref string, t long, value double")
    rows = [(1, 1, "in_range", 0.0, 4.0, 0, 4), (1, 1, "in_range", 0.0, 4.0, 0, 5), (1, 2, "quantile_ge", None, 2.5, 0, 5), (1, 3, "quantile_ge", None, 2.6, 0, 5), (1, 4, "sign", None, None, 1, 3), (1, 5, "sign", None, None, 0, 3), (1, 6, "other", 0.0, 9.0, 0, 3), (1, 7, "in_range", 0.0, 99.0, 20, 30)]
    drafts = spark.createDataFrame(rows, "cycle_id long, step long, kind string, lo double, hi double, t0 long, t1 long").withColumns({"spec_ref": F.lit("s"), "p": F.lit(0.5), "threshold": F.col("hi"), "expected_sign": F.lit(1), "assertion": F.lit("{}")})
    got = discovery.test_assertions(drafts, series, block_rows=3)
    assert sorted((r["step"], r["n"]) for r in got.collect()) == [(1, 5), (2, 6), (4, 3)]

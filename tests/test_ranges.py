"""Keyed prefix sums, trailing windows, exact quantiles and interval joins on keys of all rows, against plain forms."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions import intervals, quantiles, ranges
from holdfast.operators import discovery, incremental, partitions, patterns, pit, replication

ROWS = 3000


def one_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 10 else f"k{i % 30}", i * 7 % ROWS, rng.randrange(5)) for i in range(ROWS)] + [(None, i, 1) for i in range(5)]
    return spark.createDataFrame(rows, "k string, seq long, v long").repartition(7), rows


def sums_of(rows):
    out, total = {}, {}
    for k, seq, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total[k] = total.get(k, 0) + v
        out[k, seq] = total[k]
    return out


@pytest.mark.parametrize("key_rows", [10, 100_000])
def test_running_sums(spark, key_rows):
    df, rows = one_key(spark)
    want = sums_of(rows)
    got = ranges.running_sums(df, ["k"], ["seq"], {"s": "v", "n": "1"}, key_rows).collect()
    assert len(got) == len(rows) and all(r["s"] == want[r["k"], r["seq"]] for r in got)
    assert max(r["n"] for r in got if r["k"] == "hot") == ROWS * 9 // 10
    assert ranges.running_sums(df.limit(0), ["k"], ["seq"], {"s": "v"}, key_rows).count() == 0


def test_one_key_spreads_over_all_ranges(spark):
    df, _ = one_key(spark)
    placed = ranges.ranged(df.where("k = 'hot'"), ["k"], ["seq"])
    sizes = [r["count"] for r in placed.groupBy(ranges.PART).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.6 * sum(sizes) / 4
    own = ranges.running(placed, ["k"], {"s": "v"})
    plan = own._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__place" in line]
    assert windows and all("[__part" in line for line in windows)  # no window over a key alone sees the rows


@pytest.mark.parametrize("key_rows", [50, 100_000])
def test_budgets_of_one_cycle(spark, key_rows):
    rng = random.Random(5)
    tries = [("c" if i % 9 else "d", i, rng.choice(["get", "provenance"]), rng.choice(["ok", "unknown"])) for i in range(2000)]
    used, want = Counter(), {}
    for c, i, kind, outcome in tries:
        cost = kind != "get" or outcome == "ok"
        limited = used[c] >= 700
        used[c] += cost and not limited
        want[i] = ("rate_limited" if limited else outcome, used[c])
    log = pit.access_log(spark.createDataFrame(tries, "cycle_id string, seq long, kind string, outcome string").repartition(5), 700, key_rows)
    assert {r["seq"]: (r["outcome"], r["reads_used"]) for r in log.collect()} == want
    steps = [("c" if i % 9 else "d", i, 0.25, 0.25 * rng.randrange(3)) for i in range(2000)]
    left, dead, status = {"c": 300.0, "d": 30.0}, set(), {}
    cap = 30.0
    left = {"c": cap, "d": cap}
    for c, i, reserved, realized in steps:
        if c in dead:
            status[i] = "not run"
        elif reserved > left[c] or max(0, realized - reserved) > left[c]:
            status[i] = "killed"
            dead.add(c)
        else:
            status[i] = "ok"
            left[c] -= realized
    out = discovery.budget_ledger(spark.createDataFrame(steps, "cycle_id string, step long, reserved_usd double, realized_usd double"), cap, key_rows)
    assert {r["step"]: r["status"] for r in out.collect()} == status
    charges = spark.createDataFrame([("i", "s", i, 0.5, 0.25, 1) for i in range(900)], "invocation_id string, stage_name string, seq long, compute_usd double, llm_usd double, data_reads long")
    ceilings = spark.createDataFrame([("s", 400.0, 150.0, 5000)], "stage_name string, max_compute_usd double, max_llm_usd double, max_data_reads long")
    assert [tuple(r) for r in incremental.cost_ceilings(charges, ceilings, key_rows).collect()] == [("i", 600, "llm_usd")]


@pytest.mark.parametrize("key_rows, n", [(16, 5), (16, 40), (100_000, 5), (1, 1)])
def test_trailing_summaries_of_long_series(spark, key_rows, n):
    rng = np.random.default_rng(2)
    series = {"a": rng.normal(size=700), "b": rng.normal(size=3)}
    bars = spark.createDataFrame([(s, i * 60, float(x)) for s, v in series.items() for i, x in enumerate(v)], "spec_ref string, t long, value double").repartition(6)
    got = partitions.trailing_summaries(bars, n, key_rows).collect()
    assert len(got) == 703
    for r in got:
        v = series[r["spec_ref"]][max(0, r["t"] // 60 - n + 1) : r["t"] // 60 + 1]
        assert np.allclose([r[c] for c in partitions.STATS], [v.mean(), v.std(), v.min(), v.max(), v[-1], v[-1] - v[0]], atol=1e-12)


@pytest.mark.parametrize("group_rows", [5, 100_000])
def test_quantiles_of_one_group(spark, group_rows):
    rng = random.Random(1)
    groups = {"all": [rng.choice([0.0, 1.5, rng.random() * 9]) for _ in range(2500)], "few": [3.0, -1.0, 2.0], "one": [7.0], "same": [4.0] * 40, "null": [None, None, 5.0]}
    ps = (0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0)
    values = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, value double").repartition(5)
    asked = quantiles.at_each(spark.createDataFrame([(g,) for g in [*groups, "none"]], "g string"), ps)
    got = {(r["g"], r["p"]): r["quantile"] for r in quantiles.group_quantiles(values, ["g"], asked, group_rows).collect()}
    want = {(r["g"], p): r[f"q{i}"] for r in values.groupBy("g").agg(*[F.percentile("value", F.lit(p)).alias(f"q{i}") for i, p in enumerate(ps)]).collect() for i, p in enumerate(ps)}
    assert got == want
    assert all(math.isclose(got["all", p], float(np.quantile(groups["all"], p)), abs_tol=1e-9) for p in ps)


def test_quantiles_reach(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", 1.0), ("b", float("nan")), ("c", 5.0), ("d", None)]
    values = spark.createDataFrame(rows, "g string, value double")
    for group_rows in (10, 1000):
        got = {r["g"]: r["holds"] for r in patterns.quantiles_reach(values, ["g"], 0.4, 40.0, group_rows).collect()}
        assert got == {"a": True, "b": False, "c": False, "d": False}
        assert patterns.quantiles_reach(values, ["g"], 0.4, 40.1, group_rows).where("holds").count() == 0


WINDOWS = [(0, 3599), (1, 0), (5, 5), (-7200, 3600), (-3600 * 9 - 1, -1), (0, 315_360_000), (86_400, 86_400 + 7 * 86_400), (3600, 7199), (-315_360_000, 315_360_000), (None, 5), (9, None)]


def test_points_meet_their_windows_once(spark):
    rng = random.Random(4)
    times = [t for a, b in WINDOWS if a is not None and b is not None for t in (a - 1, a, a + 1, b - 1, b, b + 1)] + [rng.randrange(-400_000_000, 400_000_000) for _ in range(300)]
    points = spark.createDataFrame([(i, "k" if i % 3 else "j", t) for i, t in enumerate(times)] + [(-1, "k", None)], "id long, k string, t long")
    windows = spark.createDataFrame([(i, "k" if i % 2 else "j", a, b) for i, (a, b) in enumerate(WINDOWS)], "w long, k string, t0 long, t1 long")
    want = Counter((i, w) for i, t in enumerate(times) for w, (a, b) in enumerate(WINDOWS) if a is not None and b is not None and (bool(i % 3) == bool(w % 2)) and a <= t <= b)
    for small in (True, False):
        got = intervals.points_in_windows(points, windows, ["k"], 3600, small=small)
        assert Counter((r["id"], r["w"]) for r in got.collect()) == want
    cut = intervals.covered(windows, 3600).groupBy("w").count().collect()
    for r in cut:
        a, b = WINDOWS[r["w"]]
        assert r["count"] <= 2 * math.log2(b // 3600 - a // 3600 + 1) + 2
    assert max(r["count"] for r in cut) <= 2 * math.log2(175_201) + 2  # ten years by the hour, not 87 600 rows


def test_overlaps_of_hours_and_years(spark):
    rng = random.Random(6)
    cut = lambda n: [(f"p{rng.randrange(3)}", a, a + rng.choice([0, 3600, 86_400 * 3650])) for a in (rng.randrange(0, 400_000_000) for _ in range(n))]
    asked, held = cut(120), cut(150)
    requests = spark.createDataFrame([(i, p, "EmpiricalTest", a, b) for i, (p, a, b) in enumerate(asked)], "request_id long, pattern_id string, stage string, t0 long, t1 long")
    reserved = spark.createDataFrame([(p, "Discover", a, b, str(i)) for i, (p, a, b) in enumerate(held)], "pattern_id string, stage string, t0 long, t1 long, cycle_id string")
    want = Counter((i, str(j)) for i, (p, a, b) in enumerate(asked) for j, (q, c, d) in enumerate(held) if p == q and a <= d and b >= c)
    assert Counter((r["request_id"], r["held_by"]) for r in pit.overlapping(requests, reserved, 86_400).collect()) == want


def test_controls_of_one_large_window(spark):
    rows = [("p", "w" if i % 8 else "v", i // 2, float(i * 37 % 1000)) for i in range(1500)]
    values = spark.createDataFrame(rows, "pattern_id string, window_id string, t long, value double").repartition(5)
    for made in (replication.time_shuffled, replication.scope_resampled):
        small, large = (Counter(map(tuple, made(values, group_rows).collect())) for group_rows in (100_000, 20))
        assert small == large and sum(small.values()) == 1500
    shuffled = replication.time_shuffled(values, 20).collect()
    assert Counter((r["window_id"], r["value"]) for r in shuffled) == Counter((w, v) for _, w, _, v in rows)
    assert [r["value"] for r in sorted(shuffled, key=lambda r: (r["window_id"], r["t"], r["value"]))] != [v for _, w, _, v in sorted(rows, key=lambda r: (r[1], r[2], r[3]))]

"""Held-out replication tests of patterns, window by window, with controls and disjointness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.canonical import canonical_text, streamed_digest
from holdfast.functions.intervals import points_in_windows
from holdfast.functions.quantiles import at_each, group_quantiles
from holdfast.functions.ranges import KEY_ROWS, keyed_ranks
from holdfast.functions.tables import broadcast_if_small, written
from holdfast.operators import pit
from holdfast.operators.patterns import ARGS, SCOPE_COLUMNS, finite, in_scope, tagged_points, usable, verdict

OBSERVATION = "observation"


def fixed_windows(patterns: DataFrame) -> DataFrame:
    """Windows listed in the JSON column ``windows`` of each pattern; without id, ``heldout_i``."""
    kind = "array<struct<window_id: string, t0: bigint, t1: bigint>>"
    one = patterns.select("pattern_id", F.posexplode(F.from_json("windows", kind)).alias("i", "w"))
    name = F.coalesce("w.window_id", F.concat(F.lit("heldout_"), F.col("i").cast("string")))
    return one.select("pattern_id", name.alias("window_id"), "w.t0", "w.t1").where("t1 >= t0")


def grid_windows(patterns: DataFrame) -> DataFrame:
    """Candidate windows on each pattern's grid, from the search start or the gap behind the observation."""
    first = F.greatest("search_t0", F.col("obs_t1") + F.col("gap_seconds"))
    last = F.col("search_t1") - F.col("window_seconds")
    starts = F.when(first <= last, F.sequence(first, last, F.col("step_seconds")))
    return patterns.select("pattern_id", "window_seconds", F.explode(starts).alias("t0")).select("pattern_id", "t0", (F.col("t0") + F.col("window_seconds")).alias("t1"))


def window_json(pattern_id: Column, t0: Column, t1: Column) -> Column:
    return F.concat(F.lit('{"pattern_id":"'), pattern_id, F.lit('","window":{"t0":'), t0.cast("string"), F.lit(',"t1":'), t1.cast("string"), F.lit("}}"))


def heldout_windows(patterns: DataFrame) -> DataFrame:
    """(pattern_id, window_id, t0, t1) of each pattern's protocol: the windows it lists (JSON column ``windows``), or a
    choice from its grid. Of listed windows all are held out if window_count is null or their number; fewer are
    chosen as on a grid but keep their names."""
    if "windows" not in patterns.columns:
        return select_heldout(grid_windows(patterns), patterns)
    listed = patterns.where("windows is not null")
    fixed = fixed_windows(listed)
    count = fixed.groupBy("pattern_id").agg(F.count("*").alias("listed"))
    asked = listed.join(count, "pattern_id").withColumn("window_count", F.coalesce("window_count", "listed"))
    some = select_heldout(fixed.select("pattern_id", "t0", "t1"), asked).select("pattern_id", "t0", "t1")
    chosen = patterns.where("windows is null")
    return fixed.join(some, ["pattern_id", "t0", "t1"], "left_semi").select("pattern_id", "window_id", "t0", "t1").union(select_heldout(grid_windows(chosen), chosen))


def select_heldout(candidates: DataFrame, patterns: DataFrame) -> DataFrame:
    """The ``window_count`` candidates of each pattern with the smallest digests, named in order of time; more than
    there are is an error. The digest is of pattern, window and, where ``patterns`` has the column, the canonical
    JSON of the protocol (``protocol_json``)."""
    protocol = [c for c in ("protocol_json",) if c in patterns.columns]
    both = candidates.join(broadcast_if_small(patterns.select("pattern_id", "window_count", *protocol)), "pattern_id")
    text = window_json(F.col("pattern_id"), F.col("t0"), F.col("t1"))
    if protocol:
        text = F.regexp_replace(text, ',"window":', F.concat(F.lit(',"replication_protocol":'), F.regexp_replace("protocol_json", r"([\\$])", r"\\$1"), F.lit(',"window":')))
    by = Window.partitionBy("pattern_id")
    ranked = both.withColumn("digest", F.sha2(text, 256)).withColumns({"turn": F.row_number().over(by.orderBy("digest")), "candidates": F.count("*").over(by)})
    enough = F.when(F.col("window_count") > F.col("candidates"), F.raise_error(F.lit("window_count exceeds the windows there are"))).otherwise(F.col("turn") <= F.col("window_count"))
    few = ranked.where(enough)
    place = F.row_number().over(Window.partitionBy("pattern_id").orderBy("t0", "t1")) - 1
    return few.select("pattern_id", F.concat(F.lit("heldout_"), place.cast("string")).alias("window_id"), "t0", "t1")


def gap_failures(windows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Windows that start before the gap behind the observation is over; the gap is the first of three arguments."""
    gap = F.coalesce(*[F.col(c) for c in ("gap_seconds", "min_gap_seconds", "embargo_seconds") if c in patterns.columns], F.lit(0))
    return windows.join(broadcast_if_small(patterns.select("pattern_id", "obs_t1", gap.alias("gap"))), "pattern_id").where(F.col("t0") < F.col("obs_t1") + F.col("gap")).select("pattern_id", "window_id")


def observation_windows(patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern_id", F.lit(OBSERVATION).alias("window_id"), F.col("obs_t0").alias("t0"), F.col("obs_t1").alias("t1"))


def window_values(series: DataFrame, windows: DataFrame, patterns: DataFrame, bucket: int = 86400, assignment: DataFrame | None = None) -> DataFrame:
    """``series`` (spec_ref, t, value, ...) in each window (pattern_id, window_id, t0, t1), closed at both ends, and in
    the pattern's scope where ``patterns`` has scope columns; ``assignment`` (t, partition_id) tells partitions.

    A join of points and windows by dyadic nodes of ``bucket`` seconds: a window of any length is a logarithm of rows, and
    no pair is made twice.
    """
    scope = [c for c in SCOPE_COLUMNS if c in patterns.columns]
    held = windows.select("pattern_id", "window_id", "t0", "t1").join(patterns.select("pattern_id", "spec_ref", *scope), "pattern_id")
    both = points_in_windows(tagged_points(series, assignment), held, ["spec_ref"], bucket)
    if scope:
        both = both.where(in_scope(both.columns))
    return both.drop("t0", "t1", "partition_id", *scope)


def point_values(series: DataFrame, windows: DataFrame, patterns: DataFrame, assignment: DataFrame | None = None, bucket: int = 86400) -> DataFrame:
    """(pattern_id, window_id, t, value) at the times t0, t0 + step, ... up to t1 of each window that are in the pattern's
    scope: the latest value of its spec at or before them, null if there is none. The step is ``step_seconds``, or the
    window's length where that is null. A spec's value at a time is of no entity, so an entity set admits no time."""
    from holdfast.operators.partitions import latest_at

    scope = [c for c in SCOPE_COLUMNS if c in patterns.columns]
    held = windows.select("pattern_id", "window_id", "t0", "t1").join(patterns.select("pattern_id", "spec_ref", "step_seconds", *scope), "pattern_id")
    step = F.greatest(F.lit(1), F.coalesce("step_seconds", F.col("t1") - F.col("t0")))
    times = tagged_points(held.withColumn("t", F.explode(F.sequence("t0", "t1", step))), assignment)
    if scope:
        times = times.where(in_scope(times.columns))
    asked = written(times.select("pattern_id", "window_id", "spec_ref", "t"))
    return asked.join(latest_at(series, asked.select("spec_ref", "t").distinct(), bucket), ["spec_ref", "t"]).select("pattern_id", "window_id", "t", "value")


def window_verdicts(values: DataFrame, windows: DataFrame, patterns: DataFrame, keys: tuple[str, ...] = ("pattern_id",), group_rows: int = KEY_ROWS) -> DataFrame:
    """(keys, window_id, n, passed) of every window; one without values does not pass. ``keys`` name the rows of
    ``patterns``, whose assertion a window's values have to meet. Quantiles are exact and no window is gathered
    (``group_quantiles``); ``values`` is read several times."""
    own, each = list(keys), [*keys, "window_id"]
    args = broadcast_if_small(patterns.select(*own, *ARGS))
    both = values.select(*each, "value").join(args, own)
    found = both.groupBy(*each).agg(F.count("*").alias("n"), usable(F.col("value")).alias("usable"), verdict(F.col("value"), []).alias("plain"))
    ranked = "kind = 'quantile_ge' and p between 0 and 1"
    asked = patterns.where(ranked).select(*own, "p", "threshold")
    quantiles = group_quantiles(both.where(ranked).select(*each, "value"), each, windows.select(*each).join(asked.select(*own, "p"), own), group_rows)
    reached = quantiles.join(asked, [*own, "p"]).select(*each, (F.col("quantile") >= F.col("threshold")).alias("reached"))
    out = windows.select(*each).join(found, each, "left").join(reached, each, "left")
    passed = F.col("plain") | (F.col("usable") & F.coalesce("reached", F.lit(False)))
    return out.select(*each, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(passed, F.lit(False)).alias("passed"))


def rounded(value: Column) -> Column:
    """Twelve places, and no negative zero."""
    return F.round(value, 12) + F.lit(0.0)


def window_summary(values: DataFrame, group_rows: int = KEY_ROWS) -> DataFrame:
    """Size, finite values and their extremes, mean and exact median per window."""
    keys = ["pattern_id", "window_id"]
    v = F.when(finite(F.col("value")), F.col("value"))
    out = values.groupBy(*keys).agg(F.count("*").alias("size"), F.count(v).alias("finite"), rounded(F.min(v)).alias("min"), rounded(F.max(v)).alias("max"), rounded(F.avg(v)).alias("mean"))
    middle = group_quantiles(values.select(*keys, v.alias("value")), keys, at_each(out.select(*keys), (0.5,)), group_rows)
    return out.join(middle.select(*keys, rounded(F.col("quantile")).alias("median")), keys, "left")


def window_lineage(values: DataFrame, windows: DataFrame | None = None, patterns: DataFrame | None = None, deps: DataFrame | None = None) -> DataFrame:
    """One row per different source hash of each window. With ``deps`` (spec_ref, hash), the declared ones of specs, a
    window without any source hash takes those of its pattern's spec; one that has neither is an error."""
    found = values.select("pattern_id", "window_id", F.col("source_hash").alias("hash")).where("hash is not null").distinct()
    if deps is None:
        return found
    found = written(found)
    bare = windows.select("pattern_id", "window_id").join(found, ["pattern_id", "window_id"], "left_anti")
    declared = bare.join(patterns.select("pattern_id", "spec_ref"), "pattern_id").join(deps.select("spec_ref", "hash").distinct(), "spec_ref", "left")
    proved = F.coalesce("hash", F.raise_error(F.lit("a window has neither source hashes nor declared deps")))
    return found.unionByName(declared.select("pattern_id", "window_id", proved.alias("hash")))


def window_fingerprints(values: DataFrame, verdicts: DataFrame, lineage: DataFrame, windows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, window_id, fingerprint): digest of the canonical JSON of each window's assertion, source hashes in
    order, verdict, spec, summary and bounds. Hashes are digested as they pass, so a window's are not gathered."""
    keys = ["pattern_id", "window_id"]
    of = lambda kind, *names: [F.when(F.col("kind") == kind, F.col(n)).alias(n) for n in names]
    args = F.struct(*of("in_range", "lo", "hi"), *of("quantile_ge", "p", "threshold"), *of("sign", "expected_sign"))
    size = F.coalesce("size", F.lit(0))
    summary = F.struct(F.lit("float64").alias("dtype"), F.array(size).alias("shape"), size.alias("size"), F.lit(True).alias("numeric"), F.coalesce("finite", F.lit(0)).alias("finite_count"), "min", "max", "mean", F.col("median").alias("q50"))
    own = windows.select(*keys, "t0", "t1").join(patterns.select("pattern_id", "spec_ref", *ARGS), "pattern_id")
    own = own.join(verdicts.select(*keys, "passed"), keys).join(window_summary(values), keys, "left")
    rest = F.struct(F.col("passed").alias("result"), "spec_ref", summary.alias("summary"), F.struct("window_id", "t0", "t1").alias("window"))
    own = own.select(*keys, canonical_text(F.to_json(F.struct("kind", args.alias("args")))).alias("assertion"), canonical_text(F.to_json(rest)).alias("rest"))
    head = F.concat(F.lit('{"assertion":'), "assertion", F.lit(',"lineage_hashes":['))
    tail = F.concat(F.lit("],"), F.expr("substring(rest, 2)"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("place"), head.alias("text")), F.struct(F.lit(2).alias("place"), tail.alias("text"))))
    items = lineage.select(*keys, F.lit(1).alias("place"), F.concat(F.lit('"'), "hash", F.lit('"')).alias("text"))
    parts = own.select(*keys, ends.alias("e")).select(*keys, "e.place", "e.text").unionByName(items)
    return streamed_digest(parts, keys, ["text"]).withColumnRenamed("digest", "fingerprint")


def shared_lineage(lineage: DataFrame) -> DataFrame:
    """Hashes that an observation window shares with held-out windows; joined on pattern and hash, so a hash
    that many patterns use is no hot key."""
    seen = lineage.where(F.col("window_id") == OBSERVATION).select("pattern_id", "hash")
    return lineage.where(F.col("window_id") != OBSERVATION).join(seen, ["pattern_id", "hash"], "left_semi")


def disjointness(patterns: DataFrame, lineage: DataFrame, gaps: DataFrame, refused: DataFrame) -> DataFrame:
    """(pattern_id, shared, gap_failures, refused, disjoint)."""
    count = lambda df, name: df.groupBy("pattern_id").agg(F.count("*").alias(name))
    out = patterns.select("pattern_id")
    for df, name in ((shared_lineage(lineage), "shared"), (gaps, "gap_failures"), (refused, "refused")):
        out = out.join(count(df, name), "pattern_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("disjoint", (F.col("shared") == 0) & (F.col("gap_failures") == 0) & (F.col("refused") == 0))


def required_passes(n: Column, threshold: Column) -> Column:
    """max(1, ceil(n * threshold), a strict majority)."""
    return F.when(n == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(n * threshold), F.floor(n / 2) + 1)).cast("long")


def replication_verdict(verdicts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, windows, passes, required, replicated) over held-out windows."""
    counted = verdicts.where(F.col("window_id") != OBSERVATION).groupBy("pattern_id").agg(F.count("*").alias("windows"), F.count_if("passed").alias("passes"))
    both = patterns.select("pattern_id", "pass_threshold").join(counted, "pattern_id", "left").na.fill(0, ["windows", "passes"])
    required = required_passes(F.col("windows"), F.col("pass_threshold"))
    return both.withColumn("required", required).withColumn("replicated", (F.col("windows") > 0) & (F.col("passes") >= F.col("required"))).drop("pass_threshold")


def partition_results(verdicts: DataFrame, tags: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, partition_id, windows, passes, required, passed); windows without tag are partition_0."""
    held = verdicts.where(F.col("window_id") != OBSERVATION).join(tags, ["pattern_id", "window_id"], "left").withColumn("partition_id", F.coalesce("partition_id", F.lit("partition_0")))
    counted = held.groupBy("pattern_id", "partition_id").agg(F.count("*").alias("windows"), F.count_if("passed").alias("passes"))
    both = counted.join(broadcast_if_small(patterns.select("pattern_id", "partition_pass_threshold")), "pattern_id")
    return both.withColumn("required", required_passes(F.col("windows"), F.col("partition_pass_threshold"))).withColumn("passed", F.col("passes") >= F.col("required")).drop("partition_pass_threshold")


def partition_verdict(results: DataFrame) -> DataFrame:
    """A strict majority of a pattern's partitions passes."""
    return results.groupBy("pattern_id").agg(F.count("*").alias("partitions"), F.count_if("passed").alias("partition_passes")).withColumn("partitions_hold", F.col("partition_passes") * 2 > F.col("partitions"))


def _draw(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), "pattern_id", F.lit(":"), "window_id", F.lit(":"), F.col("i").cast("string")), 256)


def numbered(values: DataFrame, group_rows: int = KEY_ROWS) -> DataFrame:
    """Values with their place ``i`` from 0 in each window, by time, and the window's size ``n``. Windows of more than
    ``group_rows`` values are ranked by ranges."""
    keys = ["pattern_id", "window_id"]
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"))  # a row per window
    return keyed_ranks(values, keys, ["t", "value"], "i", group_rows).join(sizes, keys)


def time_shuffled(values: DataFrame, group_rows: int = KEY_ROWS, placed: DataFrame | None = None) -> DataFrame:
    """Each window's values dealt to its times in a hash-drawn order: the value whose draw has the same rank in the
    window as the time. Both ranks are by ranges where windows are large. ``placed``: ``numbered`` values, if at hand."""
    keys = ["pattern_id", "window_id"]
    placed = numbered(values.select(*keys, "t", "value"), group_rows) if placed is None else placed
    drawn = keyed_ranks(placed.withColumn("draw", _draw("time_shuffled")), keys, ["draw"], "place", group_rows)
    times = placed.select(*keys, F.col("i").alias("place"), "t")
    return times.join(drawn.select(*keys, "place", "value"), [*keys, "place"]).select(*keys, "t", "value")


def scope_resampled(values: DataFrame, group_rows: int = KEY_ROWS, placed: DataFrame | None = None) -> DataFrame:
    """As many values of each window, drawn with replacement by hashes."""
    keys = ["pattern_id", "window_id"]
    placed = numbered(values.select(*keys, "t", "value"), group_rows) if placed is None else placed
    pick = F.pmod(F.conv(F.substring(_draw("scope_randomized"), 1, 8), 16, 10).cast("long"), F.col("n"))
    asked = placed.select(*keys, "t", pick.alias("i"))
    return asked.join(placed.select(*keys, "i", "value"), [*keys, "i"]).select(*keys, "t", "value")


def tightened(patterns: DataFrame) -> DataFrame:
    """Patterns with thresholds moved inward by ``band``: ranges at both ends, to the middle if they cross."""
    shift = F.greatest(F.col("hi") - F.col("lo"), F.abs("hi"), F.abs("lo"), F.lit(1.0)) * F.col("band")
    lo, hi, middle = F.col("lo") + shift, F.col("hi") - shift, (F.col("lo") + F.col("hi")) / 2
    crossed = lo > hi
    return patterns.withColumns({"lo": F.when(crossed, middle).otherwise(lo), "hi": F.when(crossed, middle).otherwise(hi), "threshold": F.col("threshold") + F.greatest(F.abs("threshold"), F.lit(1.0)) * F.col("band")})


def control_results(values: DataFrame, windows: DataFrame, patterns: DataFrame, control_values: DataFrame | None = None) -> DataFrame:
    """(pattern_id, window_id, control, passed) for three controls of held-out windows.

    time_shuffled and scope_randomized pass if the assertion no longer holds on permuted and resampled values,
    or on those that ``control_values`` (pattern_id, window_id, control, value) supplies; threshold_perturbed if
    the tightened assertion gives the same verdict. All are one aggregate, over a column that names the control.
    """
    keys = ["pattern_id", "window_id"]
    plain = values.select(*keys, "t", "value")
    placed = written(numbered(plain))
    made = time_shuffled(plain, placed=placed).withColumn("control", F.lit("time_shuffled")).union(scope_resampled(plain, placed=placed).withColumn("control", F.lit("scope_randomized")))
    if control_values is not None:
        own = control_values.where(F.col("control").isin("time_shuffled", "scope_randomized")).select(*keys, F.lit(0).cast("long").alias("t"), "value", "control")
        made = made.join(own.select(*keys, "control").distinct(), [*keys, "control"], "left_anti").unionByName(own)
    named = lambda df, *names: df.withColumn("control", F.explode(F.array(*map(F.lit, names))))
    used = written(made.select(*keys, "control", "value").unionByName(named(plain, "base", "tight").select(*keys, "control", "value")))
    asserted = named(patterns, "base", "time_shuffled", "scope_randomized").unionByName(named(tightened(patterns), "tight"))
    found = window_verdicts(used, named(windows.select(*keys), "base", "tight", "time_shuffled", "scope_randomized"), asserted, ("pattern_id", "control"))
    held = lambda name: F.bool_or(F.when(F.col("control") == name, F.col("passed")))
    wide = found.groupBy(*keys).agg(*[held(name).alias(name) for name in ("base", "tight", "time_shuffled", "scope_randomized")])
    each = [("time_shuffled", ~F.col("time_shuffled")), ("scope_randomized", ~F.col("scope_randomized")), ("threshold_perturbed", F.col("base") == F.col("tight"))]
    results = F.explode(F.array(*[F.struct(F.lit(name).alias("control"), passed.alias("passed")) for name, passed in each]))
    return wide.select(*keys, results.alias("r")).select(*keys, "r.control", "r.passed")


def perturbation_verdict(controls: DataFrame) -> DataFrame:
    """Each control passes if it has windows and all pass; all three must."""
    each = controls.groupBy("pattern_id").agg(*[F.coalesce(F.bool_and(F.when(F.col("control") == c, F.col("passed"))), F.lit(False)).alias(c) for c in ("time_shuffled", "scope_randomized", "threshold_perturbed")])
    return each.withColumn("perturbed", F.col("time_shuffled") & F.col("scope_randomized") & F.col("threshold_perturbed"))


def heldout_reservations(windows: DataFrame, reservations: DataFrame, cycle_id: str, bucket: int = 7 * 86400) -> DataFrame:
    """Held-out windows with outcome and whether a new reservation is due: available windows not yet held."""
    asked = windows.withColumns({"stage": F.lit("EmpiricalTest"), "cycle_id": F.lit(cycle_id), "request_id": F.concat("pattern_id", F.lit("/"), "window_id")})
    out = pit.exact(pit.availability(asked, reservations, bucket), reservations.where("stage = 'EmpiricalTest'"))
    return out.select("pattern_id", "window_id", "t0", "t1", "outcome", ((F.col("outcome") == "available") & F.col("held_by").isNull()).alias("created_now"))


def control_seed(pattern_id: Column, control: str, window_id: Column) -> Column:
    """First 16 hex digits of a digest as an integer (decimal text)."""
    return F.conv(F.substring(F.sha2(F.concat(pattern_id, F.lit(f":{control}:"), window_id), 256), 1, 16), 16, 10)


# What the evaluation of a window and of a control of a window is charged, in dollars.
WINDOW_USD, CONTROL_USD = 1e-5, 5e-6


def values_by_mode(series: DataFrame, windows: DataFrame, patterns: DataFrame, assignment: DataFrame | None = None) -> DataFrame:
    """(pattern_id, window_id, t, value, source_hash): what each pattern reads in its windows. Patterns whose ``value_mode``
    is ``point`` read the latest value at the times of a grid (``point_values``, of no source), all others, and all where
    there is no such column, the points inside (``window_values``). One union, so each kind of join sees its patterns only."""
    names = ["pattern_id", "window_id", "t", "value", "source_hash"]
    if "value_mode" not in patterns.columns:
        return window_values(series, windows, patterns, assignment=assignment).select(*names)
    at_points = F.coalesce(F.col("value_mode") == "point", F.lit(False))
    inside = window_values(series, windows, patterns.where(~at_points), assignment=assignment)
    points = point_values(series, windows, patterns.where(at_points), assignment).withColumn("source_hash", F.lit(None).cast("string"))
    return inside.select(*names).unionByName(points.select(*names))


def selection_seed(patterns: DataFrame) -> DataFrame:
    """(pattern_id, selection_seed): digest of the pattern's id and, where there is one, the canonical JSON of its protocol."""
    protocol = F.concat(F.lit(',"replication_protocol":'), "protocol_json") if "protocol_json" in patterns.columns else F.lit("")
    return patterns.select("pattern_id", F.sha2(F.concat(F.lit('{"pattern_id":"'), "pattern_id", F.lit('"'), protocol, F.lit("}")), 256).alias("selection_seed"))


def _listed(df: DataFrame, name: str, order: list[str], rest: list[str]) -> DataFrame:
    """A pattern's rows as one array of structs in order."""
    return df.groupBy("pattern_id").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))


def replication_report(patterns: DataFrame, series: DataFrame, reservations: DataFrame, tags: DataFrame | None = None, control_values: DataFrame | None = None, assignment: DataFrame | None = None, deps: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """One row per pattern with the results of all gates and the verdict over them, under its own protocol, scope and way
    of reading values (``values_by_mode``). ``deps``: declared source hashes of specs, for windows without own ones.

    ``nested`` adds what the gates decided on: window_results, partition_results and perturbation_results, each an array of
    structs, selection_seed and compute_cost. These lists are as long as a pattern has held-out windows: a row is one
    report. Windows, their values, verdicts and controls are written once: all gates read them, and the join of the
    series runs a single time.
    """
    heldout = written(heldout_windows(patterns))
    windows = written(heldout.unionByName(observation_windows(patterns)))
    values = written(values_by_mode(series, windows, patterns, assignment))
    verdicts = written(window_verdicts(values, windows, patterns))
    held_values = values.where(F.col("window_id") != OBSERVATION)
    tags = heldout.select("pattern_id", "window_id", F.lit("partition_0").alias("partition_id")) if tags is None else tags
    refused = heldout_reservations(heldout, reservations, "test").where("outcome = 'refused'")
    results = partition_results(verdicts, tags, patterns)
    controls = control_results(held_values, heldout, patterns, control_values)
    if nested:
        results, controls = written(results), written(controls)
    clean = disjointness(patterns, window_lineage(values, windows, patterns, deps), gap_failures(heldout, patterns), refused)
    observed = verdicts.where(F.col("window_id") == OBSERVATION).select("pattern_id", F.col("passed").alias("observed"))
    out = replication_verdict(verdicts, patterns)
    for df in (observed, partition_verdict(results), perturbation_verdict(controls), clean):
        out = out.join(df, "pattern_id", "left")
    gates = [F.coalesce(c, F.lit(False)) for c in ("replicated", "partitions_hold", "perturbed", "disjoint")]
    verdict_ = gates[0] & gates[1] & gates[2] & gates[3]
    passed = sum((g.cast("int") for g in gates), F.lit(0))
    out = out.withColumn("gates_passed", passed).withColumn("verdict", verdict_)
    if not nested:
        return out
    each = heldout.join(verdicts, ["pattern_id", "window_id"]).join(tags.select("pattern_id", "window_id", "partition_id"), ["pattern_id", "window_id"], "left")
    of_windows = _listed(each, "window_results", ["t0", "t1", "window_id"], ["n", "passed", "partition_id"])
    of_partitions = _listed(results, "partition_results", ["partition_id"], ["windows", "passes", "required", "passed"])
    of_controls = _listed(controls, "perturbation_results", ["control", "window_id"], ["passed"])
    count = F.col("windows")
    usd = (1 + count) * F.lit(WINDOW_USD) + 3 * count * F.lit(CONTROL_USD)
    cost = F.struct(usd.alias("compute_usd"), F.lit(0.0).alias("llm_usd"), (1 + count).alias("window_evaluations"), (3 * count).alias("perturbation_evaluations"))
    for df in (of_windows, of_partitions, of_controls, selection_seed(patterns)):
        out = out.join(df, "pattern_id", "left")
    return out.withColumn("compute_cost", cost)

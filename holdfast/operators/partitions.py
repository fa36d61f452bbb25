"""Data-derived partitions of time: bar grids, trailing state, deterministic clustering, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.intervals import points_in_windows
from holdfast.functions.quantiles import at_each, group_quantiles
from holdfast.functions.ranges import KEY_ROWS, trailing
from holdfast.functions.tables import broadcast_if_small, with_rank, written
from holdfast.operators.patterns import finite
from holdfast.operators.replication import rounded

STATS = ("mean", "std", "min", "max", "last", "delta")


def bar_grid(spark, t0: int, t1: int, step: int) -> DataFrame:
    """Times t0, t0 + step, ... up to t1, both ends included."""
    return spark.range(t0, t1 + 1, step).select(F.col("id").alias("t"))


def series_on_grid(series: DataFrame, grid: DataFrame, step: int) -> DataFrame:
    """(spec_ref, t, value): the mean of each spec in the step from each bar on; null where it has none or is not
    finite, which ``grid_errors`` lists."""
    bars = series.groupBy("spec_ref", (F.floor(F.col("t") / step) * step).alias("t")).agg(F.avg("value").alias("value"))
    every = series.select("spec_ref").distinct().join(broadcast_if_small(grid))
    return every.join(bars, ["spec_ref", "t"], "left").withColumn("value", F.when(finite(F.col("value")), F.col("value")))


def latest_on_grid(series: DataFrame, grid: DataFrame, bucket: int = 86400) -> DataFrame:
    """(spec_ref, t, value): the latest value of each spec at or before each bar (as-of)."""
    return latest_at(series, series.select("spec_ref").distinct().join(broadcast_if_small(grid)), bucket)


def latest_at(series: DataFrame, asked: DataFrame, bucket: int = 86400) -> DataFrame:
    """(spec_ref, t, value): the latest value at or before each time asked for, different rows (spec_ref, t); as-of.

    Points and bars meet within buckets of time; what a bucket starts with is carried over from a row per spec and
    bucket, so no task sees a whole series. Values that are null are passed over.
    """
    every = asked.select("spec_ref", "t").withColumns({"value": F.lit(None).cast("double"), "bar": F.lit(1)})
    both = series.select("spec_ref", "t", "value").withColumn("bar", F.lit(0)).unionByName(every).withColumn("bucket", F.floor(F.col("t") / bucket))
    ends = both.groupBy("spec_ref", "bucket").agg(F.max(F.when(F.col("value").isNotNull(), F.struct("t", "value")))["value"].alias("end"))
    before = Window.partitionBy("spec_ref").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("spec_ref", "bucket", F.last("end", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("spec_ref", "bucket").orderBy("t", "bar", "value").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("value", F.last("value", ignorenulls=True).over(upto)).where("bar = 1")
    return inside.join(carried, ["spec_ref", "bucket"]).select("spec_ref", "t", F.coalesce("value", "carried").alias("value"))


def grid_errors(bars: DataFrame) -> DataFrame:
    return bars.where("value is null").select("spec_ref", "t")


def trailing_summaries(bars: DataFrame, n: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """Population statistics of the last ``n`` bars of each spec; fewer at the start. A spec of more than ``key_rows`` bars
    is dealt in blocks with halos (``trailing``)."""
    v = F.col("value")
    made = {"mean": lambda w: F.avg(v).over(w), "std": lambda w: F.stddev_pop(v).over(w), "min": lambda w: F.min(v).over(w), "max": lambda w: F.max(v).over(w), "last": lambda w: F.last(v).over(w), "delta": lambda w: F.last(v).over(w) - F.first(v).over(w)}
    return trailing(bars.select("spec_ref", "t", "value"), ["spec_ref"], ["t"], n, made, key_rows).select("spec_ref", "t", *STATS)


def state_matrix(summaries: DataFrame, refs: list[str], stats: list[str]) -> DataFrame:
    """(t, x0, x1, ...): specs in the given order times statistics in the given order; whole finite rows only."""
    if len(set(refs)) != len(refs) or not set(stats) <= set(STATS):
        raise ValueError("specs must be different and statistics known")
    cells = [F.max(F.when(F.col("spec_ref") == r, F.col(s))).alias(f"x{i * len(stats) + j}") for i, r in enumerate(refs) for j, s in enumerate(stats)]
    wide = summaries.groupBy("t").agg(*cells)
    return wide.where(" and ".join(f"x{i} is not null and not isnan(x{i})" for i in range(len(cells))))


def dimensions(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c != "t"]


def standardize(matrix: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """Columns by their mean and population deviation; a deviation below epsilon counts as 1."""
    xs = dimensions(matrix)
    stats = matrix.agg(*[F.avg(x).alias(f"m_{x}") for x in xs], *[F.stddev_pop(x).alias(f"s_{x}") for x in xs])
    scale = lambda x: F.when(F.col(f"s_{x}") < epsilon, F.lit(1.0)).otherwise(F.col(f"s_{x}"))
    return matrix.join(F.broadcast(stats)).select("t", *[((F.col(x) - F.col(f"m_{x}")) / scale(x)).alias(x) for x in xs])  # one row


def effective_k(matrix: DataFrame, k: int) -> DataFrame:
    """One row: rows, different rows, and the number of partitions that can be told apart."""
    xs = dimensions(matrix)
    return matrix.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*xs)).alias("different")).withColumn("k", F.least(F.lit(k), "n", "different").cast("long"))


def initial_centers(matrix: DataFrame, k: int) -> DataFrame:
    """Rows of the ranks round(linspace(0, n - 1, k)) in lexicographic order, ties by time; ranked by range."""
    xs = dimensions(matrix)
    ranked = written(with_rank(matrix, *xs, "t"))
    n = ranked.count()
    wanted = [round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)]
    picks = F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.lit(w).cast("long").alias("rank")) for i, w in enumerate(wanted)]))
    return ranked.join(F.broadcast(matrix.sparkSession.range(1).select(picks.alias("p")).select("p.label", "p.rank")), "rank").select("label", *xs)  # k rows


def _distances(xs: list[str], centers: list[tuple]) -> Column:
    if not centers:
        return F.array().cast("array<double>")
    return F.array(*[sum(((F.col(x) - F.lit(float(c))) ** 2 for x, c in zip(xs, center, strict=True)), F.lit(0.0)) for center in centers])


def assign(matrix: DataFrame, centers: list[tuple]) -> DataFrame:
    """``matrix`` with label, the nearest centre (lowest on ties), and its squared distance."""
    d = _distances(dimensions(matrix), centers)
    return matrix.withColumn("__d", d).withColumn("distance", F.array_min("__d")).withColumn("label", (F.array_position("__d", F.col("distance")) - 1).cast("int")).drop("__d")


def repair_empty(labelled: DataFrame, k: int) -> dict:
    """time -> label for empty clusters: each takes the farthest point (the first of several) of the largest
    cluster (the lowest label of several) that has more than one. ``labelled``: t, label, distance."""
    moved: dict = {}
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    for empty in [i for i in range(k) if i not in sizes]:
        largest = max(sizes, key=lambda i: (sizes[i], -i))
        if sizes[largest] < 2:
            break
        far = labelled.where((F.col("label") == largest) & ~F.col("t").isin(list(moved))).orderBy(F.desc("distance"), "t").first()
        moved[far["t"]] = empty
        sizes[largest] -= 1
        sizes[empty] = 1
    return moved


def cluster(matrix: DataFrame, k: int, iterations: int = 100, tolerance: float = 1e-12) -> tuple[DataFrame, list[tuple]]:
    """(t, label) and the final centres in lexicographic order, which number the labels.

    Lloyd steps from ``initial_centers``; centres are k literals, every step reads the written matrix and
    brings k rows of sums to the driver. An empty cluster takes the farthest point of the largest one. Labels
    are those before the last update of the centres.
    """
    xs = dimensions(matrix)
    held = written(matrix)
    k = max(1, min(k, effective_k(held, k).first()["k"]))
    start = sorted(initial_centers(held, k).collect(), key=lambda r: r["label"])
    centers = [tuple(r[x] for x in xs) for r in start]
    moved: dict = {}
    for _ in range(iterations):
        labelled = assign(held, centers)
        moved = repair_empty(labelled, k)
        labelled = override(labelled, moved)
        means = {r["label"]: tuple(r[x] for x in xs) for r in labelled.groupBy("label").agg(*[F.avg(x).alias(x) for x in xs]).collect()}
        new = [means.get(i, centers[i]) for i in range(k)]
        shift = max(abs(a - b) for c, d in zip(centers, new, strict=True) for a, b in zip(c, d, strict=True))
        before, centers = centers, new
        if shift <= tolerance:
            break
    order = sorted(range(k), key=lambda i: centers[i])
    names = {old: i for i, old in enumerate(order)}
    labelled = override(assign(held, before), moved)
    number = F.element_at(F.array(*[F.lit(names[i]) for i in range(k)]), F.col("label") + 1)
    return labelled.select("t", number.alias("label")), [centers[i] for i in order]


def override(labelled: DataFrame, moved: dict) -> DataFrame:
    label = F.col("label")
    for t, i in moved.items():
        label = F.when(F.col("t") == t, F.lit(i)).otherwise(label)
    return labelled.withColumn("label", label)


def partition_assignment(labels: DataFrame) -> DataFrame:
    return labels.select("t", F.concat(F.lit("partition_"), F.col("label").cast("string")).alias("partition_id"))


def assignment_errors(assignment: DataFrame) -> DataFrame:
    """One row with what breaks the rules: repeated times, malformed ids, numbers that are not 0 to k - 1."""
    number = F.regexp_extract("partition_id", "^partition_([0-9]+)$", 1)
    return assignment.agg((F.count("*") - F.count_distinct("t")).alias("repeated_times"), F.count_if(number == "").alias("malformed"), (F.max(number.try_cast("long")) + 1 - F.count_distinct("partition_id")).alias("gaps"))


def partition_fingerprints(matrix: DataFrame, assignment: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), key_rows: int = KEY_ROWS) -> DataFrame:
    """Statistics of each partition and column of the unscaled matrix, in long form: partition_id, dim, count,
    weight, centroid, std, min, max and one column q0, q1, ... for each quantile, exact (``group_quantiles``)."""
    xs = dimensions(matrix)
    both = matrix.join(assignment, "t")
    long = both.select("partition_id", F.explode(F.array(*[F.struct(F.lit(int(x[1:])).alias("dim"), F.col(x).alias("value")) for x in xs])).alias("c")).select("partition_id", "c.dim", "c.value")
    v = F.col("value")
    keys = ["partition_id", "dim"]
    long = written(long)
    out = written(long.groupBy(*keys).agg(F.count("*").alias("count"), rounded(F.avg(v)).alias("centroid"), rounded(F.stddev_pop(v)).alias("std"), rounded(F.min(v)).alias("min"), rounded(F.max(v)).alias("max")))
    found = group_quantiles(long, keys, at_each(out.select(*keys), quantiles), key_rows)
    wide = found.groupBy(*keys).agg(*[rounded(F.max(F.when(F.col("p") == q, F.col("quantile")))).alias(f"q{i}") for i, q in enumerate(quantiles)])
    return out.join(wide, keys, "left").withColumn("weight", rounded(F.col("count") / F.sum("count").over(Window.partitionBy("dim"))))


def partition_number(partition_id: Column) -> Column:
    return F.substring_index(partition_id, "_", -1).cast("int")


def partition_for_window(assignment: DataFrame, windows: DataFrame, keys: list[str], bucket: int = 86400, strict: bool = False) -> DataFrame:
    """``keys`` and the commonest partition of the times in each window (t0, t1); lowest number on ties. A window without
    any time gives null, or an error if ``strict``. A join of points and windows by dyadic nodes."""
    both = points_in_windows(assignment, windows.select(*dict.fromkeys([*keys, "t0", "t1"])), [], bucket)
    counted = both.groupBy(*keys, "partition_id").count()
    best = counted.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), partition_number(F.col("partition_id"))))).where("turn = 1").select(*keys, "partition_id")
    out = windows.select(*keys).join(best, keys, "left")
    if strict:
        out = out.withColumn("partition_id", F.coalesce("partition_id", F.raise_error(F.lit("no time of the assignment is in a window"))))
    return out


def assignment_profile(tags: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Fingerprints of the partitions that a set of windows is in, with their windows counted."""
    active = tags.groupBy("partition_id").agg(F.count("*").alias("windows"))
    return fingerprints.join(active, "partition_id")


def fallback_profile(windows: DataFrame) -> DataFrame:
    """Without an assignment, all windows are in partition_0."""
    return windows.agg(F.count("*").alias("windows")).select(F.lit("partition_0").alias("partition_id"), F.lit(1.0).alias("weight"), "windows")

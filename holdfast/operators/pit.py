"""Point-in-time reads and window reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.intervals import points_in_windows
from holdfast.functions.ranges import KEY_ROWS, running_sums
from holdfast.operators.ingest import first_of_each

STAGES = ("Discover", "EmpiricalTest")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed intervals: touching ends overlap."""
    return (a0 <= b1) & (a1 >= b0)


def earliest_vendor_time(provenance: DataFrame) -> DataFrame:
    """Popular hashes have many rows; they are reduced before any join."""
    return provenance.groupBy("hash").agg(F.min("vendor_timestamp").alias("earliest"))


#: Values that the rows without a key are dealt by.
SPREAD = 4096


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], row: Column | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, a row per ``keys``; null where there is none. Rows without a key find nothing;
    with ``row``, which tells rows of ``left`` apart, they are dealt by it and do not all go to one task."""
    if row is None:
        return left.join(right, keys, "left")
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    dealt = left.withColumn("__spread", F.when(absent, F.pmod(F.xxhash64(row), F.lit(SPREAD)) + 1).otherwise(0).cast("long"))
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("long")  # no literal, which would be taken out of the keys of the join
    return dealt.join(right.withColumn("__spread", zero), [*keys, "__spread"], "left").drop("__spread")


def admissible(requests: DataFrame, provenance: DataFrame, row: Column | None = None) -> DataFrame:
    """``requests`` (hash, query_time, ...) with outcome: unknown, future_denied or ok. ``row``: see ``looked_up``."""
    outcome = F.when(F.col("earliest").isNull(), "unknown").when(F.col("earliest") > F.col("query_time"), "future_denied").otherwise("ok")
    return looked_up(requests, earliest_vendor_time(provenance), ["hash"], row).withColumn("outcome", outcome).drop("earliest")


def visible_provenance(requests: DataFrame, provenance: DataFrame, key: str = "seq", bucket: int = 86400) -> DataFrame:
    """Per request, triples returned (vendor time not after the query) and suppressed.

    Triples are counted by hash and time; a request adds the counts of the buckets of time before its own, from a row
    per hash and bucket, to those before it in its bucket. No request meets the triples of its hash one by one.
    """
    at = lambda c: F.floor(F.col(c) / bucket).alias("bucket")
    dated = provenance.where("vendor_timestamp is not null").groupBy("hash", "vendor_timestamp").agg(F.count("*").alias("n"))
    dated = dated.select("hash", at("vendor_timestamp"), F.col("vendor_timestamp").alias("t"), "n", F.lit(0).alias("asked"), F.lit(None).cast(requests.schema[key].dataType).alias(key))
    asked = requests.select("hash", at("query_time"), F.col("query_time").alias("t"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked"), key)
    both = dated.union(asked)
    sums = both.groupBy("hash", "bucket").agg(F.sum("n").alias("n"))
    by_hash = Window.partitionBy("hash")
    before = F.coalesce(F.sum("n").over(by_hash.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("hash").alias("of"), F.col("bucket").alias("in"), before.alias("before"), F.sum("n").over(by_hash).alias("all"))
    upto = Window.partitionBy("hash", "bucket").orderBy("t", "asked").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("inside", F.sum("n").over(upto)).where("asked = 1")
    found = inside.join(sums, F.col("hash").eqNullSafe(F.col("of")) & F.col("bucket").eqNullSafe(F.col("in")))
    return found.groupBy(key).agg(F.sum(F.col("before") + F.col("inside")).alias("returned"), F.sum(F.col("all") - F.col("before") - F.col("inside")).alias("suppressed"))


def visible_corrections(requests: DataFrame, corrections: DataFrame, provenance: DataFrame, key: str = "seq") -> DataFrame:
    """Per request, corrections whose own earliest vendor time is not after the query, in one text as long as they are many,
    and the number of those suppressed."""
    dated = corrections.join(earliest_vendor_time(provenance).withColumnRenamed("hash", "correction_hash"), "correction_hash", "left")
    both = requests.join(dated.withColumnRenamed("original_hash", "hash"), "hash", "left")
    seen = F.coalesce(F.col("earliest") <= F.col("query_time"), F.lit(False))
    listed = F.array_join(F.sort_array(F.collect_set(F.when(seen, F.col("correction_hash")))), ",")
    return both.groupBy(key).agg(F.count_if(seen).alias("returned"), F.count_if(~seen & F.col("correction_hash").isNotNull()).alias("suppressed"), listed.alias("visible"))


#: What an attempt costs: failed byte reads nothing, other kinds always one.
_COSTS = "int(kind <> 'get' or outcome = 'ok')"


def access_log(attempts: DataFrame, cap: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """One record per attempt (cycle_id, seq, kind, outcome) with the reads used after it, under a cap of successful
    reads per cycle.

    The count of reads that would succeed meets the cap at the same row as that of reads that did, so one running sum
    decides; a cycle of more than ``key_rows`` attempts is dealt by ranges of seq (``running_sums``).
    """
    spent = running_sums(attempts, ["cycle_id"], ["seq"], {"__spent": _COSTS}, key_rows)
    outcome = F.when(F.col("__spent") - F.expr(_COSTS) >= cap, "rate_limited").otherwise(F.col("outcome"))
    return spent.withColumns({"outcome": outcome, "reads_used": F.least("__spent", F.lit(cap)), "max_reads": F.lit(cap)}).drop("__spent")


def read_budget(attempts: DataFrame, cap: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """``attempts`` with the outcome under a cap of successful reads per cycle (``access_log``)."""
    return access_log(attempts, cap, key_rows).select(*attempts.columns)


def cache_lookup(requests: DataFrame, cache: DataFrame, provenance: DataFrame, row: Column | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """Hits and misses by model, prompt and parameters; the bytes of a hit stay under the point-in-time rule.

    Cached bytes get their earliest time, and the body of ``bodies`` (hash, body; a row per hash), before requests meet
    them: so requests are joined once, and misses, which have no hash, not by it. ``row``: see ``looked_up``."""
    keys = ["model_id", "prompt_hash", "params_hash"]
    first = first_of_each(cache, keys, "first_written", "bytes_hash").select(*keys, F.col("bytes_hash").alias("hash"))
    dated = looked_up(first, earliest_vendor_time(provenance), ["hash"])
    found = looked_up(requests, dated if bodies is None else looked_up(dated, bodies, ["hash"]), keys, row)
    outcome = F.when(F.col("hash").isNull(), "miss").when(F.col("earliest").isNull(), "unknown").when(F.col("earliest") > F.col("query_time"), "future_denied").otherwise("hit")
    return found.withColumn("outcome", outcome).drop("earliest")


def put_responses(responses: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cache rows to append (the first write per key that is not there yet) and provenance of all bodies."""
    keys = ["model_id", "prompt_hash", "params_hash"]
    addressed = responses.withColumn("bytes_hash", F.sha2("body", 256))
    rows = first_of_each(addressed, keys, "fetch_time", "bytes_hash").join(cache.select(*keys), keys, "left_anti")
    source = addressed.select(F.col("bytes_hash").alias("hash"), F.concat(F.lit("llm:"), "model_id").alias("source_id"), "fetch_time", F.col("fetch_time").alias("vendor_timestamp")).distinct()
    return rows.select(*keys, "bytes_hash", F.col("fetch_time").alias("first_written")), source


WINDOW = ["pattern_id", "stage", "t0", "t1"]


def reserve(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per different window with the cycle that reserved it first, and whether that is new. Windows
    that end before they start or name no known stage are refused."""
    good = requests.where((F.col("t1") >= F.col("t0")) & F.col("stage").isin(*STAGES))
    one = first_of_each(good, WINDOW, "created", "cycle_id").withColumn("created_now", F.lit(True))
    if existing is None:
        return one.select(*WINDOW, "cycle_id", "created_now")
    held = existing.select(*WINDOW, F.col("cycle_id").alias("held_by"))
    both = one.join(held, WINDOW, "left")
    return both.select(*WINDOW, F.coalesce("held_by", "cycle_id").alias("cycle_id"), F.col("held_by").isNull().alias("created_now"))


def exact(requests: DataFrame, reservations: DataFrame) -> DataFrame:
    """Requests with the cycle that holds exactly their window, if any."""
    return requests.join(reservations.select(*WINDOW, F.col("cycle_id").alias("held_by")), WINDOW, "left")


def overlapping(requests: DataFrame, reservations: DataFrame, bucket: int, stage: str | None = None) -> DataFrame:
    """Pairs of a request and a reservation of its pattern that overlap, as closed intervals.

    Of two overlapping windows, the one that starts later starts inside the other; so the pairs are those of starts of
    reservations in requests, and of starts of requests in reservations that started before. Both are joins of points
    and windows by dyadic nodes of ``bucket`` seconds: a window of any length is a logarithm of rows, a pattern with very
    many windows no single group, and no pair is made twice.
    """
    held = reservations if stage is None else reservations.where(F.col("stage") == stage)
    right = held.select("pattern_id", F.col("stage").alias("held_stage"), F.col("t0").alias("held_t0"), F.col("t1").alias("held_t1"), F.col("cycle_id").alias("held_by")).where("held_t1 >= held_t0")
    asked = requests.where("t1 >= t0")
    later = points_in_windows(right, asked, ["pattern_id"], bucket, "held_t0", small=False)
    earlier = points_in_windows(asked, right, ["pattern_id"], bucket, "t0", "held_t0", "held_t1", small=False).where("t0 > held_t0")
    return later.unionByName(earlier)


def availability(requests: DataFrame, reservations: DataFrame, bucket: int, key: str = "request_id") -> DataFrame:
    """EmpiricalTest windows that overlap a Discover reservation of their pattern are refused."""
    tests = requests.where("stage = 'EmpiricalTest'")
    refused = overlapping(tests, reservations, bucket, "Discover").select(key).distinct().withColumn("refused", F.lit(True))
    return requests.join(refused, key, "left").withColumn("outcome", F.when(F.col("refused"), "refused").otherwise("available")).drop("refused")

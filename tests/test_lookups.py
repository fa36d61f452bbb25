"""Lookups of rows without a key."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import pit


@pytest.fixture
def shuffled(spark):
    """Joins that shuffle, into partitions that are not put together again."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for c, v in zip(old, ("false", "-1", "8"), strict=True):
        spark.conf.set(c, v)
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def test_rows_without_a_hash_do_not_meet_in_one_task(spark, shuffled):
    asked = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("hash"), F.lit(5).alias("query_time"))
    provenance = spark.range(0, 4000, 20).select(F.col("id").cast("string").alias("hash"), F.lit(5).alias("vendor_timestamp"))
    out = pit.admissible(asked, provenance, F.col("id"))
    assert {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()} == {"ok": 200, "unknown": 3800}
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("outcome")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_misses_do_not_meet_in_one_task(spark, shuffled):
    asked = spark.range(4000).select("id", F.lit("m").alias("model_id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("prompt_hash"), F.lit("p").alias("params_hash"), F.lit(5).alias("query_time"))
    cache = spark.range(0, 4000, 40).select(F.lit("m").alias("model_id"), F.col("id").cast("string").alias("prompt_hash"), F.lit("p").alias("params_hash"), F.concat(F.lit("b"), "id").alias("bytes_hash"), F.lit(1).alias("first_written"))
    provenance = spark.range(0, 4000, 80).select(F.concat(F.lit("b"), "id").alias("hash"), (F.col("id") / 500).cast("long").alias("vendor_timestamp"))
    out = pit.cache_lookup(asked, cache, provenance, F.col("id"))
    assert {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()} == {"hit": 38, "future_denied": 12, "unknown": 50, "miss": 3900}
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("outcome")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1000

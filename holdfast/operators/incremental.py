"""Incremental recomputation by fingerprints, and ceilings of cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.ranges import KEY_ROWS, running_sums
from holdfast.functions.tables import broadcast_if_small

KEY = ["stage_name", "stage_version", "inputs_hash"]


def stage_fingerprint(name: Column, version: Column, inputs_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"inputs_hash":"'), inputs_hash, F.lit('","name":"'), name, F.lit('","version":"'), version, F.lit('"}')), 256)


def work_list(inputs: DataFrame, fingerprints: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Inputs (fingerprint, ...) without a recorded output, or whose output is no longer there."""
    held = fingerprints.join(artifacts.select(F.col("hash").alias("output_hash")).distinct(), "output_hash", "left_semi")
    return inputs.join(held.select("fingerprint").distinct(), "fingerprint", "left_anti")


def record(new: DataFrame, existing: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``new`` (fingerprint, output_hash) with outcome: missing artifact, conflict (another output is recorded or
    comes with it), known or recorded."""
    outputs = new.select("fingerprint", "output_hash").union(existing.select("fingerprint", "output_hash")).groupBy("fingerprint").agg(F.count_distinct("output_hash").alias("outputs"))
    there = artifacts.select(F.col("hash").alias("output_hash")).distinct().withColumn("there", F.lit(True))
    known = existing.select("fingerprint").distinct().withColumn("known", F.lit(True))
    both = new.join(outputs, "fingerprint").join(there, "output_hash", "left").join(known, "fingerprint", "left")
    outcome = F.when(F.col("there").isNull(), "missing artifact").when(F.col("outputs") > 1, "conflict").when(F.col("known"), "known").otherwise("recorded")
    return both.select("fingerprint", "output_hash", outcome.alias("outcome"))


def cost_ceilings(charges: DataFrame, ceilings: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Per invocation: the first charge (seq) that takes compute, model or read totals over its stage's ceiling,
    and which; null where none does, or its stage has no ceilings. An invocation of more than ``key_rows`` charges is dealt
    by ranges of seq. Charges of one seq count together; those without one come after all others and are never the first.
    Charges of no invocation are a row of nulls.

    A total that comes within rounding of its ceiling is compared as a sum of decimals of twelve places, since a sum of
    doubles depends on the order of its terms: charges that add up to just the ceiling are not over it."""
    kinds = {"compute_usd": "max_compute_usd", "llm_usd": "max_llm_usd", "data_reads": "max_data_reads"}
    sums = {f"__{c}": c for c in kinds} | {f"__exact_{c}": f"try_cast({c} as decimal(26, 12))" for c in kinds}
    placed = F.col("invocation_id").isNotNull() & F.col("seq").isNotNull()
    totals = running_sums(charges.where(placed), ["invocation_id"], ["seq"], sums, key_rows, peers=True)
    run = totals.withColumns({c: F.col(f"__{c}") for c in kinds}).join(broadcast_if_small(ceilings), "stage_name", "left")  # a row per stage

    def beyond(c: str, m: str) -> Column:
        close = (F.abs(F.col(m)) < 1e12) & (F.abs(F.col(c) - F.col(m)) <= 1e-9 * F.greatest(F.lit(1e-3), F.abs(F.col(m))))
        return F.when(close, F.col(f"__exact_{c}") > F.expr(f"try_cast({m} as decimal(26, 12))")).otherwise(F.col(c) > F.col(m))

    over = F.coalesce(*[F.when(beyond(c, m), c) for c, m in kinds.items()])
    breaches = run.withColumn("over", over).select("invocation_id", F.when(F.col("over").isNotNull(), F.struct("seq", "over")).alias("b"))
    every = breaches.unionByName(charges.where(~placed).select("invocation_id"), allowMissingColumns=True)
    return every.groupBy("invocation_id").agg(F.min("b").alias("b")).select("invocation_id", F.col("b.seq").alias("failed_at"), F.col("b.over").alias("ceiling"))


def put_artifacts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Artifacts to append: one row per different content not there yet."""
    one = new.select(F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("bytes_size"), "content").dropDuplicates(["hash"])
    return one.join(existing.select("hash"), "hash", "left_anti")

"""Structured Streaming forms of ingest, audit appends and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.tables import subfolders, written
from holdfast.operators.audit import append_stored


def read_files(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A stream of the Parquet files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def bars(stream: DataFrame, key: str, ts: str, value: str, length: str, step: str, late: str) -> DataFrame:
    """Means of ``value`` in windows of ``length`` every ``step`` (tumbling if alike); rows later than ``late``
    behind the latest are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, step).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("value")).select(key, F.unix_seconds("w.start").alias("t0"), F.unix_seconds("w.end").alias("t1"), "n", "value")


def ingest_dedup(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """Blob rows (hash, ...) without those whose hash came within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["hash"])


def append_new(path: str, schema: str, digits: int = 2):
    """A sink for foreachBatch: appends the rows whose hash the table at ``path``/data does not hold yet.

    The table lies by the first ``digits`` digits of the hash and by batch; a batch is joined with the folders of its own
    digits only. Batches that are done stand in ``path``/batches: one that comes again does nothing, and one that was
    broken off starts from the same rows and replaces what it had written. Rows of one hash in a batch give one.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if str(epoch) in subfolders(spark, f"{path}/batches"):
            return
        one = written(batch.dropDuplicates(["hash"]).withColumn("prefix", F.substring("hash", 1, digits)))
        if subfolders(spark, f"{path}/batches"):
            one = one.join(held_hashes(one, path, schema, epoch), ["prefix", "hash"], "left_anti")
        rows = one.withColumn("epoch", F.lit(epoch).cast("long")).repartition("prefix")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "epoch").parquet(f"{path}/data")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/batches/{epoch}")

    return write


def held_hashes(batch: DataFrame, path: str, schema: str, epoch: int) -> DataFrame:
    """(prefix, hash) that batches before ``epoch`` left in the folders of the prefixes of ``batch``."""
    touched = [r[0] for r in batch.select("prefix").distinct().collect()]  # 16 ** digits at most
    held = batch.sparkSession.read.schema(f"{schema}, prefix string, epoch long").parquet(f"{path}/data")
    return held.where(F.col("prefix").isin(touched) & (F.col("epoch") < epoch)).select("prefix", "hash")


def audit_append(path: str):
    """A sink for foreachBatch: goes on with the hash chains stored at ``path`` by a batch of records (log_id, seq, ts,
    payload), append by append (``audit.append_stored``). Spark sorts a batch by log and seq, and tasks chain its rows as
    they pass, so no log's rows are gathered; the state is the table of tails. A record older than the last one of
    its log is stored as rejected."""

    def write(batch: DataFrame, epoch: int) -> None:
        append_stored(written(batch), path, epoch)

    return write


def run_batches(stream: DataFrame, sink, checkpoint: str, **trigger) -> None:
    """All that is there now, batch by batch, through a foreachBatch sink; a later call goes on from ``checkpoint``."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True, **trigger).start().awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, to Parquet at ``path``; a later call goes on from ``checkpoint``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()

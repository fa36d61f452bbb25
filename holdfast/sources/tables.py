"""Sources and sinks: fetched records, blob layout, ledgers, audit files and partition assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_FETCHES = "entity_id string, url string, status int, headers map<string, string>, body binary, fetch_time long"
PROVENANCE = "hash string, source_id string, fetch_time long, vendor_timestamp long"
CORRECTIONS = "correction_hash string, original_hash string"
CACHE = "model_id string, prompt_hash string, params_hash string, bytes_hash string, first_written long"
RESERVATIONS = "pattern_id string, stage string, t0 long, t1 long, cycle_id string"


def read_raw_fetches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_FETCHES).parquet(path)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Append blobs (hash, content, first_seen) under day and first two digits of the hash; rows of one folder
    meet in one task, so each append makes a file per folder."""
    out = blobs.withColumns({"day": F.date_from_unix_date(F.floor(F.col("first_seen") / 86400).cast("int")), "prefix": F.substring("hash", 1, 2)})
    out.repartition("day", "prefix").write.mode("append").partitionBy("day", "prefix").parquet(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash string, content string, first_seen long, day date, prefix string").parquet(path)


def append_index(rows: DataFrame, path: str, schema: str) -> DataFrame:
    """Append rows to an index table of fixed schema and return the whole table."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    rows.select(*names).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def write_reservations(rows: DataFrame, path: str) -> DataFrame:
    """The reservation ledger, clustered by pattern and stage so that reads of a pattern skip most files."""
    names = [c.strip().split()[0] for c in RESERVATIONS.split(",")]
    rows.select(*names).repartition("pattern_id", "stage").sortWithinPartitions("pattern_id", "stage", "t0").write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(RESERVATIONS).parquet(path)


def write_audit(lines: DataFrame, path: str) -> None:
    """One folder of text lines per UTC day, in order of ``seq``; lines are (ts, seq, line). Days are cut into ranges, so one
    day with very many lines is several files, in order of their names."""
    out = lines.withColumn("day", F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")))
    out.repartitionByRange("day", "seq").sortWithinPartitions("day", "seq").select("day", F.col("line").alias("value")).write.mode("append").partitionBy("day").text(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """(day, file, place, line) of audit files, blank lines dropped; (file, place) keeps the order of lines, by
    the start of the split and the position in it, so large files stay split."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    day = F.to_date(F.regexp_extract("file", r"day=([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    return raw.where(F.trim("value") != "").select(day.alias("day"), "file", F.struct("block", "id").alias("place"), F.col("value").alias("line"))


def assignment_json(assignment: DataFrame, size: int = 4096) -> DataFrame:
    """(chunk, body, hash): an assignment (t, partition_id) as JSON texts of up to ``size`` hours of times each."""
    chunk = F.floor(F.col("t") / (3600 * size))
    rows = assignment.groupBy(chunk.alias("chunk")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("t", "partition_id")))).alias("body"))
    return rows.withColumn("hash", F.sha2("body", 256))


def load_assignment(texts: DataFrame) -> DataFrame:
    """(t, partition_id) of texts whose hash agrees; others are refused."""
    good = F.when(F.sha2("body", 256) == F.col("hash"), F.col("body")).otherwise(F.raise_error(F.lit("the hash of an assignment does not agree")))
    rows = F.from_json(good, "array<struct<t: bigint, partition_id: string>>")
    return texts.select(F.explode(rows).alias("r")).select("r.t", "r.partition_id")

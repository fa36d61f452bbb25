"""Hash-chained audit logs: records, digests, appending and verification."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions.canonical import canonical_digest, digest
from holdfast.functions.tables import broadcast_if_small, subfolders, written

ZEROS = "0" * 64
# Keys that an envelope may have.
ENVELOPE_KEYS = ("pattern_id", "cycle_id", "m2a_id")


def validate(records: DataFrame) -> DataFrame:
    """``records`` (category, stage, envelope map, record_hash, prev_hash, and timestamp text where there is such a column)
    with what breaks the rules, joined. A timestamp may be missing; one that is there names its zone."""
    other = F.size(F.array_except(F.map_keys("envelope"), F.array(*map(F.lit, ENVELOPE_KEYS)))) > 0
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    broken = [F.when(empty("category"), "category"), F.when(empty("stage"), "stage"), F.when(other, "envelope"), F.when(F.col("record_hash").isNotNull() | F.col("prev_hash").isNotNull(), "caller set hashes")]
    if "timestamp" in records.columns:
        at = F.col("timestamp")
        zoned = at.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$") & F.try_to_timestamp(at).isNotNull()
        broken.append(F.when(at.isNotNull() & ~zoned, "timestamp"))
    return records.withColumn("errors", F.array_join(F.array_compact(F.array(*broken)), ","))


def check_digests(lines: DataFrame) -> DataFrame:
    """``lines`` (record_hash, line JSON) with digest_ok: the digest of the record without its own."""
    return lines.withColumn("digest_ok", F.coalesce(canonical_digest(F.col("line"), ("record_hash",)) == F.col("record_hash"), F.lit(False)))


def append_chain(records: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """(log_id, seq, prev_hash, record_hash, line, rejected) of records (log_id, seq, ts, payload JSON).

    Each log is a chain, so sequential; logs run in parallel, each sorted by Spark and read in one pass.
    ``tails`` (log_id, tail_hash, tail_ts) continue earlier chains. A record older than the last one before
    it is rejected and leaves the chain as it is.
    """
    return chained(records, tails).drop("ts")


def chained(records: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """``append_chain`` with the records' ts."""
    spark = records.sparkSession
    if tails is None:
        tails = spark.createDataFrame([], "log_id string, tail_hash string, tail_ts long")
    rows = records.join(tails, "log_id", "left").select("log_id", "seq", "ts", "payload", F.coalesce("tail_hash", F.lit(ZEROS)).alias("tail_hash"), F.coalesce("tail_ts", F.lit(-(1 << 62))).alias("tail_ts"))

    def run(parts):
        log, prev, last = None, ZEROS, 0
        for pdf in parts:
            out = []
            for log_id, seq, ts, payload, tail, tail_ts in pdf.itertuples(index=False):
                if log_id != log:
                    log, prev, last = log_id, tail, tail_ts
                if ts < last:
                    out.append((log_id, seq, ts, None, None, None, True))
                    continue
                record = {**json.loads(payload), "timestamp": int(ts), "prev_hash": prev}
                own = digest(record)
                out.append((log_id, seq, ts, prev, own, json.dumps({**record, "record_hash": own}, sort_keys=True, separators=(",", ":"), ensure_ascii=False), False))
                prev, last = own, ts
            yield pd.DataFrame(out, columns=["log_id", "seq", "ts", "prev_hash", "record_hash", "line", "rejected"])

    return rows.repartition("log_id").sortWithinPartitions("log_id", "seq").mapInPandas(run, "log_id string, seq long, ts long, prev_hash string, record_hash string, line string, rejected boolean")


def chain_tail(lines: DataFrame, before: int | None = None, logs: DataFrame | None = None) -> DataFrame:
    """(log_id, tail_hash, tail_ts, tail_day): the last hash, time and day of each log (before day ``before``, if given),
    which ``append_chain`` goes on from. A log of ``logs`` (log_id) without any line has the hash of zeros, and neither
    time nor day."""
    some = lines if before is None else lines.where(F.col("day") < before)
    last = F.max_by(F.struct("record_hash", "ts", "day"), F.struct("day", "line_no")).alias("last")
    tails = some.groupBy("log_id").agg(last).select("log_id", F.col("last.record_hash").alias("tail_hash"), F.col("last.ts").alias("tail_ts"), F.col("last.day").alias("tail_day"))
    if logs is None:
        return tails
    return logs.select("log_id").distinct().join(tails, "log_id", "left").withColumn("tail_hash", F.coalesce("tail_hash", F.lit(ZEROS)))


TAILS = "log_id string, tail_hash string, tail_ts long"
LINES = "log_id string, seq long, ts long, prev_hash string, record_hash string, line string, rejected boolean, day long, append long"


def stored_tails(spark: SparkSession, path: str, append: int | None = None) -> DataFrame:
    """Tails of the chains stored at ``path``, as the last append (before ``append``, if given) left them: one small table,
    whatever the number of lines."""
    names = [int(n) for n in subfolders(spark, f"{path}/tails") if n.isdigit()]
    earlier = [n for n in names if append is None or n < append]
    if not earlier:
        return spark.createDataFrame([], TAILS)
    return spark.read.schema(TAILS).parquet(f"{path}/tails/{max(earlier)}")


def append_stored(records: DataFrame, path: str, append: int) -> None:
    """Go on with the chains stored at ``path`` by ``records`` (log_id, seq, ts, payload JSON), append number ``append``.

    No line is read, only the table of tails of the append before. Lines are stored by day and append, rejected records
    among them; the new table of tails comes last. An append that is repeated starts from the same tails and replaces
    what it had written, so it changes nothing.
    """
    spark = records.sparkSession
    tails = stored_tails(spark, path, append)
    made = written(chained(records, tails))
    rows = made.withColumns({"day": F.floor(F.col("ts") / 86400).cast("long"), "append": F.lit(append).cast("long")})
    by_day = rows.repartitionByRange("day", "log_id", "seq").sortWithinPartitions("day", "log_id", "seq")
    by_day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "append").parquet(f"{path}/lines")
    last = made.where("not rejected").groupBy("log_id").agg(F.max_by(F.struct("record_hash", "ts"), "seq").alias("last"))
    new = tails.join(last, "log_id", "full").select("log_id", F.coalesce("last.record_hash", "tail_hash").alias("tail_hash"), F.coalesce("last.ts", "tail_ts").alias("tail_ts"))
    new.write.mode("overwrite").parquet(f"{path}/tails/{append}")


def stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """All records of the chains stored at ``path``, rejected ones among them (without hashes), with day and append."""
    return spark.read.schema(LINES).parquet(f"{path}/lines")


def verify_days(lines: DataFrame) -> DataFrame:
    """(log_id, day, n, valid): digests hold, each record names the one before it, the first of a day that of the
    last day with records, and times lie on the day. Only a table of day tails is ordered across days."""
    by_day = Window.partitionBy("log_id", "day").orderBy("line_no")
    tails = lines.groupBy("log_id", "day").agg(F.max_by("record_hash", "line_no").alias("tail"))
    ahead = tails.select("log_id", "day", F.lag("tail").over(Window.partitionBy("log_id").orderBy("day")).alias("before"))
    own = lines.withColumn("prior", F.lag("record_hash").over(by_day)).join(broadcast_if_small(ahead), ["log_id", "day"])
    linked = F.col("prev_hash") == F.coalesce("prior", "before", F.lit(ZEROS))
    good = F.col("digest_ok") & linked & (F.floor(F.col("ts") / 86400) == F.col("day"))
    return own.groupBy("log_id", "day").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(good, F.lit(False))).alias("valid"))


def verify_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """(log_id, days, valid) of an inclusive range of days, linked to the tail before it; missing days count as
    nothing."""
    return verify_days(lines).where(F.col("day").between(first, last)).groupBy("log_id").agg(F.count("*").alias("days"), F.bool_and("valid").alias("valid"))

"""Ingest of fetched documents: projections, vendor times, content addresses, idempotent inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_entity_id(raw: Column) -> Column:
    """Ten digits with leading zeros; null if ``raw`` is not 1 to 10 digits."""
    trimmed = F.trim(raw)
    return F.when(trimmed.rlike("^[0-9]{1,10}$"), F.lpad(trimmed, 10, "0"))


def entity_url(entity_id: Column, base: str = "https://data.example.org/submissions/") -> Column:
    return F.concat(F.lit(base + "E"), entity_id, F.lit(".json"))


def parse_http_date(value: Column) -> Column:
    """Epoch seconds of an RFC 2822 date; without zone it is UTC; null if it cannot be read."""
    bare = F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, *", "")
    named = F.regexp_replace(bare, " (GMT|UT|UTC|Z)$", " +0000")
    zoned = F.when(named.rlike("[+-][0-9]{4}$"), named).otherwise(F.concat(named, F.lit(" +0000")))
    return F.unix_seconds(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss xx")))


def vendor_time(headers: Column, body: Column) -> tuple[Column, Column]:
    """Vendor time and error. The Last-Modified header, in any case, wins and must be good; without it the
    first filing date of the body counts from midnight UTC."""
    header = F.transform_keys(headers, lambda k, v: F.lower(k))["last-modified"]
    filed = F.get_json_object(body, "$.filings.recent.filingDate[0]")
    day = F.when(filed.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.unix_date(F.try_to_date(filed, "yyyy-MM-dd")).cast("long") * 86400)
    at = F.when(header.isNotNull(), parse_http_date(header)).otherwise(day)
    error = F.when(at.isNull(), F.when(header.isNotNull(), "bad header").when(filed.isNotNull(), "bad filing date").otherwise("no vendor time"))
    return at, error


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_hash(hash_: Column) -> Column:
    return F.coalesce(hash_.rlike("^[0-9a-f]{64}$"), F.lit(False))


def put_blobs(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Blobs to append: one row for each hash not there yet, with its first time. Only hashes are shuffled."""
    one = new.groupBy("hash").agg(F.min("first_seen").alias("first_seen"), F.max("bytes_size").alias("bytes_size"))
    return one if existing is None else one.join(existing.select("hash"), "hash", "left_anti")


def put_provenance(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Provenance rows to append: different in any of four columns, with a source."""
    keys = ["hash", "source_id", "fetch_time", "vendor_timestamp"]
    rows = new.where(F.trim("source_id") != "").select(*keys).dropDuplicates(keys)
    return rows if existing is None else rows.join(existing.select(*keys), keys, "left_anti")


def link_corrections(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Correction edges to append; the original must look like a hash but need not exist."""
    keys = ["correction_hash", "original_hash"]
    rows = new.where(is_hash(F.col("original_hash"))).select(*keys).dropDuplicates(keys)
    return rows if existing is None else rows.join(existing.select(*keys), keys, "left_anti")


def provenance_listing(provenance: DataFrame) -> DataFrame:
    """Each hash with its triples in order of fetch time, source and vendor time, one value as long as they are many."""
    triple = F.struct("fetch_time", "source_id", "vendor_timestamp")
    return provenance.groupBy("hash").agg(F.count("*").alias("multiplicity"), F.sort_array(F.collect_list(triple)).alias("triples"))


def corrections_listing(corrections: DataFrame) -> DataFrame:
    """Each original with its different corrections in order, one value as long as they are many."""
    return corrections.groupBy("original_hash").agg(F.sort_array(F.collect_set("correction_hash")).alias("corrections"))


def has_blob(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    held = blobs.select("hash").distinct().withColumn("held", F.lit(True))
    return wanted.join(held, "hash", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def ingest_violations(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows that break a rule: empty content, vendor time after the fetch, or a hash not in the store."""
    checked = has_blob(rows, blobs)
    broken = F.array_compact(F.array(F.when(F.col("bytes_size") <= 0, "empty"), F.when(F.col("vendor_timestamp") > F.col("fetch_time"), "from the future"), F.when(~F.col("held"), "not stored")))
    return checked.withColumn("violations", broken).where(F.size("violations") > 0).drop("held")


def first_of_each(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__turn", turn).where("__turn = 1").drop("__turn")

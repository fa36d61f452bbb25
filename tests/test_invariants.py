"""Fetched documents that break a rule, among texts that are null or empty."""

import duckdb

from holdfast import catalog
from holdfast.operators import ingest
from tests.oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


def test_null_and_empty_texts_match_sql(spark, tmp_path):
    for name in TABLES:
        if name != "documents":
            (tmp_path / f"{name}.parquet").symlink_to(f"{FOLDER}/{name}.parquet")
    odd = [("doc_id", "text"), ("1000 + doc_id", "null"), ("2000 + doc_id", "''"), ("-1 - doc_id", "' '"), ("null", "text"), ("null", "null"), ("null", "''")]
    rows = " union all ".join(f"select cast({i} as bigint) as doc_id, cast({t} as varchar) as text, lang, source, n_chars from '{FOLDER}/documents.parquet'" for i, t in odd)
    duckdb.connect().execute(f"copy ({rows}) to '{tmp_path}/documents.parquet' (format parquet)")
    compare(spark, catalog.queries()["ingest_invariants"], catalog.oracle_sql()["ingest_invariants"], str(tmp_path))


def test_rules_of_the_operator(spark):
    rows = [("fine", "a", 3, 5, 6), ("empty", "a", 0, 5, 6), ("future", "a", 3, 7, 6), ("lost", "b", 3, 5, 6), ("all", None, 0, 7, 6)]
    fetched = spark.createDataFrame(rows, "id string, hash string, bytes_size long, vendor_timestamp long, fetch_time long")
    got = {r["id"]: r["violations"] for r in ingest.ingest_violations(fetched, spark.createDataFrame([("a",), (None,)], "hash string")).collect()}
    assert got == {"empty": ["empty"], "future": ["from the future"], "lost": ["not stored"], "all": ["empty", "from the future", "not stored"]}

"""Ceilings of cost where totals come within rounding of them."""

import duckdb
import pytest

from holdfast import catalog
from holdfast.operators import incremental
from tests.oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key_rows", [1 << 16, 2])
def test_charges_that_add_up_to_the_ceiling_are_not_over(spark, key_rows):
    rows = [("even", "s", i, x, 0.0, 0) for i, x in enumerate([0.1, 0.2, 0.3, 0.3, 0.1])] + [("over", "s", i, 0.1, 0.0, 0) for i in range(11)]
    rows += [("tight", "t", i, x, 0.0, 0) for i, x in enumerate([0.1, 0.2, 0.0001])] + [("model", "s", 0, 0.0, 0.7, 0), ("model", "s", 1, 0.0, 0.1, 1), ("nan", "s", 0, float("nan"), 0.0, 0), ("reads", "s", 4, 0.0, 0.0, 2), ("reads", "s", 5, 0.0, 0.0, 1)]
    charges = spark.createDataFrame(rows, "invocation_id string, stage_name string, seq int, compute_usd double, llm_usd double, data_reads long")
    ceilings = spark.createDataFrame([("s", 1.0, 0.8, 2), ("t", 0.3, 1.0, 9)], "stage_name string, max_compute_usd double, max_llm_usd double, max_data_reads long")
    got = {r["invocation_id"]: (r["failed_at"], r["ceiling"]) for r in incremental.cost_ceilings(charges, ceilings, key_rows).collect()}
    assert got == {"even": (None, None), "over": (10, "compute_usd"), "tight": (2, "compute_usd"), "model": (None, None), "nan": (0, "compute_usd"), "reads": (5, "data_reads")}


@pytest.mark.parametrize("key_rows", [1 << 16, 2])
def test_charges_of_one_seq_no_seq_no_invocation_or_no_ceilings(spark, key_rows):
    rows = [("tied", "s", i // 3, 0.0, 0.3, 1) for i in range(12)]  # with seq 2 reads pass 8 first, and model totals 2.5
    rows += [("late", "s", None, 9.0, 0.0, 0), ("late", "s", 1, 0.5, 0.0, 0), ("late", "s", 7, 0.25, 0.0, 0), ("late", "s", 8, 0.5, 0.0, 0), ("unplaced", "s", None, 9.0, 9.0, 99)]
    rows += [(None, "s", i, 9.0, 9.0, 99) for i in range(4)] + [("free", "other", i, 9.0, 9.0, 99) for i in range(4)]
    charges = spark.createDataFrame(rows, "invocation_id string, stage_name string, seq int, compute_usd double, llm_usd double, data_reads long")
    ceilings = spark.createDataFrame([("s", 1.0, 2.5, 8)], "stage_name string, max_compute_usd double, max_llm_usd double, max_data_reads long")
    got = [tuple(r) for r in incremental.cost_ceilings(charges, ceilings, key_rows).collect()]
    assert sorted(got, key=str) == sorted([("tied", 2, "llm_usd"), ("late", 8, "compute_usd"), ("unplaced", None, None), (None, None, None), ("free", None, None)], key=str)


def test_odd_events_match_sql(spark, tmp_path):
    """Events that share an id, are without an id, a user or a value, or are of users below 0."""
    for name in TABLES:
        if name != "events":
            (tmp_path / f"{name}.parquet").symlink_to(f"{FOLDER}/{name}.parquet")
    odd = [("event_id // 40", "user_id % 40"), ("case when event_id % 9 > 0 then event_id end", "100 + user_id % 40"), ("event_id", "-1 - user_id % 40"), ("event_id", "null"), ("null", "200 + user_id % 3")]
    rows = " union all ".join(f"select cast({e} as bigint) as event_id, ts, cast({u} as bigint) as user_id, event_type, case when event_id % 31 > 0 then value end as value, props from '{FOLDER}/events.parquet'" for e, u in odd)
    duckdb.connect().execute(f"copy ({rows}) to '{tmp_path}/events.parquet' (format parquet)")
    compare(spark, catalog.queries()["cost_ceilings"], catalog.oracle_sql()["cost_ceilings"], str(tmp_path))

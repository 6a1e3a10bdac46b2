"""Every query with SQL gives the rows of its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidelog.plans import queries as plans


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_its_sql(spark, small, duck, name):
    got = plans.QUERIES[name](spark, small).toPandas()
    want = duck.sql(plans.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda x: x[columns].astype(object).where(x[columns].notna(), None).sort_values(columns, key=lambda c: c.map(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-9)


def of_events(spark, path, schema, rows, name):
    """What the query and its SQL give on these events, sorted."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    want = con.sql(plans.ORACLE_SQL[name])
    got = plans.QUERIES[name](spark, str(path)).select(*want.columns).collect()
    return tuple(sorted((tuple(r) for r in rows), key=str) for rows in (got, want.fetchall()))


def test_leases_end_at_whole_seconds_of_any_time(spark, tmp_path):
    from datetime import datetime as at

    times = {
        1: [at(2024, 1, 1, 0, 0, 0, 600_000), at(2024, 1, 2, 0, 0, 0, 200_000)],  # a lease from second 1 is held
        2: [at(2024, 1, 1, 0, 0, 0, 400_000), at(2024, 1, 1, 23, 59, 59, 700_000)],  # one from second 0 has ended
        3: [at(2024, 1, 1, 0, 0, 0, 500_000), at(2024, 1, 1, 0, 0, 1, 500_000), at(2024, 1, 2, 0, 0, 0, 500_000)],  # halves go to even seconds
        4: [at(1969, 12, 30), at(1969, 12, 30, 12), at(1969, 12, 31, 12)],
        5: [None, None],
        6: [at(2024, 1, 1), None, at(2024, 1, 1, 1), at(2024, 1, 3)],
        None: [at(2024, 1, 1), at(2024, 1, 5)],
    }
    rows = [(user, when, k) for user, whens in times.items() for k, when in enumerate(whens)]
    got, want = of_events(spark, tmp_path, "user_id long, ts timestamp_ntz, event_id long", rows, "exclusive_lease")
    assert got == want and len(got) == len(times)


def test_rollup_of_null_values_and_keys(spark, tmp_path):
    rows = [("a", 1, 5.0), ("a", 1, None), ("a", 2, None), ("a", 3, None), ("a", None, 2.0), ("a", None, 9.0), ("b", 1, None), (None, 1, 3.0), (None, 2, float("nan"))]
    got, want = of_events(spark, tmp_path, "event_type string, user_id long, value double", rows, "fanout_rollup")
    assert str(got) == str(want) and len(got) == 3


def test_rollup_runs_no_jobs_before_it_is_asked_for(spark, small):
    spark.sparkContext.setJobGroup("rollup", "planning alone")
    try:
        rolled = plans.fanout_rollup(spark, small)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rollup")) <= 1  # the file's schema
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rolled.count() == 5


def test_entry_imports_without_the_other_folder(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    names = [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tidelog.llm")]
    with monkeypatch.context() as away:
        for name in {*names, "corpus_pipeline", "tidelog.llm", "tidelog.llm.queries"}:
            away.setitem(sys.modules, name, None)  # importing it fails
        if hasattr(sys.modules["tidelog"], "llm"):
            away.delattr(sys.modules["tidelog"], "llm")
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(plans.QUERIES) and set(alone.oracle_sql()) == set(plans.ORACLE_SQL)
    importlib.reload(entry)

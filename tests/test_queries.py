"""Registered queries against their SQL on a small table."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewatch.plans import queries as plans

SF = "/root/testdata/sf0.001"
NAMES = ["series_grid", "label_asof", "rolling_backfill", "threshold_best", "event_metrics", "pr_auc", "pacf", "qq_points", "bocpd_map_run_length", "stream_windows", "online_run_lengths", "csv_series", "metrics_files", "leaderboard_file", "plot_points"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, db, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), db.sql(plans.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (f[cols].sort_values(cols).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-9)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

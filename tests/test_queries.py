"""A slice of the registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from workload.check import TABLES, canonical

SF = "/root/testdata/sf0.001"
NAMES = ["collapse_markers", "build_segments", "estimate_sampling", "channel_quality", "detrend_smooth", "time_features", "band_power", "nearest_marker",
         "threshold_sweep", "roc_auc", "chronological_split", "stream_tail_windows", "stream_filtered_tail", "stream_peaks", "stream_prompts", "stream_control_events", "replay_decoder", "adaptive_thresholds", "find_peaks", "read_recordings",
         "quantiles_odd_keys", "click_trigger", "direction_scan", "activation_scan_best", "activity_profile", "event_thresholds"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_parses_and_belongs_to_a_query(con):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)

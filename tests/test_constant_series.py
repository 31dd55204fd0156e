"""Lag correlations of series that stand still, have gaps or one pair."""

import duckdb
import pytest
from compare import differences

import __spark_entry__ as entry

SERIES = [[5.0] * 6, [5.0, 5.0, 5.0, 7.0, 7.0], [0.0] * 25 + [1.0, 2.0, 3.0], [1.0, None, 2.0, None, 3.0, 4.0, 9.0], [1e-200, 2e-200, 5e-200], [1.0]]


@pytest.mark.parametrize("name", ["moving_vamp2", "vamp2_proxy"])
@pytest.mark.parametrize("chosen", [SERIES[:1], SERIES])
def test_constant_windows(spark, tmp_path, name, chosen):
    rows = [(i * 100 + k, f"2024-01-01 00:00:{k:02d}", i, "a", v) for i, own in enumerate(chosen) for k, v in enumerate(own)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert not differences(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name])

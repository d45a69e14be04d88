"""What is told of windows, on tables that the given ones don't hold."""

from __future__ import annotations

from datetime import datetime, timedelta

from comparing import by_duckdb, by_spark

from meterlark import catalog


def test_captures_of_one_account_at_one_instant_are_told_once_each(spark, tmp_path):
    at = datetime(2024, 1, 3, 4, 5, 6, 789_000)
    # ids, users and microseconds differ; accounts (user % 9) and milliseconds don't; the last capture is no account's
    rows = [(1, at, 3), (2, at, 3), (3, at + timedelta(microseconds=400), 12), (4, at, 4), (5, at, 13), (6, at + timedelta(hours=1), 3), (7, at, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    columns, found = by_spark(catalog.QUERIES["told_windows"](spark, str(tmp_path)))
    assert len(found) == 3 * 6
    assert (columns, found) == by_duckdb(catalog.SQL["told_windows"], str(tmp_path))

"""Streams over several batches: late rows, state kept between starts, timers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwell.streaming import windows

START = datetime(2024, 1, 1)


def table(spark, rows):
    """(arrival, hours since the start, user, value)."""
    return spark.createDataFrame([(a, START + timedelta(hours=h), u, v) for a, h, u, v in rows], "arrival int, ts timestamp_ntz, user_id long, value double")


def sessions(spark, rows):
    build = lambda x: windows.timed_sessions(x, delay="1 hour", gap_seconds=3600)
    got = windows.in_arrivals(spark, table(spark, rows), "arrival", build, mode="append").select("user_id", F.col("began").cast("timestamp_ntz").alias("b"), F.col("ended").cast("timestamp_ntz").alias("e"), "n", "total")
    return sorted((r.user_id, (r.b - START) / timedelta(hours=1), (r.e - START) / timedelta(hours=1), r.n, r.total) for r in got.collect())


def test_sessions_grow_join_and_end_by_timers(spark):
    rows = [
        (1, 0.0, 1, 1.0), (1, 1.5, 1, 2.0), (1, 0.25, 2, 1.0),  # user 1 has two open sessions
        (2, 0.75, 1, 4.0), (2, 1.75, 1, 8.0),  # a row between them, behind the newest: one session of four, then of five
        (3, 9.0, 3, 1.0), (3, 0.5, 2, 2.0), (3, 1.0, 2, 4.0),  # the watermark is still 0.75: user 2's row at 0.5 is late, the one at 1.0 is not
        (4, 2.0, 1, 64.0), (4, 20.0, 4, 1.0),  # now it is 8: the first is late, and all sessions before have ended
    ]
    got = sessions(spark, rows)
    assert got == [(1, 0.0, 1.75, 4, 15.0), (2, 0.25, 1.0, 2, 5.0), (3, 9.0, 9.0, 1, 1.0)]


def test_windows_leave_late_rows_out(spark):
    build = lambda x: windows.timely(x, delay="1 hour", width="2 hours", by=["user_id"], value="value")
    rows = [(1, 0.5, 1, 1.0), (1, 5.0, 1, 2.0), (2, 1.5, 1, 4.0), (2, 3.9, 1, 8.0), (2, 4.5, 1, 16.0), (3, 4.0, 1, 32.0), (3, 30.0, 1, 64.0), (4, 5.9, 1, 128.0)]
    # After batch 1 the watermark is 4: what comes for windows that end by then, at 1.5 and 3.9, is left out.
    got = windows.in_arrivals(spark, table(spark, rows), "arrival", build, mode="update", keys=["bucket", "user_id"]).select(F.col("bucket").cast("timestamp_ntz").alias("b"), "n", "total")
    assert sorted(((r.b - START) / timedelta(hours=1), r.n, r.total) for r in got.collect()) == [(0.0, 1, 1.0), (4.0, 3, 50.0), (30.0, 1, 64.0)]


def test_arrivals_of_nothing(spark):
    build = lambda x: windows.timely(x, delay="1 hour", width="2 hours", by=["user_id"], value="value")
    with pytest.raises(ValueError):
        windows.in_arrivals(spark, table(spark, []), "arrival", build, mode="append")

"""Streams over several micro-batches give what one batch over all rows gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.streaming import runs as S

START = datetime(2024, 1, 1)


def files(spark, folder, batches, schema):
    """One file for each batch, in the order in which a stream takes them."""
    import os
    import shutil
    import time

    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        part = f"{folder}-tmp{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        shutil.move(f"{part}/{name}", f"{folder}/{i:03d}.parquet")
        os.utime(f"{folder}/{i:03d}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return S.landed(spark, str(folder), spark.createDataFrame([], schema).schema, files_a_batch=1)


def at(hours):
    return START + timedelta(hours=hours)


def test_insert_once_over_batches(spark, tmp_path):
    stream = files(spark, tmp_path / "a", [[(1, "x", 1), (1, "x", 0), (2, "y", 2)], [(1, "x", 3), (3, "z", 4)], [(None, "n", 5)]], "k long, v string, o long")
    got = S.insert_once(stream, ["k", "v"], [F.asc("o")], "once")
    assert sorted((r.k or -1, r.o) for r in got.collect()) == [(-1, 5), (1, 0), (2, 2), (3, 4)]


def test_alerts_over_batches(spark, tmp_path):
    rows = [(1, "t", at(0), "raised", 0), (1, "t", at(1), "snooze", 1), (1, "t", at(2), "raised", 2), (2, "t", at(0), "cleared", 3), (1, "t", at(40), "raised", 4), (1, "t", at(41), "ack", 5), (1, "t", at(42), "raised", 6), (1, "t", at(43), "cleared", 7), (1, "t", at(44), "raised", 8), (1, "t", at(45), "snooze", 9), (1, "t", at(46), "cleared", 10)]
    stream = files(spark, tmp_path / "b", [rows[:3], rows[3:6], rows[6:]], "source_id long, type string, at timestamp, action string, ordinal long")
    got = S.latest(S.drained(S.alerts(stream, 86400), "alerts", "update"), ["source_id", "type"]).collect()
    assert sorted((r.source_id, r.status, r.opened, r.reopened) for r in got) == [(1, "SNOOZED", 2, 1), (2, "NONE", 0, 0)]


def test_recurrences_escalate_once(spark, tmp_path):
    rows = [(7, at(i), "seen", i) for i in range(6)] + [(7, at(6), "reopened", 6)] + [(7, at(7 + i), "seen", 7 + i) for i in range(5)]
    stream = files(spark, tmp_path / "c", [rows[:4], rows[4:8], rows[8:]], "issue_id long, at timestamp, action string, ordinal long")
    got = S.latest(S.drained(S.recurrences(stream), "rec", "update"), ["issue_id"]).collect()
    assert [(r["count"], r.escalations) for r in got] == [(5, 2)]


def test_matured_days_wait_and_late_rows_are_in(spark, tmp_path):
    batches = [[(at(1),), (at(2),)], [(at(30),), (at(3),)], [(at(100),)], [(at(101),)], [(at(4),)]]
    stream = files(spark, tmp_path / "d", batches, "ts timestamp")
    got = S.drained(S.matured_days(stream, "ts", "1 day", F.count(F.lit(1)).alias("n")), "days").collect()
    # the row of hour 4 comes when its day is closed
    assert sorted((str(r.day), r.n) for r in got) == [("2024-01-01", 3), ("2024-01-02", 1)]


def test_corrections_move_between_buckets(spark, tmp_path):
    batches = [[(1, 1, "a"), (2, 1, "a")], [(1, 2, "b")], [(1, 1, "a"), (3, 5, "b")]]
    stream = files(spark, tmp_path / "e", batches, "k long, version long, b string")
    assert {r.bucket: r.n for r in S.recomputed_buckets(stream, "k", F.col("b"), "fix").collect()} == {"a": 1, "b": 2}


def test_bands_of_a_missed_run(spark, tmp_path):
    target = datetime(2024, 7, 1)
    days = lambda d: target - timedelta(days=d)
    stream = files(spark, tmp_path / "f", [[(1, days(200))], [(1, days(170))], [(1, days(92)), (2, days(100))]], "source_id long, at timestamp")
    got = S.drained(S.crossed_bands(stream, target), "bands").collect()
    assert sorted((r.source_id, r.band) for r in got) == [(1, 90), (1, 180)]


def test_expired_keys(spark, tmp_path):
    stream = files(spark, tmp_path / "g", [[(1, at(0)), (2, at(0))], [(2, at(60))], [(3, at(200))]], "k long, ts timestamp")
    got = S.drained(S.expired(stream, "k", "ts", 48, "1 hour"), "expired").collect()
    assert sorted(r.k for r in got) == [1, 2]


@pytest.mark.parametrize("rows", [[], [(1, at(0))]])
def test_sessions_of_few_rows(spark, tmp_path, rows):
    stream = files(spark, tmp_path / "h", [rows, [(9, at(900))]], "k long, ts timestamp")
    got = S.drained(S.sessions(stream, "ts", "2 days", "1 hour", ["k"], F.count(F.lit(1)).alias("n")), "sessions").collect()
    assert [(r.k, r.n) for r in got] == [(k, 1) for k, _ in rows]

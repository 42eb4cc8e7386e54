"""E3 and J4 from rollups against the scan of the log, for any point in time."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionsift.operators import results as R
from sessionsift.operators import rollups as RU
from sessionsift.sources.committed import live_manifests

SCHEMA = "ingest_seq long, ts timestamp, cli string, session_id string, initial_chars long, result_chars long, saved_chars long"


def log_of(spark, n=400):
    rnd, start = random.Random(n), dt.datetime(2024, 3, 1)
    rows = [(i, start + dt.timedelta(seconds=rnd.randrange(45 * 86400), microseconds=rnd.randrange(10**6)) if i % 37 else None, rnd.choice(["a", "b", None]), rnd.choice([None, "s", "t"]), i, i // 2, i - i // 2) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sums(df):
    return {r.window: tuple(r)[1:] for r in df.select("window", *RU.SUMS, "saved_pct").collect()}


@pytest.mark.parametrize("now", ["2024-04-14 09:17:33.25", "2024-04-08 00:00:00", "2024-03-20 23:59:59.999999", "2024-03-01 00:30:00", "2025-01-01 12:00:00"])
def test_windows_at_any_time(spark, tmp_path, now):
    log, path, report = log_of(spark), str(tmp_path / "r"), {}
    for k in (0, 1, 1, 2, 0):
        RU.add_to_rollup(log.where(F.col("ingest_seq") % 3 == k), path, f"{k}")
    assert RU.compact_rollup(spark, path) and len(live_manifests(path)) == 1
    got = sums(RU.stats_from_rollup(RU.read_rollup(spark, path), log, now, report))
    assert got == sums(R.stats_windows(log, now))
    assert report["edge"] < 20 and report["hours"] <= 400


def test_without_rows(spark, tmp_path):
    log, path = log_of(spark).limit(0), str(tmp_path / "r")
    RU.add_to_rollup(log, path, "0")
    assert sums(RU.stats_from_rollup(RU.read_rollup(spark, path), log, "2024-04-01 00:00:00")) == sums(R.stats_windows(log, "2024-04-01 00:00:00"))


def test_a_stream_adds_each_micro_batch_once(spark, tmp_path):
    log, path = log_of(spark), str(tmp_path / "r")
    for k in range(6):
        log.where(F.col("ingest_seq") % 6 == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):  # a second run finds nothing new
        q = RU.stream_to_rollup(stream, path, str(tmp_path / "checkpoint"))
        q.awaitTermination()
        assert all(not p["stateOperators"] for p in q.recentProgress)  # no state
    assert len(live_manifests(path)) == 6
    want = {(r.hour, r.cli): tuple(r)[2:] for r in RU._added(RU._hourly(log)).collect()}
    assert {(r.hour, r.cli): tuple(r)[2:] for r in RU.read_rollup(spark, path).collect()} == want
    days = {(r.day, r.cli): r.compactions for r in RU.savings_by_day(RU.read_rollup(spark, path)).collect()}
    assert days == {(r.day, r.cli): r.n for r in log.where("ts IS NOT NULL").groupBy(F.date_trunc("day", "ts").alias("day"), "cli").agg(F.count("*").alias("n")).collect()}

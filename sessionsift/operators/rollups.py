"""Savings by hour and cli as partial sums that add up.

A rollup is a committed table (``sources.committed``) of rows ``(hour, cli, compactions, initial_chars,
result_chars, saved_chars, last_seq)``.  Each batch of the log adds its own partial sums, several rows for one hour
included; whoever reads adds them up.  A stream needs neither state nor a watermark for that, late rows are rows of
another batch, and a repeated batch adds nothing.  ``compact_rollup`` adds everything up into one generation.

Windows of E3 that begin inside an hour take the whole hours from the rollup and the rows of that one hour from the
log, so a report reads as many rows as there are hours, whatever the log's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift.operators.ordered import join_null_safe
from sessionsift.sources.committed import append_committed, compacted, read_committed, stream_committed

S = "session_id"
SUMS = ("compactions", "initial_chars", "result_chars", "saved_chars")
SCHEMA = "hour timestamp, cli string, compactions long, initial_chars long, result_chars long, saved_chars long, last_seq long"


def _hourly(log: DataFrame) -> DataFrame:
    return log.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "cli", F.lit(1).cast("long").alias("compactions"),
                      *(F.col(c).cast("long").alias(c) for c in SUMS[1:]), F.col("ingest_seq").cast("long").alias("last_seq"))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hour", "cli").agg(*(F.sum(c).alias(c) for c in SUMS), F.max("last_seq").alias("last_seq"))


def add_to_rollup(log: DataFrame, path: str, batch: str) -> bool:
    """Add a batch of log rows ``(ts, cli, ingest_seq, initial_chars, result_chars, saved_chars)``."""
    return append_committed(_added(_hourly(log)), path, batch)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each hour and cli of an Arrow batch."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["hour", "cli"]).aggregate([*((c, "sum") for c in SUMS), ("last_seq", "max")])
        sums = sums.rename_columns([c.removesuffix("_sum").replace("last_seq_max", "last_seq") for c in sums.column_names])
        yield from sums.select(batch.schema.names).cast(batch.schema).combine_chunks().to_batches()


def stream_to_rollup(log: DataFrame, path: str, checkpoint: str, stream: str = "log"):
    """Add a stream of log rows, each micro-batch once; stateless."""
    return stream_committed(_hourly(log).mapInArrow(_partial, SCHEMA), path, stream, checkpoint)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """One row for each hour and cli."""
    return _added(read_committed(spark, path, SCHEMA))


def compact_rollup(spark: SparkSession, path: str) -> bool:
    return compacted(spark, path, lambda rows, _: _added(rows).coalesce(1))


def savings_by_day(rollup: DataFrame, days: int = 1) -> DataFrame:
    """``(day, cli, ...)`` of each UTC day, or of the ``days`` that begin with it; rows without a time have no
    day."""
    day = F.date_trunc("day", "hour")
    starts = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_trunc("day", F.col("hour")) - F.make_dt_interval(k))
    rows = rollup.where("hour IS NOT NULL").withColumn("day", F.explode(starts) if days > 1 else day)
    return rows.groupBy("day", "cli").agg(*(F.sum(c).cast("bigint").alias(c) for c in SUMS))


def stats_from_rollup(rollup: DataFrame, log: DataFrame, now: str, report: dict | None = None) -> DataFrame:
    """E3 (``stats_windows``) from ``read_rollup`` and, for two edge hours, the last row and its session, ``log``.

    ``report`` gets the rows that were read: ``hours`` of the rollup and ``edge`` rows of the log."""
    from sessionsift.operators.results import _pct
    now_ts = F.to_timestamp(F.lit(now))
    ts = F.col("ts").cast("timestamp")
    seven, thirty = (now_ts - F.make_dt_interval(F.lit(d)) for d in (7, 30))
    edges = [F.date_trunc("hour", c) for c in (seven, thirty)]
    numbers = [F.col(c).cast("long").alias(c) for c in SUMS[1:]]

    def tagged(rows: DataFrame, windows: Column) -> DataFrame:
        return rows.withColumn("window", F.explode(F.filter(windows, lambda w: w.isNotNull()))).select("window", *SUMS)

    whole = F.array(F.lit("overall"), F.when(F.col("hour") >= F.date_trunc("day", now_ts), "today"),
                    F.when(F.col("hour") > edges[0], "week"), F.when(F.col("hour") > edges[1], "month"))
    hour_end = F.make_dt_interval(hours=F.lit(1))
    edge = log.where(((ts >= edges[0]) & (ts < edges[0] + hour_end)) | ((ts >= edges[1]) & (ts < edges[1] + hour_end)))
    if "day" in log.columns:  # a log in folders by day: two of them
        edge = edge.where((F.col("day") == F.to_date(edges[0])) | (F.col("day") == F.to_date(edges[1])))
    # the edge hour of the month lies far outside the week
    partial = F.array(F.when((ts > seven) & (ts < edges[0] + hour_end), "week"), F.when((ts > thirty) & (ts < edges[1] + hour_end), "month"))
    edge = edge.select("ts", F.lit(1).cast("long").alias("compactions"), *numbers)
    last = log.join(F.broadcast(rollup.agg(F.max("last_seq").alias("ingest_seq"))), "ingest_seq")  # one number
    mine = join_null_safe(log.select(S, F.lit(1).cast("long").alias("compactions"), *numbers), F.broadcast(last.select(S).limit(1)), [S])
    parts = (tagged(rollup, whole).unionByName(tagged(edge, partial))
             .unionByName(last.select(F.lit("last").alias("window"), F.lit(1).cast("long").alias("compactions"), *numbers))
             .unionByName(mine.select(F.lit("session").alias("window"), *SUMS)))
    names = log.sparkSession.createDataFrame([(w,) for w in ("last", "session", "today", "week", "month", "overall")], "window string")
    sums = parts.groupBy("window").agg(*(F.sum(c).alias(c) for c in SUMS))
    out = names.join(sums, "window", "left").select("window", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in SUMS))
    if report is not None:
        report.update(hours=rollup.count(), edge=edge.count())
    return out.withColumn("saved_pct", _pct(F.col("saved_chars"), F.col("initial_chars")))

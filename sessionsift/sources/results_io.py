"""Results log sinks and sources: A5 append_results, A6 read_results, A7 write_contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift.functions.text import parse_numeric, sanitize_log_field
from sessionsift.operators.results import latest_context, savings
from sessionsift.sources.committed import append_committed, compacted, live_manifests, read_committed

S = "session_id"
CONTEXT_BUCKETS = 64
LOG_COLUMNS = ("timestamp", "cli", "session_id", "trigger", "initial_chars", "result_chars", "saved_chars")


def log_rows(results: DataFrame) -> DataFrame:
    """Only ``ok`` results with a non-empty optimized context are logged; fields CSV-safe, sizes clamped."""
    r = results.where(F.col("ok") & (F.coalesce(F.col("optimized_context"), F.lit("")) != ""))
    i, f, s = savings(F.col("initial_size"), F.col("final_size"))
    return r.select("ts", sanitize_log_field("cli").alias("cli"),
                    sanitize_log_field(S, empty="global").alias(S),
                    sanitize_log_field("trigger").alias("trigger"),
                    i.alias("initial_chars"), f.alias("result_chars"), s.alias("saved_chars"),
                    *([F.col("ingest_seq")] if "ingest_seq" in results.columns else []))


def append_results(results: DataFrame, path: str, fmt: str = "parquet", batch: str | None = None) -> None:
    """A5: append the log rows, partitioned by UTC day (parquet), or as CSV with a header.

    With ``batch`` they are committed under that id: a repeated or killed job leaves each row once
    (``read_log``)."""
    rows = log_rows(results)
    if batch is not None:
        append_committed(rows.withColumn("day", F.to_date("ts")), path, batch, by=("day",))
    elif fmt == "csv":
        (rows.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
                     *LOG_COLUMNS[1:])
         .write.mode("append").option("header", True).csv(path))
    else:
        rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Lenient CSV read: blank lines skipped, missing/non-numeric numbers -> 0 (numeric prefix kept),
    missing text -> ''.  A missing folder gives an empty frame."""
    schema = ", ".join(f"`{c}` string" for c in LOG_COLUMNS)
    try:
        raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    except Exception as e:  # noqa: BLE001 - a missing log is an empty log
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        raw = spark.createDataFrame([], schema)
    txt = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        F.try_to_timestamp(F.col("timestamp")).alias("ts"), txt("cli").alias("cli"), txt(S).alias(S),
        txt("trigger").alias("trigger"),
        *[parse_numeric(F.col(c), 0.0).alias(c) for c in LOG_COLUMNS[4:]],  # fractions stay
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the committed batches of ``append_results(..., batch=...)``."""
    return read_committed(spark, path).drop("batch")


def write_contexts(results: DataFrame, path: str, batch: str | None = None) -> bool:
    """Commit the latest optimized context per sanitised session key as a delta of its own, in
    ``CONTEXT_BUCKETS`` folders by the key's hash.  A later delta's row replaces earlier ones of its key; a batch
    id that is committed already adds nothing (False)."""
    ok = results.where(F.col("ok") & (F.coalesce(F.col("optimized_context"), F.lit("")) != ""))
    bucket = F.pmod(F.xxhash64("key"), F.lit(CONTEXT_BUCKETS)).cast("int")
    rows = latest_context(ok).withColumn("bucket", bucket).repartition("bucket")
    return append_committed(rows, path, batch or uuid.uuid4().hex, by=("bucket",))


def _latest(rows: DataFrame, live: list[dict]) -> DataFrame:
    """The row of each key from the last batch that has it; with one batch there is nothing to compare."""
    if len(live) < 2:
        return rows
    orders = rows.sparkSession.createDataFrame([(m["batch"], m["order"]) for m in live], "batch string, order long")
    newest = F.max_by(F.struct("ts", "context", "bucket"), "order").alias("l")
    return rows.join(orders, "batch").groupBy("key").agg(newest).select("key", "l.ts", "l.context", "l.bucket")


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """``(key, ts, context)``, one row a key: the base and the deltas since."""
    live = live_manifests(path)
    rows = read_committed(spark, path, "key string, ts timestamp, context string, bucket int", live)
    return _latest(rows, live).select("key", "ts", "context")


def compact_contexts(spark: SparkSession, path: str) -> bool:
    """Make one base of the base and its deltas: readers then touch one generation of files."""
    return compacted(spark, path, lambda rows, live: _latest(rows, live).repartition("bucket"), by=("bucket",))

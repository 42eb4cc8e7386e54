"""J3 first_warnings as a stream, the events as a stream of late micro-batches, and the runner that drives any
stream to completion on the files present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift.session import scratch_dir

S = "session_id"


def first_warnings(log: DataFrame, message: str = "message") -> DataFrame:
    """Each (session or ``global``, message) exactly once, however late it comes.

    The state holds one row for each distinct pair; a watermark would bound it but drop late first
    messages and repeat old ones."""
    key = F.coalesce(F.nullif(F.col(S), F.lit("")), F.lit("global"))
    return log.select(key.alias("warn_key"), F.col(message).alias("message")).dropDuplicates(["warn_key", "message"])


def events_stream(spark: SparkSession, sf_dir: str, table: str = "events", parts: int = 5, late: bool = True) -> DataFrame:
    """A table as a file stream of ``parts`` micro-batches, however large, in the order of ``event_id``.

    The rows are first written as ``parts`` drops in the shared scratch folder, each of as many files (round-robin:
    a thousand rows for each file leave none empty), which a micro-batch takes together.  With ``late``, every
    seventh row comes one drop too late, and the last drop's come first.
    """
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    base = scratch_dir(spark, f"stream-in-{table}")
    top = rows.agg(F.max("event_id")).first()[0] or 0
    drop = F.floor(F.col("event_id") * parts / F.lit(top + 1)).cast("int")
    if late:
        drop = F.when(F.col("event_id") % 7 == 0, (drop + 1) % parts).otherwise(drop)
    rows_of = {r[0]: r[1] for r in rows.groupBy(drop).count().collect() if r[0] is not None}  # a row for each drop
    files = max(1, min([rows._jdf.rdd().getNumPartitions(), *(n // 1000 for n in rows_of.values())]))
    for k in range(parts):  # one write after the other: the source takes the oldest files first
        if files == 1 or k in rows_of:  # an empty drop is one file
            rows.where(drop == k).repartition(files).write.parquet(f"{base}/{k:03d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/*")


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive ``stream`` over everything available into a parquet sink in the shared scratch folder
    (checkpointed there too, so a restart resumes), then read the sink back as a batch DataFrame."""
    spark = stream.sparkSession
    base = scratch_dir(spark, f"stream-{name}")
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")

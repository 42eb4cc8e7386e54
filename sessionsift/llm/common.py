"""Shared helpers of the training-data operators: tables, staged intermediates, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift.session import ensure_conf, scratch_dir

#: The most rows that ``join_checked`` broadcasts (rows of a few numbers: some tens of MB).
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared checkpoint folder and read it back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a staged ``right`` of narrow rows: broadcast it only if its counted rows are at most
    ``limit``; beyond that a plain shuffle join (which AQE splits when a key is hot)."""
    if right.count() <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def crc_of_id(col: str) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))

"""Spark session and shared scratch-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every job in this package relies on.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JS ``JSON.parse`` keeps the last of duplicate keys; so does VARIANT with this on.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Text and JSON stages are CPU-heavy per byte: let AQE keep partitions of tens of KB instead of
    # packing a whole small stage into one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "sessionsift") -> SparkSession:
    """Build (or reuse) a session for tests, benches and scripts."""
    if master is None and "PYSPARK_GATEWAY_PORT" not in os.environ:  # under spark-submit its master stands
        master = f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master) if master else SparkSession.builder
    builder = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.python.unix.domain.socket.enabled", "true")
    )
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (UDFs and stateful stream functions).

    Zips the package once per SparkContext and adds it with ``addPyFile``;
    Spark distributes it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="sessionsift-pkg-")
    zip_path = shutil.make_archive(os.path.join(out, "sessionsift"), "zip", os.path.dirname(pkg_dir), "sessionsift")
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)


def ensure_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to a session someone else built, and ship the package.

    All of them are settings that a session may change at any time.  They stay: frames are run after the call
    that made them returns."""
    for k, v in SQL_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests) do we pick our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="sessionsift-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def spread(df, *keys: str):
    """Spread an input that has fewer partitions than cores (e.g. one small file, one row group).

    Large inputs already scan in parallel and are returned unchanged, and so
    is what comes out of a shuffle: counting its partitions would run it.  With
    ``keys`` (unique per row, e.g. ``session_id, pos``) the rows are
    hash-partitioned on them: even and deterministic without the local sort a
    round-robin repartition needs for safe retries.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(node in plan for node in ("Join ", "Aggregate ", "Window ", "Repartition", "Sort ", "Deduplicate ")):
        return df
    sc = df.sparkSession.sparkContext
    n = sc.defaultParallelism
    if df._jdf.rdd().getNumPartitions() < n:
        return df.repartition(n, *keys) if keys else df.repartition(n)
    return df


#: Estimated bytes of input (files as they are stored) in one partition of ``dealt``.
PART_BYTES = 16 << 20


def dealt(df, *keys: str):
    """Hash-partitioned by ``keys`` in parts of bounded size: as many as the estimated size of the input asks for, at
    least the session's number of shuffle partitions, which does not grow with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 50  # rows that are no files are taken to be of any size
    return df.repartition(max(least, -(-size // PART_BYTES)) if known else least, *keys)


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used on small, bounded intermediates (one row per session, or the capped
    candidate list) so later plans stay small and a lost executor does not
    replay the upstream stages.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

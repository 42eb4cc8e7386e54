"""Tables written by batches that count once, whole or not at all.

``committed`` is a Python data source with a writer: every task writes Parquet files under names of its own and
reports them; ``commit`` puts the names of all tasks that count into one manifest for the batch, ``abort`` deletes
what was written.  Readers take the files that manifests name and nothing else, so files of killed, repeated or
speculative tasks never show.  A batch whose manifest exists is not written again: a repeat adds nothing.

A batch may replace earlier ones (``compacted``): its manifest names them, and readers leave them out from the
moment it is there.  One job at a time writes a batch, as streams and schedulers see to.

Layout below the path: ``data/batch=<id>/[column=value/...]name.parquet`` and ``manifest/<id>.json``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from sessionsift.sources.stores import names_in, read_json, store_of, write_json


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, as paths below ``data/``."""

    files: list
    rows: int


def _named(batch: str) -> str:
    """A batch id as a file name that no store and no URI reads otherwise."""
    return quote(batch, safe="").replace("~", "%7E").replace("%", "~")


def _manifest(path: str, batch: str) -> str:
    return f"{path}/manifest/{_named(batch)}.json"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.batch = options["path"].rstrip("/"), options["batch"]
        self.by = [c for c in options.get("partitionby", "").split(",") if c]
        self.replaces = json.loads(options.get("replaces", "[]"))
        self.order, self.schema = options.get("order"), schema.json()
        self.folder = f"batch={_named(self.batch)}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.dataset as ds
        store, root = store_of(f"{self.path}/data")
        files: list[str] = []
        rows, name = 0, uuid.uuid4().hex

        def counted():
            nonlocal rows
            for batch in iterator:
                rows += batch.num_rows
                yield batch

        batches = counted()
        first = next(batches, None)
        if first is None:
            return Written([], 0)
        kinds = pa.schema([first.schema.field(c) for c in self.by])

        def every():
            yield first
            yield from batches

        ds.write_dataset(every(), f"{root}/{self.folder}", schema=first.schema, filesystem=store, format="parquet", basename_template=name + "-{i}.parquet",
                         partitioning=ds.partitioning(kinds, flavor="hive") if self.by else None, existing_data_behavior="overwrite_or_ignore",
                         file_visitor=lambda f: files.append(f.path[len(root) + 1:]))
        return Written(files, rows)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        if read_json(_manifest(self.path, self.batch)) is not None:
            self.abort(done)  # another attempt of the same batch was first
            return
        order = int(self.order) if self.order is not None else 1 + max((m["order"] for m in manifests(self.path)), default=0)
        write_json(_manifest(self.path, self.batch), {
            "batch": self.batch, "order": order, "replaces": self.replaces, "by": self.by, "schema": self.schema,
            "files": sorted(f for m in done for f in m.files), "rows": sum(m.rows for m in done)})

    def abort(self, messages: list) -> None:
        store, root = store_of(f"{self.path}/data")
        for file in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{root}/{file}")


class _StreamWriter(DataSourceStreamArrowWriter):
    """Every micro-batch is a batch named after the stream and its number, so a batch that is run again after a
    restart adds nothing."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.stream = options["batch"]

    def _of(self, number: int | str) -> _Writer:
        return _Writer(self.options | {"batch": f"{self.stream} {number}"}, self.schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._of("files").write(iterator)  # tasks don't know the number

    def commit(self, messages: list, batchId: int) -> None:
        self._of(f"{batchId:012d}").commit(messages)

    def abort(self, messages: list, batchId: int) -> None:
        self._of(batchId).abort([m for m in messages if m is not None])


class CommittedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(dict(self.options), schema)


def manifests(path: str) -> list[dict]:
    """All committed batches in the order of their commits: one small file for each."""
    found = (read_json(f"{path}/manifest/{n}") for n in names_in(f"{path}/manifest", ".json"))
    return sorted((m for m in found if m), key=lambda m: (m["order"], m["batch"]))


def live_manifests(path: str) -> list[dict]:
    """The batches that no other one replaces."""
    every = manifests(path)
    gone = {b for m in every for b in m["replaces"]}
    return [m for m in every if m["batch"] not in gone]


def append_committed(rows: DataFrame, path: str, batch: str, by: tuple[str, ...] = (), replaces: list[str] | None = None, order: int | None = None) -> bool:
    """Write ``rows`` as the batch of this id; False, and nothing done, if it is committed already."""
    if read_json(_manifest(path, batch)) is not None:
        return False
    rows.sparkSession.dataSource.register(CommittedSink)
    options = {"batch": batch, "partitionBy": ",".join(by), "replaces": json.dumps(replaces or [])} | ({} if order is None else {"order": str(order)})
    rows.write.format("committed").options(**options).mode("append").save(path)
    return True


def stream_committed(rows: DataFrame, path: str, stream: str, checkpoint: str):
    """Start writing a stream of rows as committed batches: everything available, then it ends."""
    rows.sparkSession.dataSource.register(CommittedSink)
    return (rows.writeStream.format("committed").option("batch", stream).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))


def read_committed(spark: SparkSession, path: str, schema: StructType | str | None = None, live: list[dict] | None = None) -> DataFrame:
    """The rows of all live batches (or of those given) with their ``batch``; ``schema`` is that of a table without
    any."""
    live = live_manifests(path) if live is None else live
    files = [f"{path}/data/{f}" for m in live for f in m["files"]]
    kind = StructType.fromJson(json.loads(live[-1]["schema"])) if live else spark.createDataFrame([], schema or "batch string").schema
    if "batch" not in kind.names:
        kind = StructType([*kind.fields, StructField("batch", StringType())])
    if not files:
        return spark.createDataFrame([], kind)
    out = spark.read.schema(kind).option("basePath", f"{path}/data").parquet(*files)
    return out.withColumn("batch", F.url_decode(F.replace("batch", F.lit("~"), F.lit("%"))))


def compacted(spark: SparkSession, path: str, reduce, by: tuple[str, ...] = ()) -> bool:
    """Replace all live batches by one with the rows ``reduce(rows, live)``; False if there is but one.  Batches that are
    committed meanwhile stay live and count as later ones."""
    live = live_manifests(path)
    if len(live) < 2:
        return False
    rows = reduce(read_committed(spark, path, live=live), live).drop("batch")
    return append_committed(rows, path, f"base-{uuid.uuid4().hex}", by, [m["batch"] for m in live], max(m["order"] for m in live))


def vacuum(path: str) -> int:
    """Delete the files that no live batch names (of killed writes and replaced batches); their number.  Not while
    a batch is being written or a reader still has an older list."""
    from pyarrow import fs
    store, root = store_of(f"{path}/data")
    used = {f for m in live_manifests(path) for f in m["files"]}
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    stray = [i.path for i in found if i.is_file and i.path[len(root) + 1:] not in used]
    for file in stray:
        store.delete_file(file)
    return len(stray)

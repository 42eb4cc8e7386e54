"""A1 for transcripts that grow: a streaming source that reads every byte once.

``growing_transcripts`` is a Python data source.  The offset of a stream is the number of bytes read of each file
(up to the end of its last whole line), so a run begins where the one before it ended, whatever was appended to
whichever file.  New bytes are read in chunks of at most ``chunkBytes``, small ones many to a task; a line belongs
to the chunk in which it begins.  Rows carry their place as (chunk, line in chunk); ``numbered_lines`` makes line numbers
of that, as ``read_transcripts`` gives them for the whole files, from a count for each chunk.

With ``upTo`` a run reads no further than so many bytes into a file.  Files only grow: one that has become shorter than what was read of it stops the stream.  A last line without a line
feed waits until it has one (a batch read takes it).  A run looks once at the end of each file; sessions that are over
belong in another folder.  Paths may have any scheme that ``pyarrow.fs`` knows.

Without ``offsets`` the offset of the stream itself has an entry for each file, of which Spark's driver keeps several
copies.  With ``offsets``, a folder, it only names a table there by its digest; what tasks read is written there too, a
record batch for each task, and neither is in memory as a whole but for the names and sizes of the files.
"""

from __future__ import annotations

import hashlib
import io
import os
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sessionsift.functions.text import strip_ws
from sessionsift.sources.stores import store_of

S = "session_id"
SCHEMA = "session_id string, file string, chunk long, line_in_chunk long, raw string"
CHUNK_BYTES, TAIL, READ_ROWS = 64 << 20, 1 << 16, 10_000
#: A task reads chunks of this many bytes together, each file counted with what opening it costs; more, up to a large
#: chunk, when there would be so many tasks that the driver's account of them grows large.
TASK_BYTES, OPEN_BYTES, TASKS = 4 << 20, 1 << 16, 2_000
#: The key of an offset that names a table of ends (files have a folder in their names), and rows in a batch of it.
ENDS, ENDS_ROWS = "ends", 1 << 14
ENDS_SCHEMA = pa.schema([("file", pa.large_string()), ("end", pa.int64()), ("size", pa.int64())])
PLAN_SCHEMA = pa.schema([("file", pa.large_string()), ("begin", pa.int64()), ("end", pa.int64()), ("fresh", pa.bool_())])


def session_of(file: str) -> str | None:
    """The ``session_id=`` folder a file sits in, else its name without the ending."""
    folder = re.search(r"/session_id=([^/]*)/[^/]*$", file)
    if folder:
        value = unquote(folder[1])
        return None if value == "__HIVE_DEFAULT_PARTITION__" else value
    return re.sub(r"(.)\.[^./]*$", r"\1", posixpath.basename(file))


class Chunk:
    """Lines of ``file`` that begin in [begin, end); ``fresh`` if a line begins at ``begin``."""

    def __init__(self, file: str, begin: int, end: int, fresh: bool):
        self.file, self.begin, self.end, self.fresh = file, begin, end, fresh


def chunks_of(file: str, begin: int, end: int, size: int) -> list[Chunk]:
    return [Chunk(file, at, min(at + size, end), at == begin) for at in range(begin, end, size)]


class Chunks(InputPartition):
    """What one task reads: a large chunk, or many small ones (of small files, or of little that was appended)."""

    def __init__(self, chunks: list[Chunk]):
        self.chunks = chunks


class Planned(InputPartition):
    """What one task reads, as a batch of a plan."""

    def __init__(self, plan: str, batch: int):
        self.plan, self.batch = plan, batch


def costed(chunks: Iterable[Chunk]) -> Iterator[tuple[Chunk, int]]:
    """Chunks with their bytes, and what opening a file costs at the first of its chunks."""
    file = None
    for c in chunks:
        yield c, c.end - c.begin + (OPEN_BYTES if c.file != file else 0)
        file = c.file


def task_bytes(cost: int) -> int:
    return min(max(TASK_BYTES, -(-cost // TASKS)), CHUNK_BYTES)


def packed(chunks: Iterable[Chunk], size: int = TASK_BYTES) -> Iterator[Chunks]:
    """Chunks in order, as tasks of about ``size`` bytes."""
    some: list[Chunk] = []
    room = size
    for c, cost in costed(chunks):
        if some and cost > room:
            yield Chunks(some)
            some, room = [], size
        some.append(c)
        room -= cost
    if some:
        yield Chunks(some)


@contextmanager
def _written(path: str, schema: pa.Schema) -> Iterator[list]:
    """A writer of record batches; the file gets its name, by then in the list, when it is whole."""
    store, at = store_of(path)
    store.create_dir(at, recursive=True)
    temp, name = f"{at}/.{uuid.uuid4().hex}", []
    with store.open_output_stream(temp) as f, pa.ipc.new_file(f, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        yield [out, name]
    store.move(temp, f"{at}/{name[0]}")


def _batches(path: str) -> Iterator[pa.RecordBatch]:
    store, at = store_of(path)
    with store.open_input_file(at) as f:
        table = pa.ipc.open_file(f)
        for k in range(table.num_record_batches):
            yield table.get_batch(k)


def _merged(left: Iterable[tuple], right: Iterable[tuple]) -> Iterator[tuple[str, tuple | None, tuple | None]]:
    """Rows (file, ...) of two sorted sides side by side."""
    left, right = iter(left), iter(right)
    x, y = next(left, None), next(right, None)
    while x or y:
        file = min(r[0] for r in (x, y) if r)
        here, there = x and x[0] == file, y and y[0] == file
        yield file, x if here else None, y if there else None
        x, y = next(left, None) if here else x, next(right, None) if there else y


class _Files:
    """What batch and stream readers share; the names of options come in lower case."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("chunkbytes", CHUNK_BYTES))
        self.upto = int(options.get("upto", 1 << 62))

    def found(self) -> Iterator[tuple[str, int]]:
        """Files and their sizes; local folders are walked, as a list of all that is in them is many times their names."""
        from pyarrow import fs
        store, root = store_of(self.path)
        if isinstance(store, fs.LocalFileSystem):
            return self._walked(root.rstrip("/") or "/")
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda f: any(p[:1] in ("_", ".") for p in f[len(root):].split("/"))
        return ((i.path, min(i.size, self.upto)) for i in listed if i.is_file and not hidden(i.path))

    def _walked(self, folder: str) -> Iterator[tuple[str, int]]:
        try:
            entries = os.scandir(folder)
        except FileNotFoundError:
            return
        with entries:
            for e in entries:
                if e.name[:1] in ("_", "."):
                    continue
                if e.is_dir():
                    yield from self._walked(e.path)
                elif e.is_file():
                    yield e.path, min(e.stat().st_size, self.upto)

    def sizes(self) -> dict[str, int]:
        return dict(self.found())

    def sorted_sizes(self) -> Iterator[tuple[str, int]]:
        found, parts = self.found(), []
        while some := list(islice(found, ENDS_ROWS)):
            parts.append(pa.table([pa.array(c, t) for c, t in zip(zip(*some), (pa.large_string(), pa.int64()))], names=["file", "size"]))
        if parts:
            for batch in pa.concat_tables(parts).sort_by("file").to_batches(max_chunksize=ENDS_ROWS):
                yield from zip(*(c.to_pylist() for c in batch.columns))

    def whole_lines(self, file: str, begin: int, size: int) -> int:
        """The end of the last whole line, looking back from the end in small steps."""
        store, _ = store_of(self.path)
        with store.open_input_file(file) as f:
            at = size
            while at > begin:
                low = max(begin, at - TAIL)
                f.seek(low)
                cut = f.read(at - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                at = low
        return begin

    def lines(self, part: Chunk) -> Iterator[tuple[str | None, str, int, int, str]]:
        store, _ = store_of(self.path)
        session = session_of(part.file)
        with io.BufferedReader(store.open_input_file(part.file), 1 << 20) as f:
            at = part.begin
            if not part.fresh:  # the line that began before belongs to the chunk before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(at)
            number = 0
            while at < part.end and (line := f.readline()):
                at, number = at + len(line), number + 1
                yield session, part.file, part.begin, number, line.removesuffix(b"\n").decode("utf-8", "replace")

    def chunks(self, part: Chunks | Planned) -> Iterable[Chunk]:
        if isinstance(part, Chunks):
            return part.chunks
        store, at = store_of(part.plan)
        with store.open_input_file(at) as f:
            return [Chunk(*row) for row in zip(*(c.to_pylist() for c in pa.ipc.open_file(f).get_batch(part.batch).columns))]

    def read(self, part: Chunks | Planned) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(S, pa.string()), ("file", pa.string()), ("chunk", pa.int64()), ("line_in_chunk", pa.int64()), ("raw", pa.string())])
        rows = (row for c in self.chunks(part) for row in self.lines(c))
        while some := list(islice(rows, READ_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


class GrowingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[Chunks]:
        return list(packed(c for file, size in sorted(self.files.sizes().items()) for c in chunks_of(file, 0, size, self.files.size)))

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class GrowingStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.ends, self.folder, self.last = _Files(options), {}, options.get("offsets"), None

    def initialOffset(self) -> dict:
        return {}

    def _end(self, file: str, size: int, end: int, seen: int) -> int:
        if size < end:
            raise ValueError(f"{file} has become shorter")
        return end if size == seen else self.files.whole_lines(file, end, size)

    def latestOffset(self) -> dict:
        if self.folder:
            self.last = self._stored_ends()
            return {ENDS: self.last} if self.last else {}
        for file, size in self.files.sizes().items():
            end, seen = self.ends.get(file, (0, -1))
            self.ends[file] = (self._end(file, size, end, seen), size)
        return {file: end for file, (end, _) in sorted(self.ends.items()) if end}

    def _stored_ends(self) -> str | None:
        """The name of the table of ends, the same for the same ends; None if there is none."""
        def rows():
            for file, now, last in _merged(self.files.sorted_sizes(), self._rows(self.last)):
                yield (file, self._end(file, now[1], *last[1:] if last else (0, -1)), now[1]) if now else last

        digest, any_end, found = hashlib.sha256(), False, rows()
        with _written(self.folder, ENDS_SCHEMA) as (out, name):
            while some := list(islice(found, ENDS_ROWS)):
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), ENDS_SCHEMA.types)], schema=ENDS_SCHEMA))
                for file, end, _ in some:
                    if end:
                        any_end = True
                        digest.update(f"{end} {file}\n".encode())
            name.append(f"ends-{digest.hexdigest()}")
        return digest.hexdigest() if any_end else None

    def _rows(self, name: str | None) -> Iterator[tuple[str, int, int]]:
        if name:
            for batch in _batches(f"{self.folder}/ends-{name}"):
                yield from zip(*(c.to_pylist() for c in batch.columns))

    def _ends(self, offset: dict) -> Iterable[tuple]:
        """Sorted (file, end, ...) of an offset of either kind."""
        return (r for r in self._rows(offset[ENDS]) if r[1]) if ENDS in offset else sorted(offset.items())

    def _chunks(self, start: dict, end: dict) -> Iterator[Chunk]:
        for file, before, now in _merged(self._ends(start), self._ends(end)):
            begin = before[1] if before else 0
            if now and now[1] < begin:
                raise ValueError(f"{file} has become shorter")
            if now:
                yield from chunks_of(file, begin, now[1], self.files.size)

    def partitions(self, start: dict, end: dict) -> list[Chunks] | list[Planned]:
        size = task_bytes(sum(cost for _, cost in costed(self._chunks(start, end))))
        tasks = packed(self._chunks(start, end), size)
        if not self.folder:
            return list(tasks)
        with _written(self.folder, PLAN_SCHEMA) as (out, name):
            name.append(f"plan-{uuid.uuid4().hex}")
            n = 0
            for n, t in enumerate(tasks, 1):
                columns = zip(*((c.file, c.begin, c.end, c.fresh) for c in t.chunks))
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PLAN_SCHEMA.types)], schema=PLAN_SCHEMA))
        return [Planned(f"{self.folder}/{name[0]}", k) for k in range(n)]

    def read(self, partition: Chunks | Planned) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)

    def commit(self, end: dict) -> None:
        pass


class GrowingTranscripts(DataSource):
    """``spark.readStream.format("growing_transcripts").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GrowingReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingStream(dict(self.options))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(session_id, line_no, raw)`` of the non-blank lines, numbered within their file as ``read_transcripts``
    numbers them: the lines of its earlier chunks, a row each, and the place in the chunk."""
    chunks = lines.groupBy("file", "chunk").agg(F.max("line_in_chunk").alias("__n"))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("file", "chunk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return (lines.where(strip_ws("raw") != "").join(before, ["file", "chunk"])
            .select(S, (F.col("__before") + F.col("line_in_chunk")).cast("bigint").alias("line_no"), "raw"))


def read_whole(spark: SparkSession, path: str, **options) -> DataFrame:
    """All lines of all files, as a stream would have gathered them."""
    spark.dataSource.register(GrowingTranscripts)
    return spark.read.format("growing_transcripts").options(**options).load(path)


def follow_transcripts(spark: SparkSession, path: str, store: str, **options) -> DataFrame:
    """Read what has been appended below ``path`` since the last call with the same ``store`` (its checkpoint and
    its table of lines lie there), and return all lines so far as ``read_transcripts`` would."""
    spark.dataSource.register(GrowingTranscripts)
    stream = spark.readStream.format("growing_transcripts").options(**{"offsets": f"{store}/offsets", **options}).load(path)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{store}/lines")
         .option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return numbered_lines(spark.read.schema(SCHEMA).parquet(f"{store}/lines"))

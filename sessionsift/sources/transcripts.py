"""A1 read_transcripts / write_transcripts, A2 parse_entries.

A transcript is a JSON-lines file per session.  Files are read as splits, so
a large one is read by many tasks; the number of a line is the number of lines
in earlier splits of its file plus its place in its own.  The session is the
``session_id=`` folder the file sits in, else the file name.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionsift.functions.text import strict_json, strip_ws
from sessionsift.sources.stores import store_of

S = "session_id"


#: What Spark escapes in the folder names of partitions.
_ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _file_of(session: str | None) -> str:
    """A session's file, named as Spark names partitions; the empty name has a file of its own beside the null one."""
    folder = _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", session or "") or "__HIVE_DEFAULT_PARTITION__"
    return f"{S}={folder}/part-{1 if session == '' else 0}.txt"


def _write_files(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Write sorted rows, a file for each session, one open at a time.  A file gets its name when it is whole, and a
    repeated task writes the same one again; what killed tasks leave has names that readers skip."""
    store, root = store_of(path)
    now, out, temp = None, None, ""

    def close() -> None:
        if out is not None:
            out.close()
            store.move(temp, f"{root}/{_file_of(now)}")

    for b in batches:
        sessions, values = b.column(0), b.column(1).to_pylist()
        for name, run in groupby(range(b.num_rows), sessions.to_pylist().__getitem__):
            if out is None or name != now:
                close()
                now, temp = name, f"{root}/{posixpath.dirname(_file_of(name))}/.{uuid.uuid4().hex}"
                store.create_dir(posixpath.dirname(temp))
                out = store.open_output_stream(temp)
            out.write("".join(f"{values[i]}\n" for i in run).encode())
    close()
    yield from ()


def write_transcripts(lines: DataFrame, path: str) -> None:
    """Write ``(session_id, line_no, raw)`` as one JSON-lines file per session, in line order.

    The tasks put the files in their places: a job that moves them afterwards does so one by one in the driver, and
    Hadoop's local files start a process each to set their mode.  ``_SUCCESS`` is written last."""
    from sessionsift.session import ship_package
    ship_package(lines.sparkSession)
    rows = lines.select(F.col(S).cast("string").alias(S), "line_no", F.coalesce(F.col("raw"), F.lit("")).alias("value"))
    # Spark's own overwrite, of no rows: empties the folder, unless it is being read.
    (rows.limit(0).select(S, "value").write.mode("overwrite").partitionBy(S)
     .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path))
    (rows.repartition(S).sortWithinPartitions(S, "line_no").select(S, "value")
     .mapInArrow(lambda batches: _write_files(batches, path), f"{S} string").write.format("noop").mode("overwrite").save())
    store, root = store_of(path)
    with store.open_output_stream(f"{root}/_SUCCESS"):
        pass


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A1: one row per non-blank line: ``(session_id, line_no, raw)``; ``line_no`` is 1-based in the file."""
    lines = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
             .select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("__f"),
                     F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__i")))
    # Ids rise by one along a split; a row for each split, from which the lines before it follow.  The splits are taken
    # of whole lines dealt by split (raw is never null), as their join wants them: the files are read and dealt once.
    place = F.row_number().over(Window.partitionBy("__f", "__at").orderBy("__i"))
    dealt = lines.withColumn("__n", F.when(F.col("raw").isNotNull(), place))
    splits = dealt.groupBy("__f", "__at").agg(F.min("__i").alias("__first"), F.max("__n").alias("__n"))
    earlier = Window.partitionBy("__f").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__f", "__at", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    folder = F.regexp_extract("__f", r"/session_id=([^/]*)/[^/]*$", 1)
    name = F.regexp_extract("__f", r"([^/]+?)(\.[^./]*)?$", 1)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # the path is a URI; a folder's value is escaped once more
    session = F.when(folder != "", F.nullif(plain(plain(folder)), F.lit("__HIVE_DEFAULT_PARTITION__"))).otherwise(plain(name))
    filled = F.when(F.col("__add").isNotNull(), strip_ws("raw") != "")  # of both sides: below the join it would part their shuffles
    # every line has its split; an outer join never broadcasts the lines
    return (lines.join(splits, ["__f", "__at"], "left").where(filled)
            .select(session.alias(S), (F.col("__i") + F.col("__add")).cast("bigint").alias("line_no"), "raw"))


def parse_entries(lines: DataFrame) -> DataFrame:
    """A2: parse each line as one JSON value (duplicate keys: last wins); all other lines are dropped.

    Returns ``(session_id, line_no, type, content)`` with ``content`` a VARIANT.
    """
    # exploded, not filtered: a filter would be pushed below the projection and parse each line again
    v = F.filter(F.array(strict_json("raw")), lambda x: x.isNotNull())
    parsed = lines.where(strip_ws("raw") != "").select(S, "line_no", F.explode(v).alias("__v"))
    return parsed.select(
        S, "line_no",
        F.when(F.schema_of_variant(F.try_variant_get("__v", "$.type", "variant")) == "STRING",
               F.try_variant_get("__v", "$.type", "string")).alias("type"),
        F.try_variant_get("__v", "$.message.content", "variant").alias("content"),
    )

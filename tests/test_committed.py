"""Batches count once; killed, failing and repeated writes leave no trace; compaction."""
import datetime as dt
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionsift.sources import committed as CM
from sessionsift.sources import results_io as IO


def files(path):
    return [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def results(df, rows):
    return df([(True, f"ctx {n}", dt.datetime(2024, 1, 1 + day, 12), "cli", key, "t", 10, 4, n) for n, (key, day) in enumerate(rows)],
              "ok boolean, optimized_context string, ts timestamp, cli string, session_id string, trigger string, initial_size long, final_size long, ingest_seq long")


def test_failing_then_repeated_batches_leave_each_row_once(spark, df, tmp_path):
    path = str(tmp_path / "log")
    rows = results(df, [("a", 0), ("b", 1), ("a", 1), ("c, d", 2)]).repartition(3)

    def fails(batches):
        for b in batches:
            yield b
            raise RuntimeError("killed on the way")

    with pytest.raises(Exception, match="killed on the way"):
        IO.append_results(rows.mapInArrow(fails, rows.schema), path, batch="x/1")
    assert IO.read_log(spark, path).count() == 0 and not CM.manifests(path)
    for _ in range(3):
        IO.append_results(rows, path, batch="x/1")
    IO.append_results(rows.limit(0), path, batch="x/2")
    got = IO.read_log(spark, path)
    assert sorted((r.session_id, r.ingest_seq, str(r.day), r.saved_chars) for r in got.collect()) == [
        ("a", 0, "2024-01-01", 6), ("a", 2, "2024-01-02", 6), ("b", 1, "2024-01-02", 6), ("c_ d", 3, "2024-01-03", 6)]
    pruned = got.where(F.col("day") == "2024-01-02").select("ingest_seq")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in pruned, pruned
    assert [(m["batch"], m["order"], m["rows"]) for m in CM.manifests(path)] == [("x/1", 1, 4), ("x/2", 2, 0)]


def test_a_job_killed_before_its_commit_does_not_show(spark, df, tmp_path):
    path = str(tmp_path / "t")
    options = {"path": path, "batch": "1"}
    schema = df([("k",)], "key string").schema
    batch = pa.record_batch([pa.array(["k"])], names=["key"])
    first, second = CM._Writer(options, schema), CM._Writer(options, schema)
    first.write(iter([batch]))  # the driver dies here
    message = second.write(iter([batch]))
    assert CM.read_committed(spark, path, "key string").count() == 0
    second.commit([message, None])
    first.commit([first.write(iter([batch]))])  # a late attempt of the same batch
    assert [r.key for r in CM.read_committed(spark, path).collect()] == ["k"]
    assert CM.vacuum(path) == 1 and CM.vacuum(path) == 0 and len(files(path)) == 1
    empty = second.write(iter([]))
    assert empty.files == [] and empty.rows == 0
    second.abort([message])
    assert files(path) == []


def test_contexts_compact_to_one_generation(spark, df, tmp_path):
    path = str(tmp_path / "contexts")
    assert IO.read_contexts(spark, path).count() == 0
    want = {}
    for n, keys in enumerate((["a", "b"], ["b", "c"], ["a"], ["d", "b"])):
        rows = results(df, [(k, n) for k in keys]).withColumn("optimized_context", F.concat(F.lit(f"batch {n} of "), "session_id"))
        assert IO.write_contexts(rows, path, batch=f"{n}") and not IO.write_contexts(rows, path, batch=f"{n}")
        want |= {k: f"batch {n} of {k}" for k in keys}
        if n == 2:
            assert IO.compact_contexts(spark, path)
        assert {r.key: r.context for r in IO.read_contexts(spark, path).collect()} == want
    assert len({f.split("batch=")[1].split("/")[0] for f in IO.read_contexts(spark, path).inputFiles()}) == 2  # base and a delta
    assert IO.compact_contexts(spark, path) and not IO.compact_contexts(spark, path)
    now = IO.read_contexts(spark, path)
    assert {f.split("batch=")[1].split("/")[0] for f in now.inputFiles()} == {CM.live_manifests(path)[0]["batch"]}
    assert {r.key: r.context for r in now.collect()} == want
    before = len(files(path))
    assert 0 < CM.vacuum(path) < before and {r.key: r.context for r in IO.read_contexts(spark, path).collect()} == want


def test_a_batch_committed_during_compaction_stays_later(spark, df, tmp_path):
    path = str(tmp_path / "contexts")
    for n in (0, 1):
        IO.write_contexts(results(df, [("a", n)]).withColumn("optimized_context", F.lit(f"old {n}")), path, batch=f"{n}")

    def meanwhile(rows, live):
        IO.write_contexts(results(df, [("a", 5)]).withColumn("optimized_context", F.lit("new")), path, batch="between")
        return IO._latest(rows, live)

    CM.compacted(spark, path, meanwhile, by=("bucket",))
    assert [r.context for r in IO.read_contexts(spark, path).collect()] == ["new"]

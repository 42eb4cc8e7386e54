"""H7 as one live stream against the batch pass: late micro-batches, a start from a batch, state size, both state forms."""
import random

import pytest
from pyspark.sql import functions as F

from sessionsift.plans.optimize import optimize_messages
from sessionsift.streaming import live as LV

SCHEMA = "session_id string, msg_no long, info struct<role: string>, parts array<struct<type: string, callID: string, tool: string, state: struct<status: string, input: string, output: string>>>"


def messages(seed, n=60):
    rnd, rows = random.Random(seed), []
    for s in (None, "a", "b"):
        for m in range(n):
            if rnd.random() < 0.3:
                rows.append((s, m, ("user",), rnd.choice([None, [], [("text", None, None, None)]])))
                continue
            parts = []
            for p in range(rnd.randrange(4)):
                status = rnd.choice(["completed", "completed", "error", "running"])
                cmd = rnd.choice(['{"cmd":"x"}', '{"cmd":"y","n":1}', '{"n":2}', '["z"]', "null"])
                parts.append(("tool", f"{m}.{p}", rnd.choice(["bash", "read", "Write", None]), rnd.choice([(status, cmd, f"out {m}.{p}"), None]) if rnd.random() < 0.1 else (status, cmd, f"out {m}.{p}")))
            rows.append((s, m, rnd.choice([("assistant",), None]), parts))
    rnd.shuffle(rows)
    return rows


def streamed(spark, tmp_path, rows, parts, **how):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:02d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    report = {}
    return LV.run_live(LV.live_changes(stream, **how), report=report), report


def same(spark, rows, changes):
    table = spark.createDataFrame(rows, SCHEMA)
    want, counts = optimize_messages(table)
    got, got_counts = LV.rewritten_messages(table, changes)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert sorted(map(repr, got_counts.select("session_id", "deduped", "purged_errors").collect())) == sorted(map(repr, counts.collect()))
    assert changes.count() == changes.dropDuplicates().count() > 20


@pytest.mark.parametrize("files", [True, False])
def test_late_micro_batches_end_like_the_batch(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(LV, "socket_files", lambda s: files)
    rows = messages(1)
    changes, report = streamed(spark, tmp_path, rows, 6)
    same(spark, rows, changes)
    assert report["batches"] == 6
    if files:  # newest calls, one row of turns a session, and open errors: no texts, no closed errors
        start = LV.live_start(spark.createDataFrame(rows, SCHEMA)).groupBy("kind").count().collect()
        by = {r.kind: r["count"] for r in start}
        assert report["state_rows"] <= by["done"] + 3 + by.get("error", 0) + 3 and report["state_bytes"] > 0


def test_stream_goes_on_from_a_batch(spark, tmp_path):
    rows = sorted(messages(2), key=lambda r: r[1])
    old, new = [r for r in rows if r[1] < 25], [r for r in rows if r[1] >= 25]
    random.Random(3).shuffle(new)
    table = spark.createDataFrame(old, SCHEMA)
    start = LV.live_start(table)
    done, counts = optimize_messages(table)
    changes, _ = streamed(spark, tmp_path, new, 5, start=start)
    # a part changed by the history counts once: what the batch changed, then what the stream adds
    first = LV.rewritten_messages
    before = spark.createDataFrame(rows, SCHEMA)
    want, want_counts = optimize_messages(before)
    got, _ = first(done.unionByName(spark.createDataFrame(new, SCHEMA)), changes)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    total = {r.session_id: r.deduped + r.purged_errors for r in want_counts.collect()}
    seen = {r.session_id: r.deduped + r.purged_errors for r in counts.collect()}
    for r in changes.groupBy("session_id").count().collect():
        seen[r.session_id] = seen.get(r.session_id, 0) + r["count"]
    assert seen == total


def test_idle_sessions_are_forgotten():
    class Handle:
        def __init__(self):
            self.timers = []
            self.listTimers = lambda: iter(self.timers)
            self.deleteTimer = self.timers.remove
            self.registerTimer = self.timers.append

    class Clock:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 1000)

    live = LV.LivePass(idle_ms=50)
    live.handle = Handle()
    live._wind(Clock)
    live._wind(Clock)
    assert live.handle.timers == [1050]


def test_rows_of_messages(spark):
    rows = [("s", 1, ("user",), [("tool", "c", "bash", ("error", '{"n":1}', None)), ("tool", "d", "bash", ("error", '{"t":"x"}', None))])]
    got = [tuple(r) for r in LV.live_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("part_no").collect()]
    assert got == [("s", 1, -1, "user", None), ("s", 1, 1, "error", None)]
    assert LV.live_rows(spark.createDataFrame([], SCHEMA)).where(F.lit(True)).count() == 0

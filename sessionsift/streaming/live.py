"""H7 as one live stream: the whole pass (F3, C3, E5) in a single stateful operator.

``live_changes`` turns a stream of messages, in whatever order they arrive, into a log of changed parts:
``superseded`` outputs and ``masked`` inputs.  The state of a session is kept in three variables of
``transformWithState``, so that a message touches only the entries it concerns: a map from signature to its newest
call, the newest user turns, and the list of errors that are not stale yet.  Outputs, inputs and texts never enter
the state.  ``rewritten_messages`` applies the log to the messages; after the last message this is what the batch
``optimize_messages`` gives.

A stream can go on from a batch: ``live_start`` reduces the messages seen so far to the state that they leave.
With ``idle_ms`` a timer forgets sessions without messages for so long; that is exact only if none comes later.

``transformWithState`` talks to Python workers over a socket of its own.  It is used where that is a file
(``spark.python.unix.domain.socket.enabled``, as ``get_spark`` sets it); elsewhere no port is opened, the same
processor runs in ``applyInPandasWithState`` with the three variables as one value for each session (no ``start``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionsift import constants as C
from sessionsift.functions.signature import tool_signature
from sessionsift.functions.text import is_protected
from sessionsift.operators.calls import _mask_json
from sessionsift.operators.extract import flatten_tool_parts
from sessionsift.operators.ordered import join_null_safe
from sessionsift.session import scratch_dir

S = "session_id"
ROW = "session_id string, msg_no long, part_no int, kind string, signature string"
CHANGE = "session_id string, msg_no long, part_no int, kind string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_rows(messages: DataFrame) -> DataFrame:
    """What a message means for the pass, one row each: a ``user`` turn, a ``done`` call that newer ones may
    supersede, an ``error`` whose input holds text to mask.  Other parts give no row."""
    parts = F.transform(F.coalesce("parts", F.array()), lambda p, i: F.struct(i.alias("no"), p.alias("p")))
    head = F.array(F.struct(F.lit(-1).alias("no"), F.get("parts", F.lit(0)).alias("p")))
    rows = messages.select(S, "msg_no", F.col("info.role").alias("role"), F.explode(F.concat(head, parts)).alias("x"))
    rows = rows.select(S, "msg_no", "role", F.col("x.no").cast("int").alias("part_no"), F.col("x.p.type").alias("type"), F.col("x.p.tool").alias("tool"), F.col("x.p.state").alias("state"))
    call = (F.col("part_no") >= 0) & (F.col("type") == "tool") & F.col("state").isNotNull() & ~is_protected("tool")
    done = call & (F.col("state.status") == "completed") & (F.coalesce("state.output", F.lit("")) != C.OUTPUT_MARKER)
    failed = call & (F.col("state.status") == "error")
    kind = F.when((F.col("part_no") < 0) & (F.col("role") == "user"), "user").when(done, "done").when(failed & _mask_json(F.col("state.input"))[1], "error")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    rows = rows.withColumn("signature", tool_signature("tool", "state.input"))
    return rows.select(S, "msg_no", "part_no", "kind", F.when(F.col("kind") == "done", F.col("signature")).alias("signature"))


class LivePass(StatefulProcessor):
    """One session: see the module's text."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getMapState("newest", "signature string", "msg_no long, part_no int")
        self.turns = handle.getValueState("turns", "turns array<long>")
        self.errors = handle.getListState("errors", "msg_no long, part_no int")

    def _learn(self, rows: pd.DataFrame) -> Iterator[tuple[int, int, str]]:
        """Takes rows into the state and yields the parts that change by it."""
        # plain tuples: a session has a few rows in a batch, for which frames of their own cost more than the work
        calls: dict[str | None, set] = {}
        turns, new = [], []
        for kind, signature, m, p in zip(*(rows[c].tolist() for c in ("kind", "signature", "msg_no", "part_no"))):
            if kind == "done" and isinstance(signature, str):
                calls.setdefault(signature, set()).add((int(m), int(p)))
            elif kind == "user":
                turns.append(int(m))
            elif kind == "error":
                new.append((int(m), int(p)))
        for signature, seen in sorted(calls.items()):
            key = (signature,)
            before = {tuple(self.newest.getValue(key))} if self.newest.containsKey(key) else set()
            top = max(seen | before)
            if {top} != before:
                self.newest.updateValue(key, top)
            for m, p in sorted((seen | before) - {top}):
                yield m, p, "superseded"
        known = [int(t) for t in self.turns.get()[0]] if self.turns.exists() else []
        if turns:
            known = sorted([*known, *turns])[-C.PURGE_ERROR_TURNS:]
            self.turns.update((known,))
        # an error is stale once the n-th newest user turn comes after it, in whatever order they arrived
        bound = known[0] if len(known) == C.PURGE_ERROR_TURNS else None
        if bound is None:
            if new:
                self.errors.appendList(new)
            return
        waiting = [tuple(e) for e in self.errors.get()] if turns and self.errors.exists() else []
        for m, p in (*waiting, *new):
            if m < bound:
                yield m, p, "masked"
        left = [e for e in new if e[0] >= bound]
        if any(m < bound for m, _ in waiting):
            left = [e for e in waiting if e[0] >= bound] + left
            if left:
                self.errors.put(left)
            else:
                self.errors.clear()
        elif left:
            self.errors.appendList(left)

    def _wind(self, timers) -> None:
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = [c for part in rows for c in self._learn(part)]
        self._wind(timerValues)
        if not changes:
            return
        yield pd.DataFrame({S: pd.Series([key[0]] * len(changes), dtype="object"), "msg_no": pd.Series([c[0] for c in changes], dtype="int64"),
                            "part_no": pd.Series([c[1] for c in changes], dtype="int32"), "kind": pd.Series([c[2] for c in changes], dtype="object")})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for _ in self._learn(initialState):
            pass  # told when it happened
        self._wind(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.turns.clear()
        self.errors.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Held:
    """Map, value and list state over one value: what ``LivePass`` needs of a handle."""

    def __init__(self, state: GroupState):
        newest, turns, errors = state.get if state.exists else ([], [], [])
        self.newest = {(r[0],): (r[1], r[2]) for r in newest}
        self.turns, self.errors = [int(t) for t in turns], [tuple(e) for e in errors]

    def getMapState(self, *_):
        return _Variable(containsKey=self.newest.__contains__, getValue=self.newest.get, updateValue=self.newest.__setitem__)

    def getValueState(self, *_):
        def update(value):
            self.turns = list(value[0])
        return _Variable(exists=lambda: bool(self.turns), get=lambda: (self.turns,), update=update)

    def getListState(self, *_):
        def put(rows):
            self.errors = list(rows)
        return _Variable(exists=lambda: bool(self.errors), get=lambda: list(self.errors), put=put, appendList=lambda rows: put([*self.errors, *rows]), clear=lambda: put([]))

    def stored(self) -> tuple:
        return [(k[0], *v) for k, v in self.newest.items()], self.turns, self.errors


class _Variable:
    def __init__(self, **methods):
        self.__dict__.update(methods)


_STATE = "newest array<struct<signature:string,msg_no:long,part_no:int>>, turns array<long>, errors array<struct<msg_no:long,part_no:int>>"


def _one_value(idle_ms: int | None):
    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, live = _Held(state), LivePass()
        live.init(held)
        yield from live.handleInputRows(key, pdfs, None)
        state.update(held.stored())
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
    return run


def socket_files(spark: SparkSession) -> bool:
    return spark.sparkContext.getConf().get("spark.python.unix.domain.socket.enabled", "false") == "true"


def live_changes(messages: DataFrame, start: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """``(session_id, msg_no, part_no, kind)``: every part once, as soon as the messages so far change it.

    ``messages`` is a stream as ``optimize_messages`` reads tables, every message once; ``start`` comes from
    ``live_start``."""
    if not socket_files(messages.sparkSession):
        if start is not None:
            raise ValueError("a start state needs spark.python.unix.domain.socket.enabled")
        timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
        return live_rows(messages).groupBy(S).applyInPandasWithState(_one_value(idle_ms), CHANGE, _STATE, "append", timeout)
    first = start.groupBy(S) if start is not None else None
    return live_rows(messages).groupBy(S).transformWithStateInPandas(
        LivePass(idle_ms), CHANGE, "Append", "ProcessingTime" if idle_ms else "None", first)


def live_start(messages: DataFrame) -> DataFrame:
    """The rows that matter of a table of messages: the newest call of each signature, each session's newest
    user turns, and errors that are not stale."""
    rows = live_rows(messages)
    done = rows.where("kind = 'done'").groupBy(S, "signature").agg(F.max(F.struct("msg_no", "part_no")).alias("c")).select(S, "c.msg_no", "c.part_no", F.lit("done").alias("kind"), "signature")
    users = rows.where("kind = 'user'")
    # the newest turns by repeated maxima: partial aggregates, no session in one task
    turns = None
    left = users.select(S, "msg_no")
    for _ in range(C.PURGE_ERROR_TURNS):
        top = left.groupBy(S).agg(F.max("msg_no").alias("top"))
        turns = top if turns is None else turns.unionByName(top)
        left = join_null_safe(left, top, [S]).where("msg_no < top").select(S, "msg_no")
    turns = turns.where("top IS NOT NULL")
    bound = turns.groupBy(S).agg(F.min("top").alias("bound"), F.count("*").alias("n"))
    errors = join_null_safe(rows.where("kind = 'error'"), bound, [S], "left")
    errors = errors.where((F.coalesce("n", F.lit(0)) < C.PURGE_ERROR_TURNS) | (F.col("msg_no") >= F.col("bound")))
    users = turns.select(S, F.col("top").alias("msg_no"), F.lit(-1).alias("part_no"), F.lit("user").alias("kind"), F.lit(None).cast("string").alias("signature"))
    return done.unionByName(users).unionByName(errors.select(S, "msg_no", "part_no", "kind", "signature"))


def rewritten_messages(messages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages with the changed parts replaced, and ``(session_id, deduped, purged_errors)`` of every session
    with calls, as ``optimize_messages`` gives them."""
    from sessionsift.plans.optimize import replaced_parts
    calls = flatten_tool_parts(messages)
    marked = join_null_safe(calls, changes, [S, "msg_no", "part_no"], "left")
    marked = marked.withColumn("superseded", F.coalesce(F.col("kind") == "superseded", F.lit(False))).withColumn("masked", F.coalesce(F.col("kind") == "masked", F.lit(False)))
    new = marked.withColumn("output", F.when(F.col("superseded"), F.lit(C.OUTPUT_MARKER)).otherwise(F.col("output")))
    new = new.withColumn("input", F.when(F.col("masked"), _mask_json(F.col("input"))[0]).otherwise(F.col("input")))
    counts = marked.groupBy(S).agg(F.count_if("superseded").alias("deduped"), F.count_if("masked").alias("purged_errors"))
    return replaced_parts(messages, new), counts


def run_live(stream: DataFrame, name: str = "live", report: dict | None = None) -> DataFrame:
    """Drive ``live_changes`` over everything available into a Parquet log in the shared scratch folder (a
    restart resumes there) and read the log back.  The stream's state store is RocksDB for the time of the run.
    ``report`` gets the micro-batches, the rows and the bytes of the state."""
    spark: SparkSession = stream.sparkSession
    base, before = scratch_dir(spark, f"stream-{name}"), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    if report is not None:
        steps = [p for p in q.recentProgress if p["stateOperators"]]
        report.update(batches=len([p for p in steps if p["numInputRows"]]), state_rows=steps[-1]["stateOperators"][0]["numRowsTotal"] if steps else 0,
                      state_bytes=steps[-1]["stateOperators"][0]["memoryUsedBytes"] if steps else 0)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")

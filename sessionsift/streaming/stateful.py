"""Stateful streams keyed by session: J1 stream_superseded, J2 stream_stale_errors, J5 stream_handoffs.

Each is ``groupBy(key).applyInPandasWithState`` in append mode: the state per
key is a handful of scalars (newest call; newest user turns plus pending errors;
pending hand-off body), so it stays small however long the session runs.
J1 and J5 can release idle keys after a processing-time TTL (``ttl_ms``).
Every stream ends in the same state as its batch twin (F3, C3, D4).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionsift import constants as C
from sessionsift.functions.signature import tool_signature
from sessionsift.functions.text import is_protected, sanitize_session_key

S = "session_id"


def _with_ttl(fn, ttl_ms: int | None):
    """``fn`` with a processing-time TTL for idle keys (J1, J5).  Off by default: a run with
    ``availableNow`` and a pending timeout keeps scheduling no-data batches."""
    def run(key, pdfs, state):
        return fn(key, pdfs, state, ttl_ms)
    return run


# --------------------------------------------------------------------------- J1
def _superseded(key, pdfs: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({S: pd.Series([], dtype="object"), "call_id": pd.Series([], dtype="int64")})
        return
    # plain tuples: most groups have one row, for which work on frames costs more than the rest
    rows = [r for pdf in pdfs for r in zip(pdf["seq"].tolist(), pdf["call_id"].tolist())]
    old = tuple(state.get) if state.exists else None
    top = max(rows if old is None else [*rows, old])
    out = [c for s, c in rows if (s, c) != top]
    if old is not None and old != top:
        out.append(old[1])  # a newer identical call arrived: the stored one is now superseded
    state.update((int(top[0]), int(top[1])))
    if ttl_ms:
        state.setTimeoutDuration(ttl_ms)
    if out:
        yield pd.DataFrame({S: [key[0]] * len(out), "call_id": pd.Series(out, dtype="int64")})


def _timeout(ttl_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def stream_superseded(calls: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``(session_id, call_id)`` of completed, non-protected calls once a later identical call exists.

    Compared by ``seq``, so a late older call is itself reported.
    """
    elig = calls.where((F.col("status") == "completed") & ~is_protected("tool")
                       & (F.coalesce(F.col("output"), F.lit("")) != C.OUTPUT_MARKER))
    keyed = elig.select(S, tool_signature("tool", "input").alias("signature"), "seq", "call_id")
    return keyed.groupBy(S, "signature").applyInPandasWithState(
        _with_ttl(_superseded, ttl_ms),
        "session_id string, call_id long", "seq long, call_id long", "append", _timeout(ttl_ms))


# --------------------------------------------------------------------------- J2
def _stale(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turns, pending = (list(state.get[0]), [(p["seq"], p["call_id"]) for p in state.get[1]]) if state.exists else ([], [])
    for pdf in pdfs:
        for seq, call, is_user, is_err in zip(*(pdf[c].tolist() for c in ("seq", "call_id", "is_user", "is_err"))):
            if is_user:
                turns.append(seq)
            elif is_err:
                pending.append((seq, call))
    turns = sorted(turns)[-C.PURGE_ERROR_TURNS:]
    # an error is stale once the n-th newest user turn comes after it, in whatever order they arrived
    bound = turns[0] if len(turns) == C.PURGE_ERROR_TURNS else None
    due = [c for s, c in pending if bound is not None and s < bound]
    keep = [{"seq": int(s), "call_id": int(c)} for s, c in pending if bound is None or s >= bound]
    state.update(([int(t) for t in turns], keep))
    if due:
        yield pd.DataFrame({S: [key[0]] * len(due), "call_id": pd.Series(due, dtype="int64")})


def stream_stale_errors(messages: DataFrame) -> DataFrame:
    """Errored, non-protected calls once they are ``PURGE_ERROR_TURNS`` user turns old.

    ``messages(session_id, seq, call_id, tool, status)`` with user turns as
    ``tool = 'USER'``.  Only user turns of a greater ``seq`` age an error, so rows
    may arrive late and in any order.  The state of a session holds its newest
    ``PURGE_ERROR_TURNS`` user turns and the errors that are not yet stale: it
    grows only while errors come and no user turn follows them.
    """
    m = messages.select(S, "seq", "call_id", (F.col("tool") == "USER").alias("is_user"),
                        ((F.col("status") == "error") & ~is_protected("tool") & (F.col("tool") != "USER")).alias("is_err"))
    return m.groupBy(S).applyInPandasWithState(
        _stale, "session_id string, call_id long",
        "turns array<long>, pending array<struct<seq:long,call_id:long>>", "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------------- J5
def _handoff(key, pdfs: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "ingest_seq": pd.Series([], dtype="int64"),
                            "ts": pd.Series([], dtype="datetime64[us]"), "context": pd.Series([], dtype="object")})
        return
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values("ingest_seq")
    pending = state.get[0] if state.exists else None
    out = []
    for kind, seq, ts, body in zip(rows["kind"], rows["ingest_seq"], rows["ts"], rows["body"]):
        if kind == "store":
            pending = body
        elif kind == "consume" and pending is not None:
            out.append((int(seq), ts, C.OPTIMIZED_HEADER + pending))
            pending = None
    if pending is None:
        state.remove()
    else:
        state.update((pending,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
    yield pd.DataFrame({"key": [key[0]] * len(out), "ingest_seq": pd.Series([o[0] for o in out], dtype="int64"),
                        "ts": pd.Series([o[1] for o in out], dtype="datetime64[us]"),
                        "context": [o[2] for o in out]})


def stream_handoffs(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Consume-once hand-off; state = the pending stored body, cleared on consume."""
    ev = (events.where(F.col("kind").isin("store", "consume"))
          .select(sanitize_session_key(S).alias("key"), "ingest_seq", F.col("ts").cast("timestamp").alias("ts"),
                  "kind", "body"))
    return ev.groupBy("key").applyInPandasWithState(
        _with_ttl(_handoff, ttl_ms), "key string, ingest_seq long, ts timestamp, context string", "body string",
        "append", _timeout(ttl_ms))

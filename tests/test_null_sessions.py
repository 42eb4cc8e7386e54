"""A null session is a session: its rows stay together in every operator."""
import datetime as dt

from sessionsift.operators import rank, results
from sessionsift.operators.extract import build_requests
from sessionsift.operators.params import apply_model_limits
from sessionsift.plans.optimize import optimize_context, transcripts_to_docs


def docs_of(df):
    return df([(None, 0, "alpha beta gamma"), (None, 1, "delta"), ("s", 0, "epsilon")], "session_id string, pos long, text string")


def test_gate_limits_summary_and_requests(df):
    docs = docs_of(df)
    req = df([(None, "q", "big", 0), ("s", "", "", 0), ("none", "", "", 0)], "session_id string, query string, model string, min_input_size long")
    gate = {r.session_id: (r.gate, r.n_docs, r.initial_size) for r in rank.gate_by_size(req, rank.result_sizes(docs)).collect()}
    assert gate == {None: ("run", 2, 21), "s": ("run", 1, 7), "none": ("no_optimization", 0, 0)}
    limits = df([("big", "max_chunks", "2")], "model string, key string, value string")
    got = {r.session_id: (r.size, r.max_chunks) for r in apply_model_limits(req.drop("min_input_size"), docs, limits, stored={"auto_compression_chars": 10}).collect()}
    assert got == {None: (21, 2), "s": (7, 6), "none": (0, 6)}
    assert {r.session_id: (r.docs, r["query"], r.model) for r in results.summarize_context(docs, req).collect()}[None] == (2, "q", "big")
    contexts = df([(None, 0, "a", "p", None, "m", None, None, None)], "session_id string, pos long, text string, in_prompt string, out_prompt string, in_model string, out_model string, in_options map<string,string>, out_options map<string,string>")
    assert [(r.session_id, r.n_docs, r.size) for r in build_requests(contexts).collect()] == [(None, 1, 1)]


def test_optimized_and_applied(df):
    docs = docs_of(df)
    req = df([(None, "beta", 0), ("s", "x", 0)], "session_id string, query string, min_input_size long")
    out = optimize_context(docs, req)
    got = {r.session_id: r for r in out.collect()}
    assert set(got) == {None, "s"} and got[None].status == "optimized" and got[None].initial_size == 21 and "alpha" in got[None].optimized_context
    applied = [(r.session_id, r.pos, r.text) for r in results.apply_contexts(docs, out).collect()]
    mine = sorted((p, t) for s, p, t in applied if s is None)
    assert [p for p, _ in mine] == [0, 1] and mine[1][1] == "## Optimized Context\n\n" + got[None].optimized_context
    kept = results.apply_contexts(docs, out.where("session_id = 's'")).collect()
    assert sorted(r.text for r in kept if r.session_id is None) == ["alpha beta gamma", "delta"]


def test_transcript_of_a_null_session(df):
    lines = ['{"type":"user","message":{"content":"hello"}}', '{"type":"assistant","message":{"content":[{"type":"tool_use","id":"t","name":"read","input":{"a":1}}]}}',
             '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"t","content":[{"type":"text","text":"out"}]}]}}']
    rows = [(s, i + 1, x) for s in (None, "s") for i, x in enumerate(lines)]
    got = sorted((r.session_id or "", r.text) for r in transcripts_to_docs(df(rows, "session_id string, line_no long, raw string")).collect())
    assert got == sorted((s, t) for s in ("", "s") for t in ("hello", "[tool read] out"))


def test_last_session_without_name(df):
    t = dt.datetime(2024, 1, 1)
    log = df([(1, t, None, 10, 4, 6), (2, t, "a", 10, 5, 5), (3, t, None, 1, 1, 0)], "ingest_seq long, ts timestamp, session_id string, initial_chars long, result_chars long, saved_chars long")
    got = {r.window: tuple(r)[1:4] for r in results.stats_windows(log, "2024-01-02 00:00:00").collect()}
    assert got["last"] == (1, 1, 1) and got["session"] == (2, 11, 5) and got["overall"] == (3, 21, 10)
    assert {r.window: r.compactions for r in results.stats_windows(log.limit(0), "2024-01-02 00:00:00").collect()}["session"] == 0

"""The transcript hook pair: gate, failing sessions, a repeated batch, contexts handed out once."""
import datetime as dt

from sessionsift.plans.hooks import precompact, run_precompact, session_starts
from sessionsift.sources import results_io as IO

T = dt.datetime(2024, 5, 1)
EVENT = "session_id string, ts timestamp, trigger string, custom_instructions string, ingest_seq long"


def line(kind, text):
    return '{"type":"%s","message":{"content":"%s"}}' % (kind, text)


def test_a_batch_run_twice(spark, df, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "big.jsonl").write_text("\n".join(line("user", f"{w} " * 30) for w in ("alpha", "beta", "gamma")) + "\n")
    (root / "small.jsonl").write_text(line("user", "too small") + "\n")
    events = df([("big", T, "auto", "beta please", 1), ("small", T, "manual", None, 2), ("gone", T, "auto", "", 3)], EVENT)
    log, contexts = str(tmp_path / "log"), str(tmp_path / "contexts")
    for _ in range(2):
        out = run_precompact(spark, str(root), events, log, contexts, "b", stored={"min_chars": 100})
        got = {r.session_id: (r.status, r.initial_size) for r in out.collect()}
        assert got == {"big": ("optimized", 179 + 149 + 179), "small": ("no_optimization", 9), "gone": ("no_optimization", 0)}
        assert [(r.session_id, r.cli, r.trigger) for r in IO.read_log(spark, log).collect()] == [("big", "claude-code", "auto")]
        assert [r.key for r in IO.read_contexts(spark, contexts).collect()] == ["big"]
    messages = {r.session_id: r.message for r in out.collect()}
    assert "saved" in messages["big"] and "0%" in messages["small"]
    starts = df([("big", T, "startup", 10), ("big", T, "compact", 11), ("big", T, "compact", 12), ("small", T, "compact", 13)], "session_id string, ts timestamp, source string, ingest_seq long")
    handed = session_starts(out, starts).collect()
    assert [(r.key, r.ingest_seq) for r in handed] == [("big", 11)] and handed[0].context.startswith("## Optimized Context\n\nbeta")


def test_a_model_that_cannot_be_built_fails_its_session(df):
    def broken():
        raise ImportError("no library")
    lines = df([("a", 1, line("user", "hello there"))], "session_id string, line_no long, raw string")
    r = precompact(lines, df([("a", T, "auto", "", 1)], EVENT), stored={"min_chars": 1}, scorer=broken).first()
    assert (r.ok, r.status, r.reason, r.optimized_context) == (False, "failed", "ImportError: no library", "") and "no library" in r.message

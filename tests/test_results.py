from sessionsift.operators import params as Pm
from sessionsift.operators import results as R
from sessionsift.sources.requests import validate_requests
from sessionsift.plans.optimize import optimize_context

LOG = "ingest_seq long, ts timestamp, session_id string, initial_chars long, result_chars long, saved_chars long"


def test_stats_two_rows(spark, df):
    import datetime as dt
    rows = [(1, dt.datetime(2024, 1, 30, 9), "a", 80, 30, 50), (2, dt.datetime(2024, 1, 30, 10), "b", 20, 10, 10)]
    out = {r.window: r for r in R.stats_windows(df(rows, LOG), "2024-01-30 12:00:00").collect()}
    assert [out[w].compactions for w in ("last", "session", "today", "week", "month", "overall")] == [1, 1, 2, 2, 2, 2]
    assert out["last"].saved_pct == 50 and out["overall"].saved_pct == 60
    rep = {r.metric: r for r in R.stats_report(df(rows, LOG), "2024-01-30 12:00:00").collect()}
    assert rep["saved %"].overall == "60%" and rep["initial chars"].overall == "100"


def test_stats_empty_log(spark, df):
    out = R.stats_windows(df([], LOG), "2024-01-30 12:00:00").collect()
    assert all(r.compactions == 0 and r.saved_pct == 0 for r in out)


def test_handoff_consumed_once(spark, df):
    rows = [("s1", 1, None, "store", "A"), ("s1", 2, None, "consume", None), ("s1", 3, None, "consume", None),
            ("s2", 4, None, "consume", None), ("s1", 5, None, "startup", None), ("s1", 6, None, "store", "B"),
            ("s1", 7, None, "store", "C"), ("s1", 8, None, "consume", None)]
    ev = df(rows, "session_id string, ingest_seq long, ts timestamp, kind string, body string")
    got = sorted((r.ingest_seq, r.context) for r in R.consume_handoffs(ev).collect())
    assert got == [(2, "## Optimized Context\n\nA"), (8, "## Optimized Context\n\nC")]


def test_override_rules(spark, df):
    rows = [("max_chunks", "8.6"), ("compression_rate", "1.5"), ("bogus", "1"), ("model_limits", '{"m":{"max_chunks":3}}'),
            ("model_limits", "x"), ("embed_model", "  "), (" MAX_CHUNKS ", "8"), ("min_chars", "-3")]
    out = [(r.ok, r.error) for r in Pm.validate_overrides(df(rows, "key string, value string")).collect()]
    assert out[0] == (False, "max_chunks must be a positive integer.")
    assert out[1] == (False, "compression_rate must be between 0 and 1.")
    assert out[2][0] is False and out[3] == (True, None) and out[4] == (False, "model_limits must be valid JSON.")
    assert out[5] == (False, "embed_model must be a non-empty string.") and out[6] == (True, None)
    assert out[7] == (False, "min_chars must be a positive number.")


def test_param_rounding(spark, df):
    r = df([("s", {"max_chunks": "8.6", "total_prune_budget_chars": "5000.4"})], "session_id string, options map<string,string>")
    p = Pm.resolve_params(r).first()
    assert (p.max_chunks, p.total_prune_budget_chars) == (9, 5000)


def test_request_validation(spark, df):
    raws = ['{broken}', '{"docs":"one text"}', '{"docs":["motor",7,null]}', '{"docs":[]}', '{"docs":0}',
            '{"docs":["motor","gear"]}']
    d = df([(r,) for r in raws], "raw string").selectExpr("try_parse_json(raw) as payload",
                                                           "try_variant_get(try_parse_json(raw), '$.docs') as docs")
    out = [(r.status, r.reason) for r in validate_requests(d).collect()]
    assert out[0][0] == out[1][0] == out[2][0] == "invalid_input"
    assert out[1][1] == "docs must be a list of strings" and out[2][1] == "docs must contain strings only"
    assert out[3][0] == out[4][0] == "no_optimization"
    assert out[5][0] == "run"


def test_gate_below_minimum(spark, df):
    docs = df([("s", 1, "123456789")], "session_id string, pos long, text string")
    req = df([("s", "q", 100)], "session_id string, query string, min_input_size long")
    r = optimize_context(docs, req).first()
    assert (r.status, r.initial_size, r.final_size) == ("no_optimization", 9, 9)
    assert r.reason == "context size 9 chars is below the threshold of 100 chars."


def test_optimize_end_to_end_shrinks(spark, df):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    docs = df([("s", i, " ".join(words[i % 11:] + words[:i % 11]) * 30) for i in range(12)],
              "session_id string, pos long, text string")
    req = df([("s", "alpha kappa")], "session_id string, query string")
    r = optimize_context(docs, req).first()
    assert r.status == "optimized" and 0 < r.final_size < r.initial_size


from sessionsift.functions.plugins import overlap_scorer  # noqa: E402


def test_optimize_with_pair_scorer_plugin(spark, df):
    docs = df([("s", 1, "zeta " * 600), ("s", 2, "alpha beta gamma " * 200), ("s", 3, "beta only " * 300)],
              "session_id string, pos long, text string")
    req = df([("s", "alpha beta", 2000)], "session_id string, query string, total_prune_budget_chars long")
    r = optimize_context(docs, req, scorer=overlap_scorer).first()
    # the best-scored doc (2 shared words) is first; the budget keeps only it
    assert r.status == "optimized" and r.optimized_context.split()[0] in ("alpha", "beta", "gamma")
    assert "zeta" not in r.optimized_context

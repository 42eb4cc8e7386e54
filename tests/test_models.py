"""K1 by name and K2: registry, device, batches, equal texts, failures."""
from sessionsift.functions import models as M
from sessionsift.functions import plugins as P
from sessionsift.plans.optimize import optimize_context, optimize_requests
from sessionsift.plans.queries_requests import stand_in_models
from sessionsift.sources.requests import read_requests


def sizes(batch_no):
    """An embedder that tells the size of the batch, the device and its own number."""
    def factory(device):
        return lambda texts: [[float(len(texts)), float(device == "fast"), float(batch_no)] for _ in texts]
    return factory


def test_equal_texts_once_and_batches_by_length(df):
    items = df([("one", "x" * 10)] * 5 + [("one", "y" * 200_000), ("two", "x" * 10), ("absent", "z")] + [("one", f"text {k:05}") for k in range(300)], "model string, text string")
    models = M.Models(embedders={"one": sizes(1), "two": sizes(2)}, device="fast", batch_chars=1100)
    rows = M.applied(items, "embedders", models, "array<double>").collect()
    assert len(rows) == 1 + 1 + 1 + 1 + 300  # equal texts of one model are one row
    by = {}
    for r in rows:
        by.setdefault(r.model, []).append(r)
    assert by["absent"][0].value is None and by["absent"][0].error == "KeyError: no model named 'absent'"
    assert [r.value for r in by["two"]] == [[1.0, 1.0, 2.0]]
    batches = [r.value[0] for r in by["one"]]
    assert max(batches) <= 100 and sorted(batches)[0] == 1.0 and all(r.value[1:] == [1.0, 1.0] for r in by["one"])  # short texts share a batch


def test_a_factory_that_raises_fails_its_rows_only(df):
    def broken(device):
        raise ImportError("no such library")
    items = df([("ok", "a"), ("broken", "a"), ("ok", "b\tb")], "model string, text string")
    models = M.Models(embedders={"ok": M.counting_embedder("ab"), "broken": broken})
    got = {(r.model, r.error): r.value for r in M.applied(items, "embedders", models, "array<double>").collect()}
    assert got == {("ok", None): [1.0, 0.0], ("broken", "ImportError: no such library"): None, ("ok", "ValueError: tab"): None}


def test_plugin_columns_with_a_factory_that_raises(df):
    def broken():
        raise ModuleNotFoundError("No module named 'x'")
    docs = df([("s", 0, "alpha"), ("s", 1, "beta")], "session_id string, pos long, text string")
    req = df([("s", "alpha", 0)], "session_id string, query string, min_input_size long")
    for step in ("embedder", "scorer", "token_scorer"):
        r = optimize_context(docs, req, **{step: broken}).first()
        assert (r.status, r.reason, r.optimized_context) == ("failed", "ModuleNotFoundError: No module named 'x'", "")
    assert docs.select(P.embed_column("text", broken)["error"].alias("e")).distinct().count() == 1


def test_device_chooses_the_default_compressor(df):
    docs = df([("s", 0, "a long wordy sentence b")], "session_id string, pos long, text string")
    req = df([("s", "", 0, "letters", "remainder")], "session_id string, query string, min_input_size long, embed_model string, reranker_model string")
    kept = {d: optimize_context(docs, req, models=stand_in_models(d)).first().optimized_context for d in ("cpu", "fast")}
    assert kept == {"cpu": "long wordy sentence", "fast": "wordy sentence b"}


def test_requests_without_shared_and_null_ids(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join([
        '{"query":"alpha","docs":["alpha beta","gamma"],"options":{"embed_model":"letters","reranker_model":"shared"}}',
        '{"query":"alpha","docs":["delta"],"options":{"embed_model":"broken","reranker_model":"shared"}}',
        '{"request_id":"x","query":"q","docs":["epsilon zeta"],"options":{"embed_model":"vowels","reranker_model":"shared"}}',
        '{"request_id":"x","query":"q","docs":["eta"],"options":{"embed_model":"vowels","reranker_model":"absent"}}',
        '{"request_id":null,"docs":[]}', "junk"]))
    out = [tuple(r) for r in optimize_requests(read_requests(spark, str(tmp_path)), models=stand_in_models()).select("request_id", "ok", "status", "error_code", "initial_size", "optimized_context").collect()]
    want = [(None, True, "optimized", None, 15, "alpha"), (None, False, "failed", "dependency_missing", None, None), ("x", True, "optimized", None, 12, "epsilon"),
            ("x", False, "failed", "runtime_error", None, None), (None, True, "no_optimization", None, 0, ""), (None, False, "failed", "invalid_input", None, None)]
    assert sorted(out, key=str) == sorted([w if w[1] is False or w[5] == "" else (*w[:5], [o for o in out if o[4] == w[4]][0][5]) for w in want], key=str)
    assert {o[4]: o[5] for o in out if o[2] == "optimized"}.keys() == {15, 12}


def test_fail_open_keeps_the_other_rows(df):
    def step(text):
        if "7" in text:
            raise ValueError("boom")
        return float(len(text))
    docs = df([("abc",), ("a7",), ("",)], "text string")
    got = sorted((r.text, r.r.value, r.r.error) for r in docs.select("text", P.fail_open(step)("text").alias("r")).collect())
    assert got == [("", 0.0, None), ("a7", None, "ValueError: boom"), ("abc", 3.0, None)]

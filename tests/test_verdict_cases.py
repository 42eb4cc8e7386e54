"""Cases the fixtures do not hold: text after JSON, null sessions, odd white space, numbers, late stream rows,
request-level gates, failing plug-ins, copies of vectors."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionsift.functions import plugins as P
from sessionsift.functions.signature import tool_signature
from sessionsift.functions.text import strict_json, strip_text, strip_ws
from sessionsift.operators import calls as K
from sessionsift.operators import corpus, rank
from sessionsift.operators.params import validate_overrides
from sessionsift.plans.optimize import optimize_context, optimize_messages, optimize_requests, transcripts_to_docs
from sessionsift.sources.requests import read_requests
from sessionsift.sources.transcripts import read_transcripts
from sessionsift.streaming import stateful, windows

GOOD = ['{"a":1}', " [1, 2] ", '"x"', "null", "12.5", "true", '{"v":1,"w":[{}]}', '{"a":"]"}']
BAD = ['{"a":1} junk', "{bad", "1],[2", "1}", '1,"v":2', "1 2", "", "  ", '{"a":1},', "[1", '{"a":1}{"b":2}', "1,2", '"x":1', '1}{"v":2']


def test_strict_json(df):
    d = df([(x,) for x in GOOD + BAD], "raw string")
    got = {r.raw: r.ok for r in d.select("raw", strict_json("raw").isNotNull().alias("ok")).collect()}
    assert all(got[x] for x in GOOD) and not any(got[x] for x in BAD)


def test_signature_of_inputs_that_are_no_json(spark, df):
    d = df([("t", "{bad one"), ("t", "other bad"), ("t", '{"a":1} x'), ("t", '{"a":"\\u001f"}'), ("t", '{"a":"\\u001F"}'), ("t", '{"n":0.0000001}')],
           "tool string, input string")
    got = [r.s for r in d.select(tool_signature("tool", "input").alias("s")).collect()]
    assert len(set(got[:3])) == 3 and all(s.startswith("t::") for s in got)
    assert got[3] == got[4]
    assert got[5] == 't::{"n":1e-7}'


def test_override_spacing_and_blanks(df):
    d = df([("\tmax_chunks\n", "300000000"), ("embed_model", "\n\t"), ("min_chars", "0.0001"), ("model_limits", '{"a":1} x')], "key string, value string")
    got = [(r.norm_key, r.ok, r.value_out) for r in validate_overrides(d).collect()]
    assert got == [("max_chunks", True, "300000000"), ("embed_model", False, None), ("min_chars", True, "0.0001"), ("model_limits", False, None)]


def test_two_white_space_rules(df):
    d = df([("﻿a\u0085\u001c",)], "t string").select(strip_text("t").alias("py"), strip_ws("t").alias("js")).first()
    assert d.py == "﻿a" and d.js == "a\u0085\u001c"


def test_null_sessions_keep_their_rows(df):
    rows = [(None, i, "tool_result", "sig", False, i == 1, i % 2) for i in range(4)] + [("s", 9, "text", None, False, False, 0)]
    d = df(rows, "session_id string, seq long, kind string, signature string, protected boolean, is_error boolean, u int")
    turns = K.assign_turns(d, F.col("u") == 1)
    assert sorted((r.seq, r.turn) for r in turns.collect()) == [(0, 0), (1, 1), (2, 1), (3, 2), (9, 0)]
    assert sorted(r.seq for r in K.dedupe_tool_results(d).collect()) == [3, 9]
    last = turns.where("session_id = 's'").groupBy("session_id").agg(F.max("turn").alias("__last"))
    assert K.drop_stale_errors(turns, last=last).count() == 5  # no last turn known: nothing is stale


def test_transcript_lines_with_text_after_json(df):
    line = json.dumps({"type": "user", "message": {"content": "kept"}})
    d = df([("s", 1, line), ("s", 2, line.replace("kept", "junk") + " junk"), ("s", 3, line + line)], "session_id string, line_no long, raw string")
    assert [r.text for r in transcripts_to_docs(d).collect()] == ["kept"]


def test_transcript_of_several_splits(spark, tmp_path):
    folder = tmp_path / "session_id=a%2Fb"
    folder.mkdir()
    (folder / "part.txt").write_text("\n".join(f"line {i} " + "x" * (i % 50) if i % 5 else "" for i in range(4000)))
    (tmp_path / "other.jsonl").write_text("one\r\n\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_transcripts(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        rows = {(r.session_id, r.line_no): r.raw for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("a/b", i + 1): f"line {i} " + "x" * (i % 50) for i in range(4000) if i % 5}
    assert rows == want | {("other", 1): "one\r", ("other", 3): "two"}


def streamed(spark, path, drops, schema):
    for k, rows in enumerate(drops):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_stale_errors_with_late_user_turns(spark, tmp_path):
    schema = "session_id string, seq long, call_id long, tool string, status string"
    user = lambda i: ("s", i, i, "USER", "completed")
    drops = [[("s", 5, 5, "read", "error")], [user(i) for i in (1, 2, 3, 4)], [user(8), ("s", 6, 6, "bash", "error")], [user(9), user(10), user(7)], [("s", 2, 77, "grep", "error")]]
    out = windows.run_to_parquet(stateful.stream_stale_errors(streamed(spark, tmp_path / "in", drops, schema)), "t")
    assert sorted(r.call_id for r in out.collect()) == [5, 6, 77]
    fewer = windows.run_to_parquet(stateful.stream_stale_errors(streamed(spark, tmp_path / "in2", drops[:3], schema)), "t")
    assert fewer.count() == 0


def test_first_warnings_over_batches(spark, tmp_path):
    schema = "session_id string, message string, ts timestamp"
    import datetime
    at = lambda d: datetime.datetime(2024, 1, d)
    drops = [[("s", "m", at(1))], [("s", "m", at(5))], [("s", "n", at(9))], [("s", "m", at(12))], [(None, "late", at(2)), ("s", "n", at(2))]]
    out = windows.run_to_parquet(windows.first_warnings(streamed(spark, tmp_path / "in", drops, schema)), "t")
    assert sorted(map(tuple, out.collect())) == [("global", "late"), ("s", "m"), ("s", "n")]


def test_requests_from_payload_lines(spark, tmp_path):
    doc = "short words about engines and fuel " * 40
    lines = [json.dumps({"request_id": "a", "query": "engines", "docs": [doc, doc + "x"], "options": {"min_input_size": 10}}),
             json.dumps({"request_id": "b", "docs": [doc], "options": {"min_input_size": 100000}}),
             json.dumps({"request_id": "c", "docs": [doc], "options": {"min_input_size": "100000"}}),
             json.dumps({"request_id": "d", "docs": [doc], "options": {"speed": 3}}), json.dumps({"request_id": "e"}), "", "[1"]
    (tmp_path / "r.txt").write_text("\n".join(lines))
    rows = optimize_requests(read_requests(spark, str(tmp_path))).collect()
    got = {r.request_id: (r.ok, r.status, r.error_code) for r in rows if r.request_id}
    assert got == {"a": (True, "optimized", None), "b": (True, "no_optimization", None), "c": (True, "optimized", None),
                   "d": (False, "failed", "runtime_error"), "e": (True, "no_optimization", None)}
    rest = sorted((r.ok, r.status, r.error_code) for r in rows if r.request_id is None)
    assert rest == [(False, "failed", "invalid_input"), (True, "no_optimization", None)]


def picked(docs, query, rate, max_chunks, threshold):
    """The plug-in pipeline by hand: letter vectors, shared words, long tokens first."""
    vec = lambda t: np.array([t.lower().count(chr(97 + k)) for k in range(26)], dtype=float)
    cos = lambda a, b: 0.0 if not a.any() or not b.any() else float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    score = lambda t: float(len(set(query.split()) & set(t.split())))
    ranked = sorted(range(len(docs)), key=lambda i: (-score(docs[i]), i))
    kept = []
    for i in ranked:
        if all(cos(vec(docs[i]), vec(docs[j])) < threshold for j in kept):
            kept.append(i)
    out, room = [], 10_000
    for i in kept:
        if len(docs[i]) <= room:
            out.append(i)
            room -= len(docs[i])
    texts = []
    for i in out[:max_chunks]:
        words = docs[i].split()
        best = sorted(range(len(words)), key=lambda k: (-len(words[k]), k))[:int(np.ceil(rate * len(words)))]
        texts.append(" ".join(words[k] for k in sorted(best)))
    return "\n\n".join(texts)


def test_all_plugins_and_a_failing_session(df):
    rnd = random.Random(3)
    words = "motor valve piston gear shaft crank rotor clutch brake lever spring bolt".split()
    docs = [" ".join(rnd.choices(words, k=12)) for _ in range(20)]
    rows = [("good", i, t) for i, t in enumerate(docs)] + [("bad", i, t) for i, t in enumerate(docs)] + [("bad", 50, "one\ttab")]
    req = df([(s, "gear and motor", 0, 3, 10_000, 0.5, 0.95) for s in ("good", "bad")],
             "session_id string, query string, min_input_size long, max_chunks int, total_prune_budget_chars long, compression_rate double, dedupe_threshold double")
    out = optimize_context(df(rows, "session_id string, pos long, text string"), req, scorer=P.overlap_scorer, embedder=P.letter_embedder, token_scorer=P.length_token_scorer)
    got = {r.session_id: r for r in out.collect()}
    assert got["bad"].status == "failed" and got["bad"].reason == "ValueError: tab" and got["bad"].optimized_context == ""
    assert got["good"].status == "optimized"
    assert got["good"].optimized_context == picked(docs, "gear and motor", 0.5, 3, 0.95)


def test_messages_with_user_turns_after_the_last_call(spark):
    schema = "session_id string, msg_no long, info struct<role: string>, parts array<struct<type: string, callID: string, tool: string, state: struct<status: string, input: string, output: string>>>"
    part = lambda c, status, out: ("tool", c, "bash", (status, '{"cmd":"make"}', out))
    rows = [("s", 1, ("assistant",), [part("1", "error", "no rule"), ("text", None, None, None), part("2", "completed", "v1")]),
            ("s", 2, ("assistant",), [part("3", "completed", "v2")])] + [("s", 3 + i, ("user",), None) for i in range(4)]
    out, counts = optimize_messages(spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in counts.collect()] == [("s", 1, 1)]
    parts = {r.msg_no: r.parts for r in out.collect()}
    from sessionsift import constants as C
    assert C.ERROR_INPUT_MARKER in parts[1][0].state.input and parts[1][0].state.output == "no rule"
    assert parts[1][1].type == "text" and parts[1][2].state.output == C.OUTPUT_MARKER and parts[2][0].state.output == "v2"
    assert parts[4] is None and len(parts) == 6


def brute_walk(texts, threshold):
    kept = []
    counts = []
    for i, t in enumerate(texts):
        c = {}
        for w in t.lower().split():
            c[w] = c.get(w, 0) + 1
        counts.append(c)
        norm = lambda x: sum(v * v for v in x.values()) ** 0.5
        near = any(c and counts[j] and sum(v * counts[j].get(w, 0) for w, v in c.items()) / (norm(c) * norm(counts[j])) >= threshold for j in kept)
        if not near:
            kept.append(i)
    return kept


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_corpus_dedupe_of_texts(df, threshold):
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.choices(words, k=15)) for _ in range(25)]
    for _ in range(35):  # chains of small edits
        t = rnd.choice(texts).split()
        t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append(" ".join(t))
    texts += ["", "--", "--", texts[0]]
    d = df([("g", i, t) for i, t in enumerate(texts)], "session_id string, pos long, text string")
    want = brute_walk([t.replace("--", "") for t in texts], threshold)
    assert sorted(r.pos for r in corpus.dedupe_corpus_terms(d, threshold).collect()) == want


def test_long_chain_of_rounds(spark, df):
    n = 30
    nodes = df([("g", i) for i in range(n)], "session_id string, pos long")
    edges = df([("g", i, i - 1) for i in range(1, n)], "session_id string, a long, b long")
    assert sorted(r.pos for r in corpus.greedy_fixpoint(nodes, edges).collect()) == list(range(0, n, 2))


def test_cosine_of_a_long_query(df):
    query = " ".join(f"t{k % 300}" for k in range(1000))
    d = df([("s", 1, "t1 t1 t2 x"), ("s", 2, ""), ("s", 3, "none here"), ("z", 4, "t1")], "session_id string, pos long, text string")
    got = {r.pos: r["__sim"] for r in rank.query_cosines(d, df([("s", query)], "session_id string, query string")).collect()}
    c = {f"t{k}": (4 if k < 100 else 3) for k in range(300)}
    norm = sum(v * v for v in c.values()) ** 0.5
    assert got == {1: round((2 * 4 + 4) / (norm * 6 ** 0.5), 6), 2: 0.0, 3: 0.0, 4: 0.0}


def test_no_machine_local_checkpoint_off_local(monkeypatch):
    from sessionsift import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_model_limits_of_the_configuration(df):
    from sessionsift.operators.params import apply_model_limits
    docs = df([("s", 1, "x" * 5000), ("t", 1, "x" * 5000)], "session_id string, pos long, text string")
    req = df([("s", "big", "q"), ("t", "", "q")], "session_id string, model string, query string")

    def chunks(stored, env):
        return {r.session_id: r.max_chunks for r in apply_model_limits(req, docs, stored=stored, env=env).collect()}

    stored = {"model_limits": {"big": {"max_chunks": 2}}}
    assert chunks(stored, {}) == {"s": 2, "t": 6}
    assert chunks(stored, {"model_limits": '{"big":{"max_chunks":"3"}}'}) == {"s": 3, "t": 6}
    assert chunks(stored, {"model_limits": "{broken"}) == {"s": 2, "t": 6}
    assert chunks({}, {}) == {"s": 6, "t": 6}

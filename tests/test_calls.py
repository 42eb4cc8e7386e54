import json

from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.signature import tool_signature
from sessionsift.operators import calls as K
from sessionsift.plans.optimize import optimize_live, transcripts_to_docs


def sigs(spark, pairs):
    d = spark.createDataFrame(pairs, "tool string, input string")
    return [r.s for r in d.select(tool_signature("tool", "input").alias("s")).collect()]


def test_signature_key_order_and_nulls(spark):
    got = sigs(spark, [("read", '{"b":1,"a":"x"}'), ("read", '{"a":"x","b":1}'), ("read", '{"a":null}'),
                       ("read", None), ("read", "null"), ("read", '{"a":"1"}'), ("read", '{"a":1}')])
    assert got[0] == got[1] == 'read::{"a":"x","b":1}'
    assert got[2] == "read::{}"
    assert got[3] == got[4] == "read"
    assert got[5] != got[6]


def test_signature_slow_path_matches_js(spark):
    got = sigs(spark, [("t", '{"a":{"c":null,"b":1e0}}'), ("t", '[1.0, null, {"z":null,"y":2}]'),
                       ("t", '{"n":12345678901234567890}')])
    assert got[0] == 't::{"a":{"b":1}}'
    assert got[1] == 't::[1,null,{"y":2}]'
    assert got[2] == 't::{"n":12345678901234567000}'


def live_calls(df, rows):
    d = df(rows, "session_id string, seq long, turn long, tool string, status string, input string, output string")
    return d.withColumn("signature", tool_signature("tool", "input"))


def test_superseded_newest_kept_and_idempotent(df):
    c = live_calls(df, [("s", 1, 0, "read", "completed", '{"target":"notes.md"}', "v1"),
                        ("s", 2, 0, "read", "completed", '{"target":"notes.md"}', "v2"),
                        ("s", 3, 0, "write", "completed", '{"x":1}', "w1"),
                        ("s", 4, 0, "write", "completed", '{"x":1}', "w2")])
    once = K.mark_superseded_outputs(c)
    rows = {r.seq: r for r in once.collect()}
    assert rows[1].output == C.OUTPUT_MARKER and rows[2].output == "v2"
    assert rows[3].output == "w1"  # protected
    twice = K.mark_superseded_outputs(once.drop("superseded"))
    assert twice.where("superseded").count() == 0


def test_mask_only_string_inputs_and_keep_output(df):
    c = live_calls(df, [("s", 1, 0, "bash", "error", '{"cmd":"ls","n":3,"flag":true}', "failed!"),
                        ("s", 2, 4, "USER", "completed", None, None)])
    last = c.groupBy("session_id").agg(F.max("turn").alias("__last"))
    out = K.mask_stale_error_inputs(c.where("tool <> 'USER'"), last=last).first()
    assert json.loads(out.input) == {"cmd": C.ERROR_INPUT_MARKER, "flag": True, "n": 3}
    assert out.output == "failed!" and out.masked
    again = K.mask_stale_error_inputs(c.where("tool <> 'USER'").withColumn("input", F.lit(out.input)), last=last)
    assert again.where("masked").count() == 0


def transcript(df, session, lines):
    return df([(session, i + 1, line) for i, line in enumerate(lines)], "session_id string, line_no long, raw string")


def use(i, name, inp):
    return json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": i, "name": name, "input": inp}]}})


def result(i, text, err=False):
    return json.dumps({"type": "user", "message": {"content": [
        {"type": "tool_result", "tool_use_id": i, "content": [{"type": "text", "text": text}], "is_error": err}]}})


def user(text):
    return json.dumps({"type": "user", "message": {"content": text}})


def docs_of(df, lines):
    out = transcripts_to_docs(transcript(df, "s", lines))
    return [r.text for r in out.orderBy("seq").collect()]


def test_newest_tool_result_kept(df):
    got = docs_of(df, [user("go"), use("t1", "read", {"target": "notes.md"}), result("t1", "old"),
                       use("t2", "read", {"target": "notes.md"}), result("t2", "new")])
    assert got == ["go", "[tool read] new"]


def test_stale_error_dropped_fresh_kept(df):
    got = docs_of(df, [user("u0"), use("t1", "bash", {"c": "x"}), result("t1", "boom", True),
                       user("u1"), user("u2"), user("u3"), user("u4"),
                       use("t2", "bash", {"c": "y"}), result("t2", "fresh boom", True)])
    assert "[tool bash] boom" not in got and "[tool bash] fresh boom" in got


def test_protected_kept_twice_orphan_dropped_ids_reused(df):
    got = docs_of(df, [use("t1", "Write", {"p": 1}), result("t1", "w1"), use("t1", "Write", {"p": 1}), result("t1", "w2"),
                       result("nope", "orphan"), "{bad json", "   ", use("t1", "grep", {"q": 1}), result("t1", "g")])
    assert got == ["[tool Write] w1", "[tool Write] w2", "[tool grep] g"]


def test_tail_limit(df):
    lines = [user(f"m{i}") for i in range(250)]
    got = docs_of(df, lines)
    assert len(got) == C.MAX_TRANSCRIPT_ENTRIES and got[0] == "m50" and got[-1] == "m249"


def test_live_pass_counts(df):
    c = live_calls(df, [("s", 1, 0, "read", "completed", '{"a":1}', "o"), ("s", 2, 0, "read", "completed", '{"a":1}', "o"),
                        ("s", 3, 0, "grep", "error", '{"q":"x"}', "e")])
    last = df([("s", 5)], "session_id string, __last long")
    out = optimize_live(c, last)
    counts = K.strategy_counts(out).first()
    assert (counts.deduped, counts.purged_errors) == (1, 1)


def test_asof_same_line_part_order(df):
    same_line = json.dumps({"type": "assistant", "message": {"content": [
        {"type": "tool_use", "id": "t9", "name": "grep", "input": {"q": "a"}},
        {"type": "tool_result", "tool_use_id": "t9", "content": [{"type": "text", "text": "hit"}]}]}})
    result_first = json.dumps({"type": "assistant", "message": {"content": [
        {"type": "tool_result", "tool_use_id": "t8", "content": [{"type": "text", "text": "early"}]},
        {"type": "tool_use", "id": "t8", "name": "read", "input": {"p": 1}}]}})
    got = docs_of(df, [same_line, result_first])
    assert got == ["[tool grep] hit"]

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionsift.operators.ordered import join_null_safe, last_before, running_sum


def skewed_rows(n=400, seed=3):
    rnd = random.Random(seed)
    # one hot key holds most rows, as a third-of-all-rows session would
    return [("hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 5)}", i, rnd.randint(0, 2)) for i in range(n)]


def test_running_sum_equals_window_across_blocks(df):
    d = df(skewed_rows(), "k string, seq long, v int")
    got = running_sum(d, ["k"], "seq", F.col("v"), "rs", block=7)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    exp = d.withColumn("rs", F.sum("v").over(w))
    assert sorted(map(tuple, got.select("k", "seq", "rs").collect())) == sorted(map(tuple, exp.select("k", "seq", "rs").collect()))


def test_last_before_equals_window_across_blocks(df):
    rows = [(k, s, (v if v != 1 else None)) for k, s, v in skewed_rows()]
    d = df(rows, "k string, seq long, v int")
    got = last_before(d, ["k"], "seq", "v", "lb", block=5)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    exp = d.withColumn("lb", F.last("v", ignorenulls=True).over(w))
    assert sorted(map(tuple, got.select("k", "seq", "lb").collect())) == sorted(map(tuple, exp.select("k", "seq", "lb").collect()))


def test_running_sum_windows_are_per_block(df):
    d = df(skewed_rows(50), "k string, seq long, v int")
    plan = running_sum(d, ["k"], "seq", F.col("v"), "rs", block=7)._jdf.queryExecution().executedPlan().toString()
    # the per-row window is partitioned by (key, block), never by the key alone
    assert "__blk" in plan


def test_tail_uses_partial_group_limit(df):
    from sessionsift.operators.rank import tail_places
    d = df([("s", i, "t") for i in range(30)], "session_id string, pos long, text string")
    out = tail_places(d, 5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in out.collect()) == [25, 26, 27, 28, 29]


def test_null_keys_and_orders_are_one_key(df):
    rows = [(k, s, (s or 0) % 3) for s in [*range(20), None] for k in ("a", None)]
    d = df(rows, "k string, seq long, v int")
    w = Window.partitionBy("k").orderBy("seq")
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    got = running_sum(d, ["k"], "seq", "v", "x", block=7).select("k", "seq", "x")
    assert order(got) == order(d.select("k", "seq", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x")))


def initial_plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_running_sum_broadcasts_no_rows(df):
    # an estimate far too small: narrow rows behind a wide column
    d = df(skewed_rows(50), "k string, seq long, v int")
    plan = initial_plan(running_sum(d, ["k"], "seq", F.col("v"), "rs", block=7))
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(__key") == 2  # the window needs no shuffle of its own


def test_last_before_broadcasts_no_rows(df):
    d = df(skewed_rows(50), "k string, seq long, v int")
    plan = initial_plan(last_before(d, ["k"], "seq", "v", "lb", block=7))
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(__key") == 2


def test_large_join_is_the_null_safe_join_without_broadcast(df):
    left = df([("a", 1, "x"), (None, 1, "y"), ("a", None, "z"), ("b", 2, "w")], "k string, n int, v string")
    right = df([("a", 1, 10), (None, 1, 11), ("a", None, 12), ("c", 3, 13)], "k string, n int, u int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = join_null_safe(left, right, ["k", "n"], how, large=True)
        same = join_null_safe(left, right, ["k", "n"], how)
        assert got.columns == same.columns and "Broadcast" not in initial_plan(got)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, same.collect()), key=str)


def test_transcript_docs_broadcast_nothing_that_grows(df):
    from sessionsift.plans.optimize import transcripts_to_docs
    lines = df([("s", 1, '{"type":"user","message":{"content":"hi"}}')], "session_id string, line_no long, raw string")
    docs = transcripts_to_docs(lines)
    assert "Broadcast" not in initial_plan(docs) and [r.text for r in docs.collect()] == ["hi"]

from pyspark.sql import functions as F

from sessionsift.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_strip_all_whitespace(spark):
    assert one(spark, T.strip_ws(F.lit(" ﻿  x y \n\t"))) == "x y"
    assert one(spark, T.strip_ws(F.lit("\n\n"))) == ""


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Hello, World! 42 -- Ünïcode_x"))) == ["hello", "world", "42", "ünïcode", "x"]
    assert one(spark, T.tokens(F.lit("  ...  "))) == []


def test_js_round_half_up_toward_positive(spark):
    assert one(spark, T.js_round(F.lit(-12.5))) == -12
    assert one(spark, T.js_round(F.lit(2.5))) == 3
    assert one(spark, T.js_round(F.lit(8.6))) == 9


def test_parse_numeric_prefix(spark):
    assert one(spark, T.parse_numeric(F.lit("12.5abc"), 0.0)) == 12.5
    assert one(spark, T.parse_numeric(F.lit("abc"), 7.0)) == 7.0
    assert one(spark, T.parse_numeric(F.lit("Infinity"), 3.0)) == 3.0
    assert one(spark, T.parse_numeric(F.lit(" -1e3x"), 0.0)) == -1000.0


def test_size_summary_and_percent(spark):
    assert one(spark, T.size_summary(F.lit(200), F.lit(50))) == \
        "Initial size: 200 chars, final size: 50 chars, saved: 150 chars (75%)"
    assert one(spark, T.size_summary(F.lit(None).cast("bigint"), F.lit(5))) == ""
    assert one(spark, T.size_summary(F.lit(0), F.lit(5))).endswith("saved: -5 chars (0%)")


def test_outcome_branches_in_order(spark):
    msg = lambda *a: one(spark, T.outcome_message(*[F.lit(x) for x in a]))
    assert msg(True, "no_optimization", "", None, 10, 10).startswith("[sessionsift] optimized context emitted.")
    assert msg(True, "no_optimization", "tiny", None, None, None) == "[sessionsift] no optimization applied: tiny"
    assert msg(False, "failed", "", "boom", 12, None) == "[sessionsift] optimization skipped: boom (size=12 chars)"
    assert "initial_size=undefined" in msg(True, "optimized", "", None, None, 4)
    assert msg(False, "other", "", None, None, None).endswith("without a measurable savings summary.")


def test_sanitize(spark):
    assert one(spark, T.sanitize_session_key(F.lit("a/b c.d-e"))) == "a_b_c.d-e"
    assert one(spark, T.sanitize_session_key(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, T.sanitize_log_field(F.lit('x,"y"\n'))) == "x__y__"
    assert one(spark, T.sanitize_log_field(F.lit(""), empty="global")) == "global"


def test_protected_case_insensitive(spark):
    assert one(spark, T.is_protected(F.lit("Write")))
    assert not one(spark, T.is_protected(F.lit("bash")))

"""Canonical JSON of column expressions against a plain recursive printer."""
import json
import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.signature import canonical_json, tool_signature
from sessionsift.functions.text import js_number
from sessionsift.operators.calls import _mask_json


def number(x):
    """Number to text the way JavaScript prints it (shortest round-trip digits)."""
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    _, digits, exp = Decimal(repr(abs(x))).as_tuple()
    full = "".join(map(str, digits))
    s = full.rstrip("0") or "0"
    k, n = len(s), exp + len(full)
    if k <= n <= 21:
        out = s + "0" * (n - k)
    elif 0 < n <= 21:
        out = s[:n] + "." + s[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * (-n) + s
    else:
        out = (s if k == 1 else s[0] + "." + s[1:]) + "e" + ("+" if n > 1 else "-") + str(abs(n - 1))
    return ("-" if x < 0 else "") + out


def canon(v):
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)):
        return number(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, list):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canon(x)}" for k, x in sorted(v.items()) if x is not None) + "}"


STRINGS = ["", "a", "null", ":null,", '{"x":null}', "q\"uote", "back\\slash", "\\u001F", "\x1f\x0b", "line\nend\ttab\r\b\f", "é \U0001f600", "1e5", ",}", "Infinity", "\\"]
NUMBERS = ["0", "-0", "1.0", "1e0", "1E+3", "-2.50", "12345678901234567890", "1e21", "1e-7", "0.0000001", "123456.789", "0.1000000000000000055", "1e999", "-1e400", "100000000000000000000000", "7", "9007199254740993", "0.5"]


def text_of(rnd, depth=0):
    kind = rnd.random()
    if kind < 0.25 and depth < 4:
        return "{ " + ", ".join(f"{json.dumps(k, ensure_ascii=rnd.random() < 0.5)} :{text_of(rnd, depth + 1)}" for k in rnd.sample(STRINGS, rnd.randrange(5))) + "}"
    if kind < 0.4 and depth < 4:
        return "[" + ",".join(text_of(rnd, depth + 1) for _ in range(rnd.randrange(4))) + " ]"
    if kind < 0.6:
        return rnd.choice(NUMBERS)
    return rnd.choice([json.dumps(rnd.choice(STRINGS), ensure_ascii=rnd.random() < 0.5), "null", "null", "true", "false"])


def test_canonical_json_of_random_values(spark):
    rnd = random.Random(12)
    texts = [text_of(rnd, rnd.randrange(2)) for _ in range(1500)] + ["{" + ",".join(f'"k{i}":{n}' for i, n in enumerate(NUMBERS)) + "}"]
    texts += ['{"a":null,"b":{"c":null},"d":[null,{"e":null}]}', '{"a":1,"b":null,"c":null}', '{"a":null,"b":1}', '{"a":null}', "[null]", '{"k":1e999}', '["Infinity",1e999]', '{"Infinity":1e400}']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", canonical_json("t").alias("c")).collect()
    for r in got:
        v = json.loads(r.t)
        assert r.c == (None if v is None else canon(v)), r.t


def test_no_python_in_the_plan(df):
    d = df([("t", '{"a":"x\\ny","b":null,"c":1e3}')], "tool string, input string").select(tool_signature("tool", "input").alias("s"), _mask_json(F.col("input"))[0].alias("m"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert d.first().s == 't::{"a":"x\\ny","c":1000}'


def test_numbers_as_javascript_prints_them(df):
    values = [1.0, 300000000.0, 0.0001, 1e-7, 1.5e-7, 123456789.25, 1e20, 1e21, 1.25e22, 0.001, 12345678.0, 99999999.5, 1e-6, 123456.789, -2.5e-9, -7.0]
    got = [r.s for r in df([(v,) for v in values], "v double").select(js_number("v").alias("s")).collect()]
    assert got == [number(v) for v in values]


def test_masked_inputs(df):
    marker = json.dumps(C.ERROR_INPUT_MARKER)
    cases = {'{"a":"x"} junk': ('{"a":"x"} junk', False), '{"n":1e3,"a":"x","z":null}': (f'{{"a":{marker},"n":1000,"z":null}}', True), '["x",1.0,null,["y"]]': (f'[{marker},1,null,["y"]]', True),
             f'{{"a":{marker}}}': (f'{{"a":{marker}}}', False), '{"a":1}': ('{"a":1}', False), '"text"': ('"text"', False), "{bad": ("{bad", False), '{"a":{"b":"deep\\u001F"},"c":"x"}': (f'{{"a":{{"b":"deep\\u001f"}},"c":{marker}}}', True)}
    m, touched = _mask_json(F.col("t"))
    for r in df([(t,) for t in cases], "t string").select("t", m.alias("m"), touched.alias("y")).collect():
        assert (r.m, r.y) == cases[r.t], r.t

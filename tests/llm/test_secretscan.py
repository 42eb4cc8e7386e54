"""Secret scans against plain regexes and counts."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from sessionsift.llm import queries, secretscan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8 and m[1].isascii()]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def values(text):
    out = {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8}
    out |= {(a, b) for a, k, b in base_spans(text) if k}
    return out


def listed(spans):
    return ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def brute(rows):
    """doc_id -> (counts, digest, spans) of rows (doc_id, text, source) with distinct ids; values of the base only."""
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for i, text, source in rows:
        for a, b in values(text or ""):
            owners[text[a:b]].add(source)
            repositories[text[a:b]].add(i)
    out = {}
    for i, text, _ in rows:
        text = text or ""
        base, more = base_spans(text), []
        for a, b in values(text):
            v = text[a:b]
            if len(owners[v]) >= 5 or len(repositories[v]) >= 50:
                more.append((a, 4, b))
            elif secretscan.looks_live(v):
                more.append((a, 3, b))
        counts = tuple(sum(k == x for _, k, _ in base) for x in range(3))
        out[i] = (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), sum(k == 3 for _, k, _ in more), sum(k == 4 for _, k, _ in more))
    return out


def got(df):
    assert df.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    out = got(queries.op12_secret_scan(spark, "/root/testdata/sf0.01"))
    assert out == brute(rows) and sum(r[0] for r in out.values()) > 5


def test_base_of_odd_texts():
    rng = random.Random(4)
    parts = ["token", "Token", "passwd", "password", "PASSWORD", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "ABCDEF0123456789", "deadbeef" * 4, "abc", "==", "/x.y-z_w+", "é", "\n", "12345678"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert secretscan.matches(text)[0] == base_spans(text), text


def test_ownership_separates_examples_from_live_values(spark):
    shared, own, bare = "9f8Qx2LmZ7rT4vKp", "Zk3vN8wQ1rT6yP0s", "aGk29dKxPq73LmNv82TzRw51"
    rows = [(k, f"password = '{shared}' in the manual {k}", f"owner{k % 6}") for k in range(12)]
    rows += [(100 + k, f"db token: {own}", "owner1") for k in range(3)]
    rows += [(200, "password = changeme123", "owner2"), (201, "secret=aaaaaaaaaaaa", "owner2"), (202, f"key {bare} here", "owner3"), (203, "ghp_" + "a1B2c3D4e5" * 4, None), (204, None, None)]
    rows += [(300 + k, "api_key=Q7w8E9r0T1y2U3i4", "owner5") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = got(secretscan.digest(secretscan.find(df)))
    assert all(out[k][-2:] == (0, 1) for k in range(12)) and all(out[100 + k][-2:] == (1, 0) for k in range(3))
    assert out[200][-2:] == out[201][-2:] == (0, 0) and out[200][0] == 1
    assert out[202][4] == "live:4:28" and out[203][4] == "live:0:44"
    assert all(out[300 + k][-2:] == (0, 1) for k in range(50))
    assert out[204] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0)
    table = {r["verdict"]: (r["owners"], r["repositories"]) for r in secretscan.ownership(secretscan.candidates(df)).where("owners = 6 or value is null").collect()}
    assert table == {"example": (6, 12)}


def test_edges(spark):
    long = "word " * 200_000 + "token = 'Zk3vN8wQ1rT6yP0s'" + " word" * 1000
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (4, "token = 'Zk3vN8wQ1rT6yP0s'", None), (4, "token = 'Zk3vN8wQ1rT6yP0s'", None), (None, "é\U0001f600 " + "3fa9c2e17b5d8064" * 3, "b"), (5, "0" * 100_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "th", "value", "base", "found", "owner", "repository", "verdict", "start")}).repartition(3)
    out = secretscan.digest(secretscan.find(df)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == sorted((r[0] is None, r[0]) for r in rows)
    by = {r["doc_id"]: r for r in out}
    assert by[3]["spans"] == "assign:1000000:1000025,live:1000009:1000025" and by[4]["spans"] == "assign:0:25,live:9:25"
    assert by[None]["spans"] == "hex:3:51,live:3:51" and by[5]["spans"] == "hex:0:100000" and by[1]["spans"] == by[2]["spans"] == ""
    assert secretscan.digest(secretscan.find(df.limit(0))).count() == 0

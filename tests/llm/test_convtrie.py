"""The conversation trie against a plain dictionary of beginnings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sessionsift.llm import convtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract over rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:3], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(paths[c][:d], []).append(c)
    children = dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if paths[c] == p).encode()).hexdigest()) for p, m in nodes.items())


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("path", "bytes", "node", "family", "h", "depth")})


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, "/root/testdata/sf0.01")) == brute(rows)


@pytest.mark.parametrize("shards", [1, 2, 7, 60])
def test_common_beginnings_at_every_number_of_shards(spark, shards):
    rng = random.Random(shards)
    rows = []
    for c in range(400):
        same = c % 3 == 0  # a third are copies of one conversation
        rows += [(c, t, ("user", "assistant")[t % 2], "Gleiche Zeile äöü" if same else rng.choice(["a", "b", "é"])) for t in range(4 if same else rng.randrange(1, 9))]
    rng.shuffle(rows)
    assert got(convtrie.prefix_trie(table(spark, rows).repartition(5), shards)) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "no id"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (7, 0, "a", "b"), (7, 0, "", "ab"), (8, 0, "ab", ""),
            (11, 3, "user", "x" * 200_000), (13, None, "user", "\U0001f600"), (10, 2, "tool", " "), (2**60, 0, "user", "far"), (14, 1, "user", "1:2"), (14, 2, "u", "ser")]
    rows += [(25, t, "user", f"turn {t}") for t in range(300)]  # deeper than a splitter keeps
    rows += [(c, t, "user", f"turn {t}") for c in (26, 27, 28, 29, 30, 35) for t in range(300 - c)]
    for shards in (1, 4):
        assert got(convtrie.prefix_trie(table(spark, rows).repartition(3), shards)) == brute(rows)
    none = table(spark, rows).limit(0)
    assert convtrie.prefix_trie(none).count() == 0


def test_only_rows_without_id(spark):
    assert convtrie.prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0

"""The residual index against brute force, and the walk in its three ways (rounds, session folds, components)."""
import collections
import math
import random

import pytest

from sessionsift.operators import corpus
from sessionsift.operators.components import component_labels


def cosine(x, y):
    dot = sum(n * y[t] for t, n in x.items())
    return dot / (math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values())))


def walk(texts, threshold):
    kept, vectors = [], [collections.Counter(t.split()) for t in texts]
    for i, v in enumerate(vectors):
        if not v or all(not vectors[j] or cosine(v, vectors[j]) < threshold for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("threshold", [0.5, 0.9])
@pytest.mark.parametrize("postings", [corpus.POSTINGS, 7])
def test_residual_index_misses_no_pair(spark, df, monkeypatch, threshold, postings):
    monkeypatch.setattr(corpus, "POSTINGS", postings)  # 7: frequent terms are dealt in parts
    rnd = random.Random(threshold)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rnd.randrange(30))) for _ in range(120)]
    texts += [" ".join([*t.split(), rnd.choice(words)]) for t in texts[:60]] + texts[:10] + ["...", ""]
    docs = df([("g", i, t) for i, t in enumerate(texts)], "session_id string, pos long, text string")
    report = {}
    assert sorted(r.pos for r in corpus.dedupe_corpus_terms(docs, threshold, report).collect()) == walk(texts, threshold)
    assert 0 < report["verified"] <= report["candidates"] < report["pairs"]


def brute_walk(n, edges):
    before = collections.defaultdict(list)
    for a, b in edges:
        before[a].append(b)
    kept = set()
    for i in range(n):
        if not kept.intersection(before[i]):
            kept.add(i)
    return sorted(kept)


@pytest.mark.parametrize("bound", [corpus.FOLD_EDGES, 150, 0])
def test_walk_by_folds_components_and_rounds(spark, df, monkeypatch, bound):
    monkeypatch.setattr(corpus, "FOLD_EDGES", bound)
    rnd = random.Random(9)
    n, edges = {}, {}
    for s, size, degree in (("sparse", 300, 0.9), ("dense", 200, 3), ("chain", 60, 0)):
        n[s] = size
        edges[s] = [(i, i - 1) for i in range(1, size)] if s == "chain" else sorted({(max(p), min(p)) for p in ((rnd.randrange(size), rnd.randrange(size)) for _ in range(int(size * degree))) if p[0] != p[1]})
    nodes = df([(s, i) for s in n for i in range(n[s])], "session_id string, pos long")
    links = df([(s, a, b) for s in edges for a, b in edges[s]], "session_id string, a long, b long")
    got = collections.defaultdict(list)
    for r in corpus.greedy_fixpoint(nodes, links).collect():
        got[r.session_id].append(r.pos)
    for s in n:
        assert sorted(got[s]) == brute_walk(n[s], edges[s]), s


def test_long_chain_takes_as_many_rounds_as_a_short_one(spark):
    from pyspark.sql import functions as F
    rounds = []
    for n in (50, 10_000):
        nodes = spark.range(n).select(F.lit("g").alias("session_id"), F.col("id").alias("pos"))
        edges = spark.range(1, n).select(F.lit("g").alias("session_id"), F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
        left: list[int] = []
        assert sorted(r.pos for r in corpus.greedy_fixpoint(nodes, edges, left).collect()) == list(range(0, n, 2))
        rounds.append(len(left))
    assert rounds[0] == rounds[1] <= corpus.PLAIN_ROUNDS + 1


def test_components(spark, df):
    rnd = random.Random(3)
    edges = [("x", i, i + 1) for i in range(40)] + [("x", 100, 100 + k) for k in range(1, 50)] + [("y", 5, 3), ("y", 7, 5), ("y", 9, 9)]
    rnd.shuffle(edges)
    got = {(r.session_id, r.node): r.label for r in component_labels(df(edges, "session_id string, a long, b long"), ["session_id"]).collect()}
    assert got == {**{("x", i): 0 for i in range(41)}, **{("x", 100 + k): 100 for k in range(50)}, ("y", 3): 3, ("y", 5): 3, ("y", 7): 3, ("y", 9): 9}


def test_only_verified_pairs_leave_a_task(spark, df, monkeypatch):
    """a group of blocks gives its pairs above the threshold and one row; each pair once, whatever the blocks."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rnd.randrange(1, 30))) for _ in range(90)]
    counts = [collections.Counter(t.split()) for t in texts]
    want = sorted((i, j) for i in range(90) for j in range(i) if cosine(counts[i], counts[j]) >= 0.8)
    docs = df([("g", i, t) for i, t in enumerate(texts)] + [(None, 1, "w1"), ("one", 1, "w1")], "session_id string, pos long, text string")
    vectors = corpus.term_vectors(docs)
    for postings, groups in ((1000, 1), (30, 6)):
        monkeypatch.setattr(corpus, "POSTINGS", postings)
        rows = corpus.paired_blocks(vectors, corpus.near_terms(0.8)).collect()
        assert sorted((r.a, r.b) for r in rows if r.a is not None) == want
        assert len(rows) == len(want) + groups and sum(r.met for r in rows) >= len(want)


@pytest.mark.parametrize("pivots", [1, 32])
def test_only_near_vectors_leave_a_task(spark, df, monkeypatch, pivots):
    """low threshold, several blocks; vectors of other lengths are near to none, what is not a number to all."""
    rnd = random.Random(7)
    vecs = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(100)] + [[1.0, 2.0], [2.0, 4.1], [float("nan")] + [1.0] * 7]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    near = lambda x, y: len(x) == len(y) and not dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))) < 0.3
    want = sorted((i, j) for i in range(len(vecs)) for j in range(i) if near(vecs[i], vecs[j]))
    items = df([("g", i, v) for i, v in enumerate(vecs)], "session_id string, pos long, vec array<double>")
    for postings, groups in ((1000, 1), (30, 10)):
        monkeypatch.setattr(corpus, "POSTINGS", postings)
        rows = corpus.paired_blocks(items, corpus.near_vectors(0.3, pivots)).collect()
        assert sorted((r.a, r.b) for r in rows if r.a is not None) == want
        assert len(rows) == len(want) + groups


@pytest.mark.parametrize("postings,chars", [(30, corpus.BLOCK_CHARS), (1000, 1500)])
def test_near_copies_leave_no_pairs_behind(spark, df, monkeypatch, postings, chars):
    """half of a source's pairs are neighbours; what is written grows with the docs, whatever the block."""
    monkeypatch.setattr(corpus, "POSTINGS", postings)
    monkeypatch.setattr(corpus, "BLOCK_CHARS", chars, raising=False)
    written, write = [], corpus.materialize
    monkeypatch.setattr(corpus, "materialize", lambda d: written.append(write(d)) or written[-1])
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices("the of and to in".split(), weights=[9, 5, 4, 2, 1], k=40)) for _ in range(150)]
    texts += [f"own{k} word{k} {k}" for k in range(20)] + ["", "...", None, texts[0], texts[7]]
    rnd.shuffle(texts)
    rows = [("g", 7 * i - 90, t) for i, t in enumerate(texts)] + [("h", i, t) for i, t in enumerate(texts[:25])]
    rows += [(None, 1, "the of"), (None, 2, "the of"), ("g", None, "the of"), ("h", 3, texts[3])]
    docs = df(rows, "session_id string, pos long, text string")
    got = collections.defaultdict(list)
    for r in corpus.dedupe_corpus_terms(docs, 0.9).collect():
        got[r.session_id].append(r.pos)
    assert sorted(got["h"]) == walk([t or "" for t in texts[:25]], 0.9) and sorted(got[None]) == [1, 2]
    assert sorted(p for p in got["g"] if p is not None) == [7 * i - 90 for i in walk([t or "" if t != "..." else "" for t in texts], 0.9)]
    assert got["g"].count(None) == 1
    assert max(d.count() for d in written) <= len(rows)  # the pairs: some 10,000


def test_blocks_follow_each_other_and_hold_every_doc(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(corpus, "POSTINGS", 40)
    monkeypatch.setattr(corpus, "BLOCK_CHARS", 1000)
    docs = spark.range(600).select(F.when(F.col("id") < 500, "big").when(F.col("id") < 560, "long").otherwise("one").alias("session_id"),
                                   (F.col("id") * F.col("id")).alias("pos"), F.when(F.col("id").between(500, 559), 100).otherwise(1).alias("chars"))
    cuts = {r.session_id: r["__cuts"] for r in corpus.block_cuts(docs).collect()}
    assert set(cuts) == {"big", "long"} and len(cuts["big"]) == 12 and len(cuts["long"]) == 5
    for name, ids in (("big", range(500)), ("long", range(500, 560))):
        assert cuts[name] == sorted(set(cuts[name]))
        sizes = collections.Counter(sum(c < i * i for c in cuts[name]) for i in ids)
        assert len(sizes) == len(cuts[name]) + 1 and max(sizes.values()) <= 1.5 * len(ids) / len(sizes)

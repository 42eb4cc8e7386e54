"""The corpus pipeline's stages against brute force, each on its own input."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionsift.llm.common import read_table, staged
from tests.llm.test_brute_force import brute_components, brute_lines, slow_fingerprint, words

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "packing"]


def test_quality_keeps_clean_documents(spark, docs):
    out = STAGE["quality"](spark, docs, SF)
    assert out.columns == COLUMNS
    kept = by_id(out)
    marks = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    right = [(i in kept) == (q == 1) for i, q in marks.items()]
    assert np.mean(right) >= 0.95
    before = by_id(docs)
    assert all(r == before[i] for i, r in kept.items())


def test_line_dedup_stage(spark, docs):
    out = STAGE["line_dedup"](spark, docs, SF)
    assert out.columns == COLUMNS
    want = brute_lines({i: r["text"] for i, r in by_id(docs).items()})
    got = by_id(out)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_simhash_stage(spark, docs):
    doubled = docs.unionByName(docs.where("doc_id % 50 = 0"))
    out = STAGE["simhash"](spark, doubled, SF)
    assert out.columns == COLUMNS
    texts = {i: r["text"] for i, r in by_id(docs).items()}
    ids = sorted(texts)
    groups = brute_components(np.array([slow_fingerprint(texts[i]) for i in ids], dtype=np.uint64), ids)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(groups.values()))


def test_mixing_stage(spark, docs):
    out = STAGE["mixing"](spark, docs, SF)
    assert out.columns == COLUMNS
    copies = collections.Counter(r["doc_id"] for r in out.collect())
    rows = by_id(docs)
    assert max(copies.values()) <= 3
    size = {i: len(words(r["text"])) for i, r in rows.items()}
    taken, have = collections.Counter(), collections.Counter()
    for i, r in rows.items():
        taken[r["source"]] += copies[i] * size[i]
        have[r["source"]] += size[i]
    total, names = sum(have.values()), sorted(have)
    for k, s in enumerate(names):
        share = total * (k % 3 + 1) / sum(j % 3 + 1 for j in range(len(names)))
        if share < 3 * have[s] and all(total * (j % 3 + 1) / sum(x % 3 + 1 for x in range(len(names))) < 3 * have[t] for j, t in enumerate(names)):
            assert abs(taken[s] - share) <= max(size[i] for i, r in rows.items() if r["source"] == s)
    again = collections.Counter(r["doc_id"] for r in STAGE["mixing"](spark, docs, SF).collect())
    assert copies == again


def test_packing_stage_and_whole_run(spark, docs):
    repeated = staged(docs.unionByName(docs.where("doc_id < 40")), "test-repeated")
    out = STAGE["packing"](spark, repeated, SF).collect()
    starts = collections.Counter(r["doc_id"] for r in out if r["piece"] == 0)
    assert starts == collections.Counter(r["doc_id"] for r in repeated.select("doc_id").collect())
    run = corpus_pipeline.run(spark, SF)
    for rows in (out, run.collect()):
        used = collections.defaultdict(list)
        for r in rows:
            used[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024


def test_extra_columns_survive(spark, docs):
    wide = docs.withColumns({c: F.lit(1) for c in ("row", "key", "fp", "score", "count", "size")}).limit(30)
    wide = staged(wide, "test-wide")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns, name

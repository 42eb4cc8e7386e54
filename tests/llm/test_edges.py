"""Defined cases of every training-data operator: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sessionsift.llm import licenses, linededup, lm, minhash, mixing, packing, pii, quality, simhash, vptree

LONG = "alpha beta gamma delta " * 30_000
ROWS = [
    (1, "one two three four five six seven eight", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (5, LONG, "b"),
    (6, "one two three four five six seven eight", None),
    (6, "one two three four five six seven eight", None),
    (7, "x" * 50_000, "c"),
    (None, "no id here, mail me@here.org", "c"),
    (8, "Été \U0001f600 naïve\nline two\n\nline two", "d"),
]
CLASHING = ["row", "key", "size", "fp", "score", "count", "id", "th", "range", "hash", "spans", "n_chars", "kept"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    return df.withColumns({c: F.lit(7).cast("long") for c in CLASHING}).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))


EXPECTED = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_pii(docs, none):
    rows = pii.digest(pii.find(docs)).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["n_email"] == 1 and by[None]["spans"] == "email:17:28"
    assert by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[2]["spans"] == ""
    assert pii.digest(pii.find(none)).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(EXPECTED)
    for i in (2, 3):
        assert [(r["length"], r["ids_crc32"]) for r in by[i]] == [(1, zlib.crc32((2).to_bytes(4, "little")))]
    assert len(by[6]) == 2 and by[6][0]["sequence_id"] is not None  # repeated rows are pieces of their own
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (o2 == 0) if s2 != s else (o2 == o + n)
    assert packing.pack(none).count() == 0


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r for r in rows}
    assert (by[2]["n_words"], by[2]["labels"], by[2]["first_word"], by[2]["score"]) == (0, "", None, 0.0)
    assert by[5]["n_words"] == 120_000
    assert licenses.scan(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (5, 1), (6, 1), (None, 0), (7, 0), (7, 5)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert ids(rows) == EXPECTED and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    one_class = quality.scored(docs, labels.where("quality = 1")).collect()
    assert {r["predicted"] for r in one_class} == {1}
    assert quality.scored(none, labels).count() == 0
    assert quality.scored(docs, labels.limit(0)).count() == len(ROWS)


def test_simhash(docs, none):
    rows = simhash.simhash_components(docs).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["fp"] for i in (2, 3, 4)] == [0, 0, 0] and {by[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[6]["component_id"] == 1 and by[None]["component_id"] is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids(kept.collect()) == [1, 2, 5, 7, 8, None]
    assert simhash.simhash_components(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_lm(docs, none):
    rows = lm.score_documents(docs).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[5]["n_tokens"] == 120_001
    assert all(r["score"] < 0 for r in rows)
    assert lm.score_documents(none).count() == 0


def test_lm_without_training_text(docs):
    empty = lm.train(docs.limit(0).select("text"))
    rows = lm.scored(docs, empty).collect()
    assert all(r["n_known"] == 0 and abs(r["score"]) < 1e-9 and abs(r["base_score"]) < 1e-9 for r in rows)


def test_minhash(docs, none):
    rows = minhash.with_neighbours(docs).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["near_next"] == 1.0 and by[2]["n_chars"] == 0  # the next text is empty too
    assert by[5]["n_chars"] == len(LONG)
    assert by[1]["fingerprint"] == by[6]["fingerprint"]
    only = minhash.with_neighbours(docs.where("doc_id = 1")).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0
    assert minhash.with_neighbours(none).count() == 0


def test_line_dedup(docs, none):
    rows = linededup.dedup_lines(docs).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r["kept"] for r in rows}
    assert (by[2]["text"], by[2]["n_lines"], by[2]["n_dropped"]) == ("", 1, 0)
    assert by[8]["n_lines"] == 4 and by[8]["n_dropped"] == 0  # short lines stay
    assert linededup.dedup_lines(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.sampled(docs).collect()
    assert ids([r["row"] for r in rows]) == EXPECTED
    by = {r["row"]["source"]: r for r in rows}
    assert set(by) == {"a", "b", "c", "d", None}
    assert sum(r["target"] for r in by.values()) == pytest.approx(sum(r["source_size"] for r in by.values()))
    assert all(0 <= r["copies"] <= 3 for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.sampled(none).count() == 0 and mixing.mix(none).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (None, [3.0, 3.0], 1), (40, None, 1), (9, [-5.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).withColumn("shard", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 9, -5.0), (20, 1, 9, 8.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 0, 0.0)]
    assert vptree.nearest(df.limit(0)).count() == 0


FEW = ["", "one", "one two", "one two three", "one two three four", "one two three four five", "a b c d e f", "a b c d e f g", "a b c d e f g h"]


def test_signatures_of_few_words():
    together = minhash.signatures_of(FEW)
    for n, text in enumerate(FEW):
        assert (minhash.signatures_of([text])[0] == together[n]).all()


def test_slices_of_few_words(spark):
    """Short texts alone in their slices, and a whole table of few words."""
    long = "alpha beta gamma delta " * 50_000
    for texts in ([FEW[2], long, FEW[3], long + "x", FEW[2]], FEW):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("a")).coalesce(1)
        assert minhash.with_class(minhash.with_neighbours(df), minhash.text_classes(df)).count() == len(texts)
        assert licenses.scan(df).count() == simhash.simhash_components(df).count() == linededup.dedup_lines(df).count() == len(texts)
        assert pii.digest(pii.find(df)).count() == lm.score_documents(df).count() == len(texts)


def test_minhash_classes(docs, none):
    rows = minhash.with_class(minhash.with_neighbours(docs), minhash.text_classes(docs)).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert by[1] == by[6] and by[2] == by[3] == by[4]
    assert minhash.text_classes(none).count() == 0

"""H4's corpus table: deltas equal a rebuild, lookups don't shuffle the table."""
import random
import re

from pyspark.sql import functions as F

from sessionsift.operators import terms as T
from sessionsift.operators.compress import compress_text


def table(df):
    return sorted((r.term or "", r.df) for r in df.collect())


def test_deltas_equal_a_rebuild(spark, df, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, "", " \t\n", " ".join(rnd.choices(["Alpha", "alpha,", "beta", "--", "Éa1", "x"], k=rnd.randrange(1, 9)))])) for i in range(200)]
    docs = df(rows, "pos long, text string").repartition(4)
    path = str(tmp_path / "t")
    for k in (0, 1, 1, 2, 3):
        T.add_terms(docs.where(f"pos % 4 = {k}"), path, f"{k}")
        if k == 2:
            assert T.compact_terms(spark, path)
    assert table(T.read_terms(spark, path)) == table(T.document_frequencies(docs))
    want = {}
    for _, t in rows:
        for w in {"".join(c for c in x.lower() if c.isalnum()) for x in (t or "").split()} - {""}:
            want[w] = want.get(w, 0) + 1
    got = dict(table(T.read_terms(spark, path)))
    assert got.pop("") == sum(bool((t or "").strip()) for _, t in rows) and got == want


def test_lookup_scans_the_table(spark, df, tmp_path):
    path = str(tmp_path / "t")
    T.add_terms(df([(1, "a b c"), (2, "b c"), (3, "c")], "pos long, text string"), path, "0")
    known, n = T.looked_up(T.read_terms(spark, path), df([("b",), ("c",), ("nowhere",), ("",)], "norm string"))
    assert n == 3 and sorted((r.norm, r.df) for r in known.collect()) == [("b", 2), ("c", 3)]


def test_rare_in_the_corpus_is_kept(df):
    docs = df([("s", 0, "common rare common2 odd")], "session_id string, rank int, text string")
    params = df([("s", 0.5)], "session_id string, compression_rate double")
    corpus = df([("common", 90, 0), ("common2", 80, 0), ("rare", 2, 0), (None, 100, 0)], "term string, df long, bucket int")
    assert compress_text(docs, params, terms=corpus).first().optimized_context == "rare odd"


def test_more_text_goes_to_more_tasks(spark, df, monkeypatch):
    """the tokens of one task are bounded, not a share of the input; the contexts stay the same."""
    from sessionsift.operators import compress
    docs = df([(f"s{i}", 0, f"word{i} the rare{i} the and and") for i in range(200)], "session_id string, rank int, text string").withColumn("compression_rate", F.lit(0.5))

    def run():
        out = compress_text(docs)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        return int(re.search(r"RepartitionByExpression \[session_id#\d+\], (\d+)", plan).group(1)), sorted(map(tuple, out.collect()))
    few, want = run()
    monkeypatch.setattr(compress, "PART_CHARS", 100)
    many, got = run()
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and many >= 50 and got == want

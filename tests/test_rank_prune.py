import re

from pyspark.sql import functions as F

from sessionsift.operators import prune, rank

S = "session_id"


def ranked(df, docs, scores):
    rows = [("s", i + 1, t, float(sc)) for i, (t, sc) in enumerate(zip(docs, scores))]
    d = df(rows, "session_id string, pos long, text string, score double")
    return rank.rank_docs(d, order="pos")


def texts_in_rank_order(d):
    return [r.text for r in d.orderBy("rank").collect()]


def test_rank_by_score_and_cap(df):
    r = ranked(df, ["motor", "wheel", "gear"], [2, 1, 3])
    assert texts_in_rank_order(rank.cap_chunks(r, 2)) == ["gear", "motor"]


def test_rank_is_stable_on_ties(df):
    r = ranked(df, ["a", "b", "c"], [1, 1, 1])
    assert texts_in_rank_order(r) == ["a", "b", "c"]


def _dedupe(df, docs, thr=0.9):
    r = ranked(df, docs, [3 - i * 0.1 for i in range(len(docs))])
    terms = rank.embed_docs(r.select(S, "pos", "text")).join(r.select(S, "pos", "rank"), [S, "pos"])
    params = df([("s", thr)], "session_id string, dedupe_threshold double")
    nbrs = prune.lexical_neighbours(terms.select(S, "rank", "term", "tf"), params)
    return texts_in_rank_order(prune.dedupe_semantic(r, nbrs))


def test_exact_duplicates_removed(df):
    assert _dedupe(df, ["gear", "gear", "motor"]) == ["gear", "motor"]


def test_dedupe_compares_with_kept_only(df):
    # b is close to a (dropped); c is close to b (0.87) but not to a (0.71): it survives,
    # because only kept docs count.
    assert _dedupe(df, ["p q", "p q r", "p q r s"], thr=0.8) == ["p q", "p q r s"]


def _budget(df, docs, scores, budget):
    r = ranked(df, docs, scores)
    params = df([("s", budget)], "session_id string, total_prune_budget_chars long")
    return texts_in_rank_order(prune.prune_to_budget(r, params))


def test_budget_keeps_what_fits(df):
    assert _budget(df, ["gear", "motor", "wheel"], [3, 2, 1], 11) == ["gear", "motor"]


def test_oversized_doc_kept_alone_when_positive(df):
    assert _budget(df, ["motor"], [1], 2) == ["motor"]
    assert _budget(df, ["motor", "b"], [0, 0], 2) == ["b"]


def test_budget_is_not_a_running_sum(df):
    # 5 fits, 10 is skipped (uses no budget), 3 still fits.
    assert _budget(df, ["aaaaa", "bbbbbbbbbb", "ccc"], [3, 2, 1], 9) == ["aaaaa", "ccc"]


def test_budget_zero_keeps_nothing(df):
    assert _budget(df, ["a"], [1], 0) == []


def test_list_docs_join_parts(spark, df):
    d = df([("s", 1, ["shaft", " motor ", None, "  "])], "session_id string, pos long, text array<string>")
    assert rank.normalize_docs(d).first().text == "shaft motor"


def test_purge_is_literal_and_case_insensitive(df):
    d = df([("s", 1, "[ERROR] x"), ("s", 2, "[error]y"), ("s", 3, "error] z"), ("s", 4, "[SessionSift] Error: q")],
           "session_id string, pos long, text string")
    assert [r.pos for r in rank.purge_error_docs(d).collect()] == [3]


def test_prefilter_keeps_the_cap(spark, df):
    d = df([("s", i, f"doc {i} word") for i in range(60)], "session_id string, pos long, text string")
    p = df([("s", "word 5", 40)], "session_id string, query string, cap int")
    out = rank.prefilter_topk(d, p)
    assert out.count() == 40
    assert out.where(F.col("ppos") == 1).first().pos == 5


def moved(frame):
    """Input columns of every exchange, sort and window of a plan."""
    text = frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) (Exchange|Sort|Window|WindowGroupLimit)\b.*\nInput \[\d+\]: \[(.*)\]", text)


def test_text_is_fetched_by_the_winners_only(spark, df, tmp_path):
    rows = [("hot" if i % 3 == 0 else f"s{i % 50}", i, f"word {i} " * 5) for i in range(3000)]
    df(rows, "session_id string, pos long, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    params = df([(s, "word 30 33", 40) for s in ["hot", *(f"s{k}" for k in range(50))]], "session_id string, query string, cap int")
    for frame in (rank.prefilter_topk(docs, params), rank.tail_docs(docs, 20)):
        assert not [n for n, columns in moved(frame) if "text#" in columns]
    ranked = rank.top_places(docs.select("session_id", "pos", F.col("pos").alias("x")).join(params.select("session_id", "cap"), "session_id"), "x", 40)
    assert "WindowGroupLimit" in {n for n, _ in moved(ranked)} and not [n for n, columns in moved(ranked) if "text#" in columns]
    top = rank.prefilter_topk(docs, params)
    got = {}
    for r in top.collect():
        got.setdefault(r.session_id, []).append((r.ppos, r.pos, r.text))
    assert len(got["hot"]) == 40 and {p for _, p, _ in sorted(got["hot"])[:2]} == {30, 33} and all(len(v) == 40 for v in got.values())
    assert all(t == f"word {p} " * 5 for v in got.values() for _, p, t in v)
    last = [r.pos for r in rank.tail_docs(docs, 20).where("session_id = 'hot'").collect()]
    assert sorted(last) == sorted(i for i in range(3000) if i % 3 == 0)[-20:]


def test_query_cosines_shuffle_no_terms(spark, df, monkeypatch):
    """A doc's terms look up the query where the doc is read; repeated keys count together."""
    rows = [("s", i, f"word word{i % 7} other{i} other{i}") for i in range(50)] + [("s", 3, "word"), ("s", 4, None), ("z", 1, "word"), (None, 1, "word")]
    docs, asked = df(rows, "session_id string, pos long, text string"), df([("s", "word word3 word3")], "session_id string, query string")
    few = sorted(map(tuple, rank.query_sims(docs, asked).collect()))
    seen, materialize = [], rank.materialize
    monkeypatch.setattr(rank, "materialize", lambda d: seen.append(d) or materialize(d))
    rank.query_sims(docs, asked)
    assert len(seen) == 2 and not any(n == "Exchange" and "term#" in columns for n, columns in moved(seen[1]))
    monkeypatch.setattr(rank, "BROADCAST_ROWS", 0)  # all terms counted, as for very many query terms
    assert len(few) == 50 and few == sorted(map(tuple, rank.query_sims(docs, asked).collect()))


def test_neighbour_pairs_meet_their_norms_in_one_join(spark, df):
    terms = df([("s", 1, "x", 1), ("s", 1, "y", 2), ("s", 2, "x", 1), ("s", 2, "y", 2), ("s", 3, "y", 2), ("s", 4, "z", 1), ("t", 1, "x", 1), ("t", 2, "x", 3)], f"{S} string, rank int, term string, tf long")
    params = df([("s", 0.8), ("t", 0.99)], f"{S} string, dedupe_threshold double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nbrs = prune.lexical_neighbours(terms, params)
        assert sorted((r[S], r["rank"], r.nbrs) for r in nbrs.collect()) == [("s", 2, [1]), ("s", 3, [1, 2]), ("t", 2, [1])]
        plan = nbrs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") == 2  # terms with terms, pairs with thresholds

"""Driver queries for the ranking/pruning core (H5 and its steps) on FX1 / FX2."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionsift.plans import fixtures as fx
from sessionsift.plans import oracle_h5 as O
from sessionsift.plans.optimize import optimize_context
from sessionsift.plans.registry import register
from sessionsift.session import materialize, scratch_dir
from sessionsift.operators.params import apply_model_limits


@register("h5_optimize_context_fx2",
          O.h5_sql(fx.SQL_FX2, "fx2", "fx2_req", limits=True))
def h5_fx2(spark, sf):
    """Flagship on conversations: per-model limits applied (D2), then H5."""
    docs = fx.fx2_docs(spark, sf)
    reqs = apply_model_limits(fx.fx2_requests(spark, sf), docs, fx.model_limits(spark))
    return optimize_context(docs, reqs)


@register("h5_optimize_context_fx1", O.h5_sql(fx.SQL_FX1, "fx1", "fx1_req"))
def h5_fx1(spark, sf):
    """Flagship on long documents (prefilter cap fires)."""
    return optimize_context(fx.fx1_docs(spark, sf), fx.fx1_requests(spark, sf))


# --------------------------------------------------------------------------- step queries
from sessionsift import constants as C  # noqa: E402
from sessionsift.operators import prune, rank  # noqa: E402
from sessionsift.operators.compress import compress_text  # noqa: E402
from sessionsift.plans.optimize import with_param_defaults  # noqa: E402

S = "session_id"
H1 = O.params_sql("fx1_req")
W1 = f"with recursive {fx.SQL_FX1},\n{H1},\n{O.h5_ctes('fx1')}"
W2 = f"with recursive {fx.SQL_FX2},\n{O.params_sql('fx2_req')},\n{O.h5_ctes('fx2')}"


def _clean(docs):
    return rank.purge_error_docs(rank.normalize_docs(docs))


def _fx1_ranked(spark, sf):
    # a row for each session and the bounded candidate list: written once, as the steps below read them several times
    params = materialize(with_param_defaults(fx.fx1_requests(spark, sf)))
    cands = rank.prefilter_topk(_clean(fx.fx1_docs(spark, sf)), params)
    cands = materialize(cands.select(S, F.col("ppos").alias("pos"), "text"))
    scores = rank.bm25_scores(cands, params)
    return materialize(rank.rank_docs(cands.join(scores, [S, "pos"]), order="pos")), params


@register("b9_normalize_docs", f"""with {fx.SQL_FX1}
select session_id, pos, {O.strip_text_sql('text')} as text,
       {O.strip_text_sql("array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: " + O.strip_text_sql('p') + "), lambda p: p <> ''), ' ')")} as joined
from fx1 where {O.strip_text_sql('text')} <> ''""")
def b9(spark, sf):
    d = fx.fx1_docs(spark, sf)
    return (d.select(S, "pos", F.col("text").alias("raw"))
            .select(S, "pos", rank.strip_text(F.col("raw")).alias("text"),
                    rank.normalize_parts(F.split("raw", "\n")).alias("joined"))
            .where(F.col("text") != ""))


@register("c1_purge_error_docs", f"{W1} select session_id, pos from nd2")
def c1(spark, sf):
    return _clean(fx.fx1_docs(spark, sf)).select(S, "pos")


@register("c4_gate_by_size", f"{W2} select session_id, n_docs, initial_size, gate, gate_reason from gated")
def c4(spark, sf):
    g = rank.gate_by_size(with_param_defaults(fx.fx2_requests(spark, sf)), rank.result_sizes(fx.fx2_docs(spark, sf)))
    return g.select(S, F.col("n_docs").cast("bigint"), "initial_size", "gate", "gate_reason")


@register("e7_result_sizes", f"{W1} select session_id, n_docs, cast(initial_size as bigint) as initial_size from sizes")
def e7(spark, sf):
    return rank.result_sizes(fx.fx1_docs(spark, sf))


@register("f4_tail_docs", f"""with {fx.SQL_FX1},
t as (select *, row_number() over (partition by session_id order by pos desc) as r from fx1)
select session_id, pos from t where r <= 20""")
def f4(spark, sf):
    return rank.tail_docs(fx.fx1_docs(spark, sf), 20).select(S, "pos")


@register("f5_prefilter_topk", f"{W1} select session_id, pos, case when n > cap then rn else pos end as ppos from pre where rn <= cap")
def f5(spark, sf):
    params = with_param_defaults(fx.fx1_requests(spark, sf))
    return rank.prefilter_topk(_clean(fx.fx1_docs(spark, sf)), params).select(S, "pos", "ppos")


@register("f6_rank_docs", f"{W1} select session_id, pos, rk as rank, score, fscore as first_score from ranked")
def f6(spark, sf):
    r, _ = _fx1_ranked(spark, sf)
    return r.select(S, "pos", F.col("rank").cast("bigint"), "score", "first_score")


@register("f7_cap_chunks", f"{W1} select session_id, rk as rank, pos from ranked where rk <= {C.DEFAULT_MAX_CHUNKS}")
def f7(spark, sf):
    r, _ = _fx1_ranked(spark, sf)
    return rank.cap_chunks(r, C.DEFAULT_MAX_CHUNKS).select(S, F.col("rank").cast("bigint"), "pos")


@register("g1_dedupe_semantic", f"{W1} select session_id, unnest(arg_max(kept, rk)) as rank from walk group by session_id")
def g1(spark, sf):
    r, params = _fx1_ranked(spark, sf)
    terms = rank.embed_docs(r.select(S, "pos", "text")).join(r.select(S, "pos", "rank"), [S, "pos"])
    nbrs = prune.lexical_neighbours(terms.select(S, "rank", "term", "tf"), params)
    return prune.dedupe_semantic(r, nbrs).select(S, F.col("rank").cast("bigint"))


@register("g2_prune_to_budget", f"""with recursive {fx.SQL_FX2},
rk as (select session_id, row_number() over (partition by session_id order by length(text) % 97 desc, pos) as rk,
              length(text) as len from fx2),
walk(session_id, rk, rem, stop, take) as (
  select distinct session_id, cast(0 as bigint), cast(1000 as bigint), false, []::bigint[] from fx2
  union all
  select w.session_id, r.rk,
         case when w.stop or w.rem <= 0 or r.len > w.rem then w.rem else w.rem - r.len end,
         case when w.stop or w.rem <= 0 then true when r.len > w.rem then len(w.take) = 0 else false end,
         case when w.stop or w.rem <= 0 then w.take
              when r.len > w.rem then (case when len(w.take) = 0 then list_append(w.take, r.rk) else w.take end)
              else list_append(w.take, r.rk) end
  from walk w join rk r on r.session_id = w.session_id and r.rk = w.rk + 1)
select session_id, unnest(arg_max(take, rk)) as rank from walk group by session_id""")
def g2(spark, sf):
    """Budget 1,000 over conversation turns ranked by ``length % 97`` desc, all scores 1."""
    from pyspark.sql import Window
    d = fx.fx2_docs(spark, sf)
    w = Window.partitionBy(S).orderBy((F.length("text") % 97).desc(), F.col("pos"))
    ranked = d.select(S, "text", F.row_number().over(w).alias("rank"), F.lit(1.0).alias("first_score"))
    params = ranked.select(S).distinct().withColumn("total_prune_budget_chars", F.lit(1000).cast("bigint"))
    return prune.prune_to_budget(ranked, params).select(S, F.col("rank").cast("bigint"))


@register("h1_embed_docs", f"""with {fx.SQL_FX2}
select session_id, pos, term, count(*) as tf from (select session_id, pos, unnest({O.toks_sql('text')}) as term from fx2)
group by all""")
def h1(spark, sf):
    return rank.embed_docs(fx.fx2_docs(spark, sf))


@register("h2_cosine_similarity", f"{W1} select session_id, pos, sim from sims")
def h2(spark, sf):
    params = with_param_defaults(fx.fx1_requests(spark, sf))
    return rank.query_cosines(_clean(fx.fx1_docs(spark, sf)), params).select(S, "pos", F.col("__sim").alias("sim"))


@register("h2_dense_cosine", f"""with {fx.SQL_FX6},
f as (select session_id, min_by(vec, pos) as v0 from fx6 group by all)
select x.session_id, x.pos,
       round(case when list_dot_product(x.vec, x.vec) = 0 or list_dot_product(f.v0, f.v0) = 0 then 0
             else list_dot_product(x.vec, f.v0) / (sqrt(list_dot_product(x.vec, x.vec)) * sqrt(list_dot_product(f.v0, f.v0))) end, 6) as cos
from fx6 x join f using (session_id)""")
def h2d(spark, sf):
    v = fx.fx6_vectors(spark, sf)
    first = v.groupBy(S).agg(F.min_by("vec", "pos").alias("v0"))
    return v.join(first, S).select(S, "pos", F.round(rank.dense_cosine("vec", "v0"), 6).alias("cos"))


@register("h3_relevance_score", f"{W2} select session_id, pos, score from scored")
def h3(spark, sf):
    params = with_param_defaults(fx.fx2_requests(spark, sf))
    gated = rank.gate_by_size(params, rank.result_sizes(fx.fx2_docs(spark, sf))).where(F.col("gate") == "run")
    cands = _clean(fx.fx2_docs(spark, sf).select(S, "pos", "text")).join(gated.select(S), S)
    return rank.bm25_scores(cands, gated)


@register("h4_compress_text", f"""with {fx.SQL_FX2},
ch as (select session_id, pos, {O.strip_sql('text')} as text from fx2 where {O.strip_sql('text')} <> ''),
gated as (select distinct session_id, {C.DEFAULT_COMPRESSION_RATE}::double as rate from ch),
{O.compress_ctes('ch', 'pos')}
select session_id, oc as optimized_context from comp""")
def h4(spark, sf):
    d = rank.normalize_docs(fx.fx2_docs(spark, sf).select(S, "pos", "text"))
    params = d.select(S).distinct().withColumn("compression_rate", F.lit(C.DEFAULT_COMPRESSION_RATE))
    return compress_text(d, params, order="pos")


def _term_table(spark, docs):
    """The documents' term table from three deltas, one of them added twice, two compacted."""
    from sessionsift.operators import terms as T
    path = scratch_dir(spark, "terms")
    for batch in (0, 1, 0, 2):
        T.add_terms(docs.where(F.pmod(F.xxhash64(S, "pos"), F.lit(3)) == batch), path, f"{batch}")
        if batch == 1:
            T.compact_terms(spark, path)
    return T.read_terms(spark, path)


@register("h4_corpus_idf", f"""with {fx.SQL_FX2},
ch as (select session_id, pos, {O.strip_sql('text')} as text from fx2 where {O.strip_sql('text')} <> ''),
gated as (select distinct session_id, {C.DEFAULT_COMPRESSION_RATE}::double as rate from ch),
{O.compress_ctes('ch', 'pos', corpus='fx2')}
select session_id, oc as optimized_context from comp""")
def h4_corpus(spark, sf):
    """Compression by the document frequencies of the whole corpus, stored in a table that grows by deltas."""
    docs = fx.fx2_docs(spark, sf)
    d = rank.normalize_docs(docs.select(S, "pos", "text"))
    params = d.select(S).distinct().withColumn("compression_rate", F.lit(C.DEFAULT_COMPRESSION_RATE))
    return compress_text(d, params, order="pos", terms=_term_table(spark, docs))


@register("h5_corpus_idf", O.h5_sql(fx.SQL_FX1, "fx1", "fx1_req", corpus="fx1"))
def h5_corpus(spark, sf):
    """The whole optimizer on long documents, with the corpus-wide weights."""
    docs = fx.fx1_docs(spark, sf)
    return optimize_context(docs, fx.fx1_requests(spark, sf), terms=_term_table(spark, docs))


_WALK_SQL = """items as (select r.session_id, r.rk, r.pos, coalesce(nb.nbrs, []::bigint[]) as nbrs from r left join nb using (session_id, rk)),
walk(session_id, rk, kept) as (
  select distinct session_id, cast(0 as bigint), []::bigint[] from r
  union all
  select w.session_id, i.rk, case when list_has_any(w.kept, i.nbrs) then w.kept else list_append(w.kept, i.rk) end
  from walk w join items i on i.session_id = w.session_id and i.rk = w.rk + 1),
fin as (select session_id, unnest(arg_max(kept, rk)) as rk from walk group by session_id)
select i.session_id, i.pos from fin join items i using (session_id, rk)"""


@register("g3_dedupe_corpus", f"""with recursive {fx.SQL_FX1},
r as (select session_id, pos, text, row_number() over (partition by session_id order by pos) as rk from fx1),
t as (select session_id, rk, term, count(*) as tf from (select session_id, rk, unnest({O.toks_sql('text')}) as term from r) group by all),
n as (select session_id, rk, sqrt(sum(tf * tf)) as norm from t group by all),
p as (select a.session_id, a.rk as a, b.rk as b, sum(a.tf * b.tf) as dot
      from t a join t b on a.session_id = b.session_id and a.term = b.term and b.rk < a.rk group by all),
nb as (select p.session_id, p.a as rk, list(p.b order by p.b) as nbrs
       from p join n x on x.session_id = p.session_id and x.rk = p.a join n y on y.session_id = p.session_id and y.rk = p.b
       where p.dot / (x.norm * y.norm) >= 0.9 group by all),
{_WALK_SQL}""")
def g3(spark, sf):
    """Corpus-scale greedy dedupe of the documents of a source at cosine 0.9 of their term counts."""
    from sessionsift.operators.corpus import dedupe_corpus_terms
    return dedupe_corpus_terms(fx.fx1_docs(spark, sf), 0.9)


@register("g3_dedupe_vectors", f"""with recursive {fx.SQL_FX6},
r as (select session_id, pos, vec, row_number() over (partition by session_id order by pos) as rk from fx6),
nb as (
  select a.session_id, a.rk, list(b.rk order by b.rk) as nbrs
  from r a join r b on a.session_id = b.session_id and b.rk < a.rk
  where list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) >= 0.3
  group by all),
{_WALK_SQL}""")
def g3v(spark, sf):
    """The same for the embeddings of a label at cosine 0.3 (few real neighbours: the bounds prune little)."""
    from sessionsift.operators.corpus import dedupe_corpus
    return dedupe_corpus(fx.fx6_vectors(spark, sf), 0.3)

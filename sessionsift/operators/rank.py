"""Normalise, gate, embed, score, prefilter and rank session documents.

B9 normalize_docs, C1 purge_error_docs, C4 gate_by_size, E7 result_sizes,
H1 embed_docs (lexical term counts), H2 cosine_similarity, H3 relevance_score
(BM25), F5 prefilter_topk, F6 rank_docs, F7 cap_chunks.

Long tables keyed by ``(session_id, pos)``; text never enters a sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import strip_text, tokens
from sessionsift.operators.ordered import join_null_safe
from sessionsift.session import materialize

S = "session_id"
#: The most narrow rows (a session and a few numbers) that are broadcast after they have been counted.
BROADCAST_ROWS = 1_000_000


# --------------------------------------------------------------------------- B9 / C1
def normalize_parts(parts) -> Column:
    """B9 list form: strip parts, drop null/blank ones, join by one space."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    kept = F.filter(F.transform(parts, lambda p: strip_text(p)), lambda p: p.isNotNull() & (p != ""))
    return strip_text(F.array_join(kept, " "))


def normalize_docs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Strip strings; list docs (array<string>): strip parts, drop blank/null, join by one space.

    Blank results are removed.
    """
    dtype = docs.schema[text].dataType.simpleString()
    if dtype.startswith("array"):
        norm = normalize_parts(text)
    else:
        norm = strip_text(F.col(text).cast("string"))
    return docs.withColumn(text, norm).where(F.col(text) != "")


def tail_places(docs: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """``(session_id, order)`` of the last ``n`` docs of each session: ``row_number <= n`` with a literal ``n``
    lets the planner insert a partial per-partition ``WindowGroupLimit`` before the shuffle."""
    w = Window.partitionBy(S).orderBy(F.col(order).desc())
    return docs.select(S, order).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def tail_docs(docs: DataFrame, n: int = C.MAX_TRANSCRIPT_ENTRIES, order: str = "pos") -> DataFrame:
    """the last ``n`` docs of each session (original order kept by ``order``, which is unique in a session).

    The ranking sees ``(session_id, order)`` only; the winners fetch their docs afterwards."""
    return fetched(docs, tail_places(docs, n, order), [S, order], "left_semi")


def purge_error_docs(docs: DataFrame, prefixes=C.ERROR_PREFIXES, text: str = "text") -> DataFrame:
    """Drop docs starting with an error prefix, case-insensitively (literal, not regex)."""
    longest = max(len(p) for p in prefixes)
    head = F.lower(F.substring(F.col(text), 1, longest))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | head.startswith(p.lower())
    return docs.where(~hit)


# --------------------------------------------------------------------------- E7 / C4
def result_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """E7 (initial part): per session, docs and Σ code-point length of the raw docs."""
    return docs.groupBy(S).agg(F.count(F.lit(1)).alias("n_docs"),
                               F.sum(F.length(F.col(text))).cast("bigint").alias("initial_size"))


def gate_by_size(requests: DataFrame, sizes: DataFrame, min_col: str = "min_input_size") -> DataFrame:
    """C4: label each request ``run`` / ``no_optimization`` before any costly work.

    No docs -> no_optimization with sizes 0/0; an integer ``min_input_size`` > 0
    above the initial size -> no_optimization with final = initial.
    """
    r = join_null_safe(requests, sizes, [S], "left")
    n = F.coalesce(F.col("n_docs"), F.lit(0))
    i = F.coalesce(F.col("initial_size"), F.lit(0)).cast("bigint")
    m = F.col(min_col)
    below = m.isNotNull() & (m > 0) & (i < m)
    return r.select(
        "*",
        F.when(n == 0, F.lit("no_optimization")).when(below, F.lit("no_optimization")).otherwise(F.lit("run")).alias("gate"),
        F.when(n == 0, F.lit(C.REASON_NO_DOCS))
        .when(below, F.format_string("context size %d chars is below the threshold of %d chars.", i, m.cast("bigint")))
        .otherwise(F.lit("")).alias("gate_reason"),
    ).withColumn("initial_size", i).withColumn("n_docs", n)


# --------------------------------------------------------------------------- H1 / H2
def embed_docs(docs: DataFrame, keys=(S, "pos"), text: str = "text") -> DataFrame:
    """H1 (lexical default): term counts ``(keys..., term, tf)``."""
    keys = list(keys)
    return (docs.select(*keys, F.explode(tokens(F.col(text))).alias("term"))
            .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))


def term_norms(terms: DataFrame, keys=(S, "pos")) -> DataFrame:
    keys = list(keys)
    return terms.groupBy(*keys).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def dense_cosine(a, b) -> Column:
    """H2 (dense): cosine of two ``array<double>``; zero norm -> 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """Query terms ``(session_id, term, qtf)``; a blank query has none."""
    return (queries.select(S, F.explode(tokens(F.col(query))).alias("term"))
            .groupBy(S, "term").agg(F.count(F.lit(1)).alias("qtf")))


def _tf_squares(words: Column) -> Column:
    """The sum of the squared term counts of a list of tokens: the (n+1)th copy of a term adds 2n+1."""
    zero = F.struct(F.lit("").alias("w"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("ss"))
    step = lambda s, w: F.when(s["w"] == w, F.struct(w.alias("w"), (s["n"] + 1).alias("n"), (s["ss"] + 2 * s["n"] + 1).alias("ss"))).otherwise(
        F.struct(w.alias("w"), F.lit(1).cast("bigint").alias("n"), (s["ss"] + 1).alias("ss")))
    return F.aggregate(F.sort_array(words), zero, step, lambda s: s["ss"])


def _counted_dots(docs: DataFrame, q: DataFrame) -> DataFrame:
    """``(session_id, pos, dot, ss)`` by the docs' term counts; rows of one key count together."""
    both = embed_docs(docs.select(S, "pos", "text")).join(q, [S, "term"], "left")
    return both.groupBy(S, "pos").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"), F.sum(F.col("tf") * F.col("tf")).alias("ss"))


def query_dots(docs: DataFrame, q: DataFrame) -> DataFrame:
    """``(session_id, pos, dot, ss)``: the product of a doc's and its session's query's term counts and the square of
    the doc's norm, for docs with terms; ``q(session_id, term, qtf)`` is read several times.

    As long as the query terms are few enough to be broadcast, a doc's tokens look them up where the doc is read and
    its norm comes from its own list, so two numbers a doc are shuffled instead of all its terms.  Only keys that
    stand in several rows count their terms together."""
    if q.count() > BROADCAST_ROWS:
        return _counted_dots(docs, q)
    words = docs.select(S, "pos", tokens(F.col("text")).alias("t"), F.monotonically_increasing_id().alias("row"))
    # before the explosion, not beside it: there it would be computed for every token
    words = words.withColumn("ss", _tf_squares(F.col("t"))).select(S, "pos", "row", "ss", F.explode("t").alias("term"))
    of_row = words.join(F.broadcast(q), [S, "term"], "left").groupBy(S, "pos").agg(
        F.sum("qtf").alias("dot"), F.max("ss").alias("ss"), (F.min("row") < F.max("row")).alias("several"))
    dots = materialize(of_row)
    several = dots.where("several").select(S, "pos")
    dots = dots.where("NOT several").drop("several")
    if several.isEmpty():
        return dots
    return dots.unionByName(_counted_dots(docs.join(several, [S, "pos"], "left_semi"), q))


def query_sims(docs: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """H2 (lexical): ``(session_id, pos, __sim)`` of the docs that share a term with their session's query: the
    cosine of the term counts, rounded to 6 digits."""
    q = materialize(query_terms(queries, query))
    norms = q.groupBy(S).agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf")).cast("double")).alias("__qn"))
    dots = query_dots(docs, q)
    sim = F.round(F.col("dot").cast("double") / (F.sqrt(F.col("ss").cast("double")) * F.col("__qn")), C.SCORE_DIGITS)
    return dots.where("dot > 0").join(norms, S).select(S, "pos", sim.alias("__sim"))


def query_cosines(docs: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """``docs`` with ``__sim``, the cosine of a doc's term counts with its session's query; zero norm -> 0."""
    sims = query_sims(docs, queries, query)
    return docs.join(sims, [S, "pos"], "left").withColumn("__sim", F.coalesce("__sim", F.lit(0.0)))


# --------------------------------------------------------------------------- H3
def bm25_scores(cands: DataFrame, queries: DataFrame, query: str = "query",
                k1: float = C.BM25_K1, b: float = C.BM25_B, keep: tuple[str, ...] = ()) -> DataFrame:
    """H3 (lexical default): BM25 of each doc against its session query, over the session's docs.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); one term per distinct query token; rounded to 6 digits.
    Term counts, lengths and document frequencies are aggregates over (session, pos, term) without the
    text, so a long query costs no more than its terms and no doc is copied.
    Returns ``(session_id, pos, score, *keep)``.
    """
    toks = cands.select(S, "pos", tokens(F.col("text")).alias("t"))
    lens = toks.select(S, "pos", F.size("t").alias("dl"))
    stats = lens.groupBy(S).agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))
    tf = toks.select(S, "pos", F.explode("t").alias("term")).groupBy(S, "pos", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(query_terms(queries, query).select(S, "term"), [S, "term"])
    df = hits.groupBy(S, "term").agg(F.count(F.lit(1)).alias("df"))
    h = hits.join(df, [S, "term"]).join(lens, [S, "pos"]).join(stats, S)
    idf = F.log(F.lit(1.0) + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm_len = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * norm_len)
    raw = h.groupBy(S, "pos").agg(F.sum(part).alias("raw"))
    return (cands.select(S, "pos", *keep).join(raw, [S, "pos"], "left")
            .select(S, "pos", F.round(F.coalesce(F.col("raw"), F.lit(0.0)), C.SCORE_DIGITS).alias("score"), *keep))


# --------------------------------------------------------------------------- F5
def prefilter_cap(max_chunks) -> Column:
    mc = F.col(max_chunks) if isinstance(max_chunks, str) else max_chunks
    return F.greatest(F.lit(C.PREFILTER_MIN_CAP), mc * C.PREFILTER_CHUNK_FACTOR)


def fetched(docs: DataFrame, places: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``docs`` joined with the narrow ``places``, which are written and counted first: few enough are broadcast,
    so that no other doc's text moves; beyond that both sides are shuffled."""
    places = materialize(places)
    return join_null_safe(docs, F.broadcast(places) if places.count() <= BROADCAST_ROWS else places, keys, how)


def top_places(scored: DataFrame, by: str, bound: int, cap: str = "cap") -> DataFrame:
    """The first ``cap`` rows of each session by ``by`` (null first), then ``pos``, with their place ``__rn``.

    ``bound``, a literal at least as large as every cap, lets the planner put a partial per-partition top-k
    (``WindowGroupLimit``) below the shuffle: one from each partition, at most ``bound`` rows, meets in the
    task of a hot session."""
    w = Window.partitionBy(S).orderBy(F.col(by).desc_nulls_first(), F.col("pos").asc())
    ranked = scored.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.lit(bound))
    return ranked.where(F.col("__rn") <= F.col(cap))


def prefilter_topk(docs: DataFrame, params: DataFrame, query: str = "query", carry: tuple[str, ...] = (),
                   given: str | None = None) -> DataFrame:
    """sessions with more than ``cap`` docs keep the top ``cap`` by query cosine, re-ordered by it.

    ``params`` has one row per session with ``query`` and ``cap`` (and is read twice: materialise it).  Only
    sessions above their cap are scored and ranked, on ``(session_id, pos, cosine)``; the winners fetch their text
    afterwards, so no text goes through an exchange or a sort before they are known.  Output adds ``ppos``: the
    prefilter rank when the cap fired, else the incoming ``pos``, and the ``carry`` parameter columns.  ``given``
    names a column of ``docs`` to rank by in place of the lexical cosine (null first: such a doc is always kept).
    """
    row = params.agg(F.max("cap").alias("m"), F.count("*").alias("n")).first()  # the literal bound of the plan
    bound = int(row["m"]) if row["m"] is not None else 0
    asked = F.when(strip_text(F.col(query)) == "", F.lit(" ")).otherwise(F.col(query))
    counts = docs.groupBy(S).agg(F.count(F.lit(1)).alias("__n"))
    sized = params.select(S, "cap", asked.alias("__q"), *carry).join(counts, S)
    # rows of a session's numbers and names; with the query among them they may be of any size
    by_session = F.broadcast if row["n"] <= BROADCAST_ROWS and query not in carry else (lambda side: side)
    over = F.col("__n") > F.col("cap")
    few = docs.join(by_session(sized.where(~over).drop("__q", "__n", "cap")), S).withColumn("ppos", F.col("pos").cast("bigint"))
    large = sized.where(over)
    many = docs.join(by_session(large.select(S)), S, "left_semi")
    if given is None:
        sims = query_sims(many, large.select(S, "__q"), "__q")
        scored = many.select(S, "pos").join(sims, [S, "pos"], "left").withColumn("__sim", F.coalesce("__sim", F.lit(0.0)))
    else:
        scored = many.select(S, "pos", F.col(given).alias("__sim"))
    places = top_places(scored.join(large.select(S, "cap"), S), "__sim", bound).select(S, "pos", F.col("__rn").cast("bigint").alias("ppos"))
    winners = fetched(docs, places, [S, "pos"]).join(by_session(large.drop("__q", "__n", "cap")), S)
    return few.unionByName(winners.select(*few.columns))


# --------------------------------------------------------------------------- F6 / F7
def rank_docs(scored: DataFrame, order: str = "ppos") -> DataFrame:
    """rank by score desc, stable on incoming order; ``first_score`` of the first identical text."""
    w = Window.partitionBy(S).orderBy(F.col("score").desc(), F.col(order).asc())
    wt = Window.partitionBy(S, "__h").orderBy(F.col(order).asc()).rowsBetween(Window.unboundedPreceding, 0)
    return (scored.withColumn("__h", F.sha2("text", 256)).withColumn("rank", F.row_number().over(w))
            .withColumn("first_score", F.first("score").over(wt)).drop("__h"))


def cap_chunks(ranked: DataFrame, k, rank: str = "rank") -> DataFrame:
    """first ``k`` of the ranked list (``k`` a literal or a column)."""
    k = F.col(k) if isinstance(k, str) else F.lit(k)
    return ranked.where(F.col(rank) <= k)

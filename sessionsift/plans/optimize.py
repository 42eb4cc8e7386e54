"""End-to-end plans: H5 optimize_context (flagship), H6 transcripts_to_docs, H7 optimize_live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.operators import prune, rank
from sessionsift.operators.compress import compress_scored, compress_text
from sessionsift.operators.ordered import join_null_safe, named_sessions, nameless_sessions
from sessionsift.operators.params import resolve_params
from sessionsift.session import materialize, spread
from sessionsift.sources.requests import validate_requests

S = "session_id"

PARAM_DEFAULTS = {
    "min_input_size": (C.DEFAULT_MIN_CHARS, "bigint"),
    "max_chunks": (C.DEFAULT_MAX_CHUNKS, "int"),
    "total_prune_budget_chars": (C.DEFAULT_PRUNE_BUDGET_CHARS, "bigint"),
    "compression_rate": (C.DEFAULT_COMPRESSION_RATE, "double"),
    "dedupe_threshold": (C.DEFAULT_DEDUPE_THRESHOLD, "double"),
}


def with_param_defaults(requests: DataFrame, **overrides) -> DataFrame:
    """Add any missing optimizer parameter column with its default (or an override)."""
    out = requests
    if "query" not in out.columns:
        out = out.withColumn("query", F.lit(""))
    out = out.withColumn("query", F.coalesce(F.col("query").cast("string"), F.lit("")))
    for name, (default, dtype) in PARAM_DEFAULTS.items():
        value = overrides.get(name, default)
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value).cast(dtype))
    return out.withColumn("cap", rank.prefilter_cap("max_chunks"))


MODEL_DEFAULTS = {"embed_model": C.DEFAULT_EMBED_MODEL, "reranker_model": C.DEFAULT_RERANKER_MODEL, "compressor_model": C.DEFAULT_COMPRESSOR_MODEL}


def _with_models(requests: DataFrame) -> DataFrame:
    """Model names of each request, where it has none the defaults of D3."""
    return requests.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in requests.columns else F.lit(v) for c, v in MODEL_DEFAULTS.items()})


def select_docs(docs: DataFrame, requests: DataFrame, scorer=None, embedder=None, models=None) -> tuple[DataFrame, DataFrame | None]:
    """Steps B9 -> C1 -> F5 -> H3 -> F6 -> G1 -> G2 -> F7 on gated-in sessions.

    ``requests`` (one row per session) should be materialised by the caller.

    Returns ``(session_id, rank, slot, text)``: the docs that reach compression,
    ``slot`` = 1-based position in the final list; and, if a plug-in is used,
    ``(session_id, error)`` of the sessions for which it failed.
    """
    from sessionsift.functions.models import applied, digest
    from sessionsift.functions.plugins import embed_column, pair_score_column
    extra = ["n_docs"] if "n_docs" in requests.columns else []
    by_embedder, by_scorer = (bool(models.embedders), bool(models.scorers)) if models is not None else (False, False)
    extra += list(MODEL_DEFAULTS) if models is not None else []
    params = requests.select(S, "query", "cap", "max_chunks", "total_prune_budget_chars",
                             "compression_rate", "dedupe_threshold", *extra)
    d = docs.select(S, "pos", "text").join(params.select(S), S)
    d = rank.purge_error_docs(rank.normalize_docs(d))
    # The candidate list is bounded (<= cap per session): materialise it once, with the
    # session's parameters carried on each row (no later joins with params).
    carry = ("max_chunks", "total_prune_budget_chars", "compression_rate", "dedupe_threshold")
    more = carry + (("query",) if scorer is not None or by_scorer else ()) + (("reranker_model",) if by_scorer else ())
    failing = embedder is not None or scorer is not None or by_embedder or by_scorer
    own: tuple[str, ...] = ("vec", "error") if embedder is not None or by_embedder else ()
    if not own:
        top = rank.prefilter_topk(d, params, carry=more)
    else:
        # K1: dense vectors replace the term counts in F5 and G1.  A doc or query that fails sorts first, so
        # that its error is among the candidates.
        asked = F.when(rank.strip_text(F.col("query")) == "", F.lit(" ")).otherwise(F.col("query"))
        if by_embedder:
            name = F.col("embed_model").alias("model")
            of_doc = d.join(params.select(S, name), S).withColumn("digest", digest(F.col("text")))
            of_query = params.select(S, name, asked.alias("text")).withColumn("digest", digest(F.col("text")))
            vectors = applied(of_doc.select("model", "text").unionByName(of_query.select("model", "text")), "embedders", models, "array<double>")
            vectors = vectors.select("model", "digest", F.struct("value", "error").alias("v"))
            q = of_query.join(vectors, ["model", "digest"]).select(S, F.col("v").alias("q"))
            v = of_doc.join(vectors, ["model", "digest"]).drop("model", "digest").join(q, S)
        else:
            q = params.select(S, embed_column(asked, embedder, "embedder").alias("q"))
            v = d.withColumn("v", embed_column("text", embedder, "embedder")).join(q, S)
        sim = F.round(rank.dense_cosine(F.col("v")["value"], F.col("q")["value"]), C.SCORE_DIGITS)
        v = v.select(S, "pos", "text", F.col("v")["value"].alias("vec"), F.coalesce(F.col("v")["error"], F.col("q")["error"]).alias("error"), sim.alias("sim"))
        top = rank.prefilter_topk(v, params, carry=more, given="sim")
    cands = materialize(top.select(S, F.col("ppos").alias("pos"), "text", *more, *own))
    if scorer is None and not by_scorer:
        scores = rank.bm25_scores(cands, params, keep=("text",) + carry + own)
    else:
        # K1: a pair scorer (e.g. a cross-encoder) replaces BM25 on the bounded candidate list.
        if by_scorer:
            named = cands.withColumnRenamed("reranker_model", "model").withColumn("digest", digest(F.col("query"), F.col("text")))
            values = applied(named.select("model", "query", "text"), "scorers", models, "double")
            named = named.join(values.select("model", "digest", F.struct("value", "error").alias("p")), ["model", "digest"])
            scored = named.drop("model", "digest")
        else:
            scored = cands.withColumn("p", pair_score_column("query", "text", scorer, name="pair_scorer"))
        error = F.coalesce("error", F.col("p")["error"]) if own else F.col("p")["error"]
        scores = scored.select(S, "pos", "text", *carry, *(c for c in own if c != "error"), error.alias("error"),
                               F.coalesce(F.round(F.col("p")["value"], C.SCORE_DIGITS), F.lit(0.0)).alias("score"))
    # Bounded and read three times below: materialise once.
    ranked = materialize(rank.rank_docs(scores, order="pos"))
    if not own:
        nbrs = prune.lexical_neighbours(rank.embed_docs(ranked.select(S, "rank", "text"), keys=(S, "rank")), params)
    else:
        nbrs = prune.dense_neighbours(ranked.where("vec IS NOT NULL"), params)
    items = (ranked.select(S, "rank", "text", "first_score", "total_prune_budget_chars", "max_chunks")
             .join(nbrs, [S, "rank"], "left")
             .select(S, "total_prune_budget_chars", "max_chunks",
                     F.struct(F.col("rank").cast("int").alias("rank"),
                              F.coalesce("nbrs", F.array().cast("array<int>")).alias("nbrs"),
                              F.length("text").cast("bigint").alias("len"),
                              F.col("first_score")).alias("it")))
    per_session = items.groupBy(S).agg(F.collect_list("it").alias("items"),
                                       F.first("total_prune_budget_chars").alias("total_prune_budget_chars"),
                                       F.first("max_chunks").alias("max_chunks"))
    kept = prune.greedy_keep(F.col("items"))
    survivors = F.filter(F.col("items"), lambda x: F.array_contains(kept, x["rank"]))
    take = prune.budget_fold(survivors, F.col("total_prune_budget_chars"))
    final = F.slice(take, 1, F.col("max_chunks"))
    chosen = per_session.select(S, F.posexplode(final).alias("slot", "rank"))
    # At most max_chunks docs per session; compression reads it in one pass.
    chosen = (ranked.select(S, "rank", "text", "compression_rate").join(chosen, [S, "rank"])
              .select(S, "rank", (F.col("slot") + 1).alias("slot"), "text", "compression_rate"))
    errors = ranked.where("error IS NOT NULL").groupBy(S).agg(F.min("error").alias("error")) if failing else None
    return chosen, errors


def optimize_context(docs: DataFrame, requests: DataFrame, scorer=None, embedder=None, token_scorer=None, models=None, terms=None) -> DataFrame:
    """H5 flagship: one result row per request.

    ``docs(session_id, pos, text)`` raw docs; ``requests(session_id, query,
    [min_input_size, max_chunks, total_prune_budget_chars, compression_rate,
    dedupe_threshold])``.  Returns ``(session_id, status, reason, initial_size,
    final_size, optimized_context)``; ``optimized_context`` is '' when nothing
    survives.  K1 factories: ``embedder`` replaces the term counts of F5 and G1,
    ``scorer`` (pairs) BM25, ``token_scorer`` the token weights of H4.  K2: a
    session for which a plug-in fails gets the status ``failed`` with the error
    as its reason; all others are unaffected.  ``models``
    (``functions.models.Models``) chooses the model of each step by the names in
    the request's ``embed_model``, ``reranker_model`` and ``compressor_model``.
    ``terms`` (``operators.terms``): H4 weighs tokens by a corpus, not by the session.
    """
    docs = named_sessions(spread(docs, S, "pos"))
    params = named_sessions(with_param_defaults(requests if models is None else _with_models(requests)))
    # One row per session, read by the selection and by the final join: materialise once.
    gated = materialize(rank.gate_by_size(params, rank.result_sizes(docs)))
    active = gated.where(F.col("gate") == "run")
    chosen, errors = select_docs(docs, active, scorer, embedder, models)
    by_token_scorer = models is not None and bool(models.token_scorers)
    if token_scorer is None and not by_token_scorer:
        out = gated.join(compress_text(chosen, order="slot", terms=terms), S, "left").withColumn("token_error", F.lit(None).cast("string"))
    else:
        from sessionsift.functions.models import applied, digest
        from sessionsift.functions.plugins import token_score_column
        if by_token_scorer:
            named = chosen.join(active.select(S, models.compressor(F.col("compressor_model")).alias("model")), S).withColumn("digest", digest(F.col("text")))
            values = applied(named.select("model", "text"), "token_scorers", models, "array<double>")
            scored = named.join(values.select("model", "digest", F.struct("value", "error").alias("t")), ["model", "digest"]).drop("model", "digest")
        else:
            scored = chosen.withColumn("t", token_score_column("text", token_scorer, "token_scorer"))
        scored = materialize(scored)
        failed = scored.groupBy(S).agg(F.min(F.col("t")["error"]).alias("item_error"))
        short = compress_scored(scored.withColumn("scores", F.col("t")["value"]), "scores", order="slot")
        out = gated.join(short, S, "left").join(failed, S, "left")
        out = out.withColumn("token_error", F.coalesce("item_error", "error")).drop("error", "item_error")
    if errors is None:
        errors_of = F.col("token_error")
    else:
        out = out.join(errors.select(S, F.col("error").alias("pick_error")), S, "left")
        errors_of = F.coalesce("pick_error", "token_error")
    run = F.col("gate") == "run"
    bad = run & errors_of.isNotNull()
    opt = F.when(bad, F.lit("")).otherwise(F.coalesce(F.col("optimized_context"), F.lit("")))
    return nameless_sessions(out.select(
        S,
        F.when(~run, F.col("gate")).when(bad, F.lit("failed")).when(opt == "", F.lit("no_optimization")).otherwise(F.lit("optimized")).alias("status"),
        F.when(bad, errors_of).when(run, F.lit("")).otherwise(F.col("gate_reason")).alias("reason"),
        F.col("initial_size").cast("bigint").alias("initial_size"),
        F.when(bad, F.col("initial_size")).when(run, F.length(opt)).when(F.col("n_docs") == 0, F.lit(0)).otherwise(F.col("initial_size"))
        .cast("bigint").alias("final_size"),
        opt.alias("optimized_context"),
    ))


REQUEST_OPTIONS = ("min_input_size", "max_chunks", "total_prune_budget_chars", "compression_rate", "dedupe_threshold",
                   "reranker_model", "embed_model", "compressor_model")


def optimize_requests(requests: DataFrame, keep: tuple[str, ...] = ("request_id",), **plugins) -> DataFrame:
    """H5 from request payloads (A3 rows): A4 first, then the optimizer, one result for each row.

    A row is a request of its own, whether its ``request_id`` is missing or stands in other rows too; ``keep``
    names the columns that come along.  Returns ``(*keep, ok, status, error_code, message, reason, initial_size, final_size,
    optimized_context)``: ``failed`` with ``invalid_input`` for payloads that are not requests, with
    ``dependency_missing`` for models that can't be imported, with ``runtime_error`` for unknown options and
    for plug-ins that fail otherwise; a request whose integer ``min_input_size`` is above its size, or without docs, is ``no_optimization``.
    """
    v = validate_requests(requests)
    unknown = F.array_sort(F.array_except(F.map_keys("options"), F.array(*map(F.lit, REQUEST_OPTIONS))))
    # numbered once and written: the key of a row in everything that follows
    row = F.monotonically_increasing_id().cast("string")
    v = materialize(v.withColumn("unknown", F.when(F.col("status") == "run", F.get(unknown, 0))).withColumn("__row", row))
    run = v.where("status = 'run' AND unknown IS NULL")
    docs = run.select(F.col("__row").alias(S), F.posexplode(F.try_variant_get("docs", "$", "array<string>")).alias("pos", "text"))
    asked = run.select(F.col("__row").alias(S), "query", F.map_filter("options", lambda k, x: k != "min_input_size").alias("options"), F.col("min_input_size").alias("gate_size"))
    params = resolve_params(asked).withColumn("min_input_size", F.coalesce("gate_size", F.lit(0)))
    result = optimize_context(docs, params.drop("gate_size"), **plugins)
    from sessionsift.functions.models import error_code
    r = v.select("__row", F.struct(*keep).alias("__keep"), F.col("status").alias("a4"), F.col("error_code").alias("a4_code"), F.col("reason").alias("a4_reason"), "unknown", F.col("initial_size").alias("size"))
    r = r.join(result.withColumnRenamed(S, "__row"), "__row", "left")
    invalid, odd = F.col("a4") == "invalid_input", F.col("unknown").isNotNull()
    failed = invalid | odd | F.coalesce(F.col("status") == "failed", F.lit(False))
    message = F.when(invalid, F.col("a4_reason")).when(odd, F.concat(F.lit("unknown option: "), "unknown")).when(failed, F.col("reason"))
    zero = F.lit(0).cast("bigint")
    return r.select(
        "__keep.*", (~failed).alias("ok"),
        F.when(failed, F.lit("failed")).when(F.col("a4") == "no_optimization", F.col("a4")).otherwise(F.col("status")).alias("status"),
        F.when(invalid, F.col("a4_code")).when(failed, F.when(odd, "runtime_error").otherwise(error_code(F.col("reason")))).alias("error_code"), message.alias("message"),
        F.when(failed, message).when(F.col("a4") == "no_optimization", F.col("a4_reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(failed, F.lit(None)).when(F.col("a4") == "no_optimization", zero).otherwise(F.col("initial_size")).cast("bigint").alias("initial_size"),
        F.when(failed, F.lit(None)).when(F.col("a4") == "no_optimization", zero).otherwise(F.col("final_size")).cast("bigint").alias("final_size"),
        F.when(failed, F.lit(None).cast("string")).otherwise(F.coalesce("optimized_context", F.lit(""))).alias("optimized_context"))


def optimize_live(calls: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """H7: the live pass on a call table: F3 (superseded outputs) then C3 (stale error inputs).

    ``calls(session_id, seq, turn, tool, status, input, output, signature)``;
    ``last`` = final user-turn count per session (defaults to max turn of the calls).
    Adds ``superseded`` and ``masked``; E5 counts them per session.
    """
    from sessionsift.operators import calls as K
    return K.mask_stale_error_inputs(K.mark_superseded_outputs(calls), last=last)


def replaced_parts(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """``messages`` with the input and output of the ``calls(session_id, msg_no, part_no, input, output,
    superseded, masked)`` that changed."""
    changed = calls.where("superseded OR masked").groupBy(S, "msg_no").agg(
        F.map_from_entries(F.collect_list(F.struct("part_no", F.struct("input", "output")))).alias("__new"))  # a message's parts

    def rewritten(part, i):
        new = F.col("__new")[i]
        state = F.struct(part["state"]["status"].alias("status"), new["input"].alias("input"), new["output"].alias("output"))
        return F.when(new.isNull(), part).otherwise(F.struct(part["type"].alias("type"), part["callID"].alias("callID"), part["tool"].alias("tool"), state.alias("state")))

    out = join_null_safe(messages, changed, [S, "msg_no"], "left")
    out = out.withColumn("parts", F.when(F.col("__new").isNull(), F.col("parts")).otherwise(F.transform("parts", rewritten))).drop("__new")
    return out


def optimize_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H7 from messages: ``messages(session_id, msg_no, info struct<role>, parts array<struct<type, callID, tool,
    state struct<status, input, output>>>)`` as B8 reads them.

    Returns the messages with the superseded outputs and stale error inputs of their parts replaced, and
    ``(session_id, deduped, purged_errors)``.  Every user message counts as a turn, also those after the
    last call.
    """
    from sessionsift.functions.signature import tool_signature
    from sessionsift.operators import calls as K
    from sessionsift.operators.extract import flatten_tool_parts
    flat = flatten_tool_parts(messages)
    calls = flat.withColumn("seq", F.col("msg_no") * _SEQ_LINE + F.col("part_no")).withColumn("signature", tool_signature("tool", "input"))
    last = messages.groupBy(S).agg(F.count_if(F.coalesce(F.col("info.role") == "user", F.lit(False))).alias("__last"))
    done = materialize(optimize_live(calls, last))
    return replaced_parts(messages, done), K.strategy_counts(done)


_SEQ_LINE, _SEQ_KIND = 1 << 20, 1 << 19


def transcript_items(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2 -> F1 -> B2..B7 -> D1: the item table of a transcript and each session's final turn.

    Items: ``(session_id, seq, line_no, kind, text, signature, protected, is_error, turn)``;
    ``seq`` orders an entry's texts before its tool results.
    """
    from sessionsift.functions.signature import tool_signature
    from sessionsift.functions.text import is_protected
    from sessionsift.operators import calls as K
    from sessionsift.operators import extract as X
    from sessionsift.sources.transcripts import parse_entries

    # Parsed once: four branches below read the entries (texts, turns, tool uses, tool results).
    ent = materialize(parse_entries(spread(lines, S, "line_no")).withColumn("texts", X.extract_texts("content")))
    turns = K.assign_turns(ent, (F.col("type") == "user") & (F.size("texts") > 0), order="line_no")
    last = K.last_turns(turns)
    texts = turns.select(S, "line_no", "turn", F.posexplode("texts").alias("pos", "text")).select(
        S, (F.col("line_no") * _SEQ_LINE + F.col("pos")).alias("seq"), "line_no", F.lit("text").alias("kind"), "text",
        F.lit(None).cast("string").alias("signature"), F.lit(False).alias("protected"), F.lit(False).alias("is_error"),
        "turn")
    resolved = X.resolve_tool_calls(X.explode_tool_uses(ent), X.explode_tool_results(ent))
    tools = (join_null_safe(resolved.where(F.col("text") != ""), turns.select(S, "line_no", "turn"), [S, "line_no"], large=True)
             .select(S, (F.col("line_no") * _SEQ_LINE + _SEQ_KIND + F.col("part_no")).alias("seq"), "line_no",
                     F.lit("tool_result").alias("kind"), K.label_tool_docs("name", "text").alias("text"),
                     tool_signature("name", "input").alias("signature"), is_protected("name").alias("protected"),
                     "is_error", "turn"))
    return texts.unionByName(tools), last


def transcripts_to_docs(lines: DataFrame, n: int = C.MAX_TRANSCRIPT_ENTRIES) -> DataFrame:
    """H6: transcript lines -> optimizer docs ``(session_id, seq, line_no, kind, text)``.

    Items -> F2 newest result per signature -> C2 stale errors -> F4 last ``n``.
    """
    from pyspark.sql import Window

    from sessionsift.operators import calls as K
    items, last = transcript_items(lines)
    kept = K.drop_stale_errors(K.dedupe_tool_results(items), last=last)
    w = Window.partitionBy(S).orderBy(F.col("seq").desc())
    return (kept.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
            .select(S, "seq", "line_no", "kind", "text"))

"""Projections and extraction: B1-B4 (transcript parts), B8 (live message parts),
B10 build_requests, D1 resolve_tool_calls (as-of join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import is_blank, strip_ws
from sessionsift.operators.ordered import join_null_safe, last_before

S = "session_id"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _is_str(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def extract_texts(content) -> Column:
    """B1: string -> [trimmed] if non-empty; array -> trimmed non-empty ``text`` of every part whose
    ``text`` is a string (any part type); anything else -> []."""
    content = F.col(content) if isinstance(content, str) else content
    kind = F.schema_of_variant(content)
    s = strip_ws(F.try_variant_get(content, "$", "string"))
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(F.filter(parts, lambda p: _is_str(F.try_variant_get(p, "$.text", "variant"))),
                        lambda p: strip_ws(F.try_variant_get(p, "$.text", "string")))
    texts = F.filter(texts, lambda t: t != "")
    return (F.when(kind == "STRING", F.when(s != "", F.array(s)).otherwise(_empty()))
            .when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), texts).otherwise(_empty()))


def explode_texts(entries: DataFrame) -> DataFrame:
    """B2: one text item per extracted text: ``(session_id, line_no, pos, text)``."""
    return entries.select(S, "line_no", F.posexplode(extract_texts("content")).alias("pos", "text"))


def _parts(entries: DataFrame) -> DataFrame:
    return entries.select(S, "line_no", F.posexplode(F.try_variant_get("content", "$", "array<variant>"))
                          .alias("part_no", "p"))


def explode_tool_uses(entries: DataFrame) -> DataFrame:
    """``tool_use`` parts with string ``id`` and ``name``: ``(session_id, line_no, part_no, id, name, input)``.

    ``input`` is JSON text (null when missing).
    """
    p = _parts(entries)
    get = lambda path: F.try_variant_get("p", path, "variant")
    ok = (F.try_variant_get("p", "$.type", "string") == "tool_use") & _is_str(get("$.id")) & _is_str(get("$.name"))
    return p.where(ok).select(S, "line_no", "part_no",
                              F.try_variant_get("p", "$.id", "string").alias("id"),
                              F.try_variant_get("p", "$.name", "string").alias("name"),
                              F.to_json(get("$.input")).alias("input"))


def explode_tool_results(entries: DataFrame) -> DataFrame:
    """``tool_result`` parts with a string ``tool_use_id``; text = its texts joined by newline,
    first 2000 characters; ``is_error`` only if literally ``true``."""
    p = _parts(entries)
    get = lambda path: F.try_variant_get("p", path, "variant")
    ok = (F.try_variant_get("p", "$.type", "string") == "tool_result") & _is_str(get("$.tool_use_id"))
    text = F.substring(F.array_join(extract_texts(get("$.content")), "\n"), 1, C.MAX_TOOL_DOC_CHARS)
    err = F.coalesce((F.schema_of_variant(get("$.is_error")) == "BOOLEAN")
                     & F.try_variant_get("p", "$.is_error", "boolean"), F.lit(False))
    return p.where(ok).select(S, "line_no", "part_no", F.try_variant_get("p", "$.tool_use_id", "string").alias("tool_use_id"),
                              text.alias("text"), err.alias("is_error"))


def resolve_tool_calls(uses: DataFrame, results: DataFrame) -> DataFrame:
    """D1 (as-of, inner): each result takes the latest earlier use with its id in the session
    (an earlier part of the same line counts); orphans are dropped.

    Skew-safe: uses and results are unioned and scanned in blocks per
    ``(session, id)`` with the last use carried across blocks.
    """
    u = uses.select(S, F.col("id").alias("tool_use_id"), "line_no", "part_no",
                    F.struct("name", "input").alias("__use"), F.lit(None).cast("string").alias("text"),
                    F.lit(None).cast("boolean").alias("is_error"))
    r = results.select(S, "tool_use_id", "line_no", "part_no",
                       F.lit(None).cast("struct<name:string,input:string>").alias("__use"), "text", "is_error")
    both = u.unionByName(r).withColumn("__is_res", F.col("__use").isNull())
    found = last_before(both, [S, "tool_use_id"], "line_no", "__use", "__found", tiebreak=["part_no"])
    return (found.where(F.col("__is_res") & F.col("__found").isNotNull())
            .select(S, "line_no", "part_no", "tool_use_id", F.col("__found")["name"].alias("name"),
                    F.col("__found")["input"].alias("input"), "text", "is_error"))


def flatten_tool_parts(messages: DataFrame) -> DataFrame:
    """B8 (live dialect): ``messages(session_id, msg_no, info struct<role>, parts array<struct<type, callID,
    tool, state struct<status, input, output>>>)`` -> tool calls in message order with their turn.

    Tolerates null info/parts; keeps parts with ``type = 'tool'``, a string tool and a state.
    Turn = running count of user messages (every user message counts).
    """
    from sessionsift.operators.calls import assign_turns
    m = assign_turns(messages.withColumn("__user", F.coalesce(F.col("info.role") == "user", F.lit(False))),
                     F.col("__user"), order="msg_no")
    parts = m.select(S, "msg_no", "turn", F.posexplode_outer(F.coalesce("parts", F.array())).alias("part_no", "p"))
    ok = (F.col("p.type") == "tool") & F.col("p.tool").isNotNull() & F.col("p.state").isNotNull()
    return parts.where(ok).select(
        S, "msg_no", "part_no", "turn", F.col("p.callID").alias("call_id"), F.col("p.tool").alias("tool"),
        F.col("p.state.status").alias("status"), F.col("p.state.input").alias("input"), F.col("p.state.output").alias("output"))


def build_requests(contexts: DataFrame, default_query: str = C.DEFAULT_QUERY) -> DataFrame:
    """``contexts(session_id, pos, text, in_prompt, out_prompt, in_model, out_model, in_options,
    out_options)`` (one row per doc; session columns repeated) -> one request per session.

    Docs (the long table, filtered with ``~is_blank(text)``): non-blank strings kept untrimmed; size = Σ length; query =
    first non-empty of output prompt, input prompt, default; model = first
    non-empty of input model, output model, ''; options merged, output over input.
    """
    keep = contexts.where(~is_blank("text"))
    first = lambda c: F.first(F.col(c), ignorenulls=True)
    agg = contexts.groupBy(S).agg(first("in_prompt").alias("in_prompt"), first("out_prompt").alias("out_prompt"),
                                  first("in_model").alias("in_model"), first("out_model").alias("out_model"),
                                  first("in_options").alias("in_options"), first("out_options").alias("out_options"))
    # The docs stay a long table (session_id, pos, text); the request carries their count and size.
    docs = keep.groupBy(S).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).cast("bigint").alias("size"))
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    empty_map = F.create_map().cast("map<string,string>")
    return join_null_safe(agg, docs, [S], "left").select(
        S,
        F.coalesce(nz("in_model"), nz("out_model"), F.lit("")).alias("model"),
        F.coalesce(nz("out_prompt"), nz("in_prompt"), F.lit(default_query)).alias("query"),
        F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"),
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
        F.map_concat(F.map_filter(F.coalesce("in_options", empty_map),
                                  lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("out_options", empty_map)), k)),
                     F.coalesce("out_options", empty_map)).alias("options"),
    )

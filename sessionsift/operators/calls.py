"""Tool-call rules: F1 assign_turns, F2 dedupe_tool_results, F3 mark_superseded_outputs,
C2 drop_stale_errors, C3 mask_stale_error_inputs, B6/B7 helpers, E5 strategy_counts.

"Newest per key" and "last turn of the session" are aggregates joined back
(partial aggregation before the shuffle), not session-wide windows, so a hot
session or signature is never sorted in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.signature import INFINITE, finite_json, js_json
from sessionsift.functions.text import is_protected
from sessionsift.operators.ordered import join_null_safe, running_sum

S = "session_id"


def assign_turns(entries: DataFrame, is_user_turn: Column, order: str = "seq", out: str = "turn") -> DataFrame:
    """running count of user turns per session (inclusive, so a turn precedes its own tool parts).

    ``transcript`` dialect: pass ``type = 'user' AND size(texts) > 0``; ``live``: every user message.
    """
    return running_sum(entries, [S], order, F.when(is_user_turn, 1).otherwise(0), out)


def label_tool_docs(tool, text) -> Column:
    """``[tool NAME] text``."""
    return F.concat(F.lit("[tool "), F.col(tool) if isinstance(tool, str) else tool, F.lit("] "),
                    F.col(text) if isinstance(text, str) else text)


def dedupe_tool_results(items: DataFrame, order: str = "seq") -> DataFrame:
    """F2 (transcript dialect): non-protected tool results keep only the newest per signature.

    Errors count too; text items and protected tools are always kept.
    ``items`` needs ``kind, signature, protected`` and the order column.
    """
    cand = F.coalesce((F.col("kind") == "tool_result") & ~F.col("protected") & F.col("signature").isNotNull(), F.lit(False))
    newest = (items.where(cand).groupBy(S, "signature").agg(F.max(order).alias("__newest")))
    j = join_null_safe(items, newest, [S, "signature"], "left", large=True)
    keep = ~cand | (F.col(order) == F.col("__newest"))
    return j.where(keep).drop("__newest")


def last_turns(items: DataFrame, turn: str = "turn") -> DataFrame:
    return items.groupBy(S).agg(F.max(turn).alias("__last"))


def drop_stale_errors(items: DataFrame, n: int = C.PURGE_ERROR_TURNS, last: DataFrame | None = None) -> DataFrame:
    """Drop non-protected errored tool results at least ``n`` user turns old."""
    last = last if last is not None else last_turns(items)
    j = join_null_safe(items, last, [S], "left", large=True)
    stale = ((F.col("kind") == "tool_result") & ~F.col("protected") & F.col("is_error")
             & ((F.col("__last") - F.col("turn")) >= n))
    return j.where(~F.coalesce(stale, F.lit(False))).drop("__last")


def mark_superseded_outputs(calls: DataFrame, order: str = "seq") -> DataFrame:
    """F3 (live dialect): completed, non-protected, not yet marked calls; all but the newest per
    signature get the output marker.  Idempotent.  Adds ``superseded`` (changed by this pass).
    """
    elig = ((F.col("status") == "completed") & ~is_protected("tool")
            & (F.coalesce(F.col("output"), F.lit("")) != C.OUTPUT_MARKER))
    c = calls.withColumn("__elig", elig)
    newest = c.where("__elig").groupBy(S, "signature").agg(F.max(order).alias("__newest"))
    j = join_null_safe(c, newest, [S, "signature"], "left")
    sup = F.coalesce(F.col("__elig") & (F.col(order) < F.col("__newest")), F.lit(False))
    return (j.withColumn("superseded", sup)
            .withColumn("output", F.when(sup, F.lit(C.OUTPUT_MARKER)).otherwise(F.col("output")))
            .drop("__elig", "__newest"))


def _mask_json(raw: Column) -> tuple[Column, Column]:
    """Replace every top-level string value (not already the marker) by the marker.

    Returns (JSON text after masking, touched flag); what stays is printed as JavaScript prints it.
    Objects and arrays qualify; other inputs, also text after a JSON value, are left alone.
    """
    v = finite_json(raw)
    kind = F.schema_of_variant(v)
    m = v.cast("map<string,variant>")
    a = F.try_variant_get(v, "$", "array<variant>")

    def repl(x):
        is_s = F.schema_of_variant(x) == "STRING"
        hit = is_s & ~F.try_variant_get(x, "$", "string").isin(C.ERROR_INPUT_MARKER, INFINITE)
        return hit

    marker_json = F.lit(json.dumps(C.ERROR_INPUT_MARKER))
    obj_entries = F.transform(
        F.map_entries(m),
        lambda e: F.concat(F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"),
                           F.when(repl(e["value"]), marker_json).otherwise(F.to_json(e["value"]))))
    obj_json = F.concat(F.lit("{"), F.array_join(obj_entries, ","), F.lit("}"))
    arr_json = F.concat(F.lit("["), F.array_join(
        F.transform(a, lambda x: F.when(repl(x), marker_json).otherwise(F.coalesce(F.to_json(x), F.lit("null")))), ","),
        F.lit("]"))
    is_obj, is_arr = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    touched = (F.when(is_obj, F.exists(F.map_values(m), repl))
               .when(is_arr, F.exists(a, repl)).otherwise(F.lit(False)))
    out = F.when(is_obj, js_json(obj_json)).when(is_arr, js_json(arr_json)).otherwise(raw)
    return out, F.coalesce(touched, F.lit(False))


def mask_stale_error_inputs(calls: DataFrame, n: int = C.PURGE_ERROR_TURNS, last: DataFrame | None = None) -> DataFrame:
    """C3 (live dialect): errored, non-protected calls >= ``n`` user turns old get their string
    inputs masked; outputs are kept.  Adds ``masked`` (the call changed in this pass)."""
    last = last if last is not None else last_turns(calls)
    j = join_null_safe(calls, last, [S], "left")
    stale = (F.col("status") == "error") & ~is_protected("tool") & ((F.col("__last") - F.col("turn")) >= n)
    masked_json, touched = _mask_json(F.col("input"))
    hit = stale & touched
    return (j.withColumn("masked", F.coalesce(hit, F.lit(False)))
            .withColumn("input", F.when(hit, masked_json).otherwise(F.col("input")))
            .drop("__last"))


def strategy_counts(calls: DataFrame) -> DataFrame:
    """E5: per session, outputs superseded and inputs masked by one live pass."""
    return calls.groupBy(S).agg(F.count_if("superseded").alias("deduped"), F.count_if("masked").alias("purged_errors"))

"""The transcript hook pair as one plan over all sessions: transcripts -> docs -> optimized contexts, log and hand-off.

``precompact`` is A1's lines through H6, C4 and H5; ``run_precompact`` also commits its results as one batch to the
log (A5) and to the contexts (A7).  ``session_starts`` hands contexts out, once each (D4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import outcome_message
from sessionsift.operators.ordered import join_null_safe
from sessionsift.operators.params import resolve_params
from sessionsift.operators.results import consume_handoffs
from sessionsift.plans.optimize import optimize_context, transcripts_to_docs
from sessionsift.session import materialize
from sessionsift.sources.results_io import append_results, write_contexts
from sessionsift.sources.transcripts import read_transcripts

S = "session_id"
CLI = "claude-code"


def precompact(lines: DataFrame, events: DataFrame, stored: dict | None = None, env: dict | None = None, **plugins) -> DataFrame:
    """One result for each event: ``events(session_id, ts, trigger, custom_instructions, ingest_seq)``, at most one a
    session, ``lines(session_id, line_no, raw)`` the transcripts.

    A session whose documents are smaller than ``min_chars`` (request, environment, stored configuration or default)
    or that has no transcript is ``no_optimization``; a failing plug-in makes its session ``failed``.  Returns the
    event's columns, ``cli, ok, status, reason, initial_size, final_size, optimized_context, message``.
    """
    docs = transcripts_to_docs(join_null_safe(lines, events.select(S).distinct(), [S])).select(S, F.col("seq").alias("pos"), "text")
    asked = events.select(S, F.coalesce(F.nullif("custom_instructions", F.lit("")), F.lit(C.DEFAULT_QUERY)).alias("query"))
    result = optimize_context(materialize(docs), resolve_params(asked, stored, env), **plugins)
    out = join_null_safe(events.drop("custom_instructions"), result, [S])
    ok = F.col("status") != "failed"
    out = out.withColumn("cli", F.lit(CLI)).withColumn("ok", ok)
    size = lambda c: F.when(F.col("ok"), F.col(c))  # noqa: E731 - a failed run has none
    return out.withColumn("message", outcome_message(F.col("ok"), F.col("status"), F.col("reason"), F.when(~ok, F.col("reason")), size("initial_size"), size("final_size")))


def run_precompact(spark: SparkSession, transcripts: str, events: DataFrame, log: str, contexts: str, batch: str, **how) -> DataFrame:
    """Read transcripts, optimize the sessions of ``events`` and commit log rows and contexts under ``batch``: a
    repeated run adds nothing.  Returns the results."""
    results = materialize(precompact(read_transcripts(spark, transcripts), events, **how))
    append_results(results, log, batch=batch)
    write_contexts(results, contexts, batch=batch)
    return results


def session_starts(results: DataFrame, starts: DataFrame) -> DataFrame:
    """The context that each ``starts(session_id, ts, source, ingest_seq)`` with source ``compact`` receives: the
    newest of its session's ``results`` that no start before it has taken."""
    stores = results.where(F.col("ok") & (F.col("optimized_context") != "")).select(S, "ts", "ingest_seq", F.lit("store").alias("kind"), F.col("optimized_context").alias("body"))
    takes = starts.where("source = 'compact'").select(S, "ts", "ingest_seq", F.lit("consume").alias("kind"), F.lit(None).cast("string").alias("body"))
    return consume_handoffs(stores.unionByName(takes))

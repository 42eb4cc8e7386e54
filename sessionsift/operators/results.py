"""Results, savings and stats: E1 summarize_context, E2 savings, E3 stats_windows,
E4 stats_report, E6 collect_docs, I6 normalize_result, D4 consume_handoffs,
D5 apply_contexts, J3 first_warnings (batch form).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import js_round, outcome_message, parse_numeric, sanitize_session_key, strict_json
from sessionsift.operators.ordered import join_null_safe, last_before

S = "session_id"


# --------------------------------------------------------------------------- E1 / E6
def summarize_context(docs: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per session docs, Σ chars, query and model (with defaults)."""
    agg = docs.groupBy(S).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).cast("bigint").alias("size"))
    if requests is None:
        return agg.select("*", F.lit(C.DEFAULT_QUERY).alias("query"), F.lit("").alias("model"))
    return join_null_safe(agg, requests.select(S, "query", "model"), [S], "left").select(
        S, "docs", "size", F.coalesce(F.nullif("query", F.lit("")), F.lit(C.DEFAULT_QUERY)).alias("query"),
        F.coalesce("model", F.lit("")).alias("model"))


def collect_docs(docs: DataFrame, order: str = "pos") -> DataFrame:
    """Ordered ``array<string>`` per session (an edge format; use it on bounded lists, e.g. after F4)."""
    return docs.groupBy(S).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))),
                    lambda x: x["t"]).alias("docs"))


# --------------------------------------------------------------------------- E2
def savings(initial, result) -> tuple[Column, Column, Column]:
    """Clamped ``(initial, result, saved)``; missing or non-numeric -> 0."""
    i = F.greatest(F.lit(0.0), parse_numeric(initial, 0.0))
    r = F.greatest(F.lit(0.0), parse_numeric(result, 0.0))
    return i.cast("bigint"), r.cast("bigint"), F.greatest(F.lit(0.0), i - r).cast("bigint")


# --------------------------------------------------------------------------- E3 / E4
def stats_wide(log: DataFrame, now: str) -> DataFrame:
    """One row, five metrics for each of the six windows.

    ``log(ingest_seq, ts, session_id, initial_chars, result_chars, saved_chars)``.
    ``last`` = the final row in log order, ``session`` = that row's session,
    ``today`` = at/after the UTC midnight of ``now``, ``week``/``month`` =
    less than 7/30 days before ``now`` (future rows count), ``overall`` = all.
    A null timestamp counts only in last/session/overall.  One global
    aggregate, and one over the rows of the last row's session only.
    """
    now_ts = F.to_timestamp(F.lit(now))
    ts = F.col("ts").cast("timestamp")  # local (session zone) time, also for TIMESTAMP_NTZ input
    age_ms = (F.unix_micros(now_ts) - F.unix_micros(ts)) / 1000
    conds = {
        "today": ts >= F.date_trunc("day", now_ts),
        "week": age_ms < 7 * 86400000,
        "month": age_ms < 30 * 86400000,
        "overall": F.lit(True),
    }
    aggs = []
    for w, c in conds.items():
        c = F.coalesce(c, F.lit(False))
        aggs += [F.count_if(c).alias(f"{w}_compactions"),
                 F.sum(F.when(c, F.col("initial_chars")).otherwise(0)).cast("bigint").alias(f"{w}_initial_chars"),
                 F.sum(F.when(c, F.col("result_chars")).otherwise(0)).cast("bigint").alias(f"{w}_result_chars"),
                 F.sum(F.when(c, F.col("saved_chars")).otherwise(0)).cast("bigint").alias(f"{w}_saved_chars")]
    last = F.max_by(F.struct(S, "initial_chars", "result_chars", "saved_chars"), "ingest_seq")
    g = log.agg(*aggs, last.alias("__last"), F.count(F.lit(1)).alias("__n"))
    # one row: the session to look for, known before its rows are added up
    wanted = F.broadcast(log.agg(F.max_by(F.struct(S), "ingest_seq").alias("w")).select(f"w.{S}"))
    per_session = join_null_safe(log, wanted, [S], "inner").groupBy(S).agg(
        F.count(F.lit(1)).alias("session_compactions"),
        F.sum("initial_chars").cast("bigint").alias("session_initial_chars"),
        F.sum("result_chars").cast("bigint").alias("session_result_chars"),
        F.sum("saved_chars").cast("bigint").alias("session_saved_chars"))
    g = g.withColumn(S, F.col("__last")[S])
    out = join_null_safe(g, per_session, [S], "left")
    lst = F.col("__last")
    n = F.col("__n") > 0
    return out.select(
        F.when(n, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("last_compactions"),
        F.coalesce(lst["initial_chars"], F.lit(0)).cast("bigint").alias("last_initial_chars"),
        F.coalesce(lst["result_chars"], F.lit(0)).cast("bigint").alias("last_result_chars"),
        F.coalesce(lst["saved_chars"], F.lit(0)).cast("bigint").alias("last_saved_chars"),
        *[F.coalesce(F.col(f"session_{m}"), F.lit(0)).cast("bigint").alias(f"session_{m}")
          for m in ("compactions", "initial_chars", "result_chars", "saved_chars")],
        *[F.coalesce(F.col(f"{w}_{m}"), F.lit(0)).alias(f"{w}_{m}") for w in conds for m in ("compactions", "initial_chars", "result_chars", "saved_chars")],
    )


def _pct(saved: Column, initial: Column) -> Column:
    return F.when(initial > 0, js_round(saved.cast("double") / initial * 100)).otherwise(F.lit(0)).cast("bigint")


def stats_windows(log: DataFrame, now: str) -> DataFrame:
    """One row per window: ``(window, compactions, initial_chars, result_chars, saved_chars, saved_pct)``."""
    wide = stats_wide(log, now)
    rows = [F.struct(F.lit(w).alias("window"), F.col(f"{w}_compactions").alias("compactions"),
                     F.col(f"{w}_initial_chars").alias("initial_chars"), F.col(f"{w}_result_chars").alias("result_chars"),
                     F.col(f"{w}_saved_chars").alias("saved_chars"),
                     _pct(F.col(f"{w}_saved_chars"), F.col(f"{w}_initial_chars")).alias("saved_pct"))
            for w in C.STATS_WINDOWS]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stats_report(log: DataFrame, now: str) -> DataFrame:
    """One row per metric, one column per window; thousands separators and ``NN%``."""
    wide = stats_wide(log, now)
    fmt = lambda c: F.format_number(F.col(c), 0)
    names = ("compactions", "initial_chars", "result_chars", "saved_chars")
    rows = []
    for label, m in zip(C.STATS_METRICS[:4], names):
        rows.append(F.struct(F.lit(label).alias("metric"), *[fmt(f"{w}_{m}").alias(w) for w in C.STATS_WINDOWS]))
    rows.append(F.struct(F.lit(C.STATS_METRICS[4]).alias("metric"), *[
        F.concat(_pct(F.col(f"{w}_saved_chars"), F.col(f"{w}_initial_chars")).cast("string"), F.lit("%")).alias(w)
        for w in C.STATS_WINDOWS]))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# --------------------------------------------------------------------------- I6
def normalize_result(raw) -> Column:
    """Raw optimizer reply (JSON text) -> struct(ok, optimized_context, initial_size, final_size,
    status, reason, error_code, message)."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    v = strict_json(raw)
    g = lambda p, t="string": F.try_variant_get(v, p, t)
    nz = lambda c: F.nullif(c, F.lit(""))
    ok = F.coalesce(g("$.ok", "boolean"), F.lit(False))
    ctx = F.coalesce(g("$.optimized_context"), F.lit(""))
    return F.struct(
        ok.alias("ok"),
        F.when(ok, ctx).alias("optimized_context"),
        F.when(ok, g("$.initial_size", "bigint")).alias("initial_size"),
        F.when(ok, g("$.final_size", "bigint")).alias("final_size"),
        F.when(ok, F.coalesce(nz(g("$.status")), F.when(ctx != "", "optimized").otherwise("no_optimization")))
        .otherwise(F.lit("failed")).alias("status"),
        F.when(ok, F.coalesce(g("$.reason"), F.lit("")))
        .otherwise(F.coalesce(nz(g("$.reason")), nz(g("$.message")), F.lit("Unknown error"))).alias("reason"),
        F.when(~ok, F.coalesce(nz(g("$.error_code")), F.lit("runtime_error"))).alias("error_code"),
        F.when(~ok, F.coalesce(nz(g("$.message")), F.lit("Unknown error"))).alias("message"),
    )


# --------------------------------------------------------------------------- D4 / D5
def consume_handoffs(events: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """D4 (as-of, consume once): ``events(session_id, ingest_seq, ts, kind, body)`` with kind
    ``store`` / ``consume`` (others ignored).  A consume receives the latest stored body not yet
    consumed, i.e. iff the previous store/consume event of its session key is a store.

    Skew-safe previous-row lookup per sanitised key (block scan, see ``last_before``).
    """
    ev = (events.where(F.col("kind").isin("store", "consume"))
          .withColumn("key", sanitize_session_key(S))
          .withColumn("__ev", F.struct("kind", "body")))
    prev = last_before(ev, ["key"], order, "__ev", "__prev")
    got = prev.where((F.col("kind") == "consume") & (F.col("__prev")["kind"] == "store"))
    return got.select("key", order, "ts", F.concat(F.lit(C.OPTIMIZED_HEADER), F.col("__prev")["body"]).alias("context"))


def apply_contexts(contexts: DataFrame, results: DataFrame) -> DataFrame:
    """D5 (left outer, fail open): a non-empty optimized context replaces a session's docs with
    ``[outcome message, '## Optimized Context\\n\\n' + context]``; otherwise docs are untouched."""
    rep = results.where(F.coalesce(F.col("optimized_context"), F.lit("")) != "")
    msg = outcome_message(F.lit(True), F.col("status"), F.col("reason"), F.lit(None).cast("string"),
                          F.col("initial_size"), F.col("final_size"))
    new_docs = rep.select(S, F.posexplode(F.array(msg, F.concat(F.lit(C.OPTIMIZED_HEADER), F.col("optimized_context"))))
                          .alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))
    kept = join_null_safe(contexts.select(S, F.col("pos").cast("bigint"), "text"), rep.select(S, F.lit(True).alias("__new")).distinct(), [S], "left")
    kept = kept.where("__new IS NULL").drop("__new")
    return kept.unionByName(new_docs)


# --------------------------------------------------------------------------- J3 (batch)
def first_warnings(log: DataFrame, message: str = "message", order: str = "ingest_seq") -> DataFrame:
    """J3 (batch twin): first occurrence of each (session or ``global``, message)."""
    key = F.coalesce(F.nullif(F.col(S), F.lit("")), F.lit("global"))
    return (log.withColumn("warn_key", key).groupBy("warn_key", message)
            .agg(F.min(order).alias("first_seq")))


def latest_context(results: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Latest optimized context per sanitised session key (A7 body)."""
    return (results.withColumn("key", sanitize_session_key(S))
            .groupBy("key").agg(F.max_by(F.struct("ts", "optimized_context"), F.struct("ts", order)).alias("l"))
            .select("key", F.col("l.ts").alias("ts"), F.col("l.optimized_context").alias("context")))


def window_by_day(log: DataFrame, keys=("cli",)) -> DataFrame:
    """J4 (batch twin): per UTC day and cli, count and sums."""
    return (log.groupBy(F.window("ts", "1 day").alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("compactions"), F.sum("initial_chars").cast("bigint").alias("initial_chars"),
                 F.sum("result_chars").cast("bigint").alias("result_chars"),
                 F.sum("saved_chars").cast("bigint").alias("saved_chars"))
            .select(F.col("w.start").alias("day"), *keys, "compactions", "initial_chars", "result_chars", "saved_chars"))

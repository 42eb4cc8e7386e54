"""Driver queries for the streams (J1-J5): each runs over the events as a stream of at least five
micro-batches (``availableNow``), with late rows, and must end in the same state as its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.operators import rollups as RU
from sessionsift.operators.results import savings
from sessionsift.plans import fixtures as fx
from sessionsift.plans.queries_calls import _F3_SQL, _FROM_MESSAGES, _MASKED, PROT
from sessionsift.plans.queries_results import RES_SQL
from sessionsift.plans.registry import register
from sessionsift.session import scratch_dir
from sessionsift.streaming import live as LV
from sessionsift.streaming import stateful as ST
from sessionsift.streaming import windows as WN

S = "session_id"
W3 = fx.with_sql(fx.SQL_FX3)
W5 = fx.with_sql(fx.SQL_FX5, RES_SQL)


def _calls_stream(spark, sf):
    return fx.fx3_calls(spark, sf, with_turn=False, events=WN.events_stream(spark, sf))


def _log_stream(spark, sf, late=True):
    lg = fx.fx5_log(spark, sf, events=WN.events_stream(spark, sf, late=late))
    i, r, s = savings(F.col("initial_chars"), F.col("result_chars"))
    return lg.select("ingest_seq", "ts", S, "cli", "trigger", i.alias("initial_chars"), r.alias("result_chars"),
                     s.alias("saved_chars"), F.col("result_chars").alias("raw_result"))


@register("j1_stream_superseded", f"{W3}, {_F3_SQL} select session_id, call_id from f3 where superseded")
def j1(spark, sf):
    calls = _calls_stream(spark, sf).where(F.col("tool") != "USER")  # user messages are not calls
    return WN.run_to_parquet(ST.stream_superseded(calls), "superseded")


@register("j2_stream_stale_errors", f"""{W3},
lt as (select session_id, max(turn) as last from fx3 group by all)
select f.session_id, f.call_id from fx3 f join lt using (session_id)
where f.tool <> 'USER' and lower(f.tool) not in ({PROT}) and f.status = 'error' and lt.last - f.turn >= {C.PURGE_ERROR_TURNS}""")
def j2(spark, sf):
    return WN.run_to_parquet(ST.stream_stale_errors(_calls_stream(spark, sf)), "stale")


@register("j3_first_warnings_stream", f"""{W5}
select distinct coalesce(nullif(session_id, ''), 'global') as warn_key, trigger as message from fx5""")
def j3s(spark, sf):
    return WN.run_to_parquet(WN.first_warnings(_log_stream(spark, sf).withColumnRenamed("trigger", "message")), "warn")


def _streamed_days(spark, sf, days):
    """The log as a stream into an hourly rollup (every micro-batch adds its own sums), read by day."""
    path = scratch_dir(spark, "rollup")
    RU.stream_to_rollup(_log_stream(spark, sf), path, scratch_dir(spark, "rollup-checkpoint")).awaitTermination()
    return RU.savings_by_day(RU.read_rollup(spark, path), days)


@register("j4_stream_savings", f"""{W5}
select date_trunc('day', ts) as day, cli, count(*) as compactions, cast(sum(initial_chars) as bigint) as initial_chars,
       cast(sum(result_chars) as bigint) as result_chars, cast(sum(saved_chars) as bigint) as saved_chars
from lg group by all""")
def j4s(spark, sf):
    return _streamed_days(spark, sf, 1)


@register("j5_stream_handoffs", f"""{W5},
ev as (select regexp_replace(session_id, '[^A-Za-z0-9_.-]', '_', 'g') as key, ingest_seq, ts,
              case when trigger = 'purchase' and ok and optimized_context <> '' then 'store'
                   when trigger = 'click' then 'consume' else 'other' end as kind, optimized_context as body from res),
l as (select *, lag(kind) over (partition by key order by ingest_seq) as pk, lag(body) over (partition by key order by ingest_seq) as pb
      from ev where kind in ('store', 'consume'))
select key, ingest_seq, ts, concat('## Optimized Context', chr(10), chr(10), pb) as context from l where kind = 'consume' and pk = 'store'""")
def j5(spark, sf):
    lg = _log_stream(spark, sf, late=False)  # ingest_seq is given on arrival: hand-offs come in its order
    body = F.when(F.col("raw_result") > 0, F.concat(F.lit("ctx "), F.col("ingest_seq").cast("string"))).otherwise(F.lit(""))
    kind = (F.when((F.col("trigger") == "purchase") & (body != ""), "store")
            .when(F.col("trigger") == "click", "consume").otherwise("other"))
    ev = lg.select(S, "ingest_seq", "ts", kind.alias("kind"), body.alias("body"))
    return WN.run_to_parquet(ST.stream_handoffs(ev), "handoffs")


@register("j4_stream_savings_sliding", f"""{W5},
x as (select date_trunc('day', ts) - to_days(k) as day, cli, initial_chars, result_chars, saved_chars
      from lg, (select unnest(range(0, 7)) as k) ks)
select day, cli, count(*) as compactions, cast(sum(initial_chars) as bigint) as initial_chars,
       cast(sum(result_chars) as bigint) as result_chars, cast(sum(saved_chars) as bigint) as saved_chars
from x group by all""")
def j4w(spark, sf):
    """Trailing 7-day savings per cli, sliding by a day (window start in ``day``)."""
    return _streamed_days(spark, sf, 7)


# --------------------------------------------------------------------------- H7 as one stream
def _live_log(spark, sf):
    """The change log of the messages as a stream of five micro-batches with late rows; and the messages."""
    from sessionsift.plans.queries_requests import _messages
    changes = LV.run_live(LV.live_changes(_messages(spark, sf, events=WN.events_stream(spark, sf))))
    return _messages(spark, sf), changes


@register("h7_live_stream", f"""{W3}, {_FROM_MESSAGES},
d as (select session_id, seq, case when superseded then '{C.OUTPUT_MARKER}' else output end as output, {_MASKED} as input from c3)
select f.session_id, f.seq as msg_no, coalesce(d.output, f.output) as output, coalesce(d.input, f.input) as input
from fx3 f left join d using (session_id, seq) where f.tool <> 'USER' and f.seq % 23 <> 0""")
def h7_stream(spark, sf):
    """The live pass as one stream: messages after the last micro-batch."""
    out, _ = LV.rewritten_messages(*_live_log(spark, sf))
    p = out.select(S, "msg_no", F.explode("parts").alias("p")).where("p.state IS NOT NULL")
    return p.select(S, "msg_no", "p.state.output", "p.state.input")


@register("h7_live_stream_counts", f"""{W3}, {_FROM_MESSAGES}
select session_id, count(*) filter (where superseded) as deduped, count(*) filter (where masked) as purged_errors
from c3 group by all""")
def h7_stream_counts(spark, sf):
    """Changed parts of each session, from the stream's log."""
    return LV.rewritten_messages(*_live_log(spark, sf))[1]

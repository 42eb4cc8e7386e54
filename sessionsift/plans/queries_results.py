"""Driver queries for results, savings, stats and hand-offs on FX5 (and FX2 for D5/E1/E6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import outcome_message, sanitize_log_field, sanitize_session_key, size_summary
from sessionsift.operators import results as R
from sessionsift.plans import fixtures as fx
from sessionsift.plans.registry import register
from sessionsift.session import scratch_dir
from sessionsift.sources import results_io as IO

S = "session_id"
NOW = fx.STATS_NOW
RES_SQL = """res as (
  select *, trigger <> 'error' as ok,
         case when result_chars > 0 then concat('ctx ', cast(ingest_seq as varchar)) else '' end as optimized_context,
         initial_chars as initial_size, result_chars as final_size from fx5),
lg as (select ingest_seq, ts, session_id, cli, trigger, greatest(0, initial_chars) as initial_chars,
              greatest(0, result_chars) as result_chars,
              greatest(0, greatest(0, initial_chars) - greatest(0, result_chars)) as saved_chars from fx5)"""
W5 = fx.with_sql(fx.SQL_FX5, RES_SQL)
W2 = fx.with_sql(fx.SQL_FX2)


def _results(spark, sf):
    lg = fx.fx5_log(spark, sf)
    return lg.select("*", (F.col("trigger") != "error").alias("ok"),
                     F.when(F.col("result_chars") > 0, F.concat(F.lit("ctx "), F.col("ingest_seq").cast("string")))
                     .otherwise(F.lit("")).alias("optimized_context"),
                     F.col("initial_chars").alias("initial_size"), F.col("result_chars").alias("final_size"))


def _log(spark, sf):
    lg = fx.fx5_log(spark, sf)
    i, r, s = R.savings(F.col("initial_chars"), F.col("result_chars"))
    return lg.select("ingest_seq", "ts", S, "cli", "trigger", i.alias("initial_chars"), r.alias("result_chars"),
                     s.alias("saved_chars"))


@register("a5_append_results", f"""{W5}
select ts, cli, session_id, trigger, greatest(0, initial_size) as initial_chars, greatest(0, final_size) as result_chars,
       greatest(0, greatest(0, initial_size) - greatest(0, final_size)) as saved_chars, ingest_seq
from res where ok and optimized_context <> ''""")
def a5(spark, sf):
    path = scratch_dir(spark, "results")
    IO.append_results(_results(spark, sf), path)
    return spark.read.parquet(path).drop("day")


@register("a5_committed_log", f"""{W5}
select ts, cli, session_id, trigger, greatest(0, initial_size) as initial_chars, greatest(0, final_size) as result_chars,
       greatest(0, greatest(0, initial_size) - greatest(0, final_size)) as saved_chars, ingest_seq
from res where ok and optimized_context <> ''""")
def a5_committed(spark, sf):
    """The log in three batches, one of which is written again: each row once."""
    path, rows = scratch_dir(spark, "results"), _results(spark, sf)
    for batch in (0, 1, 1, 2, 0):
        IO.append_results(rows.where(F.col("ingest_seq") % 3 == batch), path, batch=f"batch {batch}")
    return IO.read_log(spark, path).drop("day")


@register("a6_read_results", f"""{W5}
select date_trunc('millisecond', ts) as ts, cli, session_id, trigger,
       cast(case when ingest_seq % 17 = 0 then 0 when ingest_seq % 13 = 0 then initial_chars
                 when ingest_seq % 11 = 0 then initial_chars + 0.5 else initial_chars end as double) as initial_chars,
       cast(result_chars as double) as result_chars, cast(saved_chars as double) as saved_chars
from lg""")
def a6(spark, sf):
    """Round trip through a CSV log with damaged fields: a numeric prefix ('654abc'), fractions, missing numbers."""
    lg = _log(spark, sf)
    dirty = F.when(F.col("ingest_seq") % 17 == 0, F.lit(None).cast("string")) \
        .when(F.col("ingest_seq") % 13 == 0, F.concat(F.col("initial_chars").cast("string"), F.lit("abc"))) \
        .when(F.col("ingest_seq") % 11 == 0, F.concat(F.col("initial_chars").cast("string"), F.lit(".5"))) \
        .otherwise(F.col("initial_chars").cast("string"))
    path = scratch_dir(spark, "results-csv")
    (lg.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "cli", S, "trigger",
               dirty.alias("initial_chars"), "result_chars", "saved_chars")
     .write.option("header", True).csv(path))
    return IO.read_results(spark, path)


@register("a7_write_contexts", f"""{W5},
k as (select regexp_replace(session_id, '[^A-Za-z0-9_.-]', '_', 'g') as key, ts, optimized_context, ingest_seq
      from res where ok and optimized_context <> ''),
r as (select *, row_number() over (partition by key order by ts desc, ingest_seq desc) as rn from k)
select key, ts, optimized_context as context from r where rn = 1""")
def a7(spark, sf):
    path = scratch_dir(spark, "contexts")
    IO.write_contexts(_results(spark, sf), path)
    return IO.read_contexts(spark, path)


@register("a7_compacted_contexts", f"""{W5},
k as (select regexp_replace(session_id, '[^A-Za-z0-9_.-]', '_', 'g') as key, ts, optimized_context, ingest_seq, ingest_seq % 3 as batch
      from res where ok and optimized_context <> ''),
r as (select *, row_number() over (partition by key order by batch desc, ts desc, ingest_seq desc) as rn from k)
select key, ts, optimized_context as context from r where rn = 1""")
def a7_compacted(spark, sf):
    """Contexts as a base with deltas: two deltas, compaction, another delta, which replaces what the base has."""
    path, rows = scratch_dir(spark, "contexts"), _results(spark, sf)
    for batch in (0, 1, 2):
        IO.write_contexts(rows.where(F.col("ingest_seq") % 3 == batch), path, batch=f"{batch}")
        if batch == 1:
            IO.compact_contexts(spark, path)
    return IO.read_contexts(spark, path)


@register("b11_sanitize", f"""{W5}
select ingest_seq, regexp_replace(session_id, '[^A-Za-z0-9_.-]', '_', 'g') as session_key,
       regexp_replace(session_id, '[",\\r\\n]', '_', 'g') as log_session, regexp_replace(cli, '[",\\r\\n]', '_', 'g') as log_cli
from fx5""")
def b11(spark, sf):
    lg = fx.fx5_log(spark, sf)
    return lg.select("ingest_seq", sanitize_session_key(S).alias("session_key"),
                     sanitize_log_field(S, empty="global").alias("log_session"), sanitize_log_field("cli").alias("log_cli"))


def _handoff_events(spark, sf):
    r = _results(spark, sf)
    kind = (F.when((F.col("trigger") == "purchase") & F.col("ok") & (F.col("optimized_context") != ""), "store")
            .when(F.col("trigger") == "click", "consume").otherwise("other"))
    return r.select(S, "ingest_seq", "ts", kind.alias("kind"), F.col("optimized_context").alias("body"))


@register("d4_consume_handoffs", f"""{W5},
ev as (select regexp_replace(session_id, '[^A-Za-z0-9_.-]', '_', 'g') as key, ingest_seq, ts,
              case when trigger = 'purchase' and ok and optimized_context <> '' then 'store'
                   when trigger = 'click' then 'consume' else 'other' end as kind, optimized_context as body from res),
l as (select *, lag(kind) over (partition by key order by ingest_seq) as pk, lag(body) over (partition by key order by ingest_seq) as pb
      from ev where kind in ('store', 'consume'))
select key, ingest_seq, ts, concat('## Optimized Context', chr(10), chr(10), pb) as context from l where kind = 'consume' and pk = 'store'""")
def d4(spark, sf):
    return R.consume_handoffs(_handoff_events(spark, sf))


def _conv_results(spark, sf):
    c = fx.read(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t0"), F.sum(F.length("text")).cast("bigint").alias("i"))
    opt = F.when(F.col("conv_id") % 4 != 0, F.col("t0")).otherwise(F.lit(""))
    return g.select(F.col("conv_id").cast("string").alias(S), opt.alias("optimized_context"),
                    F.col("i").alias("initial_size"), F.length(opt).cast("bigint").alias("final_size"),
                    F.lit("optimized").alias("status"), F.lit("").alias("reason"))


_MSG_SQL = (f"concat('{C.MSG_PREFIX}optimized context emitted. Initial size: ', i, ' chars, final size: ', f, "
            "' chars, saved: ', i - f, ' chars (', case when i > 0 then cast(floor((i - f) / i * 100 + 0.5) as bigint) else 0 end, '%)')")


@register("d5_apply_contexts", f"""{W2},
cr as (select cast(conv_id as varchar) as session_id,
              case when conv_id % 4 <> 0 then min_by(text, turn) else '' end as opt,
              sum(length(text)) as i from conversations group by conv_id),
cr2 as (select *, length(opt) as f from cr)
select session_id, cast(pos as bigint) as pos, text from fx2 where session_id in (select session_id from cr2 where opt = '')
union all select session_id, 0, {_MSG_SQL} from cr2 where opt <> ''
union all select session_id, 1, concat('## Optimized Context', chr(10), chr(10), opt) from cr2 where opt <> ''""")
def d5(spark, sf):
    return R.apply_contexts(fx.fx2_docs(spark, sf).select(S, "pos", "text"), _conv_results(spark, sf))


@register("e1_summarize_context", f"""{W2}
select f.session_id, count(*) as docs, sum(length(f.text)) as size, r.query, r.model
from fx2 f join fx2_req r using (session_id) group by f.session_id, r.query, r.model""")
def e1(spark, sf):
    return R.summarize_context(fx.fx2_docs(spark, sf), fx.fx2_requests(spark, sf))


@register("e2_savings", f"{W5} select ingest_seq, initial_chars, result_chars, saved_chars from lg")
def e2(spark, sf):
    return _log(spark, sf).select("ingest_seq", "initial_chars", "result_chars", "saved_chars")


_E3_SQL = f"""lastrow as (select * from lg order by ingest_seq desc limit 1),
sel as (
  select 'last' as "window", l.* from lg l where ingest_seq = (select ingest_seq from lastrow)
  union all select 'session', l.* from lg l where session_id = (select session_id from lastrow)
  union all select 'today', l.* from lg l where ts >= date_trunc('day', timestamp '{NOW}')
  union all select 'week', l.* from lg l where (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 1000.0 < 7 * 86400000::bigint
  union all select 'month', l.* from lg l where (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 1000.0 < 30 * 86400000::bigint
  union all select 'overall', l.* from lg l),
wins as (select * from (values ('last'), ('session'), ('today'), ('week'), ('month'), ('overall')) v("window")),
agg as (
  select w."window", cast(count(s.ingest_seq) as bigint) as compactions,
         cast(coalesce(sum(s.initial_chars), 0) as bigint) as initial_chars,
         cast(coalesce(sum(s.result_chars), 0) as bigint) as result_chars,
         cast(coalesce(sum(s.saved_chars), 0) as bigint) as saved_chars
  from wins w left join sel s on s."window" = w."window" group by w."window"),
st as (select *, cast(case when initial_chars > 0 then floor(saved_chars / initial_chars * 100 + 0.5) else 0 end as bigint) as saved_pct from agg)"""


@register("e3_stats_windows", f"{W5}, {_E3_SQL} select * from st")
def e3(spark, sf):
    return R.stats_windows(_log(spark, sf), NOW)


@register("e3_stats_from_rollup", f"{W5}, {_E3_SQL} select * from st")
def e3_rollup(spark, sf):
    """The six windows from an hourly rollup of three batches (one of them added twice, two compacted) and the rows
    of two edge hours."""
    from sessionsift.operators import rollups as RU
    path, log = scratch_dir(spark, "rollup"), _log(spark, sf)
    for batch in (0, 1, 0, 2):
        RU.add_to_rollup(log.where(F.col("ingest_seq") % 3 == batch), path, f"{batch}")
        if batch == 1:
            RU.compact_rollup(spark, path)
    return RU.stats_from_rollup(RU.read_rollup(spark, path), log, NOW)


def _pivot(metric_sql: str, label: str) -> str:
    cols = ", ".join(f"max(case when \"window\" = '{w}' then {metric_sql} end) as \"{w}\"" for w in C.STATS_WINDOWS)
    return f"select '{label}' as metric, {cols} from st"


@register("e4_stats_report", f"""{W5}, {_E3_SQL}
{' union all '.join([_pivot("format('{:,}', " + m + ")", lab) for lab, m in zip(C.STATS_METRICS[:4], ('compactions', 'initial_chars', 'result_chars', 'saved_chars'))] + [_pivot("concat(saved_pct, '%')", C.STATS_METRICS[4])])}""")
def e4(spark, sf):
    return R.stats_report(_log(spark, sf), NOW)


@register("e6_collect_docs", f"""{W2}
select session_id, cast(count(*) as bigint) as n_docs, string_agg(text, chr(31) order by pos) as docs_text from fx2
group by session_id""")
def e6(spark, sf):
    c = R.collect_docs(fx.fx2_docs(spark, sf))
    return c.select(S, F.size("docs").cast("bigint").alias("n_docs"), F.array_join("docs", chr(31)).alias("docs_text"))


def _sized(spark, sf):
    r = _results(spark, sf)
    return r.withColumn("initial_size", F.when(F.col("ingest_seq") % 11 == 0, F.lit(None)).otherwise(F.col("initial_size")))


_SUMMARY = ("case when i is null then '' else concat('Initial size: ', i, ' chars, final size: ', f, ' chars, saved: ', i - f, "
            "' chars (', case when i > 0 then cast(floor((i - f) / i * 100 + 0.5) as bigint) else 0 end, '%)') end")
SIZED = "sz as (select ingest_seq, trigger, case when ingest_seq % 11 = 0 then null else initial_size end as i, final_size as f from res)"


@register("i2_size_summary", f"{W5}, {SIZED} select ingest_seq, {_SUMMARY} as summary from sz")
def i2(spark, sf):
    return _sized(spark, sf).select("ingest_seq", size_summary("initial_size", "final_size").alias("summary"))


@register("i5_outcome_message", f"""{W5}, {SIZED}
select ingest_seq, case
  when i is not null then concat('{C.MSG_PREFIX}optimized context emitted. ', {_SUMMARY})
  when trigger = 'view' then '{C.MSG_PREFIX}no optimization applied: the optimizer found no safer or smaller replacement for the current context.'
  when trigger = 'error' then '{C.MSG_PREFIX}optimization skipped: slow'
  else '{C.MSG_PREFIX}optimization completed, but savings summary was unavailable because size metadata was missing or non-numeric. (initial_size=undefined)'
  end as message from sz""")
def i5(spark, sf):
    r = _sized(spark, sf)
    status = (F.when(F.col("trigger") == "error", "failed").when(F.col("trigger") == "view", "no_optimization")
              .otherwise("optimized"))
    return r.select("ingest_seq", outcome_message(F.col("ok"), status, F.lit(""), F.lit("slow"), F.col("initial_size"),
                                                  F.col("final_size")).alias("message"))


@register("i6_normalize_result", f"""{W5}
select ingest_seq, ok, case when ok then optimized_context end as optimized_context,
       case when ok then initial_size end as initial_size, case when ok then final_size end as final_size,
       case when not ok then 'failed' when optimized_context <> '' then 'optimized' else 'no_optimization' end as status,
       case when ok then '' else 'slow' end as reason, case when not ok then 'runtime_error' end as error_code,
       case when not ok then 'slow' end as message
from res""")
def i6(spark, sf):
    r = _results(spark, sf)
    raw = F.when(F.col("ok"), F.to_json(F.struct(F.lit(True).alias("ok"), "optimized_context", "initial_size", "final_size"))) \
        .otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), F.lit("slow").alias("message"))))
    return r.select("ingest_seq", R.normalize_result(raw).alias("n")).select("ingest_seq", "n.*")


@register("j3_first_warnings", f"""{W5}
select coalesce(nullif(session_id, ''), 'global') as warn_key, trigger as message, min(ingest_seq) as first_seq
from fx5 group by all""")
def j3(spark, sf):
    return R.first_warnings(fx.fx5_log(spark, sf).withColumnRenamed("trigger", "message"))


@register("j4_savings_by_day", f"""{W5}
select date_trunc('day', ts) as day, cli, count(*) as compactions, cast(sum(initial_chars) as bigint) as initial_chars,
       cast(sum(result_chars) as bigint) as result_chars, cast(sum(saved_chars) as bigint) as saved_chars
from lg group by all""")
def j4(spark, sf):
    return R.window_by_day(_log(spark, sf))

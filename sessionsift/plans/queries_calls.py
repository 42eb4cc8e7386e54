"""Driver queries for the tool-call rules on FX3."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.signature import tool_signature
from sessionsift.functions.text import is_protected
from sessionsift.operators import calls as K
from sessionsift.plans import fixtures as fx
from sessionsift.plans.optimize import optimize_live
from sessionsift.plans.registry import register

S = "session_id"
PROT = ", ".join(f"'{t}'" for t in C.PROTECTED_TOOLS)
W = fx.with_sql(fx.SQL_FX3)
SIG = "concat(tool, '::', cast(json(input) as varchar))"


def _items(spark, sf):
    """Transcript-dialect items from FX3: USER rows are text items, the rest tool results."""
    c = fx.fx3_calls(spark, sf)
    return c.select(S, "seq", "turn", "tool",
                    F.when(F.col("tool") == "USER", "text").otherwise("tool_result").alias("kind"),
                    F.when(F.col("tool") != "USER", tool_signature("tool", "input")).alias("signature"),
                    (is_protected("tool") & (F.col("tool") != "USER")).alias("protected"),
                    (F.col("status") == "error").alias("is_error"))


def _live(spark, sf):
    """Live-dialect call table: FX3 without the user rows, plus the session's final turn count."""
    c = fx.fx3_calls(spark, sf)
    # The final turn count is the number of user messages: a plain partial aggregate.
    last = (fx.fx3_calls(spark, sf, with_turn=False).groupBy(S)
            .agg(F.count_if(F.col("tool") == "USER").cast("bigint").alias("__last")))
    calls = c.where(F.col("tool") != "USER").withColumn("signature", tool_signature("tool", "input"))
    return calls, last


@register("b5_tool_signature", f"{W} select session_id, seq, {SIG} as signature from fx3")
def b5(spark, sf):
    c = fx.fx3_calls(spark, sf, with_turn=False)
    return c.select(S, "seq", tool_signature("tool", "input").alias("signature"))


@register("b6_is_protected", f"{W} select session_id, seq, tool, lower(tool) in ({PROT}) as protected from fx3")
def b6(spark, sf):
    c = fx.fx3_calls(spark, sf, with_turn=False)
    return c.select(S, "seq", "tool", is_protected("tool").alias("protected"))


@register("b7_label_tool_docs", f"{W} select session_id, seq, concat('[tool ', tool, '] ', output) as text from fx3 where tool <> 'USER'")
def b7(spark, sf):
    c = fx.fx3_calls(spark, sf, with_turn=False).where(F.col("tool") != "USER")
    return c.select(S, "seq", K.label_tool_docs("tool", "output").alias("text"))


@register("f1_assign_turns", f"{W} select session_id, seq, turn from fx3")
def f1(spark, sf):
    c = fx.fx3_calls(spark, sf, with_turn=False)
    return K.assign_turns(c, F.col("tool") == "USER").select(S, "seq", "turn")


@register("f2_dedupe_tool_results", f"""{W},
it as (select *, tool <> 'USER' and lower(tool) not in ({PROT}) as cand, {SIG} as sig from fx3),
nw as (select session_id, sig, max(seq) as newest from it where cand group by all)
select it.session_id, it.seq from it left join nw using (session_id, sig) where not it.cand or it.seq = nw.newest""")
def f2(spark, sf):
    return K.dedupe_tool_results(_items(spark, sf)).select(S, "seq")


@register("c2_drop_stale_errors", f"""{W},
lt as (select session_id, max(turn) as last from fx3 group by all)
select f.session_id, f.seq from fx3 f join lt using (session_id)
where not (f.tool <> 'USER' and lower(f.tool) not in ({PROT}) and f.status = 'error' and lt.last - f.turn >= {C.PURGE_ERROR_TURNS})""")
def c2(spark, sf):
    return K.drop_stale_errors(_items(spark, sf)).select(S, "seq")


_F3_SQL = f"""it as (select *, status = 'completed' and lower(tool) not in ({PROT}) and output <> '{C.OUTPUT_MARKER}' as elig,
                   {SIG} as sig from fx3 where tool <> 'USER'),
nw as (select session_id, sig, max(seq) as newest from it where elig group by all),
f3 as (select it.*, coalesce(it.elig and it.seq < nw.newest, false) as superseded from it left join nw using (session_id, sig)),
lt as (select session_id, max(turn) as last from fx3 group by all),
c3 as (select f3.*, status = 'error' and lower(tool) not in ({PROT}) and lt.last - turn >= {C.PURGE_ERROR_TURNS} as masked
       from f3 join lt using (session_id))"""


@register("f3_mark_superseded_outputs", f"""{W}, {_F3_SQL}
select session_id, seq, case when superseded then '{C.OUTPUT_MARKER}' else output end as output, superseded from f3""")
def f3(spark, sf):
    calls, _ = _live(spark, sf)
    return K.mark_superseded_outputs(calls).select(S, "seq", "output", "superseded")


_MASKED = (f"""case when masked then concat('{{"cmd":"{C.ERROR_INPUT_MARKER}","k":', regexp_extract(input, '"k": ([0-9]+)', 1), '}}')
               else input end""")


@register("c3_mask_stale_error_inputs", f"""{W}, {_F3_SQL}
select session_id, seq, {_MASKED} as input, masked from c3""")
def c3(spark, sf):
    calls, last = _live(spark, sf)
    return K.mask_stale_error_inputs(calls, last=last).select(S, "seq", "input", "masked")


@register("e5_strategy_counts", f"""{W}, {_F3_SQL}
select session_id, count(*) filter (where superseded) as deduped, count(*) filter (where masked) as purged_errors
from c3 group by all""")
def e5(spark, sf):
    calls, last = _live(spark, sf)
    done = K.mask_stale_error_inputs(K.mark_superseded_outputs(calls), last=last)
    return K.strategy_counts(done)


@register("h7_optimize_live", f"""{W}, {_F3_SQL}
select session_id, seq, case when superseded then '{C.OUTPUT_MARKER}' else output end as output,
       {_MASKED} as input from c3""")
def h7(spark, sf):
    calls, last = _live(spark, sf)
    return optimize_live(calls, last).select(S, "seq", "output", "input")


_FROM_MESSAGES = _F3_SQL.replace("where tool <> 'USER')", "where tool <> 'USER' and seq % 23 <> 0 and seq % 31 <> 0)")


@register("h7_optimize_messages", f"""{W}, {_FROM_MESSAGES},
d as (select session_id, seq, case when superseded then '{C.OUTPUT_MARKER}' else output end as output, {_MASKED} as input from c3)
select f.session_id, f.seq as msg_no, coalesce(d.output, f.output) as output, coalesce(d.input, f.input) as input
from fx3 f left join d using (session_id, seq) where f.tool <> 'USER' and f.seq % 23 <> 0""")
def h7_messages(spark, sf):
    """The live pass from messages: parts that are no tool calls stay as they are."""
    from sessionsift.plans.optimize import optimize_messages
    from sessionsift.plans.queries_requests import _messages
    out, _ = optimize_messages(_messages(spark, sf))
    p = out.select(S, "msg_no", F.explode("parts").alias("p")).where("p.state IS NOT NULL")
    return p.select(S, "msg_no", "p.state.output", "p.state.input")

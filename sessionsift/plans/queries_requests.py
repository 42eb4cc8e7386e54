"""Driver queries for requests and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.operators import extract as X
from sessionsift.operators.params import apply_model_limits, resolve_params, validate_overrides
from sessionsift.plans import fixtures as fx
from sessionsift.plans import oracle_h5 as O
from sessionsift.plans.optimize import optimize_context, optimize_requests
from sessionsift.plans.registry import register
from sessionsift.session import scratch_dir
from sessionsift.sources.requests import read_requests, validate_requests

S = "session_id"


def _request_lines(spark, sf):
    """One JSON request per FX1 doc (request_id = source:doc_id); every fifth kind is malformed on purpose."""
    d = fx.fx1_docs(spark, sf)
    rid = F.concat(F.col(S), F.lit(":"), F.col("pos").cast("string"))
    head = F.concat(F.lit('{"request_id":'), F.regexp_replace(F.to_json(F.array(rid)), r"^\[|\]$", ""))
    one = F.to_json(F.array("text"))
    k = F.col("pos") % 5
    raw = (F.when(k == 0, F.lit("{broken"))
           .when(k == 1, F.concat(head, F.lit(',"query":"q","docs":"one text"}')))
           .when(k == 2, F.concat(head, F.lit(',"docs":'), F.regexp_replace(one, r"\]$", ",123,null]"), F.lit("}")))
           .when(k == 3, F.concat(head, F.lit(',"docs":[]}')))
           .otherwise(F.concat(head, F.lit(',"query":"engine parts","docs":'), one, F.lit(',"options":{"min_input_size":100}}'))))
    return d.select(raw.alias("value"))


def _requests(spark, sf):
    path = scratch_dir(spark, "requests")
    _request_lines(spark, sf).write.text(path)
    return read_requests(spark, path)


_A_SQL = f"""with {fx.SQL_FX1}, rq as (select concat(session_id, ':', pos) as request_id, pos % 5 as k, text from fx1)"""


@register("a3_read_requests", f"""{_A_SQL}
select request_id, case when k = 1 then 'q' when k = 4 then 'engine parts' else '' end as query,
       case when k = 4 then 100 end as min_input_size from rq where k <> 0""")
def a3(spark, sf):
    r = _requests(spark, sf).where(F.col("payload").isNotNull())
    return r.select("request_id", "query", F.col("options")["min_input_size"].cast("int").alias("min_input_size"))


@register("a4_validate_requests", f"""{_A_SQL}
select case when k = 0 then null else request_id end as request_id,
       case k when 0 then 'invalid_input' when 1 then 'invalid_input' when 2 then 'invalid_input'
              when 3 then 'no_optimization' else 'run' end as status,
       case when k in (0, 1, 2) then 'invalid_input' end as error_code,
       case k when 0 then 'invalid JSON payload' when 1 then 'docs must be a list of strings'
              when 2 then 'docs must contain strings only' when 3 then '{C.REASON_NO_DOCS}' else '' end as reason,
       cast(case when k = 4 then 1 else 0 end as bigint) as n_docs,
       cast(case when k = 4 then length(text) else 0 end as bigint) as initial_size
from rq""")
def a4(spark, sf):
    v = validate_requests(_requests(spark, sf))
    return v.select("request_id", "status", "error_code", "reason", "n_docs", "initial_size")


def _payload_lines(spark, sf):
    """One payload per conversation, of every kind: junk after the JSON, a blank line, docs that are no list or hold
    other values, no docs, an integer and a text ``min_input_size``, an unknown option, plain requests."""
    d = fx.fx2_docs(spark, sf)
    kind = F.col(S).cast("bigint") % 9
    docs = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]))
    c = d.groupBy(S).agg(docs.alias("docs")).join(fx.fx2_requests(spark, sf).select(S, "query"), S)
    text = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    cid = F.col(S).cast("bigint") % 4  # three of four payloads have no id of their own
    request_id = F.when(cid == 0, "").when(cid == 1, '"request_id":null,').when(cid == 2, '"request_id":"shared",').otherwise(F.concat(F.lit('"request_id":'), text(S), F.lit(",")))

    def payload(docs, options):
        return F.concat(F.lit("{"), request_id, F.lit('"query":'), text("query"), F.lit(',"docs":'), docs, F.lit(',"options":' + options + "}"))
    all_docs = F.col("docs")
    raw = (F.when(kind == 0, F.concat(payload(all_docs, "{}"), F.lit(" junk")))
           .when(kind == 1, F.lit("  "))
           .when(kind == 2, payload(F.lit('{"a":1}'), "{}"))
           .when(kind == 3, payload(F.regexp_replace(all_docs, r"\]$", ",7]"), "{}"))
           .when(kind == 4, payload(F.lit("[]"), "{}"))
           .when(kind == 5, payload(all_docs, '{"min_input_size":3000,"max_chunks":2}'))
           .when(kind == 6, payload(all_docs, '{"min_input_size":"3000"}'))
           .when(kind == 7, payload(all_docs, '{"max_chunk":2}'))
           .otherwise(payload(all_docs, '{"total_prune_budget_chars":1500}')))
    return c.select(raw.alias("value"))


_H5_REQ = f"""fx2_kind as (select *, cast(session_id as bigint) % 9 as kind from fx2_req),
req as (
  select session_id, coalesce(query, '') as query, cast(case when kind = 5 then 3000 else 0 end as bigint) as min_input_size,
         case when kind = 5 then 2 else {C.DEFAULT_MAX_CHUNKS} end as max_chunks,
         cast(case when kind = 8 then 1500 else {C.DEFAULT_PRUNE_BUDGET_CHARS} end as bigint) as budget,
         {C.DEFAULT_COMPRESSION_RATE}::double as rate, {C.DEFAULT_DEDUPE_THRESHOLD}::double as thr
  from fx2_kind where kind in (5, 6, 8)),
fx2_run as (select f.* from fx2 f join req using (session_id))"""


@register("h5_optimize_requests", f"""with recursive {fx.SQL_FX2}, {_H5_REQ}, {O.h5_ctes('fx2_run')}, {O.compress_ctes()},
done as (
  select g.session_id, g.gate, g.gate_reason, g.initial_size, coalesce(c.oc, '') as oc from gated g left join comp c using (session_id))
select case when kind in (0, 1) or cast(k.session_id as bigint) % 4 < 2 then null when cast(k.session_id as bigint) % 4 = 2 then 'shared' else k.session_id end as request_id, kind not in (0, 2, 3, 7) as ok,
       case when kind in (0, 2, 3, 7) then 'failed' when kind in (1, 4) or d.gate <> 'run' or d.oc = '' then 'no_optimization'
            else 'optimized' end as status,
       case when kind in (0, 2, 3) then 'invalid_input' when kind = 7 then 'runtime_error' end as error_code,
       case kind when 0 then 'invalid JSON payload' when 2 then 'docs must be a list of strings'
                 when 3 then 'docs must contain strings only' when 7 then 'unknown option: max_chunk' end as message,
       case when kind = 0 then 'invalid JSON payload' when kind = 2 then 'docs must be a list of strings'
            when kind = 3 then 'docs must contain strings only' when kind = 7 then 'unknown option: max_chunk'
            when kind in (1, 4) then '{C.REASON_NO_DOCS}' else d.gate_reason end as reason,
       cast(case when kind in (1, 4) then 0 when kind in (5, 6, 8) then d.initial_size end as bigint) as initial_size,
       cast(case when kind in (1, 4) then 0 when d.gate = 'run' then length(d.oc) when kind in (5, 6, 8) then d.initial_size end as bigint) as final_size,
       case when kind in (1, 4) then '' when kind in (5, 6, 8) then d.oc end as optimized_context
from fx2_kind k left join done d using (session_id)""")
def h5_requests(spark, sf):
    """H5 from raw payload lines: validation, gate, optimizer; a result row for every line."""
    path = scratch_dir(spark, "payloads")
    _payload_lines(spark, sf).write.text(path)
    return optimize_requests(read_requests(spark, path))


def _messages(spark, sf, events=None):
    """Live message list from FX3: user rows carry no parts; every 23rd call lacks a state, every
    31st part is not a tool part (both must be skipped)."""
    c = fx.fx3_calls(spark, sf, with_turn=False, events=events)
    state = F.when(F.col("seq") % 23 == 0, F.lit(None)).otherwise(
        F.struct(F.col("status").alias("status"), F.col("input").alias("input"), F.col("output").alias("output")))
    part = F.struct(F.when(F.col("seq") % 31 == 0, "text").otherwise("tool").alias("type"),
                    F.col("call_id").cast("string").alias("callID"), F.col("tool").alias("tool"), state.alias("state"))
    user = F.col("tool") == "USER"
    return c.select(S, F.col("seq").alias("msg_no"),
                    F.struct(F.when(user, "user").otherwise("assistant").alias("role")).alias("info"),
                    F.when(user, F.lit(None)).otherwise(F.array(part)).alias("parts"))


@register("b8_flatten_tool_parts", f"""{fx.with_sql(fx.SQL_FX3)}
select session_id, seq as msg_no, 0 as part_no, turn, cast(call_id as varchar) as call_id, tool, status from fx3
where tool <> 'USER' and seq % 23 <> 0 and seq % 31 <> 0""")
def b8(spark, sf):
    return X.flatten_tool_parts(_messages(spark, sf)).select(S, "msg_no", "part_no", "turn", "call_id", "tool", "status")


def _contexts(spark, sf):
    d = fx.fx2_docs(spark, sf)
    cid = F.col(S).cast("bigint")
    return d.select(
        S, "pos", F.when(F.col("pos") % 7 == 3, F.lit("   ")).otherwise(F.col("text")).alias("text"),
        F.when(cid % 2 == 0, F.concat(F.lit("in "), F.col(S))).otherwise(F.lit("")).alias("in_prompt"),
        F.when(cid % 5 == 0, F.concat(F.lit("out "), F.col(S))).alias("out_prompt"),
        F.lit("").alias("in_model"),
        F.when(cid % 3 == 0, "model-a").when(cid % 3 == 1, "model-b").alias("out_model"),
        F.when(cid % 2 == 0, F.create_map(F.lit("max_chunks"), F.lit("4"))).alias("in_options"),
        F.when(cid % 4 == 0, F.create_map(F.lit("max_chunks"), F.lit("8"), F.lit("min_chars"), F.lit("100"))).alias("out_options"))


@register("b10_build_requests", f"""{fx.with_sql(fx.SQL_FX2)},
c as (select session_id, cast(session_id as bigint) as cid, case when pos % 7 = 3 then '   ' else text end as text from fx2)
select session_id,
       case cid % 3 when 0 then 'model-a' when 1 then 'model-b' else '' end as model,
       case when cid % 5 = 0 then concat('out ', session_id) when cid % 2 = 0 then concat('in ', session_id)
            else '{C.DEFAULT_QUERY}' end as query,
       cast(count(*) filter (where {O.strip_sql('text')} <> '') as bigint) as n_docs,
       cast(coalesce(sum(length(text)) filter (where {O.strip_sql('text')} <> ''), 0) as bigint) as size,
       case when cid % 4 = 0 then '8' when cid % 2 = 0 then '4' end as opt_max_chunks,
       case when cid % 4 = 0 then '100' end as opt_min_chars
from c group by session_id, cid""")
def b10(spark, sf):
    r = X.build_requests(_contexts(spark, sf))
    return r.select(S, "model", "query", "n_docs", "size", F.col("options")["max_chunks"].alias("opt_max_chunks"),
                    F.col("options")["min_chars"].alias("opt_min_chars"))


@register("d2_apply_model_limits", f"""with {fx.SQL_FX2}, {O.params_sql('fx2_req', sizes_from='fx2', limits=True)}
select r.session_id, f.model, cast(coalesce(s.size, 0) as bigint) as size, r.max_chunks, r.budget as total_prune_budget_chars
from req r join fx2_req f using (session_id) left join rsize s using (session_id)""")
def d2(spark, sf):
    docs = fx.fx2_docs(spark, sf)
    r = apply_model_limits(fx.fx2_requests(spark, sf), docs, fx.model_limits(spark))
    return r.select(S, "model", "size", "max_chunks", "total_prune_budget_chars")


STORED = {"max_chunks": "7", "compression_rate": "0.4"}
ENV = {"total_prune_budget_chars": "2500.5"}


@register("d3_resolve_params", f"""{fx.with_sql(fx.SQL_FX2)}
select session_id,
       case when conv_id % 4 = 0 then 9 else 7 end as max_chunks,
       cast(case when conv_id % 4 = 1 then 5000 else 2501 end as bigint) as total_prune_budget_chars,
       case when conv_id % 4 = 2 then 0.25 else 0.4 end::double as compression_rate,
       {C.DEFAULT_DEDUPE_THRESHOLD}::double as dedupe_threshold, cast({C.DEFAULT_MIN_CHARS} as bigint) as min_input_size
from (select distinct conv_id, cast(conv_id as varchar) as session_id from conversations)""")
def d3(spark, sf):
    """Layers: request option > env > stored > default; '8.6' -> 9, 'abc' falls through, '0.25x' -> 0.25."""
    reqs = fx.fx2_requests(spark, sf)
    cid = F.col(S).cast("bigint")
    opts = (F.when(cid % 4 == 0, F.create_map(F.lit("max_chunks"), F.lit("8.6")))
            .when(cid % 4 == 1, F.create_map(F.lit("max_chunks"), F.lit("abc"), F.lit("total_prune_budget_chars"), F.lit("5000.4")))
            .when(cid % 4 == 2, F.create_map(F.lit("compression_rate"), F.lit("0.25x")))
            .otherwise(F.create_map().cast("map<string,string>")))
    r = resolve_params(reqs.withColumn("options", opts), stored=STORED, env=ENV)
    return r.select(S, "max_chunks", "total_prune_budget_chars", "compression_rate", "dedupe_threshold", "min_input_size")


_KEYS = ", ".join(f"'{k}'" for k in C.SAFE_CONFIG_KEYS + ("bogus",))
_STRING_KEYS = ", ".join(f"'{k}'" for k in C.STRING_CONFIG_KEYS)


@register("i7_validate_overrides", f"""with e as (
  select event_id, event_id % 9 as m, regexp_extract(props, '[0-9]+') as k, props, chr(9) as tab,
         list_value({_KEYS})[cast(event_id // 9 % {len(C.SAFE_CONFIG_KEYS) + 1} as int) + 1] as nk from events),
v as (
  select *, case when event_id % 5 = 0 then tab || upper(nk) || chr(10) else nk end as key,
         case m when 0 then k when 1 then k || '.5abc' when 2 then '0.' || k when 3 then '-' || k when 4 then props
                when 5 then chr(10) || tab when 6 then '3e-7' when 7 then '300000000' else props || ' junk' end as value,
         case m when 0 then cast(k as double) when 1 then cast(k as double) + 0.5 when 2 then cast('0.' || k as double)
                when 6 then 3e-7 when 7 then 3e8 else 0 end as num,
         case m when 0 then cast(cast(k as bigint) as varchar) when 1 then cast(cast(k as bigint) as varchar) || '.5'
                when 2 then regexp_replace('0.' || k, '0+$', '') when 6 then '3e-7' when 7 then '300000000' end as shown
  from e),
r as (
  select *, case when nk = 'bogus' then 'unknown config key: ' || key
                 when nk = 'model_limits' then case when m <> 4 then 'model_limits must be valid JSON.' end
                 when nk in ({_STRING_KEYS}) then case when m = 5 then nk || ' must be a non-empty string.' end
                 when not num > 0 then nk || ' must be a positive number.'
                 when nk = 'max_chunks' and num <> floor(num) then 'max_chunks must be a positive integer.'
                 when nk in ('compression_rate', 'dedupe_threshold') and num > 1 then nk || ' must be between 0 and 1.' end as error
  from v)
select event_id, key, nk as norm_key, error is null as ok,
       case when error is null then case when nk = 'model_limits' then replace(value, ' ', '') when nk in ({_STRING_KEYS}) then value else shown end end as value_out,
       error
from r""")
def i7(spark, sf):
    """Override rules on (key, value) pairs derived from events: odd spacing and case of keys, tiny and large
    numbers, blanks, JSON with and without text after it."""
    e = fx.read(spark, sf, "events")
    i, k = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0)
    keys = F.array(*[F.lit(x) for x in C.SAFE_CONFIG_KEYS + ("bogus",)])
    nk = F.element_at(keys, (F.floor(i / 9) % (len(C.SAFE_CONFIG_KEYS) + 1) + 1).cast("int"))
    key = F.when(i % 5 == 0, F.concat(F.lit("\t"), F.upper(nk), F.lit("\n"))).otherwise(nk)
    kinds = [k, F.concat(k, F.lit(".5abc")), F.concat(F.lit("0."), k), F.concat(F.lit("-"), k), F.col("props"), F.lit("\n\t"),
             F.lit("3e-7"), F.lit("300000000"), F.concat("props", F.lit(" junk"))]
    val = F.element_at(F.array(*kinds), (i % 9 + 1).cast("int"))
    return validate_overrides(e.select("event_id", key.alias("key"), val.alias("value")), keep=("event_id",))


# --------------------------------------------------------------------------- K1 / K2
from sessionsift.functions import models as M  # noqa: E402

_CHARS = {"letters": "abcdefghijklmnopqrstuvwxyz", "vowels": "aeiou "}


def _missing(device):
    raise ModuleNotFoundError("No module named 'absent_library'")


def stand_in_models(device: str = "cpu") -> M.Models:
    """Two models for each step, and an embedder that can't be imported."""
    return M.Models(
        embedders={**{k: M.counting_embedder(v) for k, v in _CHARS.items()}, "broken": _missing},
        scorers={"shared": M.shared_words_scorer, "remainder": M.remainder_scorer},
        token_scorers={"long": M.long_words_scorer, "late": M.late_words_scorer},
        device=device, default_compressor={"cpu": "long", "fast": "late"})


def _model_requests(spark, sf, broken: bool):
    """Two embedders, two rerankers and two compressors, chosen by the number of a source; with ``broken``, some
    sources name an embedder that nobody registered or that can't be imported."""
    r = fx.fx1_requests(spark, sf)
    n = F.substring(S, 4, 9).cast("int")
    embed = F.when(n % 2 == 0, "letters").otherwise("vowels")
    if broken:
        embed = F.when(n % 5 == 1, "absent").when(n % 5 == 2, "broken").otherwise(embed)
    return r.select(S, "query", embed.alias("embed_model"), F.when(n % 3 == 0, "shared").otherwise("remainder").alias("reranker_model"),
                    F.when(n % 4 == 0, "late").otherwise("").alias("compressor_model"), F.lit(0.99).alias("dedupe_threshold"))


_MODEL_REQ = f"""req as (
  select session_id, coalesce(query, '') as query, cast({C.DEFAULT_MIN_CHARS} as bigint) as min_input_size, {C.DEFAULT_MAX_CHUNKS} as max_chunks,
         cast({C.DEFAULT_PRUNE_BUDGET_CHARS} as bigint) as budget, {C.DEFAULT_COMPRESSION_RATE}::double as rate, 0.99::double as thr,
         cast(substring(session_id, 4) as int) as n, case when n % 2 = 0 then '{_CHARS["letters"]}' else '{_CHARS["vowels"]}' end as embed_chars,
         case when n % 3 = 0 then 'shared' else 'remainder' end as reranker, case when n % 4 = 0 then 'late' else 'long' end as compressor
  from fx1_req)"""


@register("k1_models_by_name", O.h5_models_sql(fx.SQL_FX1, "fx1", _MODEL_REQ))
def k1(spark, sf):
    """H5 with models chosen by each request's names: several in one job, every text embedded once."""
    return optimize_context(fx.fx1_docs(spark, sf), _model_requests(spark, sf, False), models=stand_in_models())


_K2_FAILED = "case n % 5 when 1 then concat('KeyError: no model named ', chr(39), 'absent', chr(39)) when 2 then concat('ModuleNotFoundError: No module named ', chr(39), 'absent_library', chr(39)) end"


@register("k2_fail_open", O.h5_models_sql(fx.SQL_FX1, "fx1", _MODEL_REQ, _K2_FAILED))
def k2(spark, sf):
    """The same with models that are unknown or can't be built: their sessions fail, all others go on."""
    return optimize_context(fx.fx1_docs(spark, sf), _model_requests(spark, sf, True), models=stand_in_models())


@register("k1_embed_plugin", f"""{fx.with_sql(fx.SQL_FX2)}
select session_id, pos, 26 as dim, cast(length(regexp_replace(lower(text), '[^a-z]', '', 'g')) as bigint) as n_letters from fx2""")
def k1_column(spark, sf):
    """Conversation turns embedded by a plug-in column (counts of letters; one model for each worker)."""
    from sessionsift.functions import plugins as P
    d = fx.fx2_docs(spark, sf)
    v = d.select(S, "pos", P.embed_column(F.regexp_replace("text", "\t", " "), P.letter_embedder, name="letters")["value"].alias("vec"))
    return v.select(S, "pos", F.size("vec").alias("dim"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_letters"))


# --------------------------------------------------------------------------- I1 / I3 / I4
from sessionsift.functions.text import js_round, parse_numeric, strip_ws  # noqa: E402


@register("i1_strip_ws", f"""{fx.with_sql(fx.SQL_FX2)}
select session_id, pos, {O.strip_sql("concat(chr(160), chr(65279), ' ', text, chr(10), chr(9), chr(8233))")} as text from fx2""")
def i1(spark, sf):
    """Strip every kind of leading/trailing whitespace (no-break space, BOM, separators), not only spaces."""
    d = fx.fx2_docs(spark, sf)
    padded = F.concat(F.lit(" ﻿ "), F.col("text"), F.lit("\n\t "))
    return d.select(S, "pos", strip_ws(padded).alias("text"))


@register("i4_parse_numeric", f"""with e as (select event_id, regexp_extract(props, '[0-9]+') as k from events)
select event_id, cast(k as double) + 0.5 as parsed, cast(floor(cast(k as double) + 0.5 + 0.5) as bigint) as rounded,
       cast(case when event_id % 5 = 0 then -1 else cast(k as double) + 0.5 end as double) as with_fallback from e""")
def i4(spark, sf):
    """Numeric prefix of '<k>.5abc' (and a non-numeric text falling back), then JS rounding."""
    e = fx.read(spark, sf, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"))
    txt = F.concat(F.col("k"), F.lit(".5abc"))
    bad = F.when(F.col("event_id") % 5 == 0, F.lit("abc")).otherwise(txt)
    p = parse_numeric(txt, 0.0)
    return e.select("event_id", p.alias("parsed"), js_round(p).cast("bigint").alias("rounded"),
                    parse_numeric(bad, -1.0).alias("with_fallback"))

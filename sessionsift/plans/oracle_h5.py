"""DuckDB SQL for the H5 flagship and its steps (independent of the Spark code).

The sequential walks (G1 semantic dedupe, G2 budget) are a recursive CTE over
``(session, rank)``; everything else is plain SQL over the fixture views.
"""

from __future__ import annotations

from sessionsift import constants as C

WS = r"[\t\n\x0B\f\r \x{00A0}\x{FEFF}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


PY_WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_text_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{PY_WS}+', ''), '{PY_WS}+$', '')"


def toks_sql(x: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), "
            f"lambda t: t <> '')")


def params_sql(req: str, sizes_from: str | None = None, limits: bool = False) -> str:
    """Request rows with every optimizer parameter (defaults, optionally model limits)."""
    if not limits:
        return f"""req as (
  select session_id, coalesce(query, '') as query, cast({C.DEFAULT_MIN_CHARS} as bigint) as min_input_size,
         {C.DEFAULT_MAX_CHUNKS} as max_chunks, cast({C.DEFAULT_PRUNE_BUDGET_CHARS} as bigint) as budget,
         {C.DEFAULT_COMPRESSION_RATE}::double as rate, {C.DEFAULT_DEDUPE_THRESHOLD}::double as thr
  from {req})"""
    return f"""lim as (
  select model, max(case when key = 'max_chunks' then value end) as l_mc,
         max(case when key = 'total_prune_budget_chars' then value end) as l_b
  from limits group by model),
rsize as (select session_id, sum(length(text)) as size from {sizes_from} where {strip_sql('text')} <> '' group by session_id),
req as (
  select r.session_id, coalesce(r.query, '') as query, cast({C.DEFAULT_MIN_CHARS} as bigint) as min_input_size,
         case when coalesce(s.size, 0) >= {C.DEFAULT_AUTO_COMPRESSION_CHARS} and l.l_mc is not null
              then cast(greatest(1, floor(cast(l.l_mc as double) + 0.5)) as integer) else {C.DEFAULT_MAX_CHUNKS} end as max_chunks,
         case when coalesce(s.size, 0) >= {C.DEFAULT_AUTO_COMPRESSION_CHARS} and l.l_b is not null
              then cast(greatest(1, floor(cast(l.l_b as double) + 0.5)) as bigint) else {C.DEFAULT_PRUNE_BUDGET_CHARS} end as budget,
         {C.DEFAULT_COMPRESSION_RATE}::double as rate, {C.DEFAULT_DEDUPE_THRESHOLD}::double as thr
  from {req} r left join rsize s using (session_id) left join lim l on l.model = r.model)"""


def h5_ctes(docs: str) -> str:
    """CTEs from ``req`` + ``docs`` down to ``ranked`` (F6) and ``items`` (G1 input)."""
    return f"""sizes as (select session_id, count(*) as n_docs, sum(length(text)) as initial_size from {docs} group by session_id),
gated as (
  select r.*, greatest({C.PREFILTER_MIN_CAP}, {C.PREFILTER_CHUNK_FACTOR} * r.max_chunks) as cap,
         coalesce(s.n_docs, 0) as n_docs, cast(coalesce(s.initial_size, 0) as bigint) as initial_size,
         case when coalesce(s.n_docs, 0) = 0 then 'no_optimization'
              when r.min_input_size > 0 and coalesce(s.initial_size, 0) < r.min_input_size then 'no_optimization'
              else 'run' end as gate,
         case when coalesce(s.n_docs, 0) = 0 then '{C.REASON_NO_DOCS}'
              when r.min_input_size > 0 and coalesce(s.initial_size, 0) < r.min_input_size
              then concat('context size ', cast(coalesce(s.initial_size, 0) as varchar), ' chars is below the threshold of ',
                          cast(r.min_input_size as varchar), ' chars.')
              else '' end as gate_reason
  from req r left join sizes s using (session_id)),
nd as (select d.session_id, d.pos, {strip_text_sql('d.text')} as text from {docs} d join gated g using (session_id) where g.gate = 'run'),
nd2 as (select * from nd where text <> ''
        and not ({" or ".join(f"starts_with(lower(substring(text, 1, {len(p)})), '{p}')" for p in C.ERROR_PREFIXES)})),
qm as (select session_id, cap, case when {strip_text_sql('query')} = '' then ' ' else query end as q from gated where gate = 'run'),
qtf as (select session_id, term, count(*) as qtf from (select session_id, unnest({toks_sql('q')}) as term from qm) group by all),
qn as (select session_id, sqrt(sum(qtf * qtf)) as qnorm from qtf group by all),
dtf as (select session_id, pos, term, count(*) as tf from (select session_id, pos, unnest({toks_sql('text')}) as term from nd2) group by all),
dn as (select session_id, pos, sum(tf * tf) as ss from dtf group by all),
dots as (select d.session_id, d.pos, sum(d.tf * q.qtf) as dot from dtf d join qtf q using (session_id, term) group by all),
sims as (
  select n.session_id, n.pos, n.text,
         case when coalesce(dots.dot, 0) = 0 or coalesce(dn.ss, 0) = 0 or qn.qnorm is null or qn.qnorm = 0 then 0.0
              else round(dots.dot / (sqrt(dn.ss) * qn.qnorm), 6) end as sim
  from nd2 n left join dn using (session_id, pos) left join dots using (session_id, pos) left join qn using (session_id)),
pre as (
  select s.*, q.cap, row_number() over (partition by s.session_id order by s.sim desc, s.pos) as rn,
         count(*) over (partition by s.session_id) as n
  from sims s join qm q using (session_id)),
cands as (select session_id, case when n > cap then rn else pos end as pos, text from pre where rn <= cap),
ctok as (select session_id, pos, text, {toks_sql('text')} as dt from cands),
cstat as (select session_id, pos, len(dt) as dl, count(*) over (partition by session_id) as nn,
                 avg(len(dt)) over (partition by session_id) as avgdl from ctok),
ctf as (select session_id, pos, term, count(*) as tf from (select session_id, pos, unnest(dt) as term from ctok) group by all),
qd as (select distinct session_id, term from qtf),
hits as (select c.*, count(*) over (partition by c.session_id, c.term) as df from ctf c join qd using (session_id, term)),
sc as (
  select h.session_id, h.pos,
         sum(ln(1 + (s.nn - h.df + 0.5::double) / (h.df + 0.5::double)) * h.tf * {C.BM25_K1 + 1}::double
             / (h.tf + {C.BM25_K1}::double * ({1 - C.BM25_B}::double + {C.BM25_B}::double * s.dl / s.avgdl))) as raw
  from hits h join cstat s using (session_id, pos) group by all),
scored as (select c.session_id, c.pos, c.text, round(coalesce(sc.raw, 0), 6) as score
           from cands c left join sc using (session_id, pos)),
ranked as (
  select *, row_number() over (partition by session_id order by score desc, pos) as rk,
         first_value(score) over (partition by session_id, text order by pos) as fscore
  from scored),
rterms as (select r.session_id, r.rk, t.term, t.tf from ranked r join ctf t using (session_id, pos)),
rnorm as (select session_id, rk, sqrt(sum(tf * tf)) as nrm from rterms group by all),
pairs as (
  select a.session_id, a.rk as a, b.rk as b, sum(a.tf * b.tf) as dot
  from rterms a join rterms b on a.session_id = b.session_id and a.term = b.term and b.rk < a.rk group by all),
nb as (
  select p.session_id, p.a as rk, list(p.b order by p.b) as nbrs
  from pairs p join rnorm x on x.session_id = p.session_id and x.rk = p.a
               join rnorm y on y.session_id = p.session_id and y.rk = p.b
               join gated g on g.session_id = p.session_id
  where p.dot / (x.nrm * y.nrm) >= g.thr group by all),
items as (
  select r.session_id, r.rk, length(r.text) as len, r.fscore, coalesce(nb.nbrs, []::bigint[]) as nbrs
  from ranked r left join nb using (session_id, rk)),
walk(session_id, rk, kept, rem, stop, take) as (
  select session_id, cast(0 as bigint), []::bigint[], budget, budget <= 0, []::bigint[] from gated where gate = 'run'
  union all
  select w.session_id, i.rk,
         case when list_has_any(w.kept, i.nbrs) then w.kept else list_append(w.kept, i.rk) end,
         case when list_has_any(w.kept, i.nbrs) or w.stop or w.rem <= 0 or i.len > w.rem then w.rem
              else w.rem - i.len end,
         case when list_has_any(w.kept, i.nbrs) then w.stop
              when w.stop or w.rem <= 0 then true
              when i.len > w.rem then (len(w.take) = 0 and i.fscore > 0)
              else false end,
         case when list_has_any(w.kept, i.nbrs) or w.stop or w.rem <= 0 then w.take
              when i.len > w.rem then (case when len(w.take) = 0 and i.fscore > 0 then list_append(w.take, i.rk) else w.take end)
              else list_append(w.take, i.rk) end
  from walk w join items i on i.session_id = w.session_id and i.rk = w.rk + 1),
fin as (select w.session_id, list_slice(arg_max(w.take, w.rk), 1, max(g.max_chunks)) as sl
        from walk w join gated g using (session_id) group by w.session_id),
chosen as (
  select c.session_id, c.slot, r.rk, r.text
  from (select session_id, unnest(sl) as rk, unnest(generate_series(1, len(sl))) as slot from fin) c
  join ranked r using (session_id, rk))"""


def compress_ctes(chosen: str = "chosen", order: str = "slot", corpus: str | None = None) -> str:
    """Tokens weighed by the session's chosen docs, or by all docs of ``corpus(text)``."""
    numbers = f"""cn as (select session_id, count(*) as nn from {chosen} group by all),
cdf as (select session_id, norm, count(distinct {order}) as df from ct2 where norm <> '' group by all),"""
    if corpus:
        words = "string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+')"
        numbers = f"""cn as (select s.session_id, k.nn from (select distinct session_id from {chosen}) s,
       (select count(*) as nn from {corpus} where regexp_matches(text, '[^\\t\\n\\x0B\\f\\r ]')) k),
cdf0 as (select norm, count(*) as df from (
  select unnest(list_distinct(list_transform({words}, lambda t: lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))))) as norm from {corpus}) group by norm),
cdf as (select t.session_id, t.norm, d.df from (select distinct session_id, norm from ct2 where norm <> '') t join cdf0 d using (norm)),"""
    return f"""ctoks as (
  select session_id, {order}, unnest(tl) as tok, unnest(generate_series(0, len(tl) - 1)) as tpos
  from (select session_id, {order}, string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+') as tl from {chosen})),
ct2 as (select *, lower(regexp_replace(tok, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as norm from ctoks where tok <> ''),
{numbers}
ctf2 as (select session_id, {order}, norm, count(*) as tf from ct2 group by all),
cnt as (select session_id, {order}, count(*) as ntok from ct2 group by all),
cw as (
  select t.*, f.tf, k.ntok,
         case when t.norm = '' then 0.0 else round(ln(1 + (n.nn - d.df + 0.5::double) / (d.df + 0.5::double)), 6) end as w
  from ct2 t join cn n using (session_id) left join cdf d using (session_id, norm)
  join ctf2 f using (session_id, {order}, norm) join cnt k using (session_id, {order})),
ck as (select *, row_number() over (partition by session_id, {order} order by w desc, tf, tpos) as r from cw),
cdoc as (select c.session_id, c.{order}, string_agg(c.tok, ' ' order by c.tpos) as ctext
         from ck c join gated g using (session_id) where c.r <= ceil(g.rate * c.ntok) group by all),
comp as (select session_id, string_agg(ctext, chr(10) || chr(10) order by {order}) as oc from cdoc group by all)"""


def h5_sql(fixture_ctes: str, docs: str, req: str, limits: bool = False, corpus: str | None = None) -> str:
    return f"""with recursive {fixture_ctes},
{params_sql(req, sizes_from=docs, limits=limits)},
{h5_ctes(docs)},
{compress_ctes(corpus=corpus)}
select g.session_id,
       case when g.gate <> 'run' then g.gate when coalesce(c.oc, '') = '' then 'no_optimization' else 'optimized' end as status,
       case when g.gate = 'run' then '' else g.gate_reason end as reason,
       cast(g.initial_size as bigint) as initial_size,
       cast(case when g.gate = 'run' then length(coalesce(c.oc, '')) when g.n_docs = 0 then 0 else g.initial_size end as bigint) as final_size,
       coalesce(c.oc, '') as optimized_context
from gated g left join comp c using (session_id)"""


def _between(text: str, start: str, end: str) -> str:
    """The CTEs from the one named ``start`` up to the one named ``end``."""
    return text[text.index(f"\n{start} as (") + 1:text.index(f"\n{end} as (")]


def h5_models_sql(fixture_ctes: str, docs: str, req: str, failed: str = "null") -> str:
    """H5 with models by name (K1): vectors of counted characters instead of term counts, pair scores and token
    scores of the deterministic stand-ins.  ``req`` also has ``embed_chars``, ``reranker`` and ``compressor``;
    ``failed`` is the reason of a session whose model fails (K2), else null."""
    base = h5_ctes(docs)
    vector = lambda x: f"list_transform(string_split(embed_chars, ''), lambda c: length(lower({x})) - length(replace(lower({x}), c, '')))"
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    cos = f"case when {dot('u', 'u')} = 0 or {dot('v', 'v')} = 0 then 0.0 else {dot('u', 'v')} / (sqrt({dot('u', 'u')}) * sqrt({dot('v', 'v')})) end"
    return f"""with recursive {fixture_ctes},
{req},
{base[:base.index("qm as (")]}qm as (select session_id, cap, query, reranker, embed_chars, case when {strip_text_sql('query')} = '' then ' ' else query end as q from gated where gate = 'run'),
sims as (
  select session_id, pos, text, round({cos}, 6) as sim
  from (select n.session_id, n.pos, n.text, {vector('n.text')} as u, {vector('q')} as v from nd2 n join qm using (session_id))),
{_between(base, "pre", "ctok")}
scored as (
  select c.session_id, c.pos, c.text, q.embed_chars, cast(case when reranker = 'shared'
      then len(list_filter(list_distinct(list_intersect(string_split(q.query, ' '), string_split(c.text, ' '))), lambda w: w <> ''))
      else length(c.text) % 97 end as double) as score
  from cands c join qm q using (session_id)),
{_between(base, "ranked", "rterms")}
rvec as (select session_id, rk, {vector('text')} as v from ranked),
pairs as (
  select session_id, a, b, {cos} as c from (
    select x.session_id, x.rk as a, y.rk as b, x.v as u, y.v as v from rvec x join rvec y on x.session_id = y.session_id and y.rk < x.rk)),
nb as (select p.session_id, p.a as rk, list(p.b order by p.b) as nbrs from pairs p join gated g using (session_id) where p.c >= g.thr group by all),
{base[base.index("items as ("):]},
mtok as (
  select t.*, case when compressor = 'late' then i else length(tok) end as w, count(*) over (partition by session_id, slot) as n
  from (select session_id, slot, unnest(tl) as tok, unnest(range(len(tl))) as i
        from (select session_id, slot, list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda t: t <> '') as tl from chosen)) t
  join gated using (session_id)),
mkept as (select *, row_number() over (partition by session_id, slot order by w desc, i) as r from mtok),
mdoc as (select k.session_id, slot, string_agg(tok, ' ' order by i) as ctext from mkept k join gated g using (session_id) where r <= ceil(g.rate * k.n) group by all),
comp as (select session_id, string_agg(ctext, chr(10) || chr(10) order by slot) as oc from mdoc group by all),
told as (select g.*, c.oc, case when g.gate = 'run' then {failed} end as failed from gated g left join comp c using (session_id))
select session_id,
       case when gate <> 'run' then gate when failed is not null then 'failed' when coalesce(oc, '') = '' then 'no_optimization' else 'optimized' end as status,
       case when gate <> 'run' then gate_reason else coalesce(failed, '') end as reason,
       cast(initial_size as bigint) as initial_size,
       cast(case when gate = 'run' and failed is null then length(coalesce(oc, '')) when n_docs = 0 then 0 else initial_size end as bigint) as final_size,
       case when failed is null then coalesce(oc, '') else '' end as optimized_context
from told"""

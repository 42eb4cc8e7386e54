"""Fixture views over the driver tables (FX1-FX6), in Spark and in DuckDB SQL.

Each ``fxN_*`` function reads the given parquet tables, so the work grows
with the data.  ``SQL_FX*`` are the same views for the DuckDB oracle.

Ordering note: in these tables ``event_id`` order equals ``(ts, event_id)``
order, and ``doc_id`` is unique per source, so ``seq``/``pos`` use those ids
directly instead of a session-wide ``row_number`` (which would put a whole
session in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.operators.ordered import running_sum


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


# --------------------------------------------------------------------------- FX1
def fx1_docs(spark, sf_dir) -> DataFrame:
    """docs_by_source: session = source, pos = doc_id, every 17th doc error-prefixed."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("session_id"),
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("[Error] "), F.col("text"))).otherwise(F.col("text")).alias("text"),
    )


def fx1_requests(spark, sf_dir) -> DataFrame:
    """Query of a session = the whole text of its first doc (prefix excluded)."""
    d = read(spark, sf_dir, "documents")
    # the first id first: no text travels through an aggregate
    first = d.groupBy(F.col("source").alias("session_id")).agg(F.min("doc_id").alias("doc_id"))
    return d.select("doc_id", F.col("text").alias("query")).join(first, "doc_id").select("session_id", "query")


SQL_FX1 = """fx1 as (
  select source as session_id, doc_id as pos,
         case when doc_id % 17 = 0 then concat('[Error] ', text) else text end as text
  from documents),
fx1_req as (
  select source as session_id, min_by(text, doc_id) as query
  from documents group by source)"""


# --------------------------------------------------------------------------- FX2
def fx2_docs(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"), "text", "role")


def fx2_requests(spark, sf_dir) -> DataFrame:
    """Query = text of the latest user turn; model by ``conv_id % 3``."""
    c = read(spark, sf_dir, "conversations")
    is_user = F.col("role") == "user"
    return (c.groupBy("conv_id")
            .agg(F.max_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("q"))
            .select(F.col("conv_id").cast("string").alias("session_id"),
                    F.coalesce(F.nullif(F.col("q"), F.lit("")), F.lit(C.DEFAULT_QUERY)).alias("query"),
                    F.when(F.col("conv_id") % 3 == 0, "model-a").when(F.col("conv_id") % 3 == 1, "model-b")
                    .otherwise("").alias("model")))


# Per-model limits (a parameter table, broadcast): model-a gets 3 chunks and a 1,500 budget.
MODEL_LIMITS = [("model-a", "max_chunks", "3"), ("model-a", "total_prune_budget_chars", "1500")]


def model_limits(spark) -> DataFrame:
    return spark.createDataFrame(MODEL_LIMITS, "model string, key string, value string")


SQL_FX2 = f"""fx2 as (
  select cast(conv_id as varchar) as session_id, turn as pos, text, role from conversations),
fx2_req as (
  select cast(conv_id as varchar) as session_id,
         coalesce(nullif(max_by(case when role = 'user' then text end, case when role = 'user' then turn end), ''),
                  '{C.DEFAULT_QUERY}') as query,
         case conv_id % 3 when 0 then 'model-a' when 1 then 'model-b' else '' end as model
  from conversations group by conv_id),
limits(model, key, value) as (
  values ('model-a', 'max_chunks', '3'), ('model-a', 'total_prune_budget_chars', '1500'))"""


# --------------------------------------------------------------------------- FX3
def _tool_of(event_type):
    return (F.when(event_type == "view", "USER").when(event_type == "click", "read")
            .when(event_type == "signup", "grep").when(event_type == "purchase", "Write").otherwise("bash"))


def fx3_calls(spark, sf_dir, with_turn: bool = True, events: DataFrame | None = None) -> DataFrame:
    """tool_calls: one row per event; ``USER`` rows are user turns, the rest are calls.

    ``events`` may be a streaming frame (then ``with_turn`` must be False).
    """
    e = events if events is not None else read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0)
    calls = e.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("call_id"),
        _tool_of(F.col("event_type")).alias("tool"),
        F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"),
        F.concat(F.lit('{"cmd":"'), F.col("event_type"), F.lit(" "), k, F.lit('",'),
                 F.substring("props", 2, 1 << 30)).alias("input"),
        F.concat(F.lit("out "), F.col("event_id").cast("string")).alias("output"),
    )
    if not with_turn:
        return calls
    return running_sum(calls, ["session_id"], "seq", F.when(F.col("tool") == "USER", 1).otherwise(0), "turn")


SQL_FX3 = """fx3 as (
  select cast(user_id as varchar) as session_id, event_id as seq,
         cast(sum(case when event_type = 'view' then 1 else 0 end) over (partition by user_id order by event_id
              rows between unbounded preceding and current row) as bigint) as turn,
         event_id as call_id,
         case event_type when 'view' then 'USER' when 'click' then 'read' when 'signup' then 'grep'
                         when 'purchase' then 'Write' else 'bash' end as tool,
         case event_type when 'error' then 'error' else 'completed' end as status,
         concat('{"cmd":"', event_type, ' ', regexp_extract(props, '[0-9]+'), '",', substr(props, 2)) as input,
         concat('out ', cast(event_id as varchar)) as output
  from events)"""


# --------------------------------------------------------------------------- FX4
def fx4_lines(spark, sf_dir) -> DataFrame:
    """Transcript lines, three slots per event (line_no = 3*event_id + k)."""
    e = read(spark, sf_dir, "events")
    eid = F.col("event_id")
    tool = _tool_of(F.col("event_type"))
    is_view = F.col("event_type") == "view"
    tid = F.concat(F.lit("t"), (eid % 3).cast("string"))
    line0 = F.when(is_view, F.concat(F.lit('{"type":"user","message":{"content":" turn '), eid.cast("string"),
                                      F.lit(' "}}'))).otherwise(
        F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"text","text":"note '),
                 (eid % 5).cast("string"), F.lit('"},{"type":"tool_use","id":"'), tid, F.lit('","name":"'), tool,
                 F.lit('","input":'), F.col("props"), F.lit("}]}}")))
    line1 = F.when(is_view, F.lit("")).otherwise(
        F.concat(F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"'),
                 F.when(eid % 29 == 0, F.lit("missing")).otherwise(tid),
                 F.lit('","content":[{"type":"text","text":"out '), eid.cast("string"), F.lit('"}],"is_error":'),
                 F.when(F.col("event_type") == "error", "true").otherwise("false"), F.lit("}]}}")))
    line2 = F.when(eid % 97 == 0, F.lit("{bad")).otherwise(F.lit(""))
    slots = e.select("user_id", "event_id", F.posexplode(F.array(line0, line1, line2)).alias("k", "raw"))
    return slots.select(F.col("user_id").cast("string").alias("session_id"),
                        (F.col("event_id") * 3 + F.col("k")).alias("line_no"), "raw")


SQL_FX4_EVENTS = """ev as (
  select cast(user_id as varchar) as session_id, event_id,
         case event_type when 'view' then 'USER' when 'click' then 'read' when 'signup' then 'grep'
                         when 'purchase' then 'Write' else 'bash' end as tool,
         event_type, props from events)"""


# --------------------------------------------------------------------------- FX5
def fx5_log(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    e = events if events is not None else read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ingest_seq"), "ts",
        F.when(F.col("user_id") % 3 == 0, "host-a").when(F.col("user_id") % 3 == 1, "host-b").otherwise("cli").alias("cli"),
        F.concat(F.lit("s/"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("trigger"),
        F.floor(F.col("value") * 100).cast("bigint").alias("initial_chars"),
        F.floor(F.col("value") * F.when(F.col("event_id") % 7 == 0, 150).otherwise(40)).cast("bigint").alias("result_chars"),
    )


SQL_FX5 = """fx5 as (
  select event_id as ingest_seq, ts,
         case user_id % 3 when 0 then 'host-a' when 1 then 'host-b' else 'cli' end as cli,
         concat('s/', cast(user_id as varchar)) as session_id, event_type as trigger,
         cast(floor(value * 100) as bigint) as initial_chars,
         cast(floor(value * case when event_id % 7 = 0 then 150 else 40 end) as bigint) as result_chars
  from events)"""

STATS_NOW = "2024-01-30 12:00:00"


# --------------------------------------------------------------------------- FX6
def fx6_vectors(spark, sf_dir) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.col("label").cast("string").alias("session_id"), F.col("vec_id").alias("pos"),
                    F.col("embedding").cast("array<double>").alias("vec"))


SQL_FX6 = """fx6 as (
  select cast(label as varchar) as session_id, vec_id as pos, cast(embedding as double[]) as vec from embeddings)"""


def with_sql(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes)

"""Parameters per request: D2 apply_model_limits, D3 resolve_params, I7 validate_overrides.

Stored config and environment overrides are small dictionaries (a config
file, a process environment), so they enter the plan as literals; the per
model limits are a dimension table, grouped to one map per model and
broadcast (its size is bounded by the number of configured models).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import is_blank, js_number, js_round, parse_numeric, strict_json, strip_ws
from sessionsift.operators.ordered import join_null_safe

S = "session_id"

_NUMERIC = {
    "timeout_ms": (C.DEFAULT_TIMEOUT_MS, None),
    "min_chars": (C.DEFAULT_MIN_CHARS, None),
    "compression_rate": (C.DEFAULT_COMPRESSION_RATE, None),
    "max_chunks": (C.DEFAULT_MAX_CHUNKS, 1),
    "dedupe_threshold": (C.DEFAULT_DEDUPE_THRESHOLD, None),
    "total_prune_budget_chars": (C.DEFAULT_PRUNE_BUDGET_CHARS, 1),
    "auto_compression_chars": (C.DEFAULT_AUTO_COMPRESSION_CHARS, 0),
}
_STRINGS = {
    "reranker_model": C.DEFAULT_RERANKER_MODEL,
    "embed_model": C.DEFAULT_EMBED_MODEL,
    "compressor_model": C.DEFAULT_COMPRESSOR_MODEL,
}


def _lit_str(v) -> Column:
    return F.lit(None).cast("string") if v is None else F.lit(str(v))


def resolve_params(requests: DataFrame, stored: dict | None = None, env: dict | None = None,
                   options: str = "options") -> DataFrame:
    """D3: typed parameter columns; per key request option > env > stored > default.

    A value that is not a number falls to the next layer (numeric prefix rule);
    ``max_chunks`` and the budget are rounded half up and at least 1; the auto
    threshold is rounded and at least 0.  ``min_input_size`` is the gate the
    adapters send (``min_chars``).
    """
    stored, env = stored or {}, env or {}
    r = requests
    if options not in r.columns:
        r = r.withColumn(options, F.create_map().cast("map<string,string>"))
    opt = F.col(options)
    cols = {}
    for key, (default, floor_) in _NUMERIC.items():
        v = parse_numeric(_lit_str(env.get(key)), parse_numeric(_lit_str(stored.get(key)), default))
        v = parse_numeric(opt[key], v)
        if floor_ is not None:
            v = F.greatest(F.lit(floor_), js_round(v))
        cols[key] = v
    for key, default in _STRINGS.items():
        cols[key] = F.coalesce(F.nullif(opt[key], F.lit("")), F.nullif(_lit_str(env.get(key)), F.lit("")),
                               F.nullif(_lit_str(stored.get(key)), F.lit("")), F.lit(default))
    return r.select(
        *[c for c in r.columns if c not in cols and c not in ("max_chunks", "total_prune_budget_chars",
                                                             "compression_rate", "dedupe_threshold", "min_input_size")],
        cols["max_chunks"].cast("int").alias("max_chunks"),
        cols["total_prune_budget_chars"].cast("bigint").alias("total_prune_budget_chars"),
        cols["compression_rate"].cast("double").alias("compression_rate"),
        cols["dedupe_threshold"].cast("double").alias("dedupe_threshold"),
        js_round(cols["min_chars"]).cast("bigint").alias("min_input_size"),
        cols["auto_compression_chars"].cast("bigint").alias("auto_compression_chars"),
        cols["timeout_ms"].cast("double").alias("timeout_ms"),
        cols["reranker_model"].alias("reranker_model"),
        cols["embed_model"].alias("embed_model"),
        cols["compressor_model"].alias("compressor_model"),
    )


def limits_map(limits: DataFrame) -> DataFrame:
    """``(model, key, value)`` rows -> one ``map<string,string>`` per model."""
    return limits.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("key").cast("string"), F.col("value").cast("string")))).alias("__lim"))


def configured_limits(spark: SparkSession, stored: dict | None = None, env: dict | None = None) -> DataFrame:
    """The eleventh configuration key: ``(model, key, value)`` rows of ``model_limits``, an object of options per
    model.  A layer (env, then stored) counts if it is an object or the JSON text of one."""
    for layer in (env or {}, stored or {}):
        value = layer.get("model_limits")
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                continue
        if isinstance(value, dict):
            break
    else:
        value = {}
    rows = [(str(model), str(key), x if isinstance(x, str) else json.dumps(x))
            for model, options in value.items() if isinstance(options, dict) for key, x in options.items()]
    return spark.createDataFrame(rows, "model string, key string, value string")


def apply_model_limits(requests: DataFrame, docs: DataFrame, limits: DataFrame | None = None,
                       stored: dict | None = None, env: dict | None = None) -> DataFrame:
    """D2 (+D3): model limits overwrite request options when the context is large enough.

    size = Σ length of the non-blank docs; limits apply when ``size >=
    auto_compression_chars`` and the (non-empty) model has limits (by default
    those of the configuration).  Returns
    the requests with resolved typed parameter columns and ``size``.
    """
    sizes = docs.where(~is_blank("text")).groupBy(S).agg(F.sum(F.length("text")).cast("bigint").alias("size"))
    r = join_null_safe(requests, sizes, [S], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))
    if "options" not in r.columns:
        r = r.withColumn("options", F.create_map().cast("map<string,string>"))
    stored, env = stored or {}, env or {}
    threshold = parse_numeric(_lit_str(env.get("auto_compression_chars")),
                              parse_numeric(_lit_str(stored.get("auto_compression_chars")), C.DEFAULT_AUTO_COMPRESSION_CHARS))
    threshold = F.greatest(F.lit(0), js_round(threshold))
    # One row per configured model: small, but its size isn't known here, so the join is left to the planner.
    limits = configured_limits(requests.sparkSession, stored, env) if limits is None else limits
    r = r.join(limits_map(limits), "model", "left")
    use = F.col("__lim").isNotNull() & (F.coalesce(F.col("model"), F.lit("")) != "") & (F.col("size") >= threshold)
    keys = F.map_keys("__lim")
    merged = F.map_concat(F.map_filter("options", lambda k, v: ~F.array_contains(keys, k)), F.col("__lim"))
    r = r.withColumn("options", F.when(use, merged).otherwise(F.col("options"))).drop("__lim")
    return resolve_params(r, stored, env)


# --------------------------------------------------------------------------- I7
def validate_overrides(table: DataFrame, key: str = "key", value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, value)`` -> ``(key, norm_key, ok, value_out, error)`` by the override rules."""
    raw, nk, js, num, out_num = (F.col(c) for c in ("__raw", "__key", "__json", "__num", "__shown"))
    # Each value is read once; the rules below refer to the columns.
    t = table.withColumn("__raw", F.coalesce(F.col(value).cast("string"), F.lit("")))
    t = t.withColumns({"__key": F.lower(strip_ws(F.coalesce(F.col(key).cast("string"), F.lit("")))), "__json": strict_json(raw),
                       "__num": parse_numeric(raw, F.lit(float("nan")))})
    t = t.withColumn("__shown", js_number(num))
    known = nk.isin(*C.SAFE_CONFIG_KEYS)
    kind = F.schema_of_variant(js)
    json_ok = js.isNotNull() & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    is_str = nk.isin(*C.STRING_CONFIG_KEYS)
    err = (F.when(~known, F.concat(F.lit("unknown config key: "), F.col(key).cast("string")))
           .when(nk == "model_limits", F.when(json_ok, F.lit(None)).otherwise(F.lit("model_limits must be valid JSON.")))
           .when(is_str, F.when(strip_ws(raw) != "", F.lit(None)).otherwise(F.concat(nk, F.lit(" must be a non-empty string."))))
           .when(F.isnan(num) | (num <= 0), F.concat(nk, F.lit(" must be a positive number.")))
           .when((nk == "max_chunks") & (num != F.floor(num)), F.lit("max_chunks must be a positive integer."))
           .when(nk.isin("compression_rate", "dedupe_threshold") & (num > 1), F.concat(nk, F.lit(" must be between 0 and 1."))))
    out = F.when(nk == "model_limits", F.to_json(js)).when(is_str, strip_ws(raw)).otherwise(out_num)
    t = t.withColumns({"__error": err, "__out": out})
    return t.select(*keep, F.col(key), nk.alias("norm_key"), F.col("__error").isNull().alias("ok"),
                    F.when(F.col("__error").isNull(), F.col("__out")).alias("value_out"), F.col("__error").alias("error"))

"""A3 read_requests and A4 validate_requests: optimizer request payloads as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import strict_json, strip_ws

ID = "request_id"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A3: one payload per line -> ``(request_id, payload variant, query, options map, min_input_size, docs
    variant)``.

    Defaults: ``query=''``, ``options={}``; a blank line is an empty payload (no docs); a line that is not
    one JSON value keeps a null payload (A4 labels it).  ``min_input_size`` is the option of that name if it
    is a JSON integer, else null: only an integer gates.
    """
    lines = spark.read.text(path)
    raw = F.when(strip_ws("value") == "", F.lit("{}")).otherwise(F.col("value"))
    r = lines.select(strict_json(raw).alias("payload"))
    g = lambda p, t="variant": F.try_variant_get("payload", p, t)
    opts = F.try_variant_get("payload", "$.options", "map<string,string>")
    size = g("$.options.min_input_size")
    whole = F.schema_of_variant(size).rlike("^(BIGINT|INT|SMALLINT|TINYINT)")
    return r.select(
        g("$.request_id", "string").alias(ID), "payload",
        F.when(whole, F.try_variant_get(size, "$", "bigint")).alias("min_input_size"),
        F.coalesce(g("$.query", "string"), F.lit("")).alias("query"),
        F.coalesce(opts, F.create_map().cast("map<string,string>")).alias("options"),
        g("$.docs").alias("docs"),
    )


def _falsy(v: Column) -> Column:
    k = F.schema_of_variant(v)
    return (v.isNull() | F.is_variant_null(v)
            | ((k == "STRING") & (F.try_variant_get(v, "$", "string") == ""))
            | ((k == "BOOLEAN") & ~F.try_variant_get(v, "$", "boolean"))
            | (k.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(v, "$", "double") == 0))
            | (k.startswith("ARRAY") & (F.size(F.try_variant_get(v, "$", "array<variant>")) == 0))
            | (k.startswith("OBJECT") & (F.size(F.try_variant_get(v, "$", "map<string,variant>")) == 0)))


def validate_requests(requests: DataFrame) -> DataFrame:
    """A4: label (never drop) each request: ``invalid_input`` (bad JSON, docs not a list, non-string
    element), ``no_optimization`` (no docs) or ``run``; adds ``n_docs`` and ``initial_size``."""
    docs = F.col("docs")
    arr = F.try_variant_get(docs, "$", "array<variant>")
    is_obj = F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False))
    falsy = _falsy(docs)
    not_list = ~F.coalesce(F.schema_of_variant(docs).startswith("ARRAY"), F.lit(False))
    bad_elem = F.exists(arr, lambda x: F.coalesce(F.schema_of_variant(x) != "STRING", F.lit(True)))
    strs = F.transform(arr, lambda x: F.try_variant_get(x, "$", "string"))
    size = F.aggregate(strs, F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))
    status = (F.when(~is_obj, "invalid_input").when(falsy, "no_optimization").when(not_list, "invalid_input")
              .when(bad_elem, "invalid_input").otherwise("run"))
    reason = (F.when(~is_obj, F.lit("invalid JSON payload")).when(falsy, F.lit(C.REASON_NO_DOCS))
              .when(not_list, F.lit("docs must be a list of strings"))
              .when(bad_elem, F.lit("docs must contain strings only")).otherwise(F.lit("")))
    return requests.select(
        "*", status.alias("status"),
        F.when(status == "invalid_input", F.lit("invalid_input")).alias("error_code"), reason.alias("reason"),
        F.when(status == "run", F.size(arr)).otherwise(F.lit(0)).cast("bigint").alias("n_docs"),
        F.when(status == "run", size).otherwise(F.lit(0)).cast("bigint").alias("initial_size"))

"""H4 compress_text: keep about ``rate`` of each doc's tokens, in original order.

Our lexical substitute for a neural token classifier: whitespace tokens keep
their spelling and are scored by the inverse document frequency of their
normalised form (lower-case letters/digits only) across the session's
compressed docs, or across a corpus whose term table is given; rarer first, then fewer repeats in the doc, then earlier.
Punctuation-only tokens score 0.  Each doc keeps ``ceil(rate * n_tokens)``
tokens; docs are joined by a blank line in rank order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionsift import constants as C
from sessionsift.functions.text import NON_WORD, SPACE_RUN
from sessionsift.operators.terms import looked_up
from sessionsift.session import materialize

S = "session_id"
#: Characters whose tokens meet in one task.
PART_CHARS = 2 << 20


def compress_text(docs: DataFrame, params: DataFrame | None = None, rate: str = "compression_rate",
                  order: str = "rank", terms: DataFrame | None = None) -> DataFrame:
    """``docs(session_id, order, text[, rate])`` -> ``(session_id, optimized_context)``; sessions without docs absent.

    The input is a bounded list per session (at most ``max_chunks`` docs), so
    the tokens are hash-partitioned by session once and every statistic is a
    window on that partitioning (no joins, no further exchanges), in as many
    partitions as their characters ask for.  ``terms`` (``operators.terms``)
    has the document frequencies of a corpus, which then take the place of those in the session.
    """
    if params is not None:
        docs = docs.join(params.select(S, rate), S)
    docs = materialize(docs.select(S, order, rate, "text"))  # read for its size and for its tokens
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    toks = (docs.select(S, order, rate, F.posexplode(F.split(F.col("text"), SPACE_RUN)).alias("tpos", "tok"))
            .where(F.col("tok") != "")
            .withColumn("norm", F.lower(F.regexp_replace("tok", NON_WORD, "")))
            .repartition(n, S))
    in_doc = Window.partitionBy(S, order)
    per_doc_norm = Window.partitionBy(S, order, "norm")
    if terms is None:
        toks = (toks.withColumn("N", F.size(F.collect_set(order).over(Window.partitionBy(S))))
                .withColumn("df", F.size(F.collect_set(order).over(Window.partitionBy(S, "norm")))))
    else:
        toks = materialize(toks)  # a bounded list for each session, read for its terms and again with their weights
        known, n_docs = looked_up(terms, toks.select("norm"))
        toks = toks.join(known, "norm", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("N", F.lit(n_docs)).repartition(n, S)
    toks = (toks.withColumn("tf", F.count(F.lit(1)).over(per_doc_norm))
            .withColumn("ntok", F.count(F.lit(1)).over(in_doc)))
    idf = F.log(F.lit(1.0) + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = toks.withColumn("w", F.when(F.col("norm") == "", F.lit(0.0)).otherwise(F.round(idf, C.SCORE_DIGITS)))
    w = Window.partitionBy(S, order).orderBy(F.col("w").desc(), F.col("tf").asc(), F.col("tpos").asc())
    keep = F.ceil(F.col(rate) * F.col("ntok"))
    kept = scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep)
    per_doc = (kept.groupBy(S, order)
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tpos", "tok"))),
                                             lambda x: x["tok"]), " ").alias("ctext")))
    return (per_doc.groupBy(S)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("ctext")))),
                                          lambda x: x["ctext"]), "\n\n").alias("optimized_context")))


def compress_scored(docs: DataFrame, scores: str, rate: str = "compression_rate", order: str = "slot") -> DataFrame:
    """H4 with given keep-scores, one per whitespace token (``scores`` array<double>): each doc keeps its
    ``ceil(rate * n_tokens)`` best-scored tokens, earlier ones first on ties, in their own order.

    Returns ``(session_id, optimized_context, error)``; a wrong number of scores is an error.
    """
    toks = F.filter(F.split(F.col("text"), SPACE_RUN), lambda t: t != "")
    d = docs.select(S, order, rate, scores, toks.alias("toks"))
    n = F.size("toks")
    order_by = F.array_sort(F.transform(F.col(scores), lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    kept = F.array_sort(F.transform(F.slice(order_by, 1, F.greatest(F.ceil(F.col(rate) * n).cast("int"), F.lit(0))), lambda x: x["i"]))
    text = F.array_join(F.transform(kept, lambda i: F.col("toks")[i]), " ")
    fits = F.size(scores) == n
    error = F.when(F.col(scores).isNotNull() & ~fits, F.format_string("ValueError: %d scores for %d tokens", F.size(scores), n))
    d = d.select(S, order, F.when(fits, text).alias("ctext"), error.alias("error"))
    parts = F.array_sort(F.collect_list(F.when(F.col("ctext").isNotNull(), F.struct(F.col(order), F.col("ctext")))))
    return d.groupBy(S).agg(F.array_join(F.transform(parts, lambda x: x["ctext"]), "\n\n").alias("optimized_context"), F.max("error").alias("error"))

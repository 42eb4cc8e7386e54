"""Ordered folds over a session's ranked list (G1, G2) and the corpus-scale dedupe.

G1/G2 run on the prefiltered candidates, at most ``cap`` docs per session, so
their per-session arrays are bounded.  The greedy walks are sequential by
definition; they are evaluated with the SQL higher-order ``aggregate`` fold
inside one row per session, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionsift.operators.rank import dense_cosine

S = "session_id"


# --------------------------------------------------------------------------- G1 neighbours
def lexical_neighbours(terms: DataFrame, thresholds: DataFrame, key: str = "rank",
                       threshold: str = "dedupe_threshold") -> DataFrame:
    """Earlier-ranked docs whose lexical cosine with a doc is >= threshold.

    ``terms`` = ``(session_id, key, term, tf)``.  Pairs only arise from shared
    terms inside one session (the self-join key is ``(session_id, term)``).
    Returns ``(session_id, key, nbrs array<int>)`` for docs with neighbours.
    """
    # the norms go along with the terms: the pairs are many more, and are dealt once, for their sums
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(S, key)))
    t = terms.withColumn("norm", norm)
    a = t.select(S, "term", F.col(key).alias("a"), F.col("tf").alias("tfa"), F.col("norm").alias("na"))
    b = t.select(S, "term", F.col(key).alias("b"), F.col("tf").alias("tfb"), F.col("norm").alias("nb"))
    dots = (a.join(b, [S, "term"]).where(F.col("b") < F.col("a"))
            .groupBy(S, "a", "b").agg(F.sum(F.col("tfa") * F.col("tfb")).alias("dot"), F.max("na").alias("na"), F.max("nb").alias("nb")))
    cos = F.col("dot") / (F.col("na") * F.col("nb"))  # unrounded: 0.8999996 is below 0.9
    return (dots.join(thresholds.select(S, threshold), S)
            .where(cos >= F.col(threshold))
            .groupBy(S, F.col("a").alias(key)).agg(F.array_sort(F.collect_list(F.col("b").cast("int"))).alias("nbrs")))


def dense_neighbours(vectors: DataFrame, thresholds: DataFrame, key: str = "rank",
                     threshold: str = "dedupe_threshold") -> DataFrame:
    """``lexical_neighbours`` for ``vectors(session_id, key, vec)`` of a bounded list per session."""
    a = vectors.select(S, F.col(key).alias("a"), F.col("vec").alias("va"))
    b = vectors.select(S, F.col(key).alias("b"), F.col("vec").alias("vb"))
    return (a.join(b, S).where(F.col("b") < F.col("a")).join(thresholds.select(S, threshold), S)
            .where(dense_cosine("va", "vb") >= F.col(threshold))
            .groupBy(S, F.col("a").alias(key)).agg(F.array_sort(F.collect_list(F.col("b").cast("int"))).alias("nbrs")))


# --------------------------------------------------------------------------- folds
def greedy_keep(items: Column) -> Column:
    """G1 fold: walk ``array<struct<rank,nbrs,...>>`` in rank order; keep a doc iff no kept neighbour."""
    return F.aggregate(
        F.array_sort(items),
        F.array().cast("array<int>"),
        lambda kept, x: F.when(F.arrays_overlap(kept, x["nbrs"]), kept).otherwise(F.array_append(kept, x["rank"])),
    )


def budget_fold(items: Column, budget: Column) -> Column:
    """G2 fold over ``array<struct<rank,len,first_score>>`` in rank order -> kept ranks.

    A doc that fits is taken; one that does not is skipped; an oversized doc
    is kept alone iff nothing was taken yet and its score > 0, then the walk
    stops; the walk stops once the remaining budget is <= 0.
    """
    init = F.struct(budget.cast("bigint").alias("rem"), (budget <= 0).alias("stop"),
                    F.array().cast("array<int>").alias("take"))

    def step(s, x):
        stopped = s["stop"] | (s["rem"] <= 0)
        too_big = x["len"] > s["rem"]
        keep_alone = (F.size(s["take"]) == 0) & (x["first_score"] > 0)
        return (F.when(stopped, F.struct(s["rem"].alias("rem"), F.lit(True).alias("stop"), s["take"].alias("take")))
                .when(too_big & keep_alone, F.struct(s["rem"].alias("rem"), F.lit(True).alias("stop"),
                                                     F.array_append(s["take"], x["rank"]).alias("take")))
                .when(too_big, s)
                .otherwise(F.struct((s["rem"] - x["len"]).alias("rem"), F.lit(False).alias("stop"),
                                    F.array_append(s["take"], x["rank"]).alias("take"))))

    return F.aggregate(F.array_sort(items), init, step)["take"]


def dedupe_semantic(ranked: DataFrame, nbrs: DataFrame) -> DataFrame:
    """G1: ranked docs ``(session_id, rank, ...)`` that survive the greedy walk."""
    items = (ranked.select(S, "rank").join(nbrs, [S, "rank"], "left")
             .select(S, F.struct(F.col("rank").cast("int").alias("rank"),
                                 F.coalesce("nbrs", F.array().cast("array<int>")).alias("nbrs")).alias("it")))
    kept = items.groupBy(S).agg(greedy_keep(F.collect_list("it")).alias("kept"))
    return ranked.join(kept.select(S, F.explode("kept").alias("rank")), [S, "rank"])


def prune_to_budget(ranked: DataFrame, params: DataFrame, budget: str = "total_prune_budget_chars") -> DataFrame:
    """Ranked docs ``(session_id, rank, text, first_score)`` kept by the char budget fold."""
    items = ranked.select(S, F.struct(F.col("rank").cast("int").alias("rank"),
                                      F.length("text").cast("bigint").alias("len"),
                                      F.col("first_score")).alias("it"))
    folded = (items.groupBy(S).agg(F.collect_list("it").alias("items"))
              .join(params.select(S, budget), S)
              .select(S, budget_fold(F.col("items"), F.col(budget)).alias("take")))
    return ranked.join(folded.select(S, F.explode("take").alias("rank")), [S, "rank"])

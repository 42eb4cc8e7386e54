"""Document frequencies of a growing corpus, for H4's weights.

The table is a committed one (``sources.committed``): every batch of documents adds a delta ``(term, df)`` with a row
without a term for the number of its documents.  Deltas add up, so new documents never need the old ones again, and a
repeated batch adds nothing; ``compact_terms`` makes one generation of them, in folders by a hash of the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift.functions.text import NON_WORD, SPACE_RUN
from sessionsift.session import materialize
from sessionsift.sources.committed import append_committed, compacted, read_committed

BUCKETS = 64
SCHEMA = "term string, df long, bucket int"
#: The most distinct terms that are broadcast to look up their frequencies.
LOOKUP_ROWS = 1_000_000


def weight_terms(text: Column) -> Column:
    """The distinct terms of a text as H4 weighs them: tokens at white space, lower-cased, letters and digits only."""
    return F.array_distinct(F.filter(F.transform(F.split(text, SPACE_RUN), lambda t: F.lower(F.regexp_replace(t, NON_WORD, ""))), lambda t: t != ""))


def _bucketed(rows: DataFrame) -> DataFrame:
    bucket = F.when(F.col("term").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    return rows.select("term", F.col("df").cast("long").alias("df"), bucket.alias("bucket")).repartition("bucket")


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(term, df)`` of ``docs``, blank ones excepted; the row without a term has their number."""
    some = docs.where(~F.coalesce(F.trim(F.regexp_replace(text, SPACE_RUN, " ")) == "", F.lit(True)))
    counts = some.select(F.explode(weight_terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.unionByName(some.agg(F.count("*").alias("df")).select(F.lit(None).cast("string").alias("term"), "df"))


def add_terms(docs: DataFrame, path: str, batch: str) -> bool:
    return append_committed(_bucketed(document_frequencies(docs)), path, batch, by=("bucket",))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``(term, df, bucket)``, summed over the deltas."""
    return read_committed(spark, path, SCHEMA).groupBy("term", "bucket").agg(F.sum("df").alias("df"))


def compact_terms(spark: SparkSession, path: str) -> bool:
    return compacted(spark, path, lambda rows, _: _bucketed(rows.groupBy("term").agg(F.sum("df").alias("df"))), by=("bucket",))


def looked_up(terms: DataFrame, needed: DataFrame) -> tuple[DataFrame, int]:
    """(``(norm, df)`` of the distinct ``needed(norm)``, number of documents).  The table is scanned, not shuffled,
    as long as few enough terms are needed."""
    needed = materialize(needed.where("norm <> ''").distinct())
    few = needed.count() <= LOOKUP_ROWS
    df = terms.where("term IS NOT NULL").select(F.col("term").alias("norm"), "df").join(F.broadcast(needed) if few else needed, "norm", "left_semi")
    n = terms.where("term IS NULL").agg(F.sum("df")).first()[0]
    return materialize(df.groupBy("norm").agg(F.sum("df").alias("df"))), int(n or 0)

"""Corpus pipeline over ``documents``: quality, line dedup, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the
last return the columns of ``docs``, with ``n_chars`` counted again where a stage changes the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift.llm import linededup, mixing, packing, quality, simhash
from sessionsift.llm.common import read_table, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    labels = read_table(spark, sf_dir, "labels").where(~quality.held_out())
    model = quality.fit(docs, labels)
    return docs.where(model.column(F.col("text")) >= quality.CUT)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the one of the largest id."""
    index = linededup.LineIndex.build(docs)
    changed = {"text": index.kept(F.col("text"), F.col("doc_id").cast("long"))["text"]}
    out = docs.withColumns(changed)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come up to three times."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learnt classifier or the tokeniser; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

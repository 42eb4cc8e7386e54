"""Driver queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionsift.llm import convrepair, convtrie, licenses, linededup, lm, minhash, mixing, packing, pii, quality, secretscan, simhash, vptree
from sessionsift.llm.common import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read_table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).select(*licenses.BASE_COLUMNS)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return minhash.with_class(minhash.with_neighbours(docs), minhash.text_classes(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2(F.col("kept.text").cast("binary"), 256).alias("kept_sha256"))


def op9_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.sampled(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair(convrepair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.find(read_table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_minhash": op7_minhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_vantage_points": op9_vantage_points,
    "op10_mix_sources": op10_mix_sources,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op8_line_dedup": linededup.ORACLE,
    "op9_vantage_points": vptree.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op11_conversation_repair": convrepair.ORACLE,
    "op13_prefix_trie": convtrie.ORACLE,
}

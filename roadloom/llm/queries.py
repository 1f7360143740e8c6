"""The queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import decontamination, langid, licenses, mixing, pii, quality, sharding, simhash, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that overlap."""
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))
    return quality.score(_table(spark, sf_dir, "documents"), ratings)


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return x.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op6_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_documents(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pareto_mixing, op2_spaced_seed_decontamination, op3_ordinal_quality, op4_golay_simhash, op5_anchor_pii, op6_compression_langid,
    op7_levenshtein_toxicity, op8_cover_tree_topk, op9_license_scan, op10_lookup_sharding,
)}

ORACLES = {"op1_pareto_mixing": mixing.ORACLE_SQL, "op8_cover_tree_topk": topk.ORACLE_SQL, "op9_license_scan": licenses.ORACLE_SQL, "op10_lookup_sharding": sharding.ORACLE_SQL}

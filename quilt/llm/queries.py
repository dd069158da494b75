"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.llm import bpe, embedding_dedup, fingerprints, html_text, mixing, ngram_join, periodic_runs, quality_model, quality_rules, sharding, spelling, suffix_dedup, warc
from quilt.llm.common import table
from quilt.llm.oracles import ORACLES


def vocabulary() -> str:
    """Path of the word-level BPE vocabulary; WORD_BPE_PATH overrides the installed one."""
    if path := os.environ.get("WORD_BPE_PATH"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    return warc.read(warc.write(table(spark, sf_dir, "pages"), folder), folder).drop("url")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=16)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).drop("th")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.join(table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding, "op2_embedding_dedup": op2_embedding_dedup, "op3_ngram_join": op3_ngram_join, "op5_quality_rules": op5_quality_rules, "op6_mixing": op6_mixing, "op4_quality_model": op4_quality_model, "op7_warc": op7_warc, "op8_suffix_dedup": op8_suffix_dedup, "op9_html_text": op9_html_text, "op10_bpe": op10_bpe, "op11_periodic_runs": op11_periodic_runs, "op12_spelling_variants": op12_spelling_variants, "op13_fingerprints": op13_fingerprints}
__all__ = ["ORACLES", "QUERIES"]

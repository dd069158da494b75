"""A training-corpus pipeline over ``documents``: five stages, each written and reread before the next.

Rows keep the columns of ``documents`` up to the last stage. Quality rules reject rows; of each group of near-duplicates the row with
the smallest id stays; long passages that stand earlier in the corpus are cut out of the texts (and n_chars follows); small sources
are repeated as the mixture's weights ask, every document at least once; the last stage encodes the texts.

A null id takes part in the quality rules and in mixing, and is never matched with others; of rows that repeat an id and its text, the one
whose other columns come first in order stays; rows that share an id and differ in text stay or go together; null and empty texts fail the quality
rules; texts of any length are taken whole; further columns go through up to the last stage, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.llm import bpe, mixing, ngram_join, quality_rules, queries, suffix_dedup
from quilt.llm.common import fresh, materialise, without

KEY, TEXT = "doc_id", "text"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the quality rules reject; the verdict is on id and text together."""
    row, h = fresh(docs, "_row", "_h")
    judged = quality_rules.judge(docs.withColumn(row, F.struct(F.col(KEY).alias("id"), F.xxhash64(TEXT).alias("h"))), key=row)
    rejected = judged.where("not kept").select(f"{row}.id", f"{row}.h").distinct()
    return without(docs.withColumn(h, F.xxhash64(TEXT)), rejected, {KEY: "id", h: "h"}).drop(h)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays, each of its texts once."""
    members, _ = ngram_join.join(docs, KEY, TEXT)
    losers = members.where("id <> component_id").select("id").distinct()
    left = without(docs, losers, {KEY: "id"})
    (twin,) = fresh(docs, "_again")
    again = materialise(docs.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(KEY).alias(twin)))
    if again.isEmpty():
        return left
    rest = [c for c in docs.columns if c not in (KEY, TEXT)]
    (other,) = fresh(docs, "_rest")
    once = left.join(again, F.col(KEY) == F.col(twin), "left_semi").groupBy(KEY, TEXT).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)])).alias(other))
    once = once.select(*[F.col(f"`{c}`") if c in (KEY, TEXT) else F.col(other)[c].alias(c) for c in docs.columns])
    return without(left, again, {KEY: twin}).unionByName(once)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of 100 bytes and more that start earlier in the corpus."""
    cut = suffix_dedup.strip(docs, KEY, TEXT)
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(TEXT).cast("long"))) if "n_chars" in docs.columns else cut


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat small sources towards the target entropy, no source more than twice as often as the largest."""
    return mixing.realise(docs, KEY, TEXT, target_entropy=0.99, repetition=2.0, floor_one=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.digests(docs, queries.vocabulary(), KEY, TEXT)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("suffix_dedup", repeats), ("mixing", mix), ("bpe", encode)]
#: No SQL for quantile estimates, hash-ordered permutations and byte-pair merges; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

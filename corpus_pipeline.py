"""A training corpus from ``documents``: language ID, near-duplicate removal,
benchmark decontamination, mixing to target weights, sharding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept; ``run`` writes every stage's rows as Parquet in the shared folder and
reads them back for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import hash_tree, ngram_join, raking, rank_profiles, string_tiling
from quarry.llm.common import DOCUMENT_COLUMNS, table, written

MIN_SCORE = 0.2  # a text further than this from every profile is in none of the languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language: neither ``und`` nor below MIN_SCORE. Their
    ``lang`` becomes the predicted one."""
    profiles = rank_profiles.learn(rank_profiles.training_rows(docs))
    found = rank_profiles.predicted(docs.select(*DOCUMENT_COLUMNS), profiles)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of every group of near copies; one
    without an id only where the group has none with."""
    return ngram_join.one_per_group(docs.select(*DOCUMENT_COLUMNS), null_ids_apart=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold most of a benchmark item, in whatever order."""
    return string_tiling.clean(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that tokens approach the raked margins."""
    return raking.mixed(docs.select(*DOCUMENT_COLUMNS)).where("sampled").select(*DOCUMENT_COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents into shards."""
    return hash_tree.shard(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Language profiles, greedy tiling and raking are not expressible in SQL; the tests
# hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

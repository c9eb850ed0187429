"""Registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_windows,
    collocations,
    hash_tree,
    line_runs,
    ngram_join,
    pii,
    pruned_graph,
    raking,
    rank_profiles,
    resampling,
    string_tiling,
    text_density,
    token_frames,
)
from .common import table


def op1_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled"
    )


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard(table(spark, sf_dir, "documents"))


def op4_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = rank_profiles.learn(rank_profiles.training_rows(docs))
    return rank_profiles.predicted(
        docs.select("doc_id", "text", rank_profiles.is_held_out().alias("held_out")), profiles
    ).drop("text")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.without_frequent_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_windows.read_back(chat_windows.windows(turns))


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.extract(table(spark, sf_dir, "pages"))


def op9_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_frames.write(table(spark, sf_dir, "documents"), public_tokenizers.path(token_frames.VOCABULARY))
    return token_frames.read(spark, path, with_ids=False)


QUERIES = {
    "op1_raking": op1_raking,
    "op2_weak_labels": op2_weak_labels,
    "op3_hash_tree": op3_hash_tree,
    "op4_rank_profiles": op4_rank_profiles,
    "op5_line_runs": op5_line_runs,
    "op6_chat_windows": op6_chat_windows,
    "op7_string_tiling": op7_string_tiling,
    "op8_text_density": op8_text_density,
    "op9_pruned_graph": op9_pruned_graph,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_collocations": op11_collocations,
    "op12_resampling": op12_resampling,
    "op13_token_frames": op13_token_frames,
}

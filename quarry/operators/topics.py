"""Topic analytics over hits: explode -> count -> enrich from topic tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_blank


def topic_ids(hits: DataFrame, keep: Sequence[str] = (), topics_col: str = "topics") -> DataFrame:
    """One row per topic reference; NULL or empty lists contribute nothing,
    elements without an id are skipped, repeats within a post are kept."""
    ids = F.col(f"{topics_col}.topic_hash_id")
    return hits.select(*keep, F.explode(ids).alias("topic_ids")).where(F.col("topic_ids").isNotNull())


def topic_counts(hits: DataFrame, by: Sequence[str] = (), topics_col: str = "topics") -> DataFrame:
    """``by.., topic_ids, count`` (partial aggregation before the shuffle, so a
    topic carried by a large share of posts is pre-combined map-side)."""
    return (
        topic_ids(hits, by, topics_col)
        .groupBy(*by, "topic_ids")
        .agg(F.count(F.lit(1)).cast("long").alias("count"))
    )


def first_topic(topics: DataFrame, topic_indexes: Sequence[str] | None = None) -> DataFrame:
    """One record per topic id from the searched topic tables; among copies the
    first by ``(seq, index_name)`` wins (deterministic)."""
    t = topics if topic_indexes is None else topics.where(F.col("index_name").isin(list(topic_indexes)))
    best = F.min_by(
        F.struct(F.col("topic_summary").alias("summary"), F.col("topic_narratives").alias("narratives")),
        F.struct("seq", "index_name"),
    )
    return t.groupBy("topic_hash_id").agg(best.alias("t")).select(
        F.col("topic_hash_id").alias("topic_ids"), "t.summary", "t.narratives"
    )


BROADCAST_IDS = 1_000_000  # referenced topic ids broadcast when counted below


def lookup_for(counts: DataFrame, topics: DataFrame, topic_indexes: Sequence[str] | None = None,
               check_size: bool = False) -> DataFrame:
    """First record per topic, restricted to topics the hits reference.

    The referenced ids are semi-joined into the topic scan before the
    aggregate, so the topic tables are reduced to matching rows first.  With
    ``check_size`` (inputs already materialised) the distinct ids are counted
    and broadcast when below :data:`BROADCAST_IDS`; otherwise Spark chooses.
    """
    ids = counts.select(F.col("topic_ids").alias("topic_hash_id")).distinct()
    if check_size and ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return first_topic(topics.join(ids, "topic_hash_id", "left_semi"), topic_indexes)


def enrich(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join of counts to topic records; unmatched topics get NULLs.

    The lookup has one row per topic id; AQE broadcasts it when its measured
    size is small and falls back to a shuffle join otherwise."""
    return counts.join(lookup, "topic_ids", "left")


def drop_empty(enriched: DataFrame) -> DataFrame:
    """Drop topics whose summary and narratives are both NULL or empty."""
    return enriched.where(~(is_blank("summary") & is_blank("narratives")))

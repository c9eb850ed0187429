"""Helpers shared by the operators: tables, the shared scratch folder, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, the folder all executors share.

    Only where that setting is absent (a local master, as in tests) a temporary
    folder takes its place, remembered on the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the table that ``written`` made, after its last use."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished queries, which it does once their
    plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def byte_batches(spark: SparkSession, rows: int = 256) -> None:
    """Small Arrow batches, so that a batch of long texts stays small in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(id, component)`` with the
    smallest reachable id, for every id that has an edge.

    Alternating large-star and small-star steps. Each round is one aggregation by
    node with map-side minima (no neighbour list is ever gathered) and one join,
    written to the shared folder; the number of rounds grows with the logarithm of
    the longest path. Raises when ``max_rounds`` do not suffice: never returns
    unfinished labels.
    """
    both = edges.where("a <> b").select("a", "b")
    pairs = written(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the least of u's closed neighbourhood
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
        )
        # small star: every smaller neighbour of u, and u, goes to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = written(small)
        # a star forest: one parent for each leaf, and none for a centre
        again = (
            after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
            .union(after.join(after.select(F.col("u").alias("p")), F.col("v") == F.col("p"), "left_semi").select("u"))
        )
        pairs = after
        if again.isEmpty():
            break
    else:
        raise RuntimeError(f"components: {max_rounds} rounds did not suffice")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()

"""Incremental facet table.

The selector lists are cached for an hour in an interactive tool; on Spark the
same need is a facet table kept up to date as new post files land: a file
stream, the one-pass ``(field, value)`` fan-out, a streaming count, and a
``foreachBatch`` sink that publishes the full current counts as a new version of
the table (``version=<epoch>``): readers of an older version keep their files.  ``availableNow`` processes everything that has arrived and stops, so
it runs as a scheduled batch; state and progress live under the checkpoint
location and survive executor or driver loss.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def facet_stream(stream: DataFrame, fields: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return (
        stream.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def start_refresh(spark: SparkSession, source_glob: str, schema: T.StructType, fields: Sequence[str],
                  table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    stream = spark.readStream.schema(schema).parquet(source_glob)

    def publish(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again after a failure writes its own version again
        out = batch.select("field", "value", F.col("count").cast("long"))
        out.write.mode("overwrite").parquet(f"{table_path}/version={epoch}")

    writer = facet_stream(stream, fields).writeStream.outputMode("complete").foreachBatch(publish)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()


def published(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest version of the facet table: ``field, value, count``."""
    table = spark.read.parquet(table_path)
    newest = table.select(F.max("version")).first()[0]
    return table.where(F.col("version") == newest).drop("version")


def refresh(spark: SparkSession, source_glob: str, schema: T.StructType, fields: Sequence[str],
            root: str) -> DataFrame:
    """Take in the files that arrived since the last call with the same ``root`` (a shared
    folder of the caller's choice: state and versions) and return the published table."""
    q = start_refresh(spark, source_glob, schema, fields, root + "/table", root + "/state")
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return published(spark, root + "/table")


# -- values that expire ----------------------------------------------------------------

def _buckets(stream: DataFrame, fields: Sequence[str], time_col: str, ttl: str, late: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return (
        stream.withWatermark(time_col, late)
        .select(F.col(time_col).alias("_at"), F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy(F.window("_at", ttl).alias("_w"), "field", "value")
        .agg(F.count(F.lit(1)).alias("count"), F.max("_at").alias("seen"))
        .select(F.col("_w.start").alias("bucket"), "field", "value", "count", "seen")
    )


def refresh_expiring(spark: SparkSession, source_glob: str, schema: T.StructType, fields: Sequence[str], time_col: str,
                     root: str, ttl: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Facet counts that forget: takes in the files that arrived since the last call and
    returns the live values (:func:`live`).

    Counts are kept by value and time bucket of length ``ttl``. The watermark, the newest
    time less ``late``, removes the state of buckets that have ended, so state is bounded by
    the values of the open ones; posts that arrive for an ended bucket are not counted. A
    refresh writes the changed (bucket, value) pairs alone."""

    def publish(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again after a failure writes its own changes again
        batch.write.mode("overwrite").parquet(f"{root}/changes/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(source_glob)
    q = (
        _buckets(stream, fields, time_col, ttl, late).writeStream.outputMode("update").foreachBatch(publish)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return live(spark, root, ttl)


def _latest(spark: SparkSession, root: str) -> DataFrame:
    """The last state of every (bucket, value): one partial aggregation over the changes."""
    changes = spark.read.parquet(f"{root}/changes")
    last = changes.groupBy("bucket", "field", "value").agg(F.max_by(F.struct("count", "seen"), "epoch").alias("s"))
    return last.select("bucket", "field", "value", "s.count", "s.seen")


def live(spark: SparkSession, root: str, ttl: str = "1 hour") -> DataFrame:
    """``field, value, count, seen``: values seen less than ``ttl`` before the newest post,
    with their counts in the buckets that were."""
    rows = _latest(spark, root)
    newest = rows.agg(F.max("seen")).scalar()
    kept = rows.where(F.col("seen") > newest - F.expr(f"INTERVAL {ttl}"))
    return kept.groupBy("field", "value").agg(F.sum("count").alias("count"), F.max("seen").alias("seen"))


def retire(spark: SparkSession, root: str, ttl: str = "1 hour") -> int:
    """Replace all changes by the live buckets, as the newest epoch's, and remove the older
    epochs' files. Call it between refreshes, not during one; returns the rows kept."""
    rows = _latest(spark, root)
    newest = rows.agg(F.max("seen")).scalar()
    kept = rows.where(F.col("seen") > newest - F.expr(f"INTERVAL {ttl}"))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/changes")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    epochs = sorted(int(s.getPath().getName().removeprefix("epoch=")) for s in system.listStatus(place)
                    if s.getPath().getName().startswith("epoch="))
    beside = f"{root}/retired-{epochs[-1]}"
    kept.write.mode("overwrite").parquet(beside)
    n = spark.read.parquet(beside).count()
    # the live rows are safe beside the changes before any of these goes
    spark.read.parquet(beside).write.mode("overwrite").parquet(f"{root}/changes/epoch={epochs[-1]}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for e in epochs[:-1]:
        system.delete(path(f"{root}/changes/epoch={e}"), True)
    system.delete(path(beside), True)
    return n

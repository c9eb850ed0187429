"""Stored corpus layout and result sinks.

Production layout: one Parquet table for all posts, partitioned by
``index_name`` (an index is a directory, an index selection is partition
pruning) and sorted by ``date_ts`` within files so date windows skip row
groups.  A cell-tagged copy (see :mod:`quarry.operators.ann`) is partitioned
by ``cell`` instead.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_corpus(df: DataFrame, path: str, partition_by: str = "index_name", sort_by: str | None = "date_ts",
                 mode: str = "overwrite", num_tasks: int | None = None) -> None:
    """Write posts partitioned by index (one directory per index).

    Rows are range-partitioned on ``(index, date)`` so an index holding a large
    share of all posts is split across many writer tasks (balanced by Spark's
    sampled range bounds) instead of landing in one; each task writes its
    rows date-sorted, so files carry tight date min/max statistics.  Without a
    sort column a row hash is the second range key, so a hot directory value
    (an index or cell with a third of all rows) is still split.
    """
    second = F.col(sort_by) if sort_by and sort_by in df.columns else F.xxhash64(*df.columns)
    n = num_tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(partition_by), second]
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out.write.mode(mode).partitionBy(partition_by).parquet(path)


def read_corpus(spark: SparkSession, path: str, indexes: Sequence[str] | None = None,
                partition_by: str = "index_name", schema: T.StructType | None = None) -> DataFrame:
    """Read the stored corpus; an index selection becomes a partition filter.

    With ``schema`` no file is opened to find it; without, the footers of all are read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    df = reader.parquet(path)
    return df if indexes is None else df.where(F.col(partition_by).isin(list(indexes)))


def union_indexes(frames: Sequence[DataFrame]) -> DataFrame:
    """Union per-index tables whose schemas differ (missing columns -> NULL)."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_hits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sink for hit tables (parquet or csv with a header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def write_context(packed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink for packed contexts: one JSON line per question."""
    packed.write.mode(mode).json(path)


def stored_indexes(spark: SparkSession, path: str, partition_by: str = "index_name") -> DataFrame:
    """The index names of a stored corpus, from its directory listing: no file is opened."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [s.getPath().getName() for s in listed if s.isDirectory()]
    mark = f"{partition_by}="
    found = sorted(unquote(n[len(mark) :]) for n in names if n.startswith(mark))
    missing = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the directory of null
    return spark.createDataFrame([(None if n == missing else n,) for n in found], f"{partition_by} string")


def write_sorted(df: DataFrame, path: str, order: Sequence[str | Column], fmt: str = "parquet", mode: str = "overwrite",
                 num_tasks: int | None = None) -> None:
    """Write ``df`` so that its files, one after the other, are in ``order``: range partitions,
    sorted within. Rows that tie are spread by a hash, so that one hot value fills no task."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = num_tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys.append(F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]))
    write_hits(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys), path, fmt, mode)


def read_sorted(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """A table of :func:`write_sorted` (Parquet) with each row's place in the order, from 1. The
    rows before a file come from one count per file; no row is sorted again."""
    rows = spark.read.parquet(path)
    file = F.col("_metadata.file_name")
    sizes = rows.select(file.alias("f")).groupBy("f").count().collect()
    base, total = [], 0
    by_task = sorted(((r["f"], r["count"]) for r in sizes), key=lambda x: (int(re.match(r"part-(\d+)", x[0])[1]), x[0]))
    for name, n in by_task:
        base.append((name, total))
        total += n
    places = F.broadcast(spark.createDataFrame(base, "_file string, _base long"))  # one row per file
    placed = rows.select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row")).join(places, "_file")
    return placed.withColumn(position, F.col("_base") + F.col("_row") + 1).drop("_file", "_base", "_row")

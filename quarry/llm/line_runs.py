"""Line dedup by levelled sorted runs of line hashes (operator 5, native).

Batches of documents arrive one after the other. Each adds one sorted run of
(line hash, documents) to level 0, anti-joined with the keys the runs have already
settled, which need no further counts. A level that holds ``fanout`` runs is merged
into one run of the next level. A key found in ``min_docs`` documents or more is
settled: its lines go everywhere.

DataFrame functions only; the runs are Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 3
FANOUT = 3
RUN_SHARE = 8  # a run, 24 bytes a key, takes one file for so many shuffle partitions

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A line's key, hashed twice with independent seeds; null for a key below the length.
_KEYS = (
    "transform(transform(split(coalesce(text, ''), '\\n', -1), x -> trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM x)), "
    "x -> if(length(x) < {min_chars}, null, transform(array(if(octet_length(x) = length(x), lower(x), "
    f"translate(x, '{_UPPER}', '{_UPPER.lower()}'))), "
    "k -> named_struct('a', xxhash64(k), 'b', xxhash64('line', k)))[0]))"
)


class LineRuns:
    """The runs of one corpus. ``add`` takes a batch of ``(text, ...)`` rows; every
    row counts as a document of its own."""

    def __init__(
        self,
        spark: SparkSession,
        min_docs: int = MIN_DOCS,
        min_chars: int = MIN_CHARS,
        fanout: int = FANOUT,
        path: str | None = None,
    ):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.path = path or scratch(spark)
        self.levels: list[list[DataFrame]] = [[]]
        self.runs = 0

    def keys(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``line_keys``: one pair of hashes per line, in order."""
        return docs.withColumn("line_keys", F.expr(_KEYS.format(min_chars=self.min_chars)))

    def _write(self, counts: DataFrame) -> DataFrame:
        self.runs += 1
        files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // RUN_SHARE)
        return written(counts.coalesce(files).sortWithinPartitions("a", "b"), f"{self.path}/run-{self.runs}")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        all_runs = runs[0]
        for run in runs[1:]:
            all_runs = all_runs.union(run)
        return all_runs.groupBy("a", "b").agg(F.sum("n").alias("n"))

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def settled(self) -> DataFrame:
        """Keys found in ``min_docs`` documents or more so far."""
        runs = self._all()
        if not runs:
            return self.spark.createDataFrame([], "a long, b long")
        return self._merged(runs).where(F.col("n") >= self.min_docs).select("a", "b")

    def add(self, keyed: DataFrame) -> None:
        """Count the lines of a batch that has ``line_keys``."""
        own = keyed.select(F.explode(F.array_distinct("line_keys")).alias("k")).where("k is not null")
        counts = own.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("n"))
        if self._all():
            counts = counts.join(self.settled(), ["a", "b"], "left_anti")
        self.levels[0].append(self._write(counts))
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._merged(runs)))
                self.levels[level] = []


def without_frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` for every row of ``docs(doc_id, text)``.

    Lines are what ``\\n`` separates; a line's key is the line without
    ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of ``min_chars`` code
    points or more found in ``min_docs`` rows or more lose all their lines.

    * null or empty text: one empty line, kept;
    * equal rows are documents each and count each; rows with a null or repeated
      doc_id are told apart by their texts;
    * an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    runs = LineRuns(spark, min_docs, min_chars)
    keyed = []
    for i in range(batches):
        batch = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
        batch = written(runs.keys(batch).select("doc_id", "text_hash", "line_keys"))
        runs.add(batch)
        keyed.append(batch)
    lines = keyed[0]
    for batch in keyed[1:]:
        lines = lines.union(batch)
    frequent = written(runs.settled())
    dropped = (
        lines.select("doc_id", "text_hash", F.posexplode("line_keys").alias("at", "k"))
        .where("k is not null")
        .select("doc_id", "text_hash", "at", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
        .join(frequent, ["a", "b"], "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("at").alias("dropped"))
    )
    other = dropped.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "dropped")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = "array_except(sequence(0, size(line) - 1), dropped)"
    return (
        docs.join(other, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")), "left")
        .withColumn("line", split)
        .select(
            "doc_id",
            F.size("line").cast("long").alias("n_lines"),
            F.coalesce(F.expr("if(dropped is null, 0, size(dropped))"), F.lit(0)).cast("long").alias("n_dropped"),
            F.expr(
                f"if(dropped is null, coalesce(text, ''), array_join(transform({left}, i -> line[i]), '\\n'))"
            ).alias("kept"),
        )
    )

"""Importance resampling towards a target text: hashed n-gram weights and a Gumbel draw.

Words are runs of a-z, 0-9 and non-ASCII characters (A-Z lower-cased); features are all
runs of one to three words, and a feature's bucket is the CRC-32 of its UTF-8 bytes, words
joined by one space, modulo :data:`BUCKETS`. Two counts, over the documents and over the
target's texts, give every bucket an integer gain. The gains are an array of fixed size
that is broadcast; a document's weight is the sum of the array's entries over
its features, its score the weight plus Gumbel noise from a hash of its id.

``drawn`` takes the best scores without a global sort. Scores are written once; counts over
that table narrow the cutoff down, :data:`PIVOTS` thresholds a job, first over the scores,
then over the ids that tie at the cutoff, then over row numbers where an id repeats. Only
the drawn rows are range-partitioned and sorted, and numbered by partition.

CRCs are computed for all words of a window at once: the register is linear, so that of
a run follows from those of its words (see :func:`_append`).

Edge cases: a null or empty text has no features, weight 0, and is never drawn; a null
doc_id draws as the text ``null`` and loses ties against ids; of rows with one score and
one id, those stored first win; an empty table or target gives no rows or equal gains of
the smoothing; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import written

BUCKETS = 10_000
LONGEST = 3  # words of a feature
MIN_WORDS = 20
PERCENT = 5
SEED = 42
PIVOTS = 31  # thresholds counted by one job
LAST_ID = (1 << 63) - 1  # a null id, in ties

SPACE = spans.separators(lambda b: b < 0x80 and not (48 <= b < 58 or 97 <= b < 123))

_FULL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """The register's step for each byte value (polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_BYTE = _byte_table()


def _step(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _BYTE[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


def _lookup(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The linear map that ``table`` gives for each of the four bytes."""
    return (
        table[0, register & np.uint32(255)]
        ^ table[1, (register >> np.uint32(8)) & np.uint32(255)]
        ^ table[2, (register >> np.uint32(16)) & np.uint32(255)]
        ^ table[3, register >> np.uint32(24)]
    )


def _zero_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for 0 to SHORT zero bytes, side by side (entry ``(n * 4 + k) * 256 + byte``),
    and for 1, 2, 4, 8, ... zero bytes."""
    values = np.arange(256, dtype=np.uint32)
    now = np.stack([values << np.uint32(8 * k) for k in range(4)])
    rows = []
    for _ in range(spans.SHORT + 1):
        rows.append(now)
        now = _step(now, 0)
    powers = [rows[1]]
    for _ in range(40):
        powers.append(_lookup(powers[-1], powers[-1]))
    return np.stack(rows).reshape(-1), powers


_ZEROS, _POWERS = _zero_tables()


def _past(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The register after ``n`` zero bytes."""
    short = np.minimum(n, spans.SHORT).astype(np.uint32) << np.uint32(10)
    out = (
        _ZEROS[short + (register & np.uint32(255))]
        ^ _ZEROS[short + np.uint32(256) + ((register >> np.uint32(8)) & np.uint32(255))]
        ^ _ZEROS[short + np.uint32(512) + ((register >> np.uint32(16)) & np.uint32(255))]
        ^ _ZEROS[short + np.uint32(768) + (register >> np.uint32(24))]
    )
    for i in np.flatnonzero(n > spans.SHORT):
        r, left = register[i : i + 1], int(n[i])
        for k, table in enumerate(_POWERS):
            if left >> k & 1:
                r = _lookup(table, r)
        out[i] = r[0]
    return out


def _append(register: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The register after a space and a word of ``n`` bytes, whose own register from
    zero is ``word``."""
    return _past(_step(register, 32), n) ^ word


def _registers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The register from zero over each word's bytes."""
    order, n, long = spans.by_length(start, end)
    s, size = start[order], n[order]
    r = np.zeros(len(s), np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size.astype(np.int16), -j, "left"))
        r[:m] = _step(r[:m], data[s[:m] + j])
    out = np.empty_like(r)
    out[order] = r
    for i in np.flatnonzero(long):
        out[i] = zlib.crc32(data[start[i] : end[i]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def buckets(data: np.ndarray, offsets: np.ndarray):
    """For each window of a batch ``(words' texts, features' texts, features' buckets)``."""
    held = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for s, e, text, _ in spans.words(data, offsets, SPACE):
        old = len(held[0])
        word = np.concatenate([held[0], _registers(data, s, e)])
        n = np.concatenate([held[1], e - s])
        doc = np.concatenate([held[2], text])
        run = _past(np.full(len(n), _FULL), n) ^ word
        texts, found = [doc[old:]], [run[old:]]
        for k in range(1, LONGEST):
            run = _append(run[:-1], word[k:], n[k:])
            new = np.arange(k, len(n)) >= old
            new &= doc[k:] == doc[: len(doc) - k]
            texts.append(doc[k:][new])
            found.append(run[new])
        yield text, np.concatenate(texts), (np.concatenate(found) ^ _FULL) % np.uint32(BUCKETS)
        keep = LONGEST - 1
        held = word[-keep:], n[-keep:], doc[-keep:]


def _counting(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, found in buckets(*spans.lowered(b.column("text"))):
            counts += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["bucket", "n"])


def feature_counts(texts: DataFrame) -> np.ndarray:
    """Features of all ``text`` by bucket. Each task counts its own, so at most
    :data:`BUCKETS` rows leave a task and reach the driver."""
    found = texts.select("text").mapInArrow(_counting, "bucket int, n long")
    counts = np.zeros(BUCKETS, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, floored."""
    s_all, t_all = int(raw.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(((t + 1) * (s_all + BUCKETS)) / ((s + 1) * (t_all + BUCKETS))))
            for s, t in zip(raw.tolist(), target.tolist())
        ],
        np.int64,
    )


def noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    key = f"{SEED}:{'null' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scoring(gain):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches):
        values = gain.value
        for b in batches:
            n = b.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for words, texts, found in buckets(*spans.lowered(b.column("text"))):
                n_words += np.bincount(words, minlength=n)
                n_features += np.bincount(texts, minlength=n)
                order = np.argsort(texts, kind="stable")
                sums = np.concatenate([[0], np.cumsum(values[found[order]])])
                at = np.searchsorted(texts[order], np.arange(n + 1))
                weight += sums[at[1:]] - sums[at[:-1]]
            ids = b.column("doc_id")
            score = weight + np.array([noise(i) for i in ids.to_pylist()], np.int64)
            columns = [ids] + [pa.array(x) for x in (n_words, n_features, weight, score)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(feature_counts(docs), feature_counts(target)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scoring(gain), "doc_id long, n_words long, n_features long, weight long, score long"
    )


def least_enough(df: DataFrame, column: str, need: int) -> int:
    """The least value ``c`` for which ``need`` rows (at least one, and no more than there
    are) have ``column <= c``. Every job counts the rows up to :data:`PIVOTS` thresholds
    and keeps the one interval between two of them that holds the answer."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        step = max(1, (hi - lo) // (PIVOTS + 1))
        at = [p for p in range(lo, hi, step)][: PIVOTS + 1]
        counts = df.agg(*[F.count(F.when(F.col(column) <= F.lit(p), 1)).alias(f"p{i}") for i, p in enumerate(at)]).first()
        enough = next((i for i, n in enumerate(counts) if n >= need), None)
        if enough is None:
            lo = at[-1] + 1
        else:
            hi = at[enough]
            lo = at[enough - 1] + 1 if enough else lo
    return hi


def ranked(rows: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """``rows`` numbered from 1 by ``order`` (a total one): range partitions, sorted,
    written with each row's place, which Spark's row ids hold beside the partition."""
    if rows.isEmpty():
        return rows.withColumn(rank, F.lit(None).cast("long"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("_part")).count().collect())  # at most n rows
    before, total = [], 0
    for p, size in sizes:
        before.append((p, total))
        total += size
    base = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _base long"))
    at = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).join(base, "_part")
    return placed.withColumn(rank, F.col("_base") + at + 1).drop("_place", "_part", "_base")


def drawn(scores: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, ... by falling score for the drawn rows, null for the
    others. Drawn are ``percent`` of the rows with ``min_words`` words, rounded down; ties go to
    the smaller doc_id."""
    tie = F.coalesce(F.col("doc_id"), F.lit(LAST_ID))
    table = written(
        scores.withColumns({"_loss": -F.col("score"), "_tie": tie, "_row": F.monotonically_increasing_id()})
    )
    able = table.where(F.col("n_words") >= min_words)
    left = able.count() * percent // 100
    keys, chosen, rest = ["_loss", "_tie", "_row"], F.lit(False), able
    if left:
        equal = F.lit(True)
        for key in keys:
            cut = least_enough(rest, key, left)
            chosen = chosen | (equal & (F.col(key) < cut))
            left -= rest.where(F.col(key) < cut).count()
            equal = equal & (F.col(key) == cut)
            rest = able.where(equal)
            if rest.count() <= left:
                break
        chosen = chosen | equal
    chosen = (F.col("n_words") >= min_words) & chosen
    best = ranked(table.where(chosen), keys)
    return best.unionByName(table.where(~chosen).withColumn("rank", F.lit(None).cast("long"))).drop(*keys)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document."""
    return drawn(scored(docs, target), percent)

"""Pre-filtered exact top-k vector search, for one question or a table of them.

Plan:

1. ``corpus`` is filtered first (the caller's ``where`` is pushed into the
   scan), projected to ``key, vector`` only.
2. Small question tables (at most :data:`FAST_QUESTIONS` rows within the
   byte budget, proven by one width-capped ``limit`` fetch) are broadcast.
   ``mapInArrow`` scans each corpus partition in Arrow batches (vectors read
   from the flat Arrow buffer): one float32 matrix product per batch and
   question slice, exact float64 re-scoring of a small candidate pool, and a
   running per-partition top-k by ``(distance, key)``.  The corpus is read
   once and never shuffled; each task emits at most ``k`` rows per question.
3. Larger question tables never pass through the driver: they are joined to
   the corpus in bounded tiles (:mod:`quarry.operators.tiles`).
4. Per-question merge with ``row_number() <= k`` (Spark plans a partial
   ``WindowGroupLimit`` before the shuffle).  With many candidate sources a
   first merge level by ``(question, key-hash bucket)`` bounds the rows that
   reach any single task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vectors as V
from quarry.operators import tiles
from quarry.operators.ranking import merge_levels, top_per_group
from quarry.session import ship_package

DEFAULT_K = 30  # fixed value: results per search
DEFAULT_BLOCK_BYTES = 64 << 20  # question broadcast budget and tile budget (float64 bytes)
QUESTION_CHUNK = 256  # questions scored together inside one kernel call
SCAN_ROWS = 2048  # corpus rows per kernel call: a 256 x 2048 float32 key matrix stays in cache
ATTACH_BROADCAST_ROWS = 2_000_000  # hits (questions x k) broadcast when provably below
MERGE_BUCKETS = 32  # first merge level of a scan: key-hash buckets per question, whatever the number of tasks
STATE_BYTES = 24  # one row of a running top-k: question, key, distance
# Question tables within the byte budget are broadcast (the corpus is then
# never shuffled); the row cap only bounds the fetch for very narrow vectors.
FAST_QUESTIONS = 1 << 18


def _partition_topk(state, qid: np.ndarray, key: np.ndarray, dist: np.ndarray, k: int):
    """Merge new candidates into a running top-k: arrays ``(qid, key, dist)``
    ordered by ``(qid, dist, key)``, at most ``k`` rows per question (NumPy
    only: one lexsort and a group rank, no pandas)."""
    if state is not None:
        qid = np.concatenate([state[0], qid])
        key = np.concatenate([state[1], key])
        dist = np.concatenate([state[2], dist])
    order = np.lexsort((key, dist, qid))
    qid, key, dist = qid[order], key[order], dist[order]
    n = len(qid)
    if n:
        starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]])
        rank = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        keep = rank < k
        qid, key, dist = qid[keep], key[keep], dist[keep]
    return qid, key, dist


def _limits(state, sid: np.ndarray, k: int) -> np.ndarray | None:
    """Each question's k-th distance in a running top-k, infinite while it has fewer rows."""
    if state is None or not len(state[0]):
        return None
    last = np.flatnonzero(np.r_[state[0][1:] != state[0][:-1], True])
    full = np.diff(np.r_[-1, last]) >= k
    held = state[0][last]
    at = np.minimum(np.searchsorted(held, sid), len(held) - 1)
    return np.where((held[at] == sid) & full[at], state[2][last][at], np.inf)


def question_slices(qids: np.ndarray, qmat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Questions cut into :data:`QUESTION_CHUNK`-row slices scored together."""
    return [(qids[s : s + QUESTION_CHUNK], qmat[s : s + QUESTION_CHUNK]) for s in range(0, len(qids), QUESTION_CHUNK)]


def _nearer(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else np.minimum(a, b)


def score_block(states: list | None, x, keys, slices, k, metric, known: list | None = None) -> list:
    """Fold one corpus batch ``x`` (with ``keys``) into the running top-k of
    every question slice.  Each slice keeps its own state, so a merge sorts at
    most ``QUESTION_CHUNK x k`` old rows however many questions there are.
    ``known`` (for each slice, a distance for each question): rows beyond it may be left out."""
    states = states if states is not None else [None] * len(slices)
    for r0 in range(0, len(x), SCAN_ROWS):  # sub-blocks keep each key matrix cache-sized
        b = V.Batch(x[r0 : r0 + SCAN_ROWS])  # float32 copy and norms once per sub-block
        kb = keys[r0 : r0 + SCAN_ROWS]
        for j, (sid, smat) in enumerate(slices):
            limit = _nearer(_limits(states[j], sid, k), known[j] if known else None)
            rows, cols, d = V.topk_block(b, smat, k, metric, limit)
            if not len(rows) and states[j] is not None:
                continue
            states[j] = _partition_topk(states[j], sid[cols], kb[rows], d, k)
    return states


def finish(states: list | None, key_col: str) -> pd.DataFrame | None:
    """Concatenate per-slice states into ``question_id, <key_col>, distance``."""
    done = [s for s in (states or []) if s is not None and len(s[0])]
    if not done:
        return None
    return pd.DataFrame({
        "question_id": np.concatenate([s[0] for s in done]).astype(np.int64),
        key_col: np.concatenate([s[1] for s in done]),
        "distance": np.concatenate([s[2] for s in done]),
    })


def to_batch(out: pd.DataFrame, key_col: str):
    """Candidates as an Arrow batch ``question_id, <key_col>, distance``."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(out["question_id"].to_numpy(), pa.int64()), pa.array(out[key_col].to_numpy()),
         pa.array(out["distance"].to_numpy(), pa.float64())],
        names=["question_id", key_col, "distance"],
    )


def _make_kernel(block, k: int, metric: str, key_col: str, vec_col: str):
    """Per-partition top-k against the broadcast questions, streaming the
    partition's Arrow batches (memory: one batch plus the running top-k).
    Vectors are read from the batch's flat Arrow buffer, not row by row."""

    def kernel(batches):
        qids, qmat = block.value
        slices = question_slices(qids, qmat)
        states = None
        for b in batches:
            if b.num_rows:
                x = V.arrow_matrix(b.column(vec_col))
                keys = b.column(key_col).to_numpy(zero_copy_only=False)
                states = score_block(states, x, keys, slices, k, metric)
        out = finish(states, key_col)
        if out is not None:
            yield to_batch(out, key_col)

    return kernel


def small_questions(questions: DataFrame, qid: str, vec: str, block_bytes: int, k: int):
    """The question table as ``(ids, float64 matrix)`` when it is provably
    small, else ``None`` (the caller then uses the tile join).

    The vector width is read from one row first, so the fetch is limited to
    ``min(FAST_QUESTIONS, block_bytes / (8 d + 24 k))`` rows (what a task holds of a
    question: its vector and its running top-k; plus one row to detect a larger table) before anything big reaches the driver; ``limit`` stops
    reading early, and the rows arrive as one Arrow table.  Questions without
    a vector or an id have no hits; vectors of unequal width are an error."""
    q = questions.where(F.col(vec).isNotNull() & F.col(qid).isNotNull())
    first = q.select(F.size(vec)).limit(1).collect()
    if not first:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    cap = min(FAST_QUESTIONS, block_bytes // (8 * max(1, int(first[0][0])) + STATE_BYTES * k))
    if cap <= 0:
        return None
    table = q.select(F.col(qid).cast("long").alias("q"), F.col(vec).alias("v")).limit(cap + 1).toArrow()
    if table.num_rows > cap:
        return None
    ids = table.column("q").to_numpy()
    mat = V.arrow_matrix(table.column("v"))  # one flat buffer, no per-row objects
    return ids, mat


def merge_topk(cands: DataFrame, k: int, key_col: str, levels: int = 1) -> DataFrame:
    """Global top-k per question from per-partition (or per-tile) candidates."""
    return top_per_group(cands, ["question_id"], [("distance", True), (key_col, True)], k, key_col, "rank", levels)


def search(
    corpus: DataFrame,
    questions: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "l2",
    key_col: str = "id",
    vector_col: str = "embedding",
    question_id_col: str = "question_id",
    question_vector_col: str = "embedding",
    block_bytes: int = DEFAULT_BLOCK_BYTES,
    attach_to: DataFrame | None = None,
    merge_buckets: int = MERGE_BUCKETS,
) -> DataFrame:
    """Top-``k`` rows of ``corpus`` per question.

    Returns ``question_id, <key_col>, rank, distance, score`` where ``distance``
    is the metric's ranking key (``d^2`` for l2) and ``score`` the engine score.
    Rows without a vector cannot be hits.  With ``attach_to`` the hits are
    joined to that table's columns on ``key_col``.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if vector_col not in corpus.columns:
        raise ValueError(f"corpus has no vector column {vector_col!r}")
    ship_package()
    spark = corpus.sparkSession
    key_type = corpus.schema[key_col].dataType
    out_schema = T.StructType(
        [
            T.StructField("question_id", T.LongType()),
            T.StructField(key_col, key_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    base = corpus.where(F.col(vector_col).isNotNull()).select(key_col, vector_col)
    small = small_questions(questions, question_id_col, question_vector_col, block_bytes, k)
    if small is None:
        cands, n_questions, chunks = tiles.search(  # counts the corpus without reading vectors
            corpus.select(key_col, vector_col), questions, k, metric, key_col, vector_col,
            question_id_col, question_vector_col, tile_bytes=block_bytes,
        )
        levels = merge_levels(chunks)
    elif len(small[0]):
        n_questions = len(small[0])
        shipped = spark.sparkContext.broadcast(small)
        cands = base.mapInArrow(_make_kernel(shipped, k, metric, key_col, vector_col), out_schema)
        levels = merge_buckets
    else:
        cands, levels, n_questions = spark.createDataFrame([], out_schema), 1, 0
    top = merge_topk(cands, k, key_col, levels).select(
        "question_id", key_col, "rank", "distance",
        V.score_from_key("distance", metric).alias("score"),
    )
    if attach_to is None:
        return top
    return attach(top, attach_to, key_col, rows_bound=n_questions * k)


def search_vector(corpus: DataFrame, vector: Sequence[float], k: int = DEFAULT_K, **kw) -> DataFrame:
    """Single-question search with a literal query vector (``question_id`` 0)."""
    spark = corpus.sparkSession
    q = spark.createDataFrame(
        [(0, [float(v) for v in vector])], "question_id long, embedding array<double>"
    )
    return search(corpus, q, k=k, **kw)


def search_jvm(
    corpus: DataFrame,
    vector: Sequence[float],
    k: int = DEFAULT_K,
    metric: str = "l2",
    key_col: str = "id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Single-question search entirely in the JVM (distance via higher-order
    functions, ``orderBy().limit()`` -> ``TakeOrderedAndProject``).  Used as a
    cross-check of the kernel and where Python workers are unavailable."""
    qv = F.array(*[F.lit(float(v)) for v in vector])
    scored = corpus.where(F.col(vector_col).isNotNull()).select(
        key_col, V.distance_key(F.col(vector_col), qv, metric).alias("distance")
    )
    top = scored.orderBy(F.col("distance").asc(), F.col(key_col).asc()).limit(k)
    w = Window.orderBy(F.col("distance").asc(), F.col(key_col).asc())
    return top.select(
        F.lit(0).cast("long").alias("question_id"), key_col,
        F.row_number().over(w).cast("long").alias("rank"), "distance",
        V.score_from_key("distance", metric).alias("score"),
    )


def with_threshold(hits: DataFrame, min_score: float) -> DataFrame:
    """Keep hits scoring at least ``min_score`` (applied after the top-k)."""
    return hits.where(F.col("score") >= F.lit(min_score))


def attach(hits: DataFrame, corpus: DataFrame, key_col: str = "id", rows_bound: int | None = None) -> DataFrame:
    """Join hits back to corpus columns on ``key_col``.

    A search returns at most ``questions x k`` rows; when that proven bound is
    below :data:`ATTACH_BROADCAST_ROWS` the hits are broadcast and the corpus
    is streamed through without a shuffle.  Otherwise a shuffle join (AQE may
    still demote it at run time)."""
    if rows_bound is not None and rows_bound <= ATTACH_BROADCAST_ROWS:
        return corpus.join(F.broadcast(hits), key_col, "inner")
    return hits.join(corpus, key_col, "inner")


def hit_totals(
    hits: DataFrame, filtered: DataFrame, vector_col: str = "embedding", questions: DataFrame | None = None
) -> DataFrame:
    """Per question: ``n_hits`` (rows returned) and ``n_filtered`` (rows that
    passed the filter and carry a vector, i.e. the whole candidate set). With
    ``questions`` (a ``question_id`` column) those without hits get 0."""
    n = filtered.where(F.col(vector_col).isNotNull()).agg(F.count(F.lit(1)))
    per_q = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_hits"))
    if questions is not None:
        asked = questions.select("question_id").distinct()
        per_q = asked.join(per_q, "question_id", "left").na.fill(0, ["n_hits"])
    return per_q.withColumn("n_filtered", n.scalar())  # scalar subquery, one row

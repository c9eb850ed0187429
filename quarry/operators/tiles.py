"""Top-k search for question tables too large to broadcast, with no driver hop.

Corpus rows and questions are cut into *tiles* keyed by
``(cell, corpus chunk, question block)``:

* ``cell`` is the coarse cell of an approximate search (a constant for the
  exact search).  A question appears once per probed cell.
* each cell's questions are hashed into ``t`` blocks that fit the tile byte
  budget (a block is held in memory), and its corpus rows into ``s`` chunks.
  Every block is another copy of the cell's rows: a budget that asks for more
  than :data:`COPIES` of them is raised, up to :data:`BLOCK_BYTES`, so that the
  copies do not grow with the questions.
  Chunks are *streamed*, so their count follows parallelism (about two tiles
  per task slot, a cell's share following its rows) and a cap on rows per
  task, not memory.  ``s`` and ``t`` come from one count per cell (a table with
  one row per cell, bounded by the number of cells).
* a corpus row is sent to the ``t`` blocks of its cell, a question to the
  ``s`` chunks of its cells.  A cell holding a third of all rows (or probed by
  a third of all questions) gets proportionally more chunks (blocks): no task
  grows with it.

Both sides are unioned, repartitioned by tile and sorted within partitions by
``(tile, role)``, so in every group the question rows come before the corpus
rows (a secondary sort).  Grouped ``applyInArrow`` in its iterator form then
holds the question block, streams the corpus rows Arrow batch by batch (vectors
read from the flat buffers) through the same NumPy kernel as the broadcast
path, and emits at most ``k`` rows per question; the per-question merge is
:func:`quarry.operators.knn.merge_topk`.
Exact search over all pairs costs |questions| x |corpus| distance evaluations
whatever the plan; the tiles keep every task's memory bounded and ship the
corpus ``t`` times and each question ``s`` times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vectors as V

DEFAULT_TILE_BYTES = 64 << 20  # float64 bytes of one question block held by a task
BLOCK_BYTES = 16 << 20  # no block is larger, whatever the budget
COPIES = 16  # blocks of a cell up to which the budget holds; beyond, blocks grow up to BLOCK_BYTES
MIN_CHUNK_ROWS = 256  # corpus chunks are not cut smaller than this for parallelism
MAX_CHUNK_ROWS = 1 << 22  # rows of one corpus chunk per task (bounds task time and retry cost)
TILE = "_tile"  # tiles of all cells, chunks and blocks, numbered without gaps
QUESTION, CORPUS = 0, 1  # row roles; questions sort first within a tile


def _cell_counts(df: DataFrame, cell: str, vec: str) -> dict[int, tuple[int, int]]:
    """``cell -> (rows, max dimension)``; one row per cell reaches the driver."""
    rows = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).collect()
    return {int(r[0]): (int(r["n"]), int(r["d"] or 0)) for r in rows}


def _counts_frame(cells: DataFrame, q: DataFrame, with_corpus: bool) -> DataFrame:
    """``_r, _cell, n, d`` per side and cell (corpus side: no vector column)."""
    qside = q.select(F.lit(QUESTION).alias("_r"), "_cell", F.size("_qvec").alias("_d"))
    both = qside
    if with_corpus:
        both = cells.select(F.lit(CORPUS).alias("_r"), "_cell", F.lit(None).cast("int").alias("_d")).unionByName(qside)
    return both.groupBy("_r", "_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("d"))


def _both_counts(cells: DataFrame, q: DataFrame, with_corpus: bool) -> tuple[dict, dict]:
    """Per-cell corpus rows (``cells`` holds only ``_cell``, so the count reads
    no vectors) and per-cell ``(rows, max dimension)`` of the questions, in one
    job; one row per cell and side reaches the driver."""
    rows = _counts_frame(cells, q, with_corpus).collect()
    corpus_counts: dict[int, int] = {}
    question_counts: dict[int, tuple[int, int]] = {}
    for r in rows:
        if r["_r"] == CORPUS:
            corpus_counts[int(r["_cell"])] = int(r["n"])
        else:
            question_counts[int(r["_cell"])] = (int(r["n"]), int(r["d"] or 0))
    return corpus_counts, question_counts


def plan_tiles(corpus_counts: dict[int, float], question_counts: dict[int, tuple[int, int]],
               tile_bytes: int = DEFAULT_TILE_BYTES, min_tiles: int = 1,
               max_chunk_rows: int | None = None) -> dict[int, tuple[int, int]]:
    """``cell -> (corpus chunks, question blocks)`` for every cell with questions.

    ``corpus_counts`` may be estimates (they only size the chunks): a cell
    counted empty still gets one chunk, so no corpus row can be left out.
    Question blocks stay within ``tile_bytes`` (width from the questions), unless
    more than :data:`COPIES` were needed, and always within :data:`BLOCK_BYTES`.
    Corpus chunks are spread so that there are about ``min_tiles`` tiles
    (chunks x blocks) in all - a cell's share follows its rows, never below
    :data:`MIN_CHUNK_ROWS` rows per chunk - and no chunk exceeds
    ``max_chunk_rows`` (default :data:`MAX_CHUNK_ROWS`)."""
    max_chunk_rows = max_chunk_rows or MAX_CHUNK_ROWS
    d = max((dq for _, dq in question_counts.values()), default=1)
    width = 8 * max(1, d)
    asked, most = max(1, tile_bytes // width), max(1, BLOCK_BYTES // width)
    both = {c: (max(1.0, float(corpus_counts.get(c, 0))), m) for c, (m, _) in question_counts.items() if m}
    total = sum(n for n, _ in both.values())
    plan = {}
    for c, (n, m) in both.items():
        t = math.ceil(m / min(most, max(asked, math.ceil(m / COPIES))))
        # the cell's share of the wanted tiles, over its question blocks: every
        # extra chunk copies all the cell's questions once more
        spread = min(math.ceil(min_tiles * n / total / t), math.ceil(n / MIN_CHUNK_ROWS))
        plan[c] = (max(1, spread, math.ceil(n / max_chunk_rows)), t)
    return plan


def _kernel(k: int, metric: str, key_col: str):
    from quarry.operators.knn import finish, question_slices, score_block, to_batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids: list[np.ndarray] = []
        qmats: list[np.ndarray] = []
        qlimits: list[np.ndarray] = []
        slices = known = None
        states = None
        for b in batches:
            role = b.column("_role").to_numpy(zero_copy_only=False)
            is_q = role == QUESTION
            if is_q.any():
                if slices is not None:
                    raise RuntimeError("tile rows out of order: question after corpus rows")
                qb = b.filter(pa.array(is_q))
                qids.append(qb.column("_qid").to_numpy(zero_copy_only=False).astype(np.int64))
                qmats.append(V.arrow_matrix(qb.column("_qvec")))
                if "_qlimit" in qb.schema.names:
                    qlimits.append(qb.column("_qlimit").to_numpy(zero_copy_only=False))
            if is_q.all():
                continue
            if slices is None:
                if not qids:
                    return  # no question in this tile
                slices = question_slices(np.concatenate(qids), np.vstack(qmats))
                if qlimits:
                    limits = np.concatenate(qlimits)
                    known = [x for x, _ in question_slices(limits, limits)]
                qids, qmats, qlimits = [True], [], []  # held once, in the slices
            cb = b.filter(pa.array(~is_q))
            x = V.arrow_matrix(cb.column("_vec"))
            states = score_block(states, x, cb.column(key_col).to_numpy(zero_copy_only=False), slices, k, metric, known)
        out = finish(states, key_col)
        if out is not None:
            yield to_batch(out, key_col)

    return run


def search(corpus: DataFrame, questions: DataFrame, k: int, metric: str = "l2", key_col: str = "id",
           vector_col: str = "embedding", question_id_col: str = "question_id",
           question_vector_col: str = "embedding", cell_col: str | None = None,
           tile_bytes: int = DEFAULT_TILE_BYTES,
           corpus_counts: dict[int, float] | None = None,
           question_limit_col: str | None = None) -> tuple[DataFrame, int, int]:
    """Per-tile top-``k`` candidates ``question_id, <key_col>, distance``.

    With ``cell_col`` both tables carry it (questions once per probed cell) and
    only same-cell pairs are scored.  ``corpus_counts`` (rows per cell, may be
    estimates) skips counting the corpus; otherwise it is counted from the
    cell column alone (pass the corpus without a vector-null filter and the
    count reads no vectors; rows without a vector are dropped when scored).
    ``question_limit_col``: a distance beyond which the question needs no row.
    Returns the candidates, the number of question rows (questions x probed
    cells: an upper bound on the questions, for result bounds) and the largest
    chunk count (for the merge fan-in)."""
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    spark = corpus.sparkSession
    key_type = corpus.schema[key_col].dataType
    vec_type = corpus.schema[vector_col].dataType
    qvec_type = questions.schema[question_vector_col].dataType
    cell = F.col(cell_col).cast("int") if cell_col else F.lit(0)
    cells_only = corpus.select(cell.alias("_cell"))
    c = corpus.where(F.col(vector_col).isNotNull())
    q = questions.where(F.col(question_vector_col).isNotNull() & F.col(question_id_col).isNotNull())
    c = c.select(cell.alias("_cell"), F.lit(CORPUS).alias("_role"), F.col(key_col), F.col(vector_col).alias("_vec"),
                 F.lit(None).cast("long").alias("_qid"), F.lit(None).cast(qvec_type).alias("_qvec"),
                 F.lit(None).cast("double").alias("_qlimit"))
    asked_limit = F.lit(None) if question_limit_col is None else F.col(question_limit_col)
    q = q.select(cell.alias("_cell"), F.lit(QUESTION).alias("_role"), F.lit(None).cast(key_type).alias(key_col),
                 F.lit(None).cast(vec_type).alias("_vec"), F.col(question_id_col).cast("long").alias("_qid"),
                 F.col(question_vector_col).alias("_qvec"), asked_limit.cast("double").alias("_qlimit"))
    limits = [] if question_limit_col is None else ["_qlimit"]
    counted, q_counts = _both_counts(cells_only, q, with_corpus=corpus_counts is None)
    slots = spark.sparkContext.defaultParallelism
    plan = plan_tiles(counted if corpus_counts is None else corpus_counts, q_counts, tile_bytes, 2 * slots)
    out_schema = T.StructType([
        T.StructField("question_id", T.LongType()),
        T.StructField(key_col, key_type),
        T.StructField("distance", T.DoubleType()),
    ])
    if not plan:
        return spark.createDataFrame([], out_schema), 0, 1
    if cell_col is None:  # exact search: one cell, literal shape
        (s_n, t_n), = plan.values()
        literal = {"_s": F.lit(s_n), "_t": F.lit(t_n), "_base": F.lit(0)}
        c, q = c.withColumns(literal), q.withColumns(literal)
    else:  # one row per cell: a broadcast side bounded by the number of cells
        shapes, base = [], 0
        for cc, (s_n, t_n) in sorted(plan.items()):
            shapes.append((cc, s_n, t_n, base))
            base += s_n * t_n
        shape = F.broadcast(spark.createDataFrame(shapes, "_cell int, _s int, _t int, _base int"))
        c, q = c.join(shape, "_cell"), q.join(shape, "_cell")
    c = (
        c.withColumn("_cs", F.pmod(F.xxhash64(F.col(key_col)), F.col("_s")).cast("int"))
        .withColumn("_qt", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    )
    q = (
        q.withColumn("_qt", F.pmod(F.xxhash64(F.col("_qid")), F.col("_t")).cast("int"))
        .withColumn("_cs", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    )
    cols = [(F.col("_base") + F.col("_cs") * F.col("_t") + F.col("_qt")).alias(TILE), "_role", key_col, "_vec", "_qid", "_qvec", *limits]
    n_tiles = sum(s_n * t_n for s_n, t_n in plan.values())
    # several tiles may share a task (each is still its own group): the
    # shuffle width stays near the cluster's, however many tiles there are
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * slots)
    rows = (
        q.select(*cols).unionByName(c.select(*cols))
        .repartitionById(min(n_tiles, width), F.col(TILE))  # dense ids: an even number of tiles per task
        .sortWithinPartitions(TILE, "_role")  # questions first inside every tile
    )
    cands = rows.groupBy(TILE).applyInArrow(_kernel(k, metric, key_col), out_schema)
    question_rows = sum(m for m, _ in q_counts.values())
    return cands, question_rows, max(s_n for s_n, _ in plan.values())

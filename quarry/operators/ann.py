"""Approximate top-k search with coarse cells (inverted-file style).

* :func:`build_cells` fits k-means on the corpus vectors (distributed
  ``pyspark.ml`` Lloyd iterations over the whole table) and tags every row
  with its nearest centroid ``cell``.  Stored partitioned by ``cell``
  (:func:`quarry.sources.corpus.write_corpus`), a cell filter prunes whole
  directories.
* :func:`search` picks the ``nprobe`` nearest cells per question (centroids
  are ``n_cells x d``, bounded by the parameter) and scores each question
  only against rows of its own probed cells, then merges like the exact
  search.  A question table within the broadcast budget is shipped with its
  probe lists and the corpus is filtered to the union of probed cells
  (partition pruning when stored by cell); a larger one stays distributed:
  :func:`assign_probes` runs on executors and questions meet their cells'
  rows in bounded ``(cell, chunk, block)`` tiles (:mod:`quarry.operators.tiles`).

A question probes its ``nprobe`` nearest cells, and further ones in centroid order
until the rows that pass the corpus filter reach ``max(k, min_rows)``: a selective
filter never leaves a question short of hits while the corpus has them.
``nprobe >= n_cells`` reproduces the exact search.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vectors as V
from quarry.operators import knn, tiles
from quarry.session import ship_package


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray  # (n_cells, d) float64
    ids: tuple[int, ...] = ()  # value of ``cell`` for each centroid; empty: 0, 1, 2, ...

    @property
    def n_cells(self) -> int:
        return int(self.centroids.shape[0])

    @property
    def cell_ids(self) -> np.ndarray:
        return np.asarray(self.ids or range(self.n_cells), dtype=np.int64)


def build_cells(corpus: DataFrame, n_cells: int, vector_col: str = "embedding", seed: int = 7,
                max_iter: int = 10) -> tuple[Cells, DataFrame]:
    """Fit cells on the corpus vectors; return them and the corpus with ``cell``.

    The Lloyd iterations are distributed ``pyspark.ml`` jobs over every vector
    (cached by the estimator)."""
    with_vec = corpus.where(F.col(vector_col).isNotNull())
    feats = with_vec.withColumn("_features", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol="cell").fit(feats)
    centroids = np.stack([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    tagged = model.transform(feats).drop("_features")
    return Cells(centroids), tagged


def cells_of(tagged: DataFrame, vector_col: str = "embedding") -> Cells:
    """Cells of a corpus that carries ``cell`` already: the mean vector of each. One row
    per cell reaches the driver. Rows without a vector or cell do not count."""
    values = tagged.where(F.col("cell").isNotNull()).select(
        "cell", F.posexplode(F.col(vector_col).cast("array<double>")).alias("i", "v")
    )
    means = values.groupBy("cell", "i").agg(F.avg("v").alias("m"))
    rows = means.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("dims")).collect()
    rows.sort(key=lambda r: r["cell"])
    centroids = np.array([[x["m"] for x in r["dims"]] for r in rows], dtype=np.float64)
    return Cells(centroids if rows else np.zeros((0, 0)), tuple(int(r["cell"]) for r in rows))


def write_cells(tagged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a cell-tagged corpus partitioned by ``cell`` so a probe set
    becomes a partition filter (whole directories skipped)."""
    from quarry.sources.corpus import write_corpus

    write_corpus(tagged, path, partition_by="cell", sort_by=None, mode=mode)


def read_cells(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_summary(tagged: DataFrame, columns: Sequence[str | Column], path: str, vector_col: str = "embedding",
                  mode: str = "overwrite") -> None:
    """Store, beside a cell-tagged corpus, how many rows with a vector each cell has by the
    values of ``columns`` (filter columns, or expressions of them such as a timestamp's
    day). One row for every combination that occurs."""
    rows = tagged.where(F.col(vector_col).isNotNull()).groupBy("cell", *columns).agg(F.count("*").alias("n_rows"))
    rows.write.mode(mode).parquet(path)


def held_rows(summary: DataFrame) -> DataFrame:
    """``cell, n_rows`` of a summary to which the search's filter was applied: what
    :func:`search` takes as ``held`` instead of counting the filtered corpus."""
    return summary.groupBy("cell").agg(F.sum("n_rows").alias("n_rows"))


PROBE_CHUNK = 1024  # questions whose centroid keys are computed together


def _probes(cells: Cells, qmat: np.ndarray, nprobe: int, metric: str) -> np.ndarray:
    """(m, p) nearest cells per question, nearest first (ties by cell id).
    Computed in question chunks, so memory is PROBE_CHUNK x n_cells at most."""
    n, p = cells.n_cells, min(nprobe, cells.n_cells)
    out = np.empty((len(qmat), p), dtype=np.int64)
    for s in range(0, len(qmat), PROBE_CHUNK):
        keys = V.block_keys(cells.centroids, qmat[s : s + PROBE_CHUNK], metric).T  # (m, n)
        part = np.argpartition(keys, p - 1, axis=1)[:, :p] if p < n else np.tile(np.arange(n), (len(keys), 1))
        order = np.lexsort((part, np.take_along_axis(keys, part, axis=1)))  # by key, then cell
        out[s : s + PROBE_CHUNK] = np.take_along_axis(part, order, axis=1)
    return out


def _probed(cells: Cells, qmat: np.ndarray, nprobe: int, metric: str, rows: np.ndarray,
            need: int) -> tuple[np.ndarray, np.ndarray]:
    """(question index, cell id) of every probe: the ``nprobe`` nearest cells, and the
    next ones while the cells before them hold fewer than ``need`` rows. ``rows``:
    filtered rows of each cell, in centroid order."""
    found_q, found_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(qmat), PROBE_CHUNK):
        near = _probes(cells, qmat[s : s + PROBE_CHUNK], cells.n_cells, metric)
        held = rows[near]
        wanted = np.cumsum(held, axis=1) - held < need
        wanted[:, :nprobe] = True
        q, at = np.nonzero(wanted)
        found_q.append(q + s)
        found_c.append(cells.cell_ids[near[q, at]])
    return np.concatenate(found_q), np.concatenate(found_c)


def _members(flat_q: np.ndarray, flat_c: np.ndarray) -> dict[int, np.ndarray]:
    """cell -> indices of the questions probing it (one sort, no cell x question scan)."""
    order = np.argsort(flat_c, kind="stable")
    c_sorted, q_sorted = flat_c[order], flat_q[order]
    starts = np.flatnonzero(np.r_[True, c_sorted[1:] != c_sorted[:-1]]) if len(c_sorted) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(c_sorted)]
    return {int(c_sorted[a]): q_sorted[a:b] for a, b in zip(starts, ends)}


def _make_kernel(bq, k, metric, key_col, vec_col):
    def kernel(batches):
        qids, qmat, probes = bq.value
        members = _members(*probes)
        slices: dict[int, list] = {}  # cell -> its questions' slices, built when the cell first appears
        states: dict[int, list] = {}  # a running top-k per (cell, question slice)
        for b in batches:
            if not b.num_rows:
                continue
            x = V.arrow_matrix(b.column(vec_col))
            keys = b.column(key_col).to_numpy(zero_copy_only=False)
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            order = np.argsort(cells, kind="stable")  # the batch's rows grouped by cell with one sort
            cs = cells[order]
            starts = np.flatnonzero(np.r_[True, cs[1:] != cs[:-1]])
            for a, e in zip(starts, np.r_[starts[1:], len(cs)]):
                c = int(cs[a])
                if c not in members:
                    continue
                if c not in slices:
                    qi = members[c]
                    slices[c] = knn.question_slices(qids[qi], qmat[qi])
                rows = order[a:e]
                states[c] = knn.score_block(states.get(c), x[rows], keys[rows], slices[c], k, metric)
        out = knn.finish([s for st in states.values() for s in st], key_col)
        if out is not None:
            yield knn.to_batch(out, key_col)

    return kernel


def assign_probes(questions: DataFrame, cells: Cells, nprobe: int, metric: str = "l2",
                  question_id_col: str = "question_id", question_vector_col: str = "embedding",
                  rows: np.ndarray | None = None, need: int = 0) -> DataFrame:
    """``question_id, <vector>, cell``: one row per probed cell of each question,
    computed on executors against the broadcast centroids (``n_cells x d``,
    bounded by the parameter, not by the data). ``rows`` and ``need``: see :func:`_probed`."""
    ship_package()
    held = np.zeros(cells.n_cells, np.int64) if rows is None else rows
    bc = questions.sparkSession.sparkContext.broadcast((cells, held))
    out = T.StructType([
        T.StructField(question_id_col, T.LongType()),
        T.StructField(question_vector_col, T.ArrayType(T.DoubleType())),
        T.StructField("cell", T.IntegerType()),
    ])

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            qmat = V.arrow_matrix(b.column(question_vector_col))
            known, held = bc.value
            asked, found = _probed(known, qmat, nprobe, metric, held, need)
            at = pa.array(asked)
            yield pa.RecordBatch.from_arrays(
                [b.column(question_id_col).take(at), b.column(question_vector_col).take(at),
                 pa.array(found.astype(np.int32))],
                names=[question_id_col, question_vector_col, "cell"],
            )

    q = questions.where(F.col(question_vector_col).isNotNull() & F.col(question_id_col).isNotNull())
    q = q.select(F.col(question_id_col).cast("long").alias(question_id_col),
                 F.col(question_vector_col).cast("array<double>").alias(question_vector_col))
    return q.mapInArrow(probe, out)


def search(tagged: DataFrame, cells: Cells, questions: DataFrame, k: int = knn.DEFAULT_K, nprobe: int = 8,
           metric: str = "l2", key_col: str = "id", vector_col: str = "embedding",
           question_id_col: str = "question_id", question_vector_col: str = "embedding",
           block_bytes: int = knn.DEFAULT_BLOCK_BYTES, min_rows: int = 0,
           merge_buckets: int = knn.MERGE_BUCKETS, held: DataFrame | None = None) -> DataFrame:
    """Approximate top-k per question over a cell-tagged, possibly filtered corpus.
    Every question meets at least ``max(k, min_rows)`` rows, or all there are. The filtered
    rows of each cell come from ``held`` (:func:`held_rows`), so that planning reads a
    summary alone; without it one count per cell is taken of the filtered corpus first.

    A small question table (bounded fetch) is broadcast with its probe lists
    and the corpus is filtered to the probed cells (partition pruning when
    stored by cell).  A larger one stays distributed: probes are assigned on
    executors and questions meet corpus rows of the same cell in bounded tiles
    (:mod:`quarry.operators.tiles`), hot cells split on both sides."""
    ship_package()
    spark = tagged.sparkSession
    out_schema = T.StructType([
        T.StructField("question_id", T.LongType()),
        T.StructField(key_col, tagged.schema[key_col].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    if held is None:
        held = tagged.where(F.col(vector_col).isNotNull()).groupBy("cell").agg(F.count("*").alias("n_rows"))
    counts = {int(r["cell"]): int(r["n_rows"]) for r in held.collect() if r["cell"] is not None}
    rows = np.array([counts.get(int(c), 0) for c in cells.cell_ids], dtype=np.int64)
    need = max(k, min_rows)
    # a task may hold every probed cell's copy of its questions: all copies of the
    # question matrix must fit the budget for the broadcast path
    p = max(1, min(nprobe, cells.n_cells))
    small = knn.small_questions(questions, question_id_col, question_vector_col, block_bytes // p, k)
    probes = None
    if small is not None and len(small[0]) and cells.n_cells:
        probes = _probed(cells, small[1], nprobe, metric, rows, need)
        if len(probes[0]) * (8 * small[1].shape[1] + knn.STATE_BYTES * k) > block_bytes:
            small = None
    if not counts or not cells.n_cells or (small is not None and not len(small[0])):
        cands = spark.createDataFrame([], out_schema)
    elif small is None:
        probed = assign_probes(questions, cells, nprobe, metric, question_id_col, question_vector_col, rows, need)
        cands, _, _ = tiles.search(
            tagged.select(key_col, vector_col, "cell"), probed, k, metric, key_col, vector_col,
            question_id_col, question_vector_col, cell_col="cell", tile_bytes=block_bytes,
            corpus_counts=counts,
        )
    else:
        probed_cells = sorted({int(c) for c in np.unique(probes[1])})
        base = tagged.where(F.col("cell").isin(probed_cells)).select(key_col, vector_col, "cell")
        bq = spark.sparkContext.broadcast((*small, probes))
        cands = base.mapInArrow(_make_kernel(bq, k, metric, key_col, vector_col), out_schema)
    return knn.merge_topk(cands, k, key_col, merge_buckets).select(
        "question_id", key_col, "rank", "distance", V.score_from_key("distance", metric).alias("score")
    )


def recall(approx: DataFrame, exact: DataFrame, key_col: str = "id") -> float:
    """Mean per-question recall of ``approx`` against ``exact`` (same k)."""
    j = exact.alias("e").join(approx.alias("a"), ["question_id", key_col], "left")
    r = j.groupBy("question_id").agg(
        (F.count(F.col("a.rank")) / F.count(F.lit(1))).alias("r")
    ).agg(F.avg("r")).first()[0]
    return float(r or 0.0)

"""Exact top-k search that leaves out whole cells of a stored corpus by lower bounds.

The corpus is stored in *units*: every row belongs to its nearest centroid and, within
that cell, to a ring of distances from it. For a question at distance ``t`` of a centroid, no row of
a ring from ``low`` to ``high`` is nearer than ``max(0, t - high, low - t)`` (the triangle
inequality). A question visits its units in order of that bound, and is closed when its
k-th distance is below the bound of the next unit: then no unvisited row can be a hit. Rows
beyond the k-th distance of the rounds before are neither kept nor sent on.

Rounds. In the first a question visits units until they hold ``k`` rows, in each further
one ``growth`` times as many as so far, but none beyond its k-th distance. A round is one
Spark job over the open questions: bounds are computed on executors against the broadcast
units (their number is a parameter), and questions meet the units' rows in the bounded tiles of
:mod:`quarry.operators.tiles`, hot units and hot question blocks split. What a round
found is written, so that no round is computed twice. The centroids are fitted on a bounded
sample; they decide the cost and never the result. A filter on the stored corpus needs no
count: units that look full and are not only cost another round.

How much is left out depends on the data: clustered vectors skip most units, vectors
spread evenly in many dimensions none, and then every pair is scored, as by
:func:`quarry.operators.knn.search`. :class:`Found` reports the rows scored by question.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vectors as V
from quarry.operators import knn, tiles
from quarry.session import scratch, ship_package, written

METRICS = ("l2", "cosine")  # those with a triangle inequality (cosine: of unit vectors)
SAMPLE = 20_000  # rows the centroids are fitted on
GROWTH = 8
MARGIN = 1e-9  # relative slack of a bound, above the rounding of float64
PRUNED_UNITS = 4096  # units named in a partition filter at most


@dataclass(frozen=True)
class Units:
    """Units of a stored corpus, by id: centroid, ring and number of rows."""

    metric: str
    ids: np.ndarray  # (u,) value of ``cell``
    centroids: np.ndarray  # (u, d)
    low: np.ndarray  # (u,) least and greatest distance of a row from the centroid
    high: np.ndarray
    rows: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(m, u) lower bounds of the distance between a question and a unit's rows."""
        t = _distances(_placed(q, self.metric), self.centroids)
        b = np.maximum(t - self.high, self.low - t) - MARGIN * (1.0 + t + self.high)
        return np.maximum(b, 0.0)


@dataclass(frozen=True)
class Found:
    hits: DataFrame  # question_id, <key>, rank, distance, score
    effort: DataFrame  # question_id, n_units, n_scored
    rounds: int


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space of the bounds: as they are, or of length 1 for cosine."""
    if metric == "l2":
        return x
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(V.block_keys(x, c, "l2"), 0.0))


def fit_centroids(corpus: DataFrame, n_cells: int, key_col: str = "id", vector_col: str = "embedding",
                  metric: str = "l2", sample: int = SAMPLE, iterations: int = 8) -> np.ndarray:
    """k-means on the ``sample`` rows with the least hash of their key."""
    rows = corpus.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(key_col), key_col).limit(sample)
    x = V.arrow_matrix(rows.select(vector_col).toArrow().column(0))
    x = _placed(x, metric)
    x = x[np.isfinite(x).all(axis=1)] if len(x) else x
    if not len(x):
        return np.zeros((0, 0))
    c = x[np.linspace(0, len(x) - 1, min(n_cells, len(x))).astype(int)]
    for _ in range(iterations):
        near = V.block_keys(x, c, "l2").argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _tagged(corpus: DataFrame, centroids: np.ndarray, metric: str, vector_col: str) -> DataFrame:
    """``corpus`` with ``_cell`` and ``_to``, its distance from the centroid. Rows that are
    nobody's neighbour (null, not finite, zero under cosine) are left out."""
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*corpus.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_to", T.DoubleType())])

    def tag(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _placed(V.arrow_matrix(b.column(vector_col)), metric)
            t = _distances(x, shared.value)
            ok = np.isfinite(t).all(axis=1)
            t, b = t[ok], b.filter(pa.array(ok))
            cell = t.argmin(axis=1) if len(t) else np.zeros(0, np.int64)
            columns = [*b.columns, pa.array(cell.astype(np.int32)), pa.array(t[np.arange(len(t)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "_cell", "_to"])

    return corpus.where(F.col(vector_col).isNotNull()).mapInArrow(tag, schema)


def store(corpus: DataFrame, path: str, n_cells: int = 256, rings: int = 4, key_col: str = "id",
          vector_col: str = "embedding", metric: str = "l2", sample: int = SAMPLE) -> None:
    """Write ``corpus`` by unit (``path/rows``, partitioned by ``cell``) and its units
    (``path/units``: at most ``n_cells * rings`` rows)."""
    from quarry.operators.ann import write_cells

    if metric not in METRICS:
        raise ValueError(f"no bound for metric {metric!r}")
    ship_package()
    spark = corpus.sparkSession
    centroids = fit_centroids(corpus, n_cells, key_col, vector_col, metric, sample)
    if not len(centroids):
        corpus.limit(0).withColumn("cell", F.lit(0)).write.parquet(f"{path}/rows")
        spark.createDataFrame([], _UNITS).write.parquet(f"{path}/units")
        return
    tagged = written(_tagged(corpus, centroids, metric, vector_col), "tagged")
    share = [i / rings for i in range(1, rings)]
    edges = tagged.groupBy("_cell").agg(
        (F.percentile_approx("_to", share, 1000) if share else F.array().cast("array<double>")).alias("_edges")
    )  # one row per cell
    ring = F.size(F.filter("_edges", lambda e: e < F.col("_to")))
    rows = tagged.join(F.broadcast(edges), "_cell").withColumn("cell", F.col("_cell") * F.lit(rings) + ring)
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "_cell int, centroid array<double>")
    units = rows.groupBy("cell", "_cell").agg(F.min("_to").alias("low"), F.max("_to").alias("high"), F.count("*").alias("rows"))
    units.join(F.broadcast(places), "_cell").withColumn("metric", F.lit(metric)).select(
        "cell", "centroid", "low", "high", "rows", "metric"
    ).write.parquet(f"{path}/units")
    write_cells(rows.drop("_cell", "_to", "_edges"), f"{path}/rows")


_UNITS = "cell int, centroid array<double>, low double, high double, rows long, metric string"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Units]:
    rows = spark.read.schema(_UNITS).parquet(f"{path}/units").orderBy("cell").collect()
    units = Units(
        rows[0]["metric"] if rows else "l2",
        np.array([r["cell"] for r in rows], np.int64),
        np.array([r["centroid"] for r in rows], np.float64) if rows else np.zeros((0, 0)),
        np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]),
        np.array([r["rows"] for r in rows], np.int64),
    )
    return spark.read.parquet(f"{path}/rows"), units


def next_units(units: Units, q: np.ndarray, visited: np.ndarray, limit: np.ndarray, k: int,
               growth: int = GROWTH) -> tuple[np.ndarray, np.ndarray]:
    """(question index, unit index) to visit now. ``visited``: units each question has been to,
    the first in its order; ``limit``: its k-th distance, infinite while it has fewer hits."""
    asked, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(q), 1024):
        b = units.bounds(q[s : s + 1024])
        b[~np.isfinite(b).all(axis=1)] = np.inf  # such a question has no neighbour
        order = np.argsort(b, axis=1, kind="stable")
        closed = (b <= limit[s : s + 1024, None]).sum(axis=1)
        closed = np.where(np.isfinite(b).any(axis=1), closed, 0)
        been = visited[s : s + 1024]
        held = np.cumsum(units.rows[order], axis=1)
        first = (held < k).sum(axis=1) + 1
        until = np.minimum(closed, np.where(been == 0, first, growth * been))
        at = np.arange(order.shape[1])
        now, place = np.nonzero((at >= been[:, None]) & (at < until[:, None]))
        asked.append(now + s)
        found.append(order[now, place])
    return np.concatenate(asked), np.concatenate(found)


def _scale(metric: str) -> float:
    """The distance key is d^2, and 1 - cos = d^2 / 2 of unit vectors."""
    return 1.0 if metric == "l2" else 2.0


def _probes(open_questions: DataFrame, units: Units, k: int, growth: int) -> DataFrame:
    """``question_id, cell, n`` (rows of the unit) and ``limit``: the question's k-th distance key
    so far, or infinite."""
    scale = _scale(units.metric)
    shared = open_questions.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        known = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q = V.arrow_matrix(b.column("_qvec"))
            limit = b.column("_limit").to_numpy(zero_copy_only=False).astype(np.float64)
            visited = b.column("_visited").to_numpy(zero_copy_only=False).astype(np.int64)
            at, unit = next_units(known, q, visited, limit, k, growth)
            yield pa.RecordBatch.from_arrays(
                [b.column("question_id").take(pa.array(at)), pa.array(known.ids[unit].astype(np.int32)), pa.array(known.rows[unit]),
                 pa.array(limit[at] ** 2 / scale)],
                names=["question_id", "cell", "n", "limit"],
            )

    return open_questions.mapInArrow(run, "question_id long, cell int, n long, limit double")


def search(stored: DataFrame, units: Units, questions: DataFrame, k: int = knn.DEFAULT_K, key_col: str = "id",
           vector_col: str = "embedding", question_id_col: str = "question_id", question_vector_col: str = "embedding",
           growth: int = GROWTH, block_bytes: int = knn.DEFAULT_BLOCK_BYTES) -> Found:
    """Exact top ``k`` of ``stored`` (possibly filtered) for each question. Question ids are
    unique; a question without an id or a vector has no hits."""
    ship_package()
    spark = stored.sparkSession
    asked = questions.where(F.col(question_vector_col).isNotNull() & F.col(question_id_col).isNotNull()).select(
        F.col(question_id_col).cast("long").alias("question_id"),
        F.col(question_vector_col).cast("array<double>").alias("_qvec"),
    )
    schema = T.StructType([
        T.StructField("question_id", T.LongType()), T.StructField(key_col, stored.schema[key_col].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    hits = spark.createDataFrame([], schema)
    visits = spark.createDataFrame([], "question_id long, cell int, n long, limit double")
    counts = dict(zip(units.ids.tolist(), units.rows.tolist()))
    rounds = 0
    while len(units.ids):
        been = visits.groupBy("question_id").agg(F.count("*").alias("_visited"))
        scale = _scale(units.metric)
        limit = hits.groupBy("question_id").agg(
            F.when(F.count("*") >= k, F.sqrt(F.max("distance") * F.lit(scale)) * F.lit(1 + MARGIN) + F.lit(MARGIN))
            .alias("_limit")
        )
        state = asked.join(been, "question_id", "left").join(limit, "question_id", "left") if rounds else asked.withColumns(
            {"_visited": F.lit(0), "_limit": F.lit(float("inf"))})
        state = state.na.fill({"_visited": 0}).withColumn("_limit", F.coalesce("_limit", F.lit(float("inf"))))
        now = written(_probes(state, units, k, growth), "probes")
        wanted = [r["cell"] for r in now.select("cell").distinct().limit(PRUNED_UNITS + 1).collect()]
        if not wanted:
            break
        corpus = stored.select(key_col, vector_col, "cell")
        if len(wanted) <= PRUNED_UNITS:
            corpus = corpus.where(F.col("cell").isin(wanted))
        found, _, chunks = tiles.search(
            corpus, now.drop("n").join(asked, "question_id"), k, units.metric, key_col, vector_col, "question_id", "_qvec",
            cell_col="cell", tile_bytes=block_bytes, corpus_counts=counts, question_limit_col="limit",
        )
        best = knn.merge_topk(hits.unionByName(found), k, key_col, knn.merge_levels(chunks * len(wanted)))
        hits = written(best.drop("rank"), "hits")
        visits = visits.unionByName(now) if rounds else now
        rounds += 1
    top = knn.merge_topk(hits, k, key_col).select(
        "question_id", key_col, "rank", "distance", V.score_from_key("distance", units.metric).alias("score")
    )
    effort = asked.select("question_id").join(
        visits.groupBy("question_id").agg(F.count("*").alias("n_units"), F.sum("n").alias("n_scored")), "question_id", "left"
    ).na.fill(0)
    return Found(top, effort, rounds)

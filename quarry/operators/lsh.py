"""Approximate top-k by hash tables of random projections, joined bucket by bucket.

Components are scaled and floored to integers, and every projection has entries 1 and -1
from an integer formula, so that a signature is exact arithmetic, the same in any
engine. A table's bucket is the signs of ``bits`` projections; a row and a question
meet where they share a bucket of one of the ``tables``.

The join runs in the tiles of :mod:`quarry.operators.tiles`, a bucket a cell: a hot bucket
is split on both sides, no pair list of a bucket is ever formed, and each tile hands on
``k`` rows per question. A row that meets a question in several tables counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vectors as V
from quarry.operators import knn, tiles
from quarry.session import ship_package

SCALE = 1 << 20  # a component counts in units of 1 / SCALE
LIMIT = float(1 << 40)  # larger scaled components are cut to it, in either direction
PRIME = 2147483647


def sign(dim: int, projection: int) -> int:
    """Entry ``dim`` of a projection: 1 or -1."""
    x = (dim * 1103515245 + projection * 12820163 + 12345) % PRIME
    x = x * 48271 % PRIME
    x = (x * (x % 65536 + 7) + 3) % PRIME
    return 1 - 2 * (x // 1024 % 2)


def projections(n: int, dim: int) -> np.ndarray:
    return np.array([[sign(i, p) for i in range(dim)] for p in range(n)], np.int64).reshape(n, dim)


def buckets(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(n, tables) bucket of each vector; table ``t`` numbers its own from ``t << bits``."""
    scaled = np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64)
    up = scaled @ projections(tables * bits, x.shape[1]).T >= 0
    weights = 1 << np.arange(bits)
    return (up.reshape(len(x), tables, bits) * weights).sum(axis=2) + (np.arange(tables) << bits)


def bucketed(df: DataFrame, tables: int, bits: int, vector_col: str = "embedding") -> DataFrame:
    """``df`` once for each table, with ``cell``, its bucket there. Rows whose vector is null or
    not finite have none."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = V.arrow_matrix(b.column(vector_col))
            ok = np.flatnonzero(np.isfinite(x).all(axis=1))
            cells = buckets(x[ok], tables, bits)
            for t in range(tables):
                columns = [c.take(pa.array(ok)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cells[:, t].astype(np.int32))], names=[*b.schema.names, "cell"])

    return df.where(F.col(vector_col).isNotNull()).mapInArrow(run, schema)


def search(corpus: DataFrame, questions: DataFrame, k: int = knn.DEFAULT_K, tables: int = 16, bits: int = 8,
           metric: str = "l2", key_col: str = "id", vector_col: str = "embedding", question_id_col: str = "question_id",
           question_vector_col: str = "embedding", block_bytes: int = knn.DEFAULT_BLOCK_BYTES) -> DataFrame:
    """Top ``k`` by exact distance among the rows that share a bucket with the question.

    ``tables << bits`` buckets at most: that many counts are planned with."""
    if (tables << bits) > 1 << 22:
        raise ValueError("tables << bits must stay below 4 million buckets")
    ship_package()
    rows = bucketed(corpus.select(key_col, vector_col), tables, bits, vector_col)
    asked = bucketed(
        questions.where(F.col(question_id_col).isNotNull()).select(
            F.col(question_id_col).cast("long").alias("question_id"), F.col(question_vector_col).alias("_qvec")),
        tables, bits, "_qvec",
    )
    found, _, chunks = tiles.search(
        rows, asked, k, metric, key_col, vector_col, "question_id", "_qvec", cell_col="cell", tile_bytes=block_bytes
    )
    once = found.groupBy("question_id", key_col).agg(F.min("distance").alias("distance"))
    return knn.merge_topk(once, k, key_col, knn.merge_levels(chunks * tables)).select(
        "question_id", key_col, "rank", "distance", V.score_from_key("distance", metric).alias("score")
    )

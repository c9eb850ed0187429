"""Vector distance / score.

Two forms of the same math:
* Column expressions (higher-order functions, JVM-side) for single rows and
  small candidate sets;
* a NumPy block kernel used inside ``mapInArrow`` / ``applyInArrow`` for
  scanning a corpus against a block of questions (Arrow batches; float32
  approximate keys, exact float64 re-score of the candidate pool).

Scores follow the usual search-engine conventions:
``l2``: ``1 / (1 + d^2)``; ``cosine``: ``(1 + cos) / 2``; ``dot``: ``(1 + a.b) / 2``.
Ranking is by ascending *distance key* (``d^2`` for l2, ``1 - cos`` for cosine,
``-a.b`` for dot) with the document key as tiebreak.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def squared_l2(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2))


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def distance_key(a: str | Column, b: str | Column, metric: str = "l2") -> Column:
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "cosine":
        return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def score_from_key(key: str | Column, metric: str = "l2") -> Column:
    k = _col(key)
    if metric == "l2":
        return F.lit(1.0) / (F.lit(1.0) + k)
    if metric == "cosine":
        return (F.lit(2.0) - k) / F.lit(2.0)
    if metric == "dot":
        return (F.lit(1.0) - k) / F.lit(2.0)
    raise ValueError(f"unknown metric {metric!r}")


# --------------------------------------------------------------------------
# NumPy kernel
# --------------------------------------------------------------------------

def arrow_matrix(col) -> np.ndarray:
    """(n, d) float64 matrix from an Arrow list column of equal-length,
    non-null vectors, read from the flat child values (no per-row Python)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0), dtype=np.float64)
    if col.null_count:
        raise ValueError("null vector in a scored batch")
    lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    d = int(lengths[0])
    if (lengths != d).any():
        raise ValueError("vectors of different lengths")
    vals = col.flatten().to_numpy(zero_copy_only=False)
    return vals.astype(np.float64, copy=False).reshape(n, d)


def arrow_vectors(mat: np.ndarray, dtype=np.float32):
    """Arrow list column from an (n, d) matrix (inverse of :func:`arrow_matrix`)."""
    import pyarrow as pa

    n, d = mat.shape
    offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat, dtype=dtype).reshape(-1)))


def stack_vectors(values) -> np.ndarray:
    """Object array of equal-length float arrays -> (n, d) float64 matrix."""
    if len(values) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def exact_keys(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise exact key between matching rows of ``x`` and ``q`` (same shape)."""
    if metric == "l2":
        diff = x - q
        return np.einsum("ij,ij->i", diff, diff)
    d = np.einsum("ij,ij->i", x, q)
    if metric == "cosine":
        n = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", q, q))
        return 1.0 - d / n
    return -d


def block_keys(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(n, m) approximate keys via one matrix product (BLAS)."""
    g = x @ q.T
    if metric == "l2":
        return np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", q, q)[None, :] - 2.0 * g
    if metric == "cosine":
        nx = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        nq = np.sqrt(np.einsum("ij,ij->i", q, q))[None, :]
        return 1.0 - g / (nx * nq)
    return -g


# Candidates within a margin of the k-th approximate key are re-scored exactly
# in float64.  The approximate keys are computed in float32 (half the memory
# traffic of float64, faster BLAS); a dot product of length d errs by at most
# about d * eps32 * |x||q| and the norm terms add a few eps32 * scale, so a key
# and the k-th key together are off by less than (d + 8) * eps32 * scale; the
# margin (absolute floor + 4x that) guarantees no true top-k member falls
# outside the pool.
KEY_MARGIN = 1e-9
KEY_MARGIN_REL_D = 4.0 * 2.0**-24  # per dimension, relative to the key scale


class Batch:
    """A corpus batch prepared once for all question slices: float64 rows for
    the exact re-score, float32 rows and squared norms for the approximate keys."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.x32 = x.astype(np.float32)
        self.sq = np.einsum("ij,ij->i", x, x)
        self.norm_max = float(np.sqrt(self.sq.max())) if len(x) else 0.0
        self._wide = None

    def wide(self) -> np.ndarray:
        """float32 rows with 1 and the squared norm behind: one matrix product gives the l2 keys."""
        if self._wide is None:
            one = np.ones(len(self.x), np.float32)
            self._wide = np.column_stack([self.x32, one, self.sq.astype(np.float32)])
        return self._wide

    def comparable(self, metric: str) -> np.ndarray:
        """Rows that have a distance: finite, and not zero under cosine."""
        ok = np.isfinite(self.sq)
        return ok & (self.sq > 0) if metric == "cosine" else ok


def key_margin(b: Batch, q: np.ndarray, metric: str) -> np.ndarray:
    """Per-question tolerance for the approximate keys of :func:`question_keys`."""
    rel = KEY_MARGIN_REL_D * (b.x.shape[1] + 8)
    if metric == "cosine":
        return np.full(q.shape[0], KEY_MARGIN + rel * 4.0)
    nq = np.sqrt(np.einsum("ij,ij->i", q, q))
    scale = (b.norm_max + nq) ** 2 if metric == "l2" else b.norm_max * nq
    return KEY_MARGIN + rel * scale


def question_keys(q: np.ndarray, b: Batch, metric: str) -> np.ndarray:
    """(m, n) float32 approximate keys, one row per question (contiguous rows,
    so the per-question selection runs along memory order); built in place.
    Under l2 the norms are two more dimensions of the product (its terms add up to
    the key scale at most, so the margin holds)."""
    if metric == "l2":
        sq = np.einsum("ij,ij->i", q, q)
        return np.column_stack([-2.0 * q, sq, np.ones(len(q))]).astype(np.float32) @ b.wide().T
    g = q.astype(np.float32) @ b.x32.T
    if metric == "cosine":
        g /= np.sqrt(np.einsum("ij,ij->i", q, q)).astype(np.float32)[:, None]
        g /= np.sqrt(b.sq).astype(np.float32)[None, :]
        np.subtract(np.float32(1.0), g, out=g)
        return g
    np.negative(g, out=g)
    return g


POOL = 4  # times k: rows per question that pass known limits before the block's own k-th key is sought


def topk_block(x, q: np.ndarray, k: int, metric: str, limit: np.ndarray | None = None,
               allowed: np.ndarray | None = None):
    """For each question (row of ``q``), indices into the batch ``x`` (an
    array or a prepared :class:`Batch`) of a candidate pool that surely
    contains its k nearest rows, with exact float64 keys. With ``limit`` (a distance
    for each question, such as its k-th so far) rows beyond it may be left out; with
    ``allowed`` (questions x rows) only those rows count.

    Returns (row_idx, question_idx, exact_key) flat arrays. A row with a NaN,
    null or infinite component, and under cosine a zero row, is nobody's
    neighbour; it is taken out before the bound is computed, so it hides no
    other row of its block.
    """
    b = x if isinstance(x, Batch) else Batch(x)
    ok = b.comparable(metric)
    if not ok.all():
        at = np.flatnonzero(ok)
        rows, cols, keys = topk_block(b.x[at], q, k, metric, limit, None if allowed is None else allowed[:, at])
        return at[rows], cols, keys
    n = b.x.shape[0]
    if n == 0 or q.shape[0] == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    approx = question_keys(q, b, metric)  # (m, n) float32
    if allowed is not None:
        approx[~allowed] = np.inf
    margin = key_margin(b, q, metric)

    def within(most: np.ndarray) -> np.ndarray:
        # the bound is rounded up to float32
        passing = approx <= np.nextafter((most + margin).astype(np.float32), np.float32(np.inf))[:, None]
        return passing if allowed is None else passing & allowed

    near = within(limit) if limit is not None and np.isfinite(limit).all() else None
    if near is None or np.count_nonzero(near) > POOL * k * len(q):
        kk = min(k, n)
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1].astype(np.float64)
        near = within(kth if limit is None else np.minimum(kth, limit))
    cols, rows = np.divmod(np.flatnonzero(near), n)  # several times faster than nonzero of two dimensions
    keys = np.empty(len(rows))
    step = max(1, 4_000_000 // max(1, b.x.shape[1]))
    for s in range(0, len(rows), step):
        r, c = rows[s : s + step], cols[s : s + step]
        keys[s : s + step] = exact_keys(b.x[r], q[c], metric)
    return rows, cols, keys

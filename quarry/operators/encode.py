"""Batch text encoder: a pluggable model applied to Arrow batches (the model is
built once per task, not per row).

The default :class:`HashingEncoder` is a deterministic signed feature-hashing
bag of words (md5 of lower-cased word tokens, log-damped counts),
L2-normalised, so texts that share words land close together.  Any object with
``encode(list[str]) -> ndarray (n, d)`` can replace it (e.g. a local ONNX
sentence model).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.functions.vectors import arrow_vectors
from quarry.session import ship_package

ROWS = 1024  # texts encoded at a time: bounds the dense vectors a worker holds
TOKENS = 1 << 18  # tokens counted together


def token_hash(token: str) -> int:
    """The first 32 bits of the token's md5."""
    return int(hashlib.md5(token.encode("utf-8", "replace")).hexdigest()[:8], 16)


class HashingEncoder:
    """Tokens are runs of letters, digits and ``_``; a token adds its sign (the top
    bit of its hash) to bucket ``hash % dim``.  A text without tokens is a zero vector."""

    def __init__(self, dim: int = 1024, sublinear: bool = True):
        import regex

        self.dim = dim
        self.sublinear = sublinear
        self.hash = functools.lru_cache(1 << 18)(token_hash)
        self.word = regex.compile(r"[\p{L}\p{N}_]+")

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """Hashes the distinct tokens of about :data:`TOKENS` at a time, however long a text is."""
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        tokens: list[str] = []
        rows: list[int] = []
        counts: list[int] = []
        for row, text in enumerate(texts):
            low = (text or "").lower()
            if len(low) <= TOKENS:
                found = [self.word.findall(low)]
            else:
                every = (m.group() for m in self.word.finditer(low))
                found = iter(lambda: list(itertools.islice(every, TOKENS)), [])
            for part in found:
                tokens += part
                rows.append(row)
                counts.append(len(part))
                if len(tokens) >= TOKENS:
                    self._add(out, tokens, rows, counts)
                    tokens, rows, counts = [], [], []
        self._add(out, tokens, rows, counts)
        if self.sublinear:
            out = np.sign(out) * np.log1p(np.abs(out))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        np.divide(out, n, out=out, where=n > 0)
        return out

    def _add(self, out: np.ndarray, tokens: list[str], rows: list[int], counts: list[int]) -> None:
        if not tokens:
            return
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
        h = np.array([self.hash(t) for t in coded.dictionary.to_numpy(zero_copy_only=False)], np.int64)
        at = coded.indices.to_numpy()
        first, last = rows[0], rows[-1]
        place = (np.repeat(rows, counts) - first) * self.dim + (h % self.dim)[at]
        sums = np.bincount(place, np.where(h >> 31, -1.0, 1.0)[at], (last - first + 1) * self.dim)
        out[first : last + 1] += sums.reshape(-1, self.dim)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
           factory: Callable[[], object] | None = None, prompt: str = "") -> DataFrame:
    """Add a vector column computed from whole texts, each after ``prompt`` (what a
    model expects in front of a question); a null text is encoded as null.

    Runs as a ``mapInArrow`` plan node rather than an expression UDF: a later
    filter on the vector (``IS NOT NULL`` in search) cannot then be pushed
    below a shuffle by inlining the model call, so every text is encoded once.
    The batch's other columns pass through untouched and the vectors are
    written as one flat Arrow buffer.
    """
    ship_package()
    fac = factory or (lambda: HashingEncoder())
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        model = fac()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                texts = [t if t is None else prompt + t for t in b.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    b.columns + [arrow_vectors(model.encode(texts))], names=b.schema.names + [out_col]
                )

    return df.mapInArrow(run, schema)

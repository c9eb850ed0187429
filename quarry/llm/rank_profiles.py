"""Language ID by rank-order profiles (operator 4).

Letters, and runs of anything else as one blank, give character n-grams of one to
three. A language's profile ranks the most frequent of all its training texts, a
document's those of its whole text; the out-of-place distance sums, over the
document's n-grams, how far their ranks are apart, and a language without the n-gram
costs the most. The least distance wins.

n-grams are exact: three code points of 21 bits in one integer.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches

ORDER = 3
TOP = 400
SPAN = 1 << 20  # code points counted at a time
FLUSH = 300_000  # distinct n-grams a task holds per language
SALTS = 8

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[cuts], np.add.reduceat(c, cuts)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, sorted, and how often they occur. n-grams
    of a blank alone don't count. Empty for a text without letters."""
    keys, counts, carry = [], [], np.zeros(0, np.int64)
    for at in range(0, len(text or ""), SPAN):
        points = np.frombuffer(text[at : at + SPAN].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = _is_letter()[points]
        points = np.where(letter, points, 32)
        blank = ~letter
        blank[1:] &= blank[:-1]
        blank[0] &= not at or (len(carry) > 0 and carry[-1] == 32)
        points = points[~blank]
        if not at:
            points = np.r_[np.int64(32), points]  # a text begins and ends with a blank
        if at + SPAN >= len(text) and len(points) and points[-1] != 32:
            points = np.r_[points, np.int64(32)]
        x, new = np.r_[carry, points], len(carry)
        grams = []
        for n in range(1, ORDER + 1):
            if len(x) < n:
                continue
            g = x[: len(x) - n + 1].copy()
            for i in range(1, n):
                g = (g << 21) | x[i : len(x) - n + 1 + i]
            g = g[max(0, new - n + 1) :]
            grams.append(g[g != 32])
        if grams:
            k, c = np.unique(np.concatenate(grams), return_counts=True)
            keys.append(k)
            counts.append(c)
        carry = x[-(ORDER - 1) :]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = (keys[0], counts[0]) if len(keys) == 1 else _merge(keys, counts)
    if not len(k) or not (k != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return k, c


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` keys by falling count, ties by key."""
    return keys[np.lexsort((keys, -counts))[:top]]


def _count_batches(batches):
    held: dict[str, list] = {}

    def rows(lang, k, c):
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)], names=["lang", "gram", "n"]
        )

    for batch in batches:
        new: dict[str, list] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            k, c = gram_counts(text.as_py())
            if len(k):
                new.setdefault(lang.as_py(), []).append((k, c))
        for lang, found in new.items():
            parts = found + ([held.pop(lang)] if lang in held else [])
            k, c = _merge([p[0] for p in parts], [p[1] for p in parts])
            if len(k) > FLUSH:
                yield rows(lang, k, c)
            else:
                held[lang] = (k, c)
    for lang, (k, c) in held.items():
        yield rows(lang, k, c)


class Profiles:
    """Ranked n-grams by language, at most ``top`` each."""

    def __init__(self, ranks: dict[str, np.ndarray], top: int = TOP):
        self.top = top
        self.langs = sorted(ranks)
        self.tables = []
        for lang in self.langs:
            order = np.argsort(ranks[lang])
            self.tables.append((ranks[lang][order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text)
        if not len(keys) or not self.langs:
            return "und", 0.0
        own = ranked(keys, counts, self.top)
        place = np.arange(len(own))
        best = None
        for lang, (known, rank) in zip(self.langs, self.tables):
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            far = np.where(known[at] == own, np.abs(rank[at] - place), self.top)
            distance = int(np.minimum(far, self.top).sum())
            if best is None or distance < best[1]:
                best = lang, distance
        return best[0], 1.0 - best[1] / (self.top * len(own))


def learn(labelled: DataFrame, top: int = TOP) -> Profiles:
    """Profiles of every non-null ``lang`` of ``labelled(text, lang)``, from all its
    texts. Only the ``top`` of each salted part of a language reach the driver."""
    byte_batches(labelled.sparkSession)
    counts = (
        labelled.where("lang is not null and text is not null")
        .select("text", "lang")
        .mapInArrow(_count_batches, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    )
    best = counts.selectExpr(
        "*", "row_number() over (partition by lang, salt order by n desc, gram) as r"
    ).where(F.col("r") <= top)
    rows = best.select("lang", "gram", "n").toArrow().to_pandas()
    return Profiles(
        {lang: ranked(g["gram"].to_numpy(), g["n"].to_numpy(), top) for lang, g in rows.groupby("lang")}, top
    )


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` and columns ``lang_pred`` and ``score`` (from 0 to 1: one less the
    distance as a share of the largest).

    * null text, or no letter: ``und``, score 0; so everything without profiles;
    * equal distances: the first language by name; texts are read whole;
    * columns named ``lang_pred`` or ``score`` are replaced, all others stay.
    """
    byte_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    if "text" not in docs.columns:
        raise ValueError("docs has no column text")

    def run(batches):
        for batch in batches:
            out = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents whose crc32(doc_id) leaves another remainder than 2 by 4."""
    return docs.where(~is_held_out())


def is_held_out():
    """crc32 of the doc_id as text, by 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Benchmark decontamination by greedy string tiling (operator 7).

Documents and items are sequences of word hashes, lower-cased, without punctuation. Windows that a document shares with
an item, found by rolling hash, seed their comparison. Along each diagonal the seeds
give the longest common runs; the longest is marked, then the longest of what is left
unmarked, until no run reaches the least length. The share of the item that the tiles
cover does not depend on their order, so reordered passages count in full.

The items are small and bounded in bytes: they are read by the driver in blocks of a
fixed size, one pass over the documents for each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import byte_batches

LEAST = 5  # words of a tile
COVERAGE = 0.5
ITEM_BLOCK = 16 << 20  # bytes of item texts broadcast at a time
SEED_SPAN = 1 << 16  # document windows compared at a time
MATCHES = 1 << 20  # and matches of theirs, or one window's
_MARKS = 1 << 20


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> tuple[int, int]:
    """(words of the item that greedy tiles cover, number of tiles).

    Ties: the run that starts first in the item, then in the document.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return 0, 0
    ours, theirs = _rolling(doc, least), _rolling(item, least)
    runs = _runs(ours, theirs, least)
    heapq.heapify(runs)
    free_doc, free_item = {}, np.ones(len(item), bool)
    tiles = 0
    while runs and free_item.any():
        size, j, i = heapq.heappop(runs)
        size = -size
        free = free_item[j : j + size].copy()
        for x in range(size):
            free[x] &= free_doc.get(i + x, True)
        if free.all():
            tiles += 1
            free_item[j : j + size] = False
            for x in range(size):
                free_doc[i + x] = False
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(runs, (a - b, j + a, i + a))
    return int((~free_item).sum()), tiles


def _runs(ours: np.ndarray, theirs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(-words, item place, document place)`` of the longest common runs.

    Matching windows are looked at in chunks of about :data:`MATCHES`; only the first and the
    last match of a run are kept, and those pair up along each diagonal. So memory grows
    with the runs, not with the matches of repeated words."""
    order = np.argsort(theirs, kind="stable")
    keys = theirs[order]
    first, last = [], []
    for at in range(0, len(ours), SEED_SPAN):
        part = ours[at : at + SEED_SPAN]
        lo = np.searchsorted(keys, part, "left")
        n = np.searchsorted(keys, part, "right") - lo
        chunk = np.cumsum(n) // MATCHES
        for c in np.flatnonzero(np.bincount(chunk)).tolist():
            a, b = np.searchsorted(chunk, [c, c + 1])
            size = n[a:b]
            i = np.repeat(np.arange(a, b), size) + at
            j = order[np.repeat(lo[a:b], size) + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)]
            begins = (i == 0) | (j == 0) | (ours[i - 1] != theirs[j - 1])
            ends = (i == len(ours) - 1) | (j == len(theirs) - 1)
            ends[~ends] = ours[i[~ends] + 1] != theirs[j[~ends] + 1]
            first.append((i[begins], j[begins]))
            last.append((i[ends], j[ends]))
    if not first:
        return []
    (i, j), (k, m) = (tuple(np.concatenate(x) for x in zip(*part)) for part in (first, last))
    by, to = np.lexsort((j, i - j)), np.lexsort((m, k - m))
    size = k[to] - i[by] + least
    return list(zip((-size).tolist(), j[by].tolist(), i[by].tolist()))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return W.batch_words(pc.utf8_lower(texts), W.LETTERS)


def _rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``k`` words, by doubling."""
    out, width = words, 1
    while width < k:
        step = min(width, k - width)
        out = out[: len(words) - width - step + 1] * W._STEP ** np.uint64(step) + out[step : len(words) - width + 1]
        width += step
    return W.mix(out)


class Items:
    """One block of items, ready to broadcast: word hashes and seeds by window length."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        words, at = _words(pa.array(texts, pa.string()))
        self.least = least
        self.ids, self.words = [], []
        for i, item in enumerate(ids):
            w = words[at[i] : at[i + 1]]
            if item is not None and len(w):
                self.ids.append(item)
                self.words.append(w)
        self.seeds = []
        for k in sorted({min(least, len(w)) for w in self.words}):
            found = [(s, i) for i, w in enumerate(self.words) if min(least, len(w)) == k for s in _rolling(w, k)]
            h = np.array([s for s, _ in found], np.uint64)
            owner = np.array([i for _, i in found], np.int64)
            order = np.argsort(h, kind="stable")
            marks = np.zeros(_MARKS, bool)
            marks[(h % np.uint64(_MARKS)).astype(np.int64)] = True
            self.seeds.append((k, h[order], owner[order], marks))

    def candidates(self, words: np.ndarray, at: np.ndarray):
        """(text, items that share a seed with it) of a batch of texts."""
        pairs = []
        for k, keys, owner, marks in self.seeds:
            if len(words) < k:
                continue
            h = _rolling(words, k)
            hit = np.flatnonzero(marks[(h % np.uint64(_MARKS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            text = np.searchsorted(at, hit, "right") - 1
            inside = hit + k <= at[text + 1]
            text, lo, n = text[inside], lo[inside], n[inside]
            own = owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            pairs.append(np.stack([np.repeat(text, n), own], 1))
        return np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []


def _blocks(benchmark: DataFrame):
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null"
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // ITEM_BLOCK)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield part.toArrow()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE
) -> DataFrame:
    """``(doc_id, item_id, n_tiles, covered, item_words, coverage)``: pairs of
    ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` whose tiles cover at least
    ``coverage`` of the item's words.

    * null, blank and short texts: no tiles; an item shorter than a tile must occur whole;
    * null or blank items, or a null item_id: match nothing;
    * repeated rows on either side: repeated pairs; equal runs: the first in the item;
    * an empty table on either side gives no rows; other columns are ignored; texts and
      items are compared whole.
    """
    spark = docs.sparkSession
    byte_batches(spark)
    schema = "doc_id long, item_id long, n_tiles long, covered long, item_words long, coverage double"
    out = None
    for block in _blocks(benchmark):
        items = spark.sparkContext.broadcast(
            Items(block.column("item_id").to_pylist(), block.column("text").to_pylist(), least)
        )

        def run(batches, items=items):
            known = items.value
            for batch in batches:
                words, at = _words(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                rows = []
                for i, k in known.candidates(words, at):
                    item = known.words[k]
                    covered, tiles = tile(words[at[i] : at[i + 1]], item, known.least)
                    if covered and covered >= coverage * len(item):
                        rows.append((ids[i], known.ids[k], tiles, covered, len(item), covered / len(item)))
                if rows:
                    types = [*[pa.int64()] * 5, pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                        names=["doc_id", "item_id", "n_tiles", "covered", "item_words", "coverage"],
                    )

        found = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` without contaminated ones. Every row is judged by its own
    text, whatever its doc_id."""
    spark = docs.sparkSession
    byte_batches(spark)
    out = docs
    for block in _blocks(benchmark):
        items = spark.sparkContext.broadcast(
            Items(block.column("item_id").to_pylist(), block.column("text").to_pylist(), least)
        )

        def run(batches, items=items):
            known = items.value
            for batch in batches:
                words, at = _words(batch.column("text"))
                keep = np.ones(batch.num_rows, bool)
                for i, k in known.candidates(words, at):
                    if keep[i]:
                        item = known.words[k]
                        covered, _ = tile(words[at[i] : at[i + 1]], item, known.least)
                        keep[i] = not covered or covered < coverage * len(item)
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out

"""Places of words in an Arrow batch of whole texts, vectorised window by window.

A word is a longest run of bytes that are not separators, within one text. Windows have
a fixed size and words are never cut: one that is open at a window's end is given out
with the window in which it ends. So memory beside the batch itself is that of a window,
however long a text or a word is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 19
SHORT = 64  # words of more bytes are hashed one by one

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.uint64(0xFF51AFD7ED558CCD)


def separators(is_separator) -> np.ndarray:
    """A table of 256 booleans from a test of byte values."""
    return np.array([bool(is_separator(b)) for b in range(256)])


def lowered(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The batch's bytes with A-Z lower-cased, eight zero bytes after them, and the
    offset of each text. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        np.take(LOWER, np.frombuffer(buffers[2], np.uint8)[lo:hi], out=data[:-8])
    return data, offsets - lo


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``size`` bytes, one text at least."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n, dtype=np.int64) // size
    ends = [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)] if len(n) else []
    for lo, hi in zip([0, *ends], ends):
        yield batch.slice(lo, hi - lo)


def words(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray, breaks: np.ndarray | None = None, window: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(start, end, text, piece)`` of the words that end in each window, in order.

    ``space``: the separators. ``breaks``: those among them that also end a piece; ``piece``
    numbers the pieces of the batch, and a text begins one too (without ``breaks`` it is
    the text's number). Every text of the batch is covered, those without words by nothing.
    """
    size = int(offsets[-1])
    opened, piece = -1, 0
    window = window or WINDOW
    for lo in range(0, size, window):
        hi = min(size, lo + window)
        solid = ~space[data[lo:hi]]
        a, b = np.searchsorted(offsets, [lo, hi])
        first = np.unique(offsets[a:b]) - lo  # places in the window where a text begins
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        starts[0] &= opened < 0
        starts[first] = solid[first]
        ends = ~solid  # a word ends before a separator or a new text
        ends[1:] &= solid[:-1]
        ends[0] &= opened >= 0
        inner = first[first > 0]
        ends[inner] = solid[inner - 1]
        if len(first) and first[0] == 0:
            ends[0] = opened >= 0
        s, e = np.flatnonzero(starts) + lo, np.flatnonzero(ends) + lo
        if opened >= 0:
            s = np.concatenate([[opened], s])
        if hi == size and len(s) > len(e):
            e = np.concatenate([e, [size]])
        opened = int(s[-1]) if len(s) > len(e) else -1
        s = s[: len(e)]
        text = np.searchsorted(offsets, s, "right") - 1
        if breaks is None:
            yield s, e, text, text
            continue
        cuts = breaks[data[lo:hi]]
        cuts[first] = True
        sums = np.cumsum(cuts)
        # a word from the window before lies in the piece that window ended with
        at = np.where(s >= lo, sums[np.maximum(s - lo, 0)], 0)
        yield s, e, text, at + piece
        piece += int(sums[-1])


def by_length(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the words by falling length, long ones as 0; their lengths; which are long."""
    n = end - start
    long = n > SHORT
    n = np.where(long, 0, n).astype(np.uint8)
    return np.argsort(n, kind="stable")[::-1], n, long


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step; another one for each ``seed``."""
    import xxhash

    order, n, long = by_length(start, end)
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from any place on
    s, size = start[order], n[order].astype(np.int64)
    h = (size + seed).astype(np.uint64) * _GOLD
    for j in range(0, int(size[0]) if len(size) else 0, 8):
        m = int(np.searchsorted(-size, -j, "left"))  # words with more than j bytes
        left = np.minimum(size[:m] - j, 8).astype(np.uint64)
        lane = lanes[s[:m] + j] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        x = (h[:m] ^ lane) * _LANE
        h[:m] = x ^ (x >> np.uint64(29))
    out = np.empty_like(h)
    out[order] = h * _GOLD ^ (h >> np.uint64(32))
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out

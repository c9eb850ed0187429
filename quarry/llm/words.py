"""Word and shingle hashes of whole texts, vectorised over an Arrow batch.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased.
Hashes are 64-bit and depend on the word's bytes only, so any cut of a text at
white space gives the same sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20

# lower-cased byte; white space is 0, and a NUL byte takes a value no UTF-8 text has
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0] = 0xFF
_CLASS[ord("A") : ord("Z") + 1] += 32
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

# the same, with every ASCII character but letters and digits as white space
LETTERS = _CLASS.copy()
LETTERS[[i for i in range(1, 128) if not chr(i).isalnum()]] = 0

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_CHUNK * 2, 1 << int(n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        tables = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > _CHUNK * 2:
            return tables
        _powers[size] = tables
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunk_words(chars: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its sum before mixing, its length) in one chunk; ``breaks``: text
    starts in it."""
    solid = chars != 0
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    starts[breaks] = solid[breaks]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = breaks[breaks > 0]
    ends[inner - 1] = solid[inner - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    up, down = _power_tables(len(chars) + 1)
    sums = np.empty(len(chars) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(chars * up[: len(chars)], out=sums[1:], dtype=np.uint64)
    return s, (sums[e] - sums[s]) * down[s], e - s


def batch_words(texts: pa.Array, classes: np.ndarray = _CLASS) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a batch, in order, and the offset of each text's
    first word (``len(texts) + 1`` entries). A null text has no words. ``classes``
    gives each byte's value, 0 between words.

    Chunks have a fixed size. A word that a chunk's end cuts goes on in the next one: its
    sum so far and its length are carried over, so no word, however long, is held."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    starts, hashes = [], []
    opened: tuple[int, int, int] | None = None  # start, sum, length of a word that may go on
    for at in range(lo, hi, _CHUNK):
        end = min(hi, at + _CHUNK)
        a, b = np.searchsorted(offsets, [at, end])
        first = np.unique(offsets[a:b]) - at
        s, h, size = _chunk_words(classes[data[at:end]], first)
        s = s + at
        if opened is not None:
            if len(s) and s[0] == at and not (len(first) and first[0] == 0):
                h[0] = np.uint64((opened[1] + int(h[0]) * pow(int(_BASE), opened[2], 1 << 64)) % (1 << 64))
                s[0], size[0] = opened[0], size[0] + opened[2]
            else:
                s, h, size = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(_closed(opened), (s, h, size)))
            opened = None
        if end < hi and len(s) and s[-1] + size[-1] == end:
            opened = int(s[-1]), int(h[-1]), int(size[-1])
            s, h, size = s[:-1], h[:-1], size[:-1]
        starts.append(s)
        hashes.append(mix(h + (size - 1).astype(np.uint64)))
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return h, np.searchsorted(s, offsets)


def _closed(word: tuple[int, int, int]) -> tuple[np.int64, np.uint64, np.int64]:
    return np.int64(word[0]), np.uint64(word[1]), np.int64(word[2])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles in order; fewer words: the whole sequence."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = words[: n - width + 1].copy()
    for i in range(1, width):
        h *= _STEP
        h += words[i : n - width + 1 + i]
    return mix(h + np.uint64(width))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingles(words, k))

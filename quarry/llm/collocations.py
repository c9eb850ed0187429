"""Collocations by partitioned mining: local supports, a union, and one exact count.

A shard is a run of the words that one task reads, of at most :data:`SHARD_WORDS` words, so
that it is mined in memory. With ``m`` occurrences needed in a language of ``n`` words, a
phrase that is frequent has ``m * n_i / n`` occurrences or more in some shard that holds
``n_i`` of them. So each shard is mined completely, level by level (pairs, triples; words are
counted before), at the local support ``ceil(m * n_i / n)``, at least 1, and emits its locally
frequent phrases with their local counts. Where all shards had a support of 1, nothing is held
back and the sums of these counts are exact. In a language in which shards held phrases back, a
phrase stays in the union unless what it was counted plus all that shards may have held back
(one less than their supports) is below ``m``, and the shards of that language count the union.

A phrase is sent as the hashes of its words, 64 bits each, never by its text, and is named
once, when it is known to be frequent, by joins with the frequent words. No two words of the
table share a hash: that is tested, and hashes of another seed are taken otherwise. So the hashes
are exact keys, and counts are those of the words.

A phrase can be frequent only if what remains without its first and without its last word is;
both are looked up in a bitmap of the level below, of fixed size (:data:`MAP_BITS`), built by
Spark. A fuller bitmap lets more through and never holds one back.

Scores: every candidate is cut after each of its words, and both parts, frequent as
well, are joined to their counts; decimals of 38 digits hold the products. A candidate is
dropped if a longer one that contains it has at least half its count.

Edge cases: a null text is empty, a null lang is ``und``; an empty table, or one where nothing
is frequent, gives no rows; repeated rows count each time; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranking import shuffle_levels, top_per_group

from . import spans
from .common import written
from .words import mix

SUPPORT = 10
LONGEST = 3
CONTAINED = 50  # percent of a phrase's count at which a longer one stands for it
BEST = 2000
SHARD_WORDS = 1_000_000
MAP_BITS = 1 << 27
KNOWN_LANGS = 1000  # languages whose size the tasks are told; others are mined at support 1
WORD_WINDOW = 4 << 20  # bytes whose words are counted together
SENT_ROWS = 1 << 16  # of a shard's phrases, in one batch
HELD_KEYS = 400_000  # distinct phrases a task counts before it hands them on

BREAKS = spans.separators(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
SPACE = BREAKS | spans.separators(lambda b: b in b"\x20\x09")

_STEP = np.uint64(0xD6E8FEB86659FD93)


class Map:
    """A set of hashes as a bitmap: may say yes to others, never no to its own."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    @classmethod
    def of(cls, hashes: DataFrame, bits: int = MAP_BITS) -> "Map":
        """From a column ``h`` of any length. Spark builds pieces of 4 KB, ``bits / 32768``
        of them at most, and only those reach the driver."""
        at = F.col("h").bitwiseAND(F.lit(bits - 1))
        pieces = hashes.groupBy(F.shiftright(at, 15).alias("piece")).agg(
            F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bitmap")
        )
        out = np.zeros(bits // 8, np.uint8)
        for r in pieces.collect():
            out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(r["bitmap"], np.uint8)
        return cls(out)


def _lang_hashes(langs: list[str], seed: int) -> np.ndarray:
    import xxhash

    known = {x: xxhash.xxh64_intdigest(x.encode(), seed) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    return mix(spans.hashes(data, start, end, seed) ^ lang)


def _windows(lang: str, texts: pa.Array, longest: int, seed: int):
    """``(hash of each word, piece, words carried over)`` for each window of texts of one
    language; the last words of the one before come first, so that no phrase is missed."""
    data, offsets = spans.lowered(texts)
    of = _lang_hashes([lang], seed)
    held = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for s, e, _, piece in spans.words(data, offsets, SPACE, BREAKS):
        now = [np.concatenate(pair) for pair in zip(held, (_word_hashes(data, s, e, of, seed), piece))]
        yield *now, len(held[0])
        held = [x[-(longest - 1) :] for x in now]


def _sums(words: list[np.ndarray]) -> np.ndarray:
    """A sum for each phrase from its words' hashes, one array for each place in the phrase."""
    out = words[0]
    for h in words[1:]:
        out = out * _STEP + h
    return out


def _hash(words: list[np.ndarray]) -> np.ndarray:
    """The hash of each phrase that bitmaps hold."""
    return mix(_sums(words) + np.uint64(len(words)))


def _phrases(h: np.ndarray, piece: np.ndarray, old: int, size: int, below: Map) -> list[np.ndarray]:
    """The phrases of ``size`` words that end in a new word and whose parts, the first and the
    last word left out, ``below`` has: the hashes of their words, one array for each place."""
    n = len(h) - size + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * size
    ok = piece[size - 1 :] == piece[:n]
    if old:
        ok &= np.arange(size - 1, len(h)) >= old
    had = below.has(_hash([h[k : n + 1 + k] for k in range(size - 1)]))
    at = np.flatnonzero(ok & had[:-1] & had[1:])
    return [h[at + k] for k in range(size)]


class _Counts:
    """Counts by language and string, handed on as batches before they fill the memory."""

    def __init__(self):
        self.held = defaultdict(Counter)

    def full(self) -> bool:
        return sum(map(len, self.held.values())) > HELD_KEYS

    def batches(self):
        for lang, counts in self.held.items():
            phrases = pa.array(counts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), phrases, pa.array(counts.values(), pa.int64())],
                names=["lang", "phrase", "n"],
            )
        self.held.clear()


def _by_lang(batch: pa.RecordBatch):
    """``(lang, texts)`` of the batch's runs of texts, 8 MB or one text each."""
    for part in spans.slices(batch):
        codes = part.column("lang").dictionary_encode()
        places = codes.indices.to_numpy()
        for i, lang in enumerate(codes.dictionary.to_pylist()):
            yield lang, part.column("text").take(pa.array(np.flatnonzero(places == i)))


def _count_words(batches):
    counts = _Counts()
    for b in batches:
        for lang, texts in _by_lang(b):
            data, offsets = spans.lowered(texts)
            for s, e, _, _ in spans.words(data, offsets, SPACE, window=WORD_WINDOW):
                if not len(s):
                    continue
                region = data[s[0] : e[-1]]  # whole words and separators
                ends = np.concatenate([[0], np.cumsum(e - s)])
                found = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(region[~SPACE[region]])]
                ).value_counts()
                of = counts.held[lang]
                for word, n in zip(found.field("values").to_numpy(zero_copy_only=False).tolist(), found.field("counts").to_numpy().tolist()):
                    of[word] += n
                if counts.full():
                    yield from counts.batches()
    yield from counts.batches()


def _hash_words(seed: int):
    """``(h, lang, word)`` of each (lang, word)."""

    def run(batches):
        for b in batches:
            data, offsets = spans.lowered(b.column("phrase"))
            lang = _lang_hashes(b.column("lang").to_pylist(), seed)
            h = _word_hashes(data, offsets[:-1], offsets[1:], lang, seed)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("lang"), b.column("phrase")], names=["h", "lang", "word"])

    return run


def _hash_phrases(batches):
    """The hash of each phrase, given as its words' hashes."""
    for b in batches:
        words = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns]
        yield pa.RecordBatch.from_arrays([pa.array(_hash(words).view(np.int64))], names=["h"])


def _keys(size: int) -> list[str]:
    return [f"w{k}" for k in range(1, size + 1)]


def _mined(size: int) -> str:
    return ", ".join(f"{k} long" for k in [*_keys(size), "n"])


def _miner(size: int, support: int, totals, below, seed: int, union=None):
    """Mines shards for phrases of ``size`` words: their words' hashes and counts, of locally
    frequent ones, and one row without a second word for each language of which the shard
    holds phrases back: the hash of the language, and the count that a phrase may have there
    without being emitted. Languages that ``totals`` does not have are mined at support 1.
    ``union``: only phrases in that bitmap are counted."""
    names = [*_keys(size), "n"]

    def rows(words, n):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in [*words, n]], names=names)

    def shard(found, words):
        for lang in list(found):
            held = max(-(-support * words[lang] // totals.value[lang]) - 1, 0) if lang in totals.value else 0
            if held:
                yield rows([_lang_hashes([lang], seed).view(np.int64), *[pa.nulls(1, pa.int64())] * (size - 1)], [held])
            columns = [np.concatenate(c) for c in zip(*found.pop(lang))]
            if not len(columns[0]):
                continue
            # a phrase that equal sums part into two runs is summed by Spark, but must not be held back
            order = np.lexsort(columns) if held else np.argsort(_sums(columns))
            new = np.zeros(len(order), bool)
            new[0] = True
            for k, c in enumerate(columns):
                columns[k] = c = c[order]
                new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            n = np.diff(np.r_[first, len(order)])
            first, n = first[n > held], n[n > held]
            for i in range(0, len(first), SENT_ROWS):
                at = first[i : i + SENT_ROWS]
                yield rows([c[at].view(np.int64) for c in columns], n[i : i + SENT_ROWS])

    def run(batches):
        found, words, seen = defaultdict(list), Counter(), 0
        for b in batches:
            for lang, texts in _by_lang(b):
                for h, piece, old in _windows(lang, texts, size, seed):
                    phrases = _phrases(h, piece, old, size, below.value)
                    if union is not None:
                        had = union.value.has(_hash(phrases))
                        phrases = [x[had] for x in phrases]
                    found[lang].append(phrases)
                    words[lang] += len(h) - old
                    seen += len(h) - old
                    if seen >= SHARD_WORDS:
                        yield from shard(found, words)
                        found, words, seen = defaultdict(list), Counter(), 0
        if seen:
            yield from shard(found, words)

    return run


_COUNTED = "lang string, phrase string, n long"
_WORDS = "h long, lang string, word string"


class Miner:
    """Frequent phrases of ``docs(text, lang)`` by language."""

    def __init__(self, docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, map_bits: int = MAP_BITS):
        self.docs = docs.select(
            F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
        )
        self.spark, self.support, self.longest, self.map_bits = docs.sparkSession, support, longest, map_bits

    def _counted(self, docs: DataFrame, size: int, *how) -> DataFrame:
        mined = docs.mapInArrow(_miner(size, self.support, *how), _mined(size))
        return written(mined.groupBy(*_keys(size)).agg(F.sum("n").alias("n")))

    def _bitmap(self, phrases: DataFrame, size: int):
        hashes = phrases.select(*_keys(size)).mapInArrow(_hash_phrases, "h long")
        return self.spark.sparkContext.broadcast(Map.of(hashes, self.map_bits))

    def _seed(self) -> int:
        """The first seed for which no two words have the same hash."""
        for seed in count():
            hashes = self.words.select("lang", "phrase").mapInArrow(_hash_words(seed), _WORDS)
            if hashes.groupBy("h").count().where("count > 1").isEmpty():
                return seed

    def mine(self) -> None:
        """``words`` and ``phrases``: ``(lang, phrase, n)``, the first all words, the second
        the frequent phrases of 2 to ``longest`` words; ``totals``: ``(lang, n)``."""
        counts = self.docs.mapInArrow(_count_words, _COUNTED)
        self.words = written(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
        self.totals = self.words.groupBy("lang").agg(F.sum("n").alias("n"))
        known = {r["lang"]: r["n"] for r in self.totals.orderBy(F.desc("n"), "lang").limit(KNOWN_LANGS).collect()}
        seed = self._seed()
        frequent = self.words.where(F.col("n") >= self.support).select("lang", "phrase")
        self.names = written(frequent.mapInArrow(_hash_words(seed), _WORDS))
        below = self._bitmap(self.names.select(F.col("h").alias("w1")), 1)
        self.phrases = self.words.where("false")
        for size in range(2, self.longest + 1):
            level = written(self._level(size, known, below, seed))
            self.phrases = self.phrases.unionByName(level.select("lang", "phrase", "n"))
            if size < self.longest:
                below = self._bitmap(level, size)

    def _level(self, size: int, known: dict[str, int], below, seed: int) -> DataFrame:
        """The frequent phrases of ``size`` words: their words' hashes, ``lang, phrase, n``."""
        tell = self.spark.sparkContext.broadcast
        mined = self._counted(self.docs, size, tell(known), below, seed)
        of = dict(zip(_lang_hashes(list(known), seed).view(np.int64).tolist(), known))
        held = {of[r["w1"]]: r["n"] for r in mined.where("w2 is null").collect()}
        mined = mined.where("w2 is not null")
        exact = self.named(mined.where(F.col("n") >= self.support), size)
        if not held:
            return exact
        slack = self.spark.createDataFrame(list(held.items()), "lang string, held long")
        langs = self.names.join(F.broadcast(slack), "lang").select(F.col("h").alias("w1"), "held")
        union = self._bitmap(mined.join(langs, "w1").where(F.col("n") + F.col("held") >= self.support), size)
        counted = self._counted(self.docs.where(F.col("lang").isin(list(held))), size, tell({}), below, seed, union)
        return exact.where(~F.col("lang").isin(list(held))).unionByName(
            self.named(counted.where(F.col("n") >= self.support), size)
        )

    def named(self, phrases: DataFrame, size: int) -> DataFrame:
        """``phrases`` with ``lang`` and ``phrase``, from the frequent words."""
        for k in _keys(size):
            word = self.names.select(F.col("h").alias(k), F.col("word").alias(f"_{k}"), *(["lang"] if k == "w1" else []))
            phrases = phrases.join(word, k)
        return phrases.select(*_keys(size), "lang", F.concat_ws(" ", *(f"_{k}" for k in _keys(size))).alias("phrase"), "n")


def contained(phrases: DataFrame, percent: int = CONTAINED) -> DataFrame:
    """``phrases`` without those that a longer one contains with ``percent`` of their count."""
    words = F.split("phrase", " ")
    size = F.size(words)
    parts = phrases.where(size > 2).select(
        "lang", "n",
        F.explode(F.expr(
            "flatten(transform(sequence(2, size(split(phrase, ' ')) - 1), k -> "
            "transform(sequence(1, size(split(phrase, ' ')) - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))"
        )).alias("phrase"),
    )
    longer = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n"))).drop("longer")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of each phrase at its lowest-scoring cut; ``counts``
    holds the counts of all parts."""
    words = F.split("phrase", " ")
    cuts = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), words.alias("_w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w") - F.col("k")), " ").alias("right"),
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    exact = "cast({} as decimal(15, 0))"
    a, l, r = (exact.format(c) for c in "alr")
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn(
        "score", F.expr(f"(cast(1000000 as decimal(7, 0)) * {a} * {a}) div ({l} * {r})")
    )
    best = joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", F.col("b.score").cast("long").alias("score"))


def collocations(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, percent: int = CONTAINED, best: int = BEST,
    map_bits: int = MAP_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of each language, by
    falling score, falling count, then the phrase."""
    miner = Miner(docs, support, longest, map_bits)
    miner.mine()
    counts = miner.words.where(F.col("n") >= support).unionByName(miner.phrases)
    rows = scored(contained(miner.phrases, percent), counts)
    top = top_per_group(
        rows, ["lang"], [("score", False), ("a", False), ("phrase", True)], best, "phrase", "rank", shuffle_levels(docs)
    )
    return top.join(miner.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

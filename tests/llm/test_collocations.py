"""op11: partitioned mining against a count of every phrase."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations, spans
from tests.llm.test_operators import docs


def brute(rows, support=10, longest=3, percent=50, best=2000):
    """``rows`` of (text, lang): all phrases counted in plain Python."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    gone = {
        (p[0], *p[1:][i : i + k])
        for p, a in found.items() for k in range(2, len(p) - 1) for i in range(len(p) - k)
        if 100 * a >= percent * f[(p[0], *p[1:][i : i + k])]
    }
    out = []
    for lang in n:
        rows = []
        for p, a in found.items():
            if p[0] != lang or p in gone:
                continue
            w = p[1:]
            cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, k = min((1000000 * a * a // (x * y), k) for k, (x, y) in enumerate(cuts))
            rows.append((-score, -a, " ".join(w).encode(), *cuts[k]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(rng, n, vocabulary=40):
    words = [rng.choice(["ab", "Été", "x1", "ı", "語", "don't"]) + str(i) for i in range(vocabulary)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(30)):
            t += rng.choice(words[: rng.randrange(1, vocabulary)]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " "])
        out.append(t)
    return out


def test_collocations_match_a_count_of_all_phrases(spark):
    rng = random.Random(3)
    t = texts(rng, 700, 9) + [None, "", "Of The of the", "\x0b\x0c;;", "w" * 200 + " tail"] * 12
    langs = [rng.choice(["en", "fr", None, "und", ""]) for _ in t]
    found = collocations.collocations(docs(spark, t, langs).repartition(7), map_bits=1 << 20)
    want = brute(list(zip(t, langs)))
    assert len(want) > 30 and result(found) == want


@pytest.mark.parametrize("best, percent", [(3, 50), (2000, 100), (2000, 1)])
def test_collocation_parameters(spark, best, percent):
    rng = random.Random(best + percent)
    t = texts(rng, 200, 12)
    found = collocations.collocations(docs(spark, t), percent=percent, best=best, map_bits=1 << 20)
    assert result(found) == brute([(x, "en") for x in t], percent=percent, best=best)


def test_collocations_at_lowered_supports_and_full_bitmaps(spark, monkeypatch):
    """Shards of 50 words, windows of 64 bytes, phrases of up to 4 words, and bitmaps so
    small that they let nearly everything through: the same result."""
    rng = random.Random(8)
    t = texts(rng, 150, 8)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 50)
    monkeypatch.setattr(spans, "WINDOW", 64)
    monkeypatch.setattr(collocations, "HELD_KEYS", 5)
    found = collocations.collocations(docs(spark, t), longest=4, map_bits=1 << 15)
    assert result(found) == brute([(x, "en") for x in t], longest=4)


def test_local_supports_hold_phrases_back_and_lose_none(spark):
    """Three shards of one language: the support of each is a third, and what one shard
    holds back is made up for in the union."""
    lines = ["alpha beta"] * 4 + ["gamma delta"] * 4 + [f"w{i} x{i}" for i in range(92)]
    rows = docs(spark, lines * 3, ["en"] * 300).repartition(3)
    miner = collocations.Miner(rows, map_bits=1 << 20)
    miner.mine()
    assert {r["phrase"]: r["n"] for r in miner.phrases.collect()} == {"alpha beta": 12, "gamma delta": 12}


def test_languages_that_shards_hold_back_beside_others(spark):
    """Twelve shards: "en" is in all of them and mined at support 1, each text of "fr" and
    "de" in one, so that their shards hold phrases back; all counts are exact."""
    rng = random.Random(21)
    t = texts(rng, 600, 9) + ["le la. " * 14, "le la. " * 2, "der die das der die das ; " * 6, "der die " * 5, "die das"]
    langs = ["en"] * 600 + ["fr"] * 2 + ["de"] * 3
    found = collocations.collocations(docs(spark, t, langs).repartition(12), map_bits=1 << 20)
    want = brute(list(zip(t, langs)))
    assert {x[0] for x in want} == {"en", "fr", "de"} and result(found) == want


def test_tasks_send_no_phrase_by_its_text(spark, monkeypatch):
    """Tasks send words by their text and phrases as hashes of their words, so that a phrase
    is named once and not by every task that has read it."""
    made, frame = [], type(spark.range(1))
    plain = frame.mapInArrow

    def spied(self, *args, **kwargs):
        made.append(plain(self, *args, **kwargs))
        return made[-1]

    monkeypatch.setattr(frame, "mapInArrow", spied)
    lines = ["alpha beta gamma"] * 48 + [f"w{i} x{i}" for i in range(48)]
    miner = collocations.Miner(docs(spark, lines).repartition(8), map_bits=1 << 20)
    miner.mine()
    assert {r["phrase"]: r["n"] for r in miner.phrases.collect()} == {"alpha beta": 48, "beta gamma": 48, "alpha beta gamma": 48}
    named = [df for df in made if "phrase" in df.columns]
    assert named and not any(df.where("phrase like '% %'").count() for df in named)


def test_words_of_one_hash_are_hashed_anew(spark, monkeypatch):
    """With seed 0 all words have one hash, so another seed is taken."""
    plain = collocations._hash_words

    def one_hash(seed):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([7] * len(b), pa.int64()), *b.columns], names=["h", "lang", "word"])

        return plain(seed) if seed else run

    monkeypatch.setattr(collocations, "_hash_words", one_hash)
    t = texts(random.Random(4), 200, 12) + ["w" * 200 + " tail"] * 12
    found = collocations.collocations(docs(spark, t), map_bits=1 << 20)
    assert result(found) == brute([(x, "en") for x in t])


def test_exact_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", big), ("en", "a", 7 * big), ("en", "b", 9 * big - 1)], "lang string, phrase string, n long")
    row = collocations.scored(counts.where("phrase = 'a b'"), counts).first()
    assert row["score"] == 1000000 * big * big // (7 * big * (9 * big - 1))


def test_collocations_of_nothing(spark):
    empty = docs(spark, ["a b"]).limit(0)
    assert collocations.collocations(empty, map_bits=1 << 20).count() == 0
    assert collocations.collocations(docs(spark, [None, "a b", ""]), map_bits=1 << 20).count() == 0


def test_a_bitmap_keeps_all_its_hashes(spark):
    rng = random.Random(5)
    h = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    import numpy as np

    known = collocations.Map.of(spark.createDataFrame([(x,) for x in h], "h long"), 1 << 20)
    assert known.has(np.array(h, np.int64).view(np.uint64)).all()
    others = np.array([rng.randrange(1 << 64) for _ in range(20000)], np.uint64)
    assert known.has(others).mean() < 0.02
    assert math.isclose(sum(bin(b).count("1") for b in known.bits), 5000, rel_tol=0.01)

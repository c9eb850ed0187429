"""op12: hashed weights, the draw and its ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import resampling, spans
from tests.llm.test_operators import docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out, able = [], []
    for doc_id, text in rows:
        n, f = features(text)
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in f
        )
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out))


def text(rng):
    return "".join(rng.choice(["a", "B", "é", "1", " ", " ", "-", "\n", "zz", "語", "\x00", ".", "w" * rng.choice([1, 1, 1, 40])])
                   for _ in range(rng.randrange(300)))


@pytest.mark.parametrize("percent, window", [(5, 1 << 19), (37, 61), (100, 1 << 10)])
def test_resampling_matches_plain_python(spark, monkeypatch, percent, window):
    rng = random.Random(percent)
    texts = [text(rng) for _ in range(300)] + [None, "", "..."] + ["of the " * 30] * 40
    target = [text(rng) for _ in range(30)] + ["of the sea", None]
    monkeypatch.setattr(spans, "WINDOW", window)
    items = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    found = resampling.resample(docs(spark, texts).repartition(5), items, percent)
    rows = found.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == brute(list(enumerate(texts)), target, percent)


def test_ties_go_to_the_smaller_id_then_to_the_row_stored_first(spark):
    rows = [(i % 50, 30, 0, 0, 7 if i < 900 else 9) for i in range(1000)] + [(None, 30, 0, 0, 7)] * 100 + [(3, 1, 0, 0, 99)]
    scores = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    out = resampling.drawn(scores, percent=50).collect()
    best = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in best] == list(range(1, 551)) and len(out) == 1101
    assert [r["score"] for r in best] == [9] * 100 + [7] * 450
    assert [r["doc_id"] for r in best[100:]] == [i for i in range(25) for _ in range(18)]
    every = resampling.drawn(scores, percent=100).where("rank is not null")
    assert every.count() == 1100 and every.where("doc_id is null").agg(F.min("rank")).first()[0] == 1001


def test_a_cutoff_is_found_in_any_range(spark):
    rng = random.Random(1)
    for values in ([5], [5] * 9, [-(1 << 62), 0, 1 << 61], [rng.randrange(-10**9, 10**9) for _ in range(300)]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        for need in {1, (len(values) + 1) // 2, len(values)}:
            assert resampling.least_enough(df, "v", need) == sorted(values)[need - 1]


def test_resampling_of_nothing(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resample(docs(spark, ["a"]).limit(0), target).count() == 0
    rows = resampling.resample(docs(spark, [None, "a b"]), target.limit(0)).orderBy("doc_id").collect()
    assert [(r["n_features"], r["rank"]) for r in rows] == [(0, None), (3, None)] and rows[0]["weight"] == 0


def test_noise_of_a_null_id():
    assert isinstance(resampling.noise(None), int) and resampling.noise(1) != resampling.noise(2)

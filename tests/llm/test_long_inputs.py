"""Inputs whose cost once grew with their square: repeated words, stray tags, many spans."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import pii, string_tiling, text_density


def test_equal_words_on_both_sides_take_bounded_memory():
    tracemalloc.start()
    assert string_tiling.tile(np.ones(20_000, np.uint64), np.ones(1500, np.uint64)) == (1500, 1)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("matches, span", [(1, 1 << 16), (5, 3), (1 << 20, 2)])
def test_runs_do_not_depend_on_the_chunks(monkeypatch, matches, span):
    rng = random.Random(matches)
    pairs = [
        (np.array([rng.randrange(v) for _ in range(60)], np.uint64), np.array([rng.randrange(v) for _ in range(25)], np.uint64))
        for v in (1, 2, 3, 9) for _ in range(40)
    ]
    want = [string_tiling.tile(a, b, 3) for a, b in pairs]
    monkeypatch.setattr(string_tiling, "MATCHES", matches)
    monkeypatch.setattr(string_tiling, "SEED_SPAN", span)
    assert [string_tiling.tile(a, b, 3) for a, b in pairs] == want


def test_stray_end_tags_cost_nothing():
    at = time.perf_counter()
    text_density.parse("<div>" * 60_000 + "</b>" * 60_000)
    assert time.perf_counter() - at < 5


def test_many_failed_spans_beside_many_good_ones():
    text = "999.1.1.1 4111111111111111 +1 (555) 123-4567 a@b.co 555-123-4567 " * 15_000
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    at = time.perf_counter()
    (row,) = next(iter(pii._scan([batch]))).to_pylist()
    assert time.perf_counter() - at < 30
    good, _ = pii.strict_spans(text)
    assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in good) for k in pii.KINDS] and row["n_email"] == 15_000
    strict = sorted((s["start"], s["end"]) for s in row["found"] if s["strict"])
    loose = [(s["start"], s["end"]) for s in row["found"] if not s["strict"]]
    joined = sorted([(*s, 1) for s in strict] + [(*s, 0) for s in loose])
    assert all(a[1] <= b[0] for a, b in zip(joined, joined[1:]) if a[2] != b[2])


@pytest.mark.parametrize("chunk", [1, 2, 5, 64])
def test_words_do_not_depend_on_the_chunks(monkeypatch, chunk):
    from quarry.llm import words

    rng = random.Random(chunk)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(["a", "B", "é", "  ", "\n", "x" * 9, "\x00", "."]) for _ in range(rng.randrange(25))) for _ in range(150)]
    batch = pa.array(texts, pa.string())
    want = [words.batch_words(batch, c) for c in (words._CLASS, words.LETTERS)]
    monkeypatch.setattr(words, "_CHUNK", chunk)
    monkeypatch.setattr(words, "_powers", {})
    for c, (h, at) in zip((words._CLASS, words.LETTERS), want):
        got = words.batch_words(batch, c)
        assert (got[0] == h).all() and (got[1] == at).all()


def test_a_long_word_is_not_held():
    from quarry.llm import words

    tracemalloc.start()
    h, at = words.batch_words(pa.array(["a" * (16 << 20), "a tail"]))
    assert len(h) == 3 and at.tolist() == [0, 1, 3] and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_a_cluster_without_members_of_its_own_has_nothing_to_search():
    from quarry.llm import pruned_graph

    table = pa.table({
        "home": pa.array([False, False]), "node": pa.array([4, 9], pa.int64()),
        "unit": pa.array([[1.0, 0.0], [1.0, 0.0]], pa.list_(pa.float64())), "near": pa.array([[9], [4]], pa.list_(pa.int64())),
    })
    assert pruned_graph._search(0.98, 8, 0.02)((0, 2, 1), table).num_rows == 0

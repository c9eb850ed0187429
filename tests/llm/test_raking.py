"""Raked probabilities: margins under caps, and cell tables of any size."""

import random

import numpy as np
import pandas as pd
import pytest

from quarry.llm import raking

SCHEMA = "doc_id long, text string, lang string, source string, topic string, tokens int"


def corpus(spark, n=1500):
    """A small source that its share of a draw exhausts, a hot one, nulls and repeated rows."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        source = "tiny" if i % 75 == 0 else "hot" if i % 3 else f"s{i % 4}"
        text = None if i % 97 == 0 else " ".join(["w"] * rng.randrange(1, 300))
        rows.append((None if i % 101 == 0 else i, text, rng.choice(["en", "en", "de", None]), source, "clash", 1))
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


def shares(rows, name, by):
    out, total = {}, sum(r.tokens * r[by] for r in rows)
    for r in rows:
        out[r[name] or "(none)"] = out.get(r[name] or "(none)", 0.0) + r.tokens * r[by]
    return {k: v / total for k, v in out.items()}


def test_margins_of_the_probabilities_hold_under_caps(spark):
    """What ``min(1, c * weight)`` misses: capped cells leave their margins to the others."""
    targets = {"source": {"hot": 0.55, "tiny": 0.05, "s0": 0.2, "s3": 0.1, "s1": 0.05, "s2": 0.05},
               "lang": {"en": 0.4, "de": 0.4, "(none)": 0.2}}
    rows = raking.mixed(corpus(spark), targets, keep=0.3).collect()
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens * r.probability for r in rows) / total - 0.3) < 1e-6
    assert any(r.probability == 1.0 for r in rows) and all(0 <= r.probability <= 1 for r in rows)
    held = sum(r.tokens for r in rows if r.source == "tiny") / (0.3 * total)
    reached = shares(rows, "source", "probability")
    assert held < 0.05 and abs(reached["tiny"] - held) < 1e-6  # drawn whole; the others share the rest
    rest = (1 - held) / 0.95
    assert all(abs(reached[s] - rest * v) < 1e-6 for s, v in targets["source"].items() if s != "tiny")
    assert all(abs(shares(rows, "lang", "probability")[k] - v) < 1e-6 for k, v in targets["lang"].items())


@pytest.mark.parametrize("targets, keep", [(None, 0.5), ({"lang": {"en": 0.7, "de": 0.3}}, 0.2), (None, 1.0), (None, 0.0)])
def test_cells_beyond_the_driver_get_the_same_rows(spark, monkeypatch, targets, keep):
    order = lambda r: (r.doc_id is None, r.doc_id, r.tokens)
    monkeypatch.setattr(raking, "TOLERANCE", 1e-7)
    monkeypatch.setattr(raking, "ROUNDS", 6)
    here = sorted(raking.mixed(corpus(spark, 300), targets, keep).collect(), key=order)
    monkeypatch.setattr(raking, "MAX_CELLS", 3)
    there = sorted(raking.mixed(corpus(spark, 300), targets, keep).collect(), key=order)
    assert len(here) == len(there) == 320
    for a, b in zip(here, there):
        assert (a.doc_id, a.text, a.topic) == (b.doc_id, b.text, b.topic)
        assert a.weight == pytest.approx(b.weight, abs=1e-5) and a.probability == pytest.approx(b.probability, abs=1e-5)


def test_margins_report(spark):
    rows = raking.mixed(corpus(spark), keep=0.3)
    report = {(r.dimension, r.value): r for r in raking.margins(rows).collect()}
    assert {d for d, _ in report} == set(raking.DIMENSIONS)
    for d in raking.DIMENSIONS:
        of = [r for r in report.values() if r.dimension == d]
        assert all(sum(r[c] for r in of) == pytest.approx(1.0) for c in ("present", "target", "expected", "drawn"))
    assert report["lang", "en"].expected == pytest.approx(report["lang", "en"].target, abs=1e-6)
    assert raking.margins(rows.where("false")).count() == 0


def test_probabilities_of_random_cells():
    rng = np.random.default_rng(1)
    for _ in range(40):
        cells = pd.DataFrame({"a": rng.integers(0, 5, 40), "b": rng.integers(0, 4, 40), "tokens": rng.integers(0, 500, 40)})
        cells = cells.groupby(["a", "b"], as_index=False).sum()
        targets = {c: dict(enumerate(rng.random(5) + 0.05)) for c in "ab"}
        total = cells["tokens"].sum()
        for keep in (0.05, 0.4, 0.9, 1.0):
            p = raking.probabilities(cells, targets, keep * total)
            assert ((p >= 0) & (p <= 1)).all()
            assert (p * cells["tokens"]).sum() == pytest.approx(keep * total, rel=1e-6)

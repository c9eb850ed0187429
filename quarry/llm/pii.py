"""Personal data by weak supervision (operator 2).

Candidate spans come from strict and loose patterns. Labelers vote on each: the
pattern with its validity rule, a gazetteer, the words before it, its shape and its
digits. Expectation-maximisation (Dawid-Skene, one reliability per labeler and class)
turns the votes into label probabilities, and a logistic span classifier is fitted to
those. It decides on what the strict patterns have not found; strict spans stay.

Votes and features are small integers, so the whole corpus enters the fit as counts
of their combinations: a table bounded by the number of codes, whatever the input.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, written

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++"
)
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")

# gazetteers: endings of mail domains, calling codes, issuer digits
_ENDINGS = frozenset("com org net edu gov info io co de fr es uk eu it nl ch at be us ca au".split())
_CALLING = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 62 63 64 65 66 81 82 86 90 91".split())
_CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "@"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "account", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "llame", "anruf", "appel"),
}
_AGAINST = ("token", "key", "secret", "hash", "version", "id =", "sha")
LABELERS = 5
_CONTEXT = 32


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _small_number(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def strict_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans that pass, matches that fail their rule), leftmost and non-overlapping
    within a kind, in the order of KINDS, then by start. Linear in the text."""
    good, bad = [], []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            good.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    if not re.search(r"[0-9]", text):
        return good, bad
    for m in _IP.finditer(text):
        if m.group(1):
            ok = all(map(_small_number, m.group().split(".")))
            (good if ok else bad).append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if len(d) >= 12:
            (good if 16 <= len(d) <= 19 and _luhn(d) else bad).append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            ok = 8 <= len(_digits(m.group())) <= 15
            (good if ok else bad).append(("phone", m.start(), m.end()))
    return good, bad


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "(at)" in text or "[at]" in text:
        found += [("email", m.start(), m.end()) for m in _LOOSE_MAIL.finditer(text)]
    found += [("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
    return found


def _side(c: str) -> int:
    """0 edge or white space, 1 punctuation, 2 letter or digit."""
    return 0 if not c or c.isspace() else 2 if c.isalnum() else 1


def _codes(text: str, kind: str, start: int, end: int, strict: int) -> tuple[int, int]:
    """(votes in base 3, features in mixed radix). A vote is 0 no, 1 yes, 2 abstain."""
    span = text[start:end]
    digits = _digits(span)
    before = text[max(0, start - _CONTEXT) : start].lower()
    left, right = _side(text[start - 1 : start]), _side(text[end : end + 1])
    if kind == "email":
        known = re.split(r"[.\s\])]", span)[-1].lower() in _ENDINGS
    elif kind == "ip":
        known = 1 <= int(span.split(".")[0].lstrip("0")[:4] or "0") <= 223
    elif kind == "card":
        known = digits[0] in "3456"
    else:
        known = digits.startswith(_CALLING) if span[0] == "+" else len(digits) == 10
    cue = 1 if any(c in before for c in _CUES[kind]) else 0 if any(c in before for c in _AGAINST) else 2
    shape = int(left < 2 and right < 2)
    plain = 2 if kind == "email" else int(len(set(digits)) > 2)
    votes = 0
    for v in (strict, int(known), cue, shape, plain):
        votes = votes * 3 + v
    size = 0 if len(span) < 12 else 1 if len(span) < 16 else 2 if len(span) < 24 else 3
    share = min(3, 4 * len(digits) // len(span))
    features = 0
    for v, base in ((KINDS.index(kind), 4), (size, 4), (share, 4), (left, 3), (right, 3), (cue, 3), (int(known), 2), (strict, 3)):
        features = features * base + v
    return votes, features


_RADIX = (4, 4, 4, 3, 3, 3, 2, 3)


def _scan(batches):
    kinds = {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            good, bad = strict_spans(text)
            taken = sorted((s, e) for _, s, e in good)
            starts = [s for s, _ in taken]
            reach = list(accumulate((e for _, e in taken), max))  # greatest end of the first spans

            def meets(s, e, starts=starts, reach=reach):
                before = bisect_left(starts, e)
                return before > 0 and reach[before - 1] > s

            more = [(*x, 0) for x in bad] + [(*x, 2) for x in loose_spans(text)]
            spans = [(kinds[k], s, e, *_codes(text, k, s, e, 1), True) for k, s, e in good]
            spans += [
                (kinds[k], s, e, *_codes(text, k, s, e, strict), False)
                for k, s, e, strict in more
                if not meets(s, e)
            ]
            count = [sum(k == kind for k, _, _ in good) for kind in KINDS]
            base = ",".join(f"{k}:{s}:{e}" for k, s, e in good)
            rows.append((doc_id, *count, sha256(base.encode()).hexdigest(), [
                {"kind": a, "start": b, "end": c, "votes": v, "features": f, "strict": t} for a, b, c, v, f, t in spans
            ]))
        cols = list(zip(*rows)) if rows else [[] for _ in range(7)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.string()),
             pa.array(cols[6], _SPANS)],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"],
        )


_SPANS = pa.list_(pa.struct([
    ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("features", pa.int32()),
    ("strict", pa.bool_()),
]))
_SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "found array<struct<kind: int, start: bigint, end: bigint, votes: int, features: int, strict: boolean>>"
)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of 0 no, 1 yes, 2 abstain) and how often each occurs:
    (P(vote | class) by labeler, class and vote; P(true | pattern))."""
    yes, no = (votes == 1).sum(1), (votes == 0).sum(1)
    post = (1 + yes) / (2 + yes + no)
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        for j in range(votes.shape[1]):
            for v in range(3):
                table[j, :, v] = weight[:, votes[:, j] == v].sum(1)
        table = (table + 0.1) / (table + 0.1).sum(2, keepdims=True)
        ll = np.log(prior)[:, None] + sum(np.log(table[j][:, votes[:, j]]) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
    return table, post


def _one_hot(features: np.ndarray) -> np.ndarray:
    out, rest = [np.ones((len(features), 1))], features.astype(np.int64)
    for base in reversed(_RADIX):
        out.append(np.eye(base)[rest % base])
        rest = rest // base
    return np.hstack(out)


def fit_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps on weighted rows; rows repeat ``counts`` times."""
    x = _one_hot(features)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + ridge * w
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row of
    ``docs(doc_id, text)``: counts and digest of the strict spans, and all spans,
    ``kind:start:end`` in code points, comma-joined by kind, then start.

    * null or empty text: no spans, digest of the empty string; texts are read whole;
    * null and repeated doc_ids: a row each; equal texts give equal results;
    * overlapping spans of different kinds all stay; an added span never overlaps a
      strict one;
    * an empty table, or one without candidates, fits nothing and adds nothing; other
      columns are ignored.
    """
    byte_batches(docs.sparkSession)
    found = written(docs.select("doc_id", "text").mapInArrow(_scan, _SCHEMA))
    # at most 3**5 vote patterns times 10,368 feature codes, a few hundred in practice
    codes = (
        found.select(F.explode("found").alias("x"))
        .groupBy("x.votes", "x.features")
        .agg(F.count("*").alias("n"))
        .toArrow()
        .to_pandas()
    )
    accepted: frozenset[int] = frozenset()
    if len(codes):
        votes = codes["votes"].to_numpy()
        patterns = np.stack([votes // 3**i % 3 for i in reversed(range(LABELERS))], 1)
        n = codes["n"].to_numpy().astype(float)
        _, post = reliabilities(patterns, n)
        features = codes["features"].to_numpy()
        weights = fit_classifier(features, post, n)
        accepted = frozenset(features[_one_hot(features) @ weights > np.log(threshold / (1 - threshold))].tolist())

    def spans(batches):
        for batch in batches:
            out = []
            for row in batch.column("found").to_pylist():
                kept = sorted((x["kind"], x["start"], x["end"]) for x in row if x["strict"] or x["features"] in accepted)
                out.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in kept))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "spans"]
            )

    return found.mapInArrow(spans, _SCHEMA.split(", found")[0] + ", spans string")

"""The pipeline as a whole against plain Python, stage by stage on what the last one kept."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm import raking, rank_profiles, string_tiling
from tests.llm.test_operators import brute_components, brute_tile

WORDS = {"aa": ["kata", "tako", "oka", "tok"], "bb": ["smit", "stroll", "glim", "ims"], "cc": ["ñé", "éñú", "ñúé", "úé"]}


def grams(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return []
    padded = f" {re.sub(' +', ' ', letters).strip()} "
    found = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del found[" "]

    def key(g):  # the code points as one number
        return sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))

    return sorted(found.items(), key=lambda x: (-x[1], key(x[0])))


def brute_languages(docs):
    top, counts = rank_profiles.TOP, {}
    for d in docs:
        if d["lang"] and _crc(d["doc_id"]) % 4 != 2:
            own = counts.setdefault(d["lang"], Counter())
            for g, n in grams(d["text"]):
                own[g] += n
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    profiles = {
        lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:top])} for lang, c in counts.items() if c
    }
    kept = []
    for d in docs:
        own = [g for g, _ in grams(d["text"])][:top]
        if not own:
            continue
        far = {
            lang: sum(min(top, abs(p[g] - i)) if g in p else top for i, g in enumerate(own)) for lang, p in profiles.items()
        }
        lang = min(far, key=lambda x: (far[x], x))
        if 1 - far[lang] / (top * len(own)) >= corpus_pipeline.MIN_SCORE:
            kept.append(d | {"lang": lang})
    return kept


def _crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


def brute_one_per_group(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    return [d for d, (i, _, root) in zip(docs, brute_components([d["text"] for d in docs])) if i == root]


def brute_clean(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bad = set()
    for d in docs:
        for item in map(words, items):
            least = min(string_tiling.LEAST, len(item))
            covered = brute_tile(words(d["text"]), item, least) if item else 0
            if covered and covered >= string_tiling.COVERAGE * len(item):
                bad.add(d["doc_id"])
    return [d for d in docs if d["doc_id"] not in bad]


def brute_mixed(docs):
    """Probabilities at most 1 whose expected tokens meet every margin, one bisection a value."""
    for d in docs:
        n = len(d["text"])
        d["topic"] = "note" if n < 200 else "short" if n < 1500 else "article" if n < 6000 else "long"
        d["tokens"] = len(d["text"].split())
    cells = Counter()
    for d in docs:
        cells[d["source"] or "(none)", d["lang"], d["topic"]] += d["tokens"]
    budget = raking.KEEP * sum(cells.values())
    wanted = []
    for k in range(3):
        own = Counter()
        for c, n in cells.items():
            own[c[k]] += n
        lo, hi = 0.0, 1e9  # the multiplier of the tempered shares, each at most what the value holds
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(n, mid * n**raking.TEMPER) for n in own.values()) < budget else (lo, mid)
        wanted.append({v: min(n, hi * n**raking.TEMPER) for v, n in own.items()})
    q = {c: raking.KEEP for c in cells}
    for _ in range(60):
        for k in range(3):
            for v, want in wanted[k].items():
                of = [c for c in cells if c[k] == v and cells[c]]
                if not of:
                    continue
                lo, hi = 0.0, 1e9
                for _ in range(100):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if sum(cells[c] * min(1, mid * q[c]) for c in of) < want else (lo, mid)
                for c in of:
                    q[c] *= hi if hi < 1e8 else 1.0
    out = []
    for d in docs:
        draw = (int(hashlib.md5(f"mix/{d['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        if draw < min(1, q[d["source"] or "(none)", d["lang"], d["topic"]]):
            out.append(d)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    item = " ".join(f"quiz{rng.choice('abcdefgh')}{i} tako" for i in range(20))
    rows = []
    for i in range(160):
        lang = "abc"[i % 3] * 2
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "o"]) for _ in range(rng.randrange(8, 90)))
        rows.append([text, lang])
    base = rows[4][0].split() + rows[7][0].split() + rows[10][0].split()
    for i in range(20):  # near copies, far ones among them
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "glim"
        rows.append([" ".join(w), "bb"])
    rows += [list(r) for r in rows[30:40]]
    half = item.split()
    rows += [[rows[0][0] + " " + item, "aa"], [" ".join(half[20:] + ["oka"] + half[:20]), "aa"]]
    rows += [[None, "aa"], ["", "bb"], ["12 34", None], ["зовут его иван", None], ["kata tako oka", None]]
    made = [(i, t, lang, None if i % 50 == 9 else f"s{i * i % 4}", len(t or "")) for i, (t, lang) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("tables"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(made, columns).write.parquet(f"{path}/documents.parquet")
    items = [(0, item), (1, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in made], [item, None, ""]


def test_stages_and_run_match_brute_force(spark, tables):
    path, docs, items = tables
    brute = [
        brute_languages, brute_one_per_group, lambda d: brute_clean(d, items), brute_mixed,
    ]
    frame = spark.read.parquet(f"{path}/documents.parquet")
    schema = frame.schema
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], brute):
        kept = plain([dict(d) for d in docs])
        got = stage(spark, frame, path)
        assert got.columns == frame.columns, name
        assert {(r.doc_id, r.lang) for r in got.collect()} == {(d["doc_id"], d["lang"]) for d in kept}, name
        assert 0 < len(kept) < len(docs), name  # every stage has work to do here
        docs = [{c: d[c] for c in frame.columns} for d in kept]
        frame = spark.createDataFrame([tuple(d.values()) for d in docs], schema)
    rows = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in docs)
    size = {d["doc_id"]: len(d["text"].encode()) + 16 for d in docs}
    shards = {}
    for r in rows:
        assert r.size == size[r.doc_id]
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_empty_tables(spark, tables, tmp_path):
    path, _, _ = tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

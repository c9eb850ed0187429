"""Each operator against a brute-force version, and its defined edge cases."""

import collections
import hashlib
import itertools
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import (
    chat_windows,
    common,
    hash_tree,
    line_runs,
    ngram_join,
    pii,
    pruned_graph,
    raking,
    rank_profiles,
    string_tiling,
    text_density,
)

DOCS = "doc_id long, text string, lang string, source string, n long, node string, label string"


def docs(spark, texts, langs=None):
    """Documents with ids from 0, and columns whose names clash with the operators' own."""
    rows = [
        (i, t, (langs or ["en"] * len(texts))[i], f"s{i % 3}", 7, "x", "y") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def near_group(rng, n, words=60, edits=4):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("hot", [2, 1000])
def test_ngram_join_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT_POSTING", hot)
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 7)
    monkeypatch.setattr(ngram_join, "LOCAL_MIN", 2)
    rng = random.Random(3)
    texts = near_group(rng, 40, edits=7) + near_group(rng, 25, edits=3) + near_group(rng, 10, 9, 1)
    texts += [None, "", " \t", "A b", "a B", "a b c", "x " * 400] + texts[:5]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(docs(spark, texts)).collect()}
    assert got == set(brute_components(texts))


def test_ngram_join_nulls_and_empty_table(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f"]).withColumn("doc_id", F.expr("nullif(doc_id, 1)"))
    got = sorted(map(tuple, ngram_join.classes(d).collect()), key=str)
    assert got == [(0, 2, 0), (None, 2, None)]
    assert ngram_join.one_per_group(d).count() == 2
    assert ngram_join.classes(d.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (5, 5)]
    got = {tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(i, 100) for i in (100, 101, 102)}


def test_string_tiling_catches_reordered_passages(spark):
    rng = random.Random(1)
    item = [f"q{i}" for i in range(30)]
    parts = [item[:10], item[10:20], item[20:]]
    shuffled = " x y ".join(" ".join(p) for p in (parts[2], parts[0], parts[1]))
    texts = [
        "pre " + " ".join(item) + " post", shuffled, shuffled.upper().replace(" ", "!! "), " ".join(item[:12]),
        None, "", "q1 " * 500, " ".join(rng.choices(item, k=200)),
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "zz yy"), (None, "a")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in string_tiling.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 1): (30, 1), (1, 1): (30, 3), (2, 1): (30, 3)}
    assert {r.doc_id for r in string_tiling.clean(docs(spark, texts), bench).collect()} == {3, 4, 5, 6, 7}
    assert string_tiling.contaminated(docs(spark, texts), bench.where("false")).count() == 0


def brute_tile(doc, item, least):
    marked_d, marked_i, covered = set(), set(), 0
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while (
                    i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]
                    and i + k not in marked_d and j + k not in marked_i
                ):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return covered
        covered += best[0]
        marked_d |= set(range(best[1], best[1] + best[0]))
        marked_i |= set(range(best[2], best[2] + best[0]))


def test_tile_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        doc = rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64)
        item = rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64)
        assert string_tiling.tile(doc, item, 3)[0] == brute_tile(doc.tolist(), item.tolist(), min(3, len(item)))


def brute_base(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base_spans_match_the_patterns():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("a.@1-+ 25(4é_%") for _ in range(rng.randrange(40)))
        assert pii.strict_spans(text)[0] == brute_base(text), text
    card = "4111 1111-1111 1111"
    assert pii.strict_spans(f"x {card} y")[0] == [("card", 2, 2 + len(card))]


def test_pii_result_and_edges(spark):
    texts = ["mail me at a@b.com or c [at] d.org", None, "", "call 555-123-4567 now", "ip 1.2.3.4 and 999.1.1.1"]
    rows = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    assert rows[0].n_email == 1 and rows[4].n_ip == 1
    assert rows[1].spans == rows[2].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i, t in enumerate(texts):
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(t or ""))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    assert pii.find(docs(spark, texts).where("false")).count() == 0


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in (0.95, 0.8, 0.7)], 1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, post = pii.reliabilities(patterns, counts.astype(float))
    assert abs(table[0][1][1] - 0.95) < 0.04 and abs(table[1][0][0] - 0.8) < 0.05
    assert post[(patterns == 1).all(1)][0] > 0.9 > 0.1 > post[(patterns == 0).all(1)][0]


def test_hash_tree_laws(spark):
    texts = ["é" * (i % 7) for i in range(3000)]
    rows = hash_tree.shard(docs(spark, texts)).collect()
    by = {}
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
        assert r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 30 < moved < 130
    odd = docs(spark, [None, ""]).withColumn("doc_id", F.expr("nullif(doc_id, 0)"))
    assert {(r.doc_id, r.size) for r in hash_tree.shard(odd).collect()} == {(None, 16), (1, 16)}


def test_hash_tree_weights_move_only_inside_their_subtree(spark):
    tree = hash_tree.layout(20)
    heavier = [hash_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 7 else 1.0) for x in tree]
    d = docs(spark, [""] * 2000)
    key = F.col("doc_id").cast("string")
    rows = hash_tree.place(hash_tree.place(d, key, tree, "a"), key, heavier, "b").select("a", "b").collect()
    assert all(r.a == r.b or r.b // 10 == 0 for r in rows)


def test_rank_profiles_held_out(spark):
    rng = random.Random(4)
    words = {"aa": ["kata", "tako", "oka"], "bb": ["smit", "stroll", "glim"], "cc": ["ñé", "éñú", "ñúé"]}
    texts, langs = [], []
    for i in range(120):
        lang = "abc"[i % 3] * 2
        texts.append(" ".join(rng.choices(words[lang], k=12)))
        langs.append(lang)
    texts += [None, "12 34 --", ""]
    langs += ["aa", None, "bb"]
    d = docs(spark, texts, langs)
    found = rank_profiles.predicted(d, rank_profiles.learn(rank_profiles.training_rows(d)))
    for r in found.collect():
        assert 0 <= r.score <= 1 and r.n == 7
        assert r.lang_pred == (langs[r.doc_id] if r.doc_id < 120 else "und")


def test_gram_counts_across_spans(monkeypatch):
    text = "Ab  cé1d " * 50
    whole = rank_profiles.gram_counts(text)
    monkeypatch.setattr(rank_profiles, "SPAN", 7)
    parts = rank_profiles.gram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_line_runs(spark):
    rng = random.Random(6)
    lines = ["Foo", " foo\t", "bar", "", "é É", "É é", "z"] + [f"u{i}" for i in range(400)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(9))) for _ in range(120)] + [None, "", "\n\n"]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    seen = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_runs.without_frequent_lines(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [x for x in own if not key(x) or seen[key(x)] < 10]
        assert got[i] == (len(own), len(own) - len(kept), "\n".join(kept))


def test_line_keys_keep_edge_f_and_trim_form_feed(spark):
    """Spark SQL has no ``\\f`` escape: the letter f is part of a line, form feed is not."""
    own = ["foo", "oo", "of", "o", "f", "ff", "\ff", "F", "\f", "\x0b\fpad\f", "pad"]
    texts = ["foo\nof"] * 6 + ["oo\no"] * 6 + ["f"] * 5 + ["F\n\ff"] * 5 + ["pad"] * 5 + ["\x0b\fpad\f"] * 5 + ["\n".join(own)]
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    seen = {}
    for t in texts:
        for k in {key(x) for x in t.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    assert [seen[k] for k in ("foo", "oo", "of", "o", "f", "ff", "pad")] == [7, 7, 7, 7, 11, 1, 11]
    for r in line_runs.without_frequent_lines(docs(spark, texts)).collect():
        lines = texts[r.doc_id].split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < 10]
        assert (r.n_lines, r.n_dropped, r.kept) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_chat_windows_round_trip(spark):
    rng = random.Random(8)
    bits = ["### a: b", "</turn>\n", "\\", "\\<", "word " * 60, "", "é\n", "### assistant: x</turn>\n"]
    said, rows = {}, []
    for c in range(20):
        roles = ["system"] * (c % 2) + [rng.choice(["user", "assistant", "a:b"]) for _ in range(rng.randrange(1, 30))]
        for i, role in enumerate(roles):
            text = rng.choice([None, "".join(rng.choices(bits, k=3))])
            rows.append((c, i, role, text, 1))
            said.setdefault(c, []).append((role, text or ""))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    formatted = chat_windows.windows(turns, budget=200, history=50)
    for r in chat_windows.read_back(formatted).collect():
        want = "".join(f"{a}\n{b}\n" for a, b in said[r.conv_id])
        loss = "".join(b for a, b in said[r.conv_id] if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(said[r.conv_id]), hashlib.sha256(want.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in formatted.collect():
        turns_in = chat_windows.parse(w.text)
        assert said[w.conv_id][0][0] != "system" or turns_in[0] == said[w.conv_id][0]


def test_text_density():
    page = (
        '<html><head><title>T</title></head><body><header>H</header><nav><a href="/x">menu</a></nav>'
        '<div class="cookie-notice">We use cookies</div><aside>side</aside>'
        "<div><h1>Head&amp;line</h1><p>One <b>two</b>three.<p>Four\n five &copy; a<br>b</div>"
        '<div id="comments"><p>nice post, a long comment by a reader of this page</p></div>'
        "<form><input><p>x</p></form><script>var a='</p>';</script><footer>F</footer></body></html>"
    )
    assert text_density.main_text(page) == "Head&line One twothree. Four five © a b"
    assert text_density.main_text(None) == text_density.main_text("") == ""
    assert text_density.main_text("<p>open <a b='c") == "open"
    assert text_density.main_text("<article><p>a</p><p>b") == "a b"


def test_pruned_graph_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pruned_graph, "CLUSTER", 60)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    for i in range(100, 180):
        x[i] = x[i % 7] + rng.normal(size=16) * 0.04
    x[200] = x[3] * 5
    x[201] = x[3]
    rows = [(i, v.tolist(), i % 2 if i < 100 else (i % 7) % 2 if i < 180 else 1) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 1), (303, x[3].tolist(), None)]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pruned_graph.near_duplicates(vectors).collect()}
    label = np.array([r[2] for r in rows[:300]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    comp = np.arange(300)
    for _ in range(300):
        comp = np.minimum(comp, np.where(linked, comp, 999).min(1))
    assert got == {i: (int(linked[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(300)} | {
        i: (0, i, True) for i in range(300, 304)
    }
    assert pruned_graph.near_duplicates(vectors.where("false")).count() == 0


def large_groups(spark, groups=20, size=150):
    """Groups of near copies in one label, each larger than a node's candidates."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(groups, 32)), size, axis=0)
    x = x / np.linalg.norm(x, axis=1)[:, None] + rng.normal(size=x.shape) * 0.005
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_pruned_graph_reaches_large_groups(spark):
    assert 150 > 4 * pruned_graph.DEGREE + 1
    got = pruned_graph.near_duplicates(large_groups(spark)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {
        (i, 149, i - i % 150, i % 150 == 0) for i in range(3000)
    }


def test_pruned_graph_audit_on_large_groups(spark):
    vectors = large_groups(spark)
    assert pruned_graph.audit(vectors) == {"queries": 60, "true": 60 * 149, "found": 60 * 149, "recall": 1.0}
    one = spark.createDataFrame([(0, 1)], "a long, b long")
    assert pruned_graph.audit(vectors, links=one)["found"] == 1


def test_pruned_graph_parts_clusters_that_the_sample_leaves_large(spark, monkeypatch):
    monkeypatch.setattr(pruned_graph, "SAMPLE", 5)
    monkeypatch.setattr(pruned_graph, "SPLIT", 500)
    monkeypatch.setattr(pruned_graph, "PARTS", 4)
    vectors = large_groups(spark)
    graph = pruned_graph.FlatGraph(vectors)
    graph.build()
    assert graph.placed.groupBy("cluster").count().agg(F.max("count")).first()[0] <= 500
    home = graph.placed.groupBy("node").agg(F.sum(F.col("home").cast("int")).alias("homes"))
    assert home.count() == 3000 and home.where("homes <> 1").isEmpty()
    assert graph.placed.select("node", "cluster").distinct().count() == graph.placed.count()
    got = pruned_graph.near_duplicates(vectors).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 149, i - i % 150) for i in range(3000)}


def test_cluster_graph_is_connected():
    x = np.eye(6)[[0] * 5 + [1] * 5 + [2] * 5]
    lists = [{j for j in range(15) if j // 5 == i // 5 and j != i} for i in range(15)]
    assert pruned_graph._parts(lists).max() == 2
    pruned_graph._join_parts(lists, x)
    assert not pruned_graph._parts(lists).any()
    assert all(i in lists[j] for i in range(15) for j in lists[i])


def test_raking_meets_margins_and_budget(spark):
    rng = random.Random(11)
    texts = [" ".join(["w"] * rng.randrange(1, 400)) for _ in range(3000)] + [None, ""]
    d = docs(spark, texts, [rng.choice(["en", "en", "en", "de"]) for _ in texts])
    targets = {"source": {"s0": 0.5, "s1": 0.25, "s2": 0.25}, "lang": {"en": 0.6, "de": 0.4}}
    rows = raking.mixed(d, targets, keep=0.2).collect()
    total = sum(r.tokens for r in rows)
    expected = sum(r.tokens * r.probability for r in rows)
    assert abs(expected / total - 0.2) < 1e-6
    raked = {}
    for r in rows:
        raked[r.source] = raked.get(r.source, 0) + r.tokens * r.weight
    assert all(abs(raked[s] / total - v) < 1e-6 for s, v in targets["source"].items())
    drawn = sum(r.tokens for r in rows if r.sampled)
    assert abs(drawn / total - 0.2) < 0.03
    assert raking.mixed(d.where("false")).count() == 0


def test_clean_judges_every_row_by_its_text(spark):
    quiz = " ".join(f"quiz{i}" for i in range(20))
    rows = [(None, f"a {quiz}"), (None, "clean one"), (None, None), (1, quiz), (1, "clean two"), (2, "clean two"), (2, quiz)]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row long")
    bench = spark.createDataFrame([(0, quiz)], "item_id long, text string")
    assert {r.row for r in string_tiling.clean(d, bench).collect()} == {1, 2, 4, 5}


def test_one_per_group_with_null_and_repeated_ids(spark):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    near = a + " more"
    rows = [
        (3, a, "x"), (3, a, "w"), (3, a, "x"),  # one of three equal rows
        (5, near, "x"), (5, b, "x"), (6, b, "x"),  # 5 is kept for b, not for a's copy
        (None, a, "x"), (None, c, "x"), (None, c + " more", "x"), (None, c, "y"),  # one for c
        (7, e, "x"), (None, e, "x"), (None, e + " more", "x"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in ngram_join.one_per_group(d, null_ids_apart=False).collect()]
    assert len(got) == 4
    assert {(3, a, "w"), (5, b, "x"), (7, e, "x")} < set(got)
    assert [r[1][:3] for r in got if r[0] is None] == ["c0 "]
    apart = [tuple(r) for r in ngram_join.one_per_group(d).collect()]
    assert set(got) < set(apart) and sorted(r[1][:2] for r in apart if r[0] is None) == ["a0", "c0", "e0"]
    blank = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, " ", "x")], d.schema)
    assert len(ngram_join.one_per_group(blank).collect()) == 3


def test_text_density_keeps_content_whatever_its_class():
    p = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."
    for name in ("layout has-sidebar", "post no-comments", "sidebar", "widget"):
        assert text_density.main_text(f"<div class='{name}'><article><p>{p}</article></div>") == p
        assert text_density.main_text(f"<div class='{name}'><p>{p}</p><p>{p}</p></div><footer>x</footer>") == f"{p} {p}"
    inside = f"<article><h1 class='article-header'>T</h1><p class='notice'>N</p><p>{p}</article>"
    assert text_density.main_text(inside) == f"T N {p}"
    beside = f"<div><p>{p}<p>{p}</div><div class='sidebar widget-2'><p>{p}</div>"
    assert text_density.main_text(beside) == f"{p} {p}"


def test_text_density_dropped_elements_end_with_their_parents():
    assert text_density.main_text("<p class='ad'>x<p>real</p>") == "real"
    assert text_density.main_text("<div><p class='ad'>x</div><article><p>first</p>") == "first"
    assert text_density.main_text("<div><nav><ul><li>a<li>b</div><p>real") == "real"
    assert text_density.main_text("<head><link><body><p>real") == "real"
    assert text_density.main_text("<ul><li class='share'>s<li>real</ul>") == "real"


class Held:
    def __init__(self, value):
        self.value = value


def test_only_shingles_that_others_publish_are_sent():
    # all published shingles were sent, however few had a partner
    rng = random.Random(4)
    texts = near_group(rng, 3, 400, edits=3) + [" ".join(f"u{i}x{j}" for j in range(400)) for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i::2])], names=["text"]) for i in range(2)]
    heavy = Held((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    announced = [y for x in batches for y in ngram_join._announce(5, 75, 4, heavy)([x])]
    marks, width = np.zeros(1 << 13, np.uint8), 1 << 9
    for part in ngram_join._announced_twice(4, 16)(announced):
        at = part.column("bucket")[0].as_py() * width
        marks[at : at + width] = np.frombuffer(pa.decompress(part.column("part")[0].as_buffer(), width, codec="zstd"), np.uint8)
    sent = [e for x in batches for y in ngram_join._publish(5, 75, 8, heavy, Held((16, marks)))([x]) for e in y.column("entries")]
    sent = np.concatenate([ngram_join._unpack(e) for e in sent])
    published = [list(ngram_join._prefixes([x], 5, 75, heavy, set())) for x in batches]
    prefixes = {a: prefix for x in published for a, _, prefix, _ in x}
    count = collections.Counter(np.concatenate(list(prefixes.values())).tolist())
    groups = {int(a) for a, x in prefixes.items() if any(count[t] > 1 for t in x.tolist())}
    assert len(groups) == 3
    for a, prefix in prefixes.items():
        shared = {t for t in prefix.tolist() if count[t] > 1}
        assert shared <= set(sent["token"][sent["node"] == a].tolist())
    assert len(sent) < 0.2 * sum(map(len, prefixes.values()))


def test_ngram_join_long_sets_in_tiles_and_scratch(spark, monkeypatch, tmp_path):
    # sets beyond the bits of BITS, exact copies, and no tables of sets left behind (F2)
    monkeypatch.setattr(ngram_join, "HOT_POSTING", 2)
    monkeypatch.setattr(ngram_join, "LOCAL_MIN", 2)
    monkeypatch.setattr(ngram_join, "BITS", 256)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    texts = []
    for i in range(16):
        w = list(base)
        for at in rng.sample(range(300), 3 * (i % 7)):
            w[at] = f"e{i}x{at}"
        texts.append(" ".join(w[: 300 - 5 * i]))
    texts += texts[:4] + [f"other{i} " * 3 for i in range(3)]
    monkeypatch.setattr(common, "scratch", lambda spark: str(tmp_path / uuid.uuid4().hex))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(docs(spark, texts)).collect()}
    assert got == set(brute_components(texts))
    tables = [pq.read_schema(next(d.glob("*.parquet"))).names for d in tmp_path.iterdir() if any(d.glob("*.parquet"))]
    assert tables and not [x for x in tables if "tokens" in x or "members" in x]


def test_tile_partners_are_those_of_all_links():
    rng = np.random.default_rng(6)
    sets = []
    for base in (rng.integers(0, 1 << 63, n, np.uint64) for n in (40, 600, 900, 5000)):
        for cut in (0, 0.05, 0.12, 0.3):
            keep = rng.random(len(base)) >= cut
            sets.append(np.unique(np.r_[base[keep], rng.integers(0, 1 << 63, 3, np.uint64)]))
    batch = {c: [] for c in ("node", "comp", "part", "n", "bits", "wide")}
    for i, s in enumerate(sets):
        wide = ngram_join._parities(s, max(2048, 1 << (2 * len(s)).bit_length())).tobytes() if 2 * len(s) > 2048 else None
        row = (i, i // 2, 0, len(s), ngram_join._parities(s, 2048).view(np.int64).tolist(), wide)
        for c, x in zip(batch, row):
            batch[c].append(x)
    key = [pa.scalar(x, t) for x, t in ((0, pa.int64()), ("R", pa.string()), (0, pa.int32()), (0, pa.int32()))]
    got = set(ngram_join._tile_partners(75)(key, pa.table(batch)).column("node").to_pylist())
    linked = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i // 2 != j // 2
              and 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))}
    assert linked and linked <= got and len(got) < len(sets)


def test_one_per_group_sends_the_keys_of_dropped_rows(spark):
    # the keys of all rows that stay were sent, or the texts shuffled
    texts = [" ".join(f"t{i}x{j}" for j in range(30)) for i in range(12)]
    texts += [texts[0] + " more", texts[1]]
    kept = ngram_join.one_per_group(docs(spark, texts))
    assert "LeftAnti" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12))

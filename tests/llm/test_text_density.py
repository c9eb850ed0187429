"""Main text by composite text density: what stays beside the path, and what names say."""

import time

import pytest

from quarry.llm import text_density

P = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."
PARAGRAPHS = f"<p>{P}</p><p>{P} Second.</p><p>{P} Third <a href=x>link</a>.</p>"
BODY = f"<h1>Title here</h1>{PARAGRAPHS}"
WANT = f"Title here {P} {P} Second. {P} Third link."
OTHER = f"<p>{P} reader says so.</p>" * 4
NAMES = [
    "class=comment-list", "id=disqus_thread", "class=related-posts", "class=ad-container", "class='sidebar-left x'",
    "id=post-comments", "class=commentlist", "class=adsbygoogle", "class=cookie-consent", "class=share-buttons",
    "class=sidebarRight", "role=complementary",
]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize(
    "page",
    [
        "<article>{body}{other}</article>",
        "<main>{body}{other}</main>",
        "<main><article>{body}</article>{other}</main>",
        "<div class=wrap><div class=content>{body}</div>{other}</div>",
        "<div id=page>{other}<div>{body}</div></div>",
        "<div class=wrap><h1>Title here</h1><div class=body>{paragraphs}</div>{other}</div>",
        "{body}{other}",
    ],
)
def test_what_is_named_otherwise_goes_at_any_depth(page, name):
    html = page.format(body=BODY, paragraphs=PARAGRAPHS, other=f"<div {name}>{OTHER}</div>")
    assert text_density.main_text(html) == WANT


def test_readers_never_outweigh_the_article():
    comments = f"<section id=comments><article class=comment>{OTHER * 20}</article></section>"
    for article in (f"<article>{BODY}</article>", f"<div>{BODY}</div>"):
        assert text_density.main_text(f"<div class=page>{article}{comments}</div>") == WANT
    assert text_density.main_text(f"<article>{BODY}</article><div class=ad>{OTHER * 20}</div>") == WANT


def test_the_path_decides_inside_one_wrapper():
    menu = "<div><a href=1>Home</a> <a href=2>About us</a></div>"
    html = f"<div class=wrap>{menu}<div><div>{BODY}</div></div><div><span>Imprint</span></div></div>"
    assert text_density.main_text(html) == WANT
    # sections whose density reaches the path's stay, in page order
    halves = f"<div class=wrap>{menu}<section>{BODY}</section><section>{PARAGRAPHS}{PARAGRAPHS}</section></div>"
    assert text_density.main_text(halves) == " ".join([WANT] + [WANT.removeprefix("Title here ")] * 2)


def test_an_article_keeps_its_short_parts():
    html = f"<article><header><h1>Title here</h1></header><div>{PARAGRAPHS}</div><p class=ad>buy</p><p>End.</p></article>"
    assert text_density.main_text(html) == f"{WANT} End."
    assert text_density.main_text(f"<main><article>{BODY}</article><div><p>{P} notice</p></div></main>") == WANT
    two = f"<article>{BODY}</article><div><p>{P}</p></div><article>{PARAGRAPHS}{PARAGRAPHS}</article>"
    assert text_density.main_text(two) == " ".join([WANT] + [WANT.removeprefix("Title here ")] * 2)


def test_tags_decide_nothing_where_the_densities_do():
    for n in (1, 2, 9):
        page = f"<nav><a href=1>x</a></nav><div class=ad>Buy now.</div><article>{BODY * n}</article><footer>F</footer>"
        assert text_density.main_text(page) == text_density.main_text(page.replace("article", "div"))


def test_deep_and_long_pages_take_linear_time():
    start = time.time()
    deep = "<div>" * 20_000 + BODY + "</div>" * 20_000
    assert text_density.main_text(deep) == WANT
    assert text_density.main_text(f"<div class=sidebar>{'<article>' * 20_000}{BODY}").endswith(WANT)
    assert len(text_density.main_text(f"<div>{BODY * 20_000}</div>")) == 20_000 * (len(WANT) + 1) - 1
    assert time.time() - start < 30


def test_null_and_repeated_ids_and_an_empty_table(spark):
    rows = [(None, "u", f"<p>{P}"), (1, None, None), (1, None, None), (1, "v", "")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, text_density.extract(pages).collect()), key=str)
    assert got == sorted([(None, "u", P, len(P)), (1, None, "", 0), (1, None, "", 0), (1, "v", "", 0)], key=str)
    assert text_density.extract(pages.where("false")).count() == 0

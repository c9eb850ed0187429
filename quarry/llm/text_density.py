"""Main text of web pages by composite text density (operator 8).

Every DOM node has C characters, T tags, of these LC characters and LT tags in links;
its density is C/T, adjusted by a logarithm that falls with its share of links. A
node's density sum adds its children's. The node of the greatest sum marks the
content; the least density on its path up to the body is the threshold that other
parts of the page must reach.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_batches

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>?", re.S
)
_RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "noscript", "textarea", "title", "template", "iframe")}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
                 "th": {"tr", "table"}, "option": {"select"}}
_DROP = frozenset(
    "head script style noscript template nav footer aside form button select input textarea iframe svg canvas object"
    " menu dialog audio video title".split()
)
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_PIECE = _TEXT | {"li", "dt", "dd", "caption", "figcaption", "summary"}
OUTWEIGHS = 4  # a named element of so many times the greatest density sum elsewhere is the content
# words in class, id or role that name something other than the article, as the first or last word of a name
_ELSEWHERE = frozenset(
    "ad ads adslot advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr newsletter sidebar"
    " aside related recommended trending nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar"
    " comment comments reply replies disqus share sharing complementary contentinfo pagination copyright".split()
)
# words that do so only where no other word of the name speaks for the article
_PERHAPS = frozenset(
    "promotion banner consent notice alert popup modal overlay signup subscribe widget header discussion social login"
    " search popular respond".split()
)
_LAYOUT = frozenset(
    "list thread container wrapper wrap box section area left right top bottom inner outer block panel unit slot region"
    " column col posts articles stories links items site main global primary secondary sticky fixed bar group row".split()
)
_MODIFIERS = frozenset("no not has have with without is hide show enable disable".split())  # of a layout: "has-sidebar"
_READERS = frozenset("comment comments reply replies disqus related recommended".split())
_RUN_ON = re.compile(r"sidebar|advert|adsby|sponsor|newsletter|breadcrumb|disqus|cookie|comments|commentlist|relatedp")


class _Node:
    __slots__ = ("tag", "up", "items", "c", "t", "lc", "lt", "density", "total", "gone", "aside", "readers", "inside")

    def __init__(self, tag, up, gone=False, named=frozenset()):
        self.tag, self.up, self.items = tag, up, []
        self.gone, self.aside = gone, bool(named)  # dropped; named as something other than the article
        self.readers = not named.isdisjoint(_READERS)  # as comments, or as other articles
        self.inside = tag in ("article", "main") or (up is not None and up.inside)
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0


def _dropped(tag: str, attributes: str, within: _Node) -> bool:
    """Whether an element is never content."""
    if tag in _DROP:
        return True
    if tag == "header":
        return not within.inside
    return tag not in ("article", "main") and bool(attributes) and _HIDDEN.search(attributes) is not None


def _words(name: str) -> list[str]:
    """The words of a class, id or role that say what an element is."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if not _MODIFIERS.isdisjoint(words):
        return []
    run_on = [_RUN_ON.match(w) for w in words]
    words = [w if w in _ELSEWHERE or m is None else m.group() for w, m in zip(words, run_on)]
    return [{"advert": "ads", "adsby": "ads", "commentlist": "comments", "relatedp": "related"}.get(w, w)
            for w in words if w not in _LAYOUT]


def _named(tag: str, attributes: str, within: _Node) -> frozenset:
    """The words of a whole name in class, id or role that names something other than
    the article; none for an element that may be content. Headings and paragraphs of an
    article are its own unless nothing but such words names them; a declared article can
    only be a comment, or another article that is recommended."""
    if not attributes or tag == "main":
        return frozenset()
    for m in _NAMES.finditer(attributes):
        for name in m.group(1).strip("\"'").split():
            words = _words(name)
            if not words:
                continue
            if within.inside and tag in _TEXT:
                elsewhere = _ELSEWHERE.issuperset(words)
            else:
                elsewhere = words[0] in _ELSEWHERE or words[-1] in _ELSEWHERE or (_ELSEWHERE | _PERHAPS).issuperset(words)
            if elsewhere and (tag != "article" or not _READERS.isdisjoint((words[0], words[-1]))):
                return frozenset(words)
    return frozenset()


def parse(html: str) -> _Node:
    """The DOM without what is never content. Items of a node are nodes and strings."""
    root = node = _Node("body", None)
    open_tags: Counter[str] = Counter()  # of the elements from the body down to ``node``, without it

    def leave(last: _Node) -> _Node:
        """Close all elements up to ``last``; the element it is in."""
        here = node
        while here is not last.up:
            open_tags[here.tag] -= 1
            here = here.up
        return here

    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            if not node.gone:
                node.items.append(unescape(html[at:]))
            break
        if m.start() > at and not node.gone:
            node.items.append(unescape(html[at : m.start()]))
        at = m.end()
        if not m.group(2):
            continue
        close, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if not close and tag in _RAW:
            end = _RAW[tag].search(html, at)
            gt = html.find(">", end.end() - 1) if end else -1
            at = gt + 1 if gt >= 0 else len(html)
            continue
        if tag in ("html", "body"):
            if tag == "body" and open_tags["head"]:
                up = node
                while up.tag != "head":
                    up = up.up
                node = leave(up)
            continue
        if close:
            if open_tags[tag]:  # else it closes nothing
                up = node
                while up.tag != tag:
                    up = up.up
                node = leave(up)
            continue
        if tag in _CLOSES_P and open_tags["p"]:
            up = node
            while up is not None and up.tag not in ("p", "td", "th", "button"):
                up = up.up
            if up is not None and up.tag == "p":
                node = leave(up)
        if tag in _SELF_CLOSING and open_tags[tag]:
            up = node
            while up.up is not None and up.tag != tag and up.tag not in _SELF_CLOSING[tag]:
                up = up.up
            if up.tag == tag:
                node = leave(up)
        if tag in _VOID or attributes.endswith("/"):
            if tag not in _DROP and not node.gone:
                node.items.append(_Node(tag, node))
            continue
        gone = node.gone or _dropped(tag, attributes, node)
        child = _Node(tag, node, gone, frozenset() if gone else _named(tag, attributes, node))
        if not gone:
            node.items.append(child)
        node = child
        open_tags[tag] += 1
    return root


def content(root: _Node) -> list[_Node]:
    """Drop the elements that are named as something else than the article, and measure
    what is left. Names lose against the page: text that outweighs the rest stays
    whatever its names say, and so does the one declared article, unless an article or
    main that no name speaks against has text. Comments and recommended articles stay
    only where there is no other text."""
    nodes = measure(root)
    if not any(x.aside for x in nodes):
        return nodes
    outside, within = [], []
    readers: set[int] = set()  # elements in one that is named as comments or other articles
    for x in nodes:  # parents first
        up = x.up
        x.inside = x.aside or (up is not None and up.inside)
        if (x.aside and x.readers) or (up is not None and id(up) in readers):
            readers.add(id(x))
        (within if x.inside else outside).append(x)
    # a density that named elements give to their parent does not speak for the parent
    own = max((x.total - sum(i.density for i in x.items if isinstance(i, _Node) and i.aside) for x in outside), default=0.0)
    own = max(own, max((x.density for x in outside if x.tag in _TEXT), default=0.0))
    text = any(i.strip() for x in outside for i in x.items if isinstance(i, str))
    held = {id(x) for x in within if x.tag == "main"}
    articles = [x for x in within if x.tag == "article" and id(x) not in readers]
    if not any(x.tag in ("article", "main") and x.c for x in outside):
        if len(articles) == 1:
            held.add(id(articles[0]))
        best = max((x for x in within if not text or id(x) not in readers), key=lambda x: x.total, default=None)
        if best is not None and best.total > OUTWEIGHS * own:
            held.add(id(best))
    for x in reversed(nodes):  # children first
        if id(x) in held:
            x.aside = False
            if x.up is not None:
                held.add(id(x.up))
    for x in nodes:
        x.items = [i for i in x.items if isinstance(i, str) or not i.aside]
        x.c = x.t = x.lc = x.lt = 0
        x.density = x.total = 0.0
    return measure(root)


def _nodes(root: _Node) -> list[_Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(i for i in reversed(x.items) if isinstance(i, _Node))
    return out


def measure(root: _Node) -> list[_Node]:
    """Fill in counts, densities and density sums; returns all nodes, parents first."""
    nodes = _nodes(root)
    for x in reversed(nodes):
        x.c += sum(len("".join(i.split())) for i in x.items if isinstance(i, str))
        if x.tag == "a":
            x.lc, x.lt = x.c, x.t + 1
        if x.up is not None:
            x.up.c += x.c
            x.up.t += x.t + 1
            x.up.lc += x.lc
            x.up.lt += x.lt
    page = root.lc / max(root.c, 1)
    for x in nodes:
        if x.c:
            tags, links, own = max(x.t, 1), max(x.lt, 1), max(x.c - x.lc, 1)
            base = math.log(x.c / own * x.lc + page * x.c + math.e)
            x.density = max(0.0, x.c / tags * math.log(x.c / max(x.lc, 1) * tags / links + 1e-9) / max(math.log(base + 1e-9), 1.0))
        if x.up is not None:
            x.up.total += x.density
    return nodes


def _blocks(root: _Node) -> str:
    blocks, run = [], []

    def end():
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x.tag in _BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.items))
    end()
    return " ".join(blocks)


def _stays(x: _Node, threshold: float, mixed: bool, article: bool, before: bool) -> bool:
    """Whether an element beside the path is content. Its density decides; below the
    threshold stay parts of running text (``mixed``), a heading before the content, and
    in a declared article all that is not mostly links."""
    if not x.c or (mixed and x.tag not in _BLOCK) or x.density >= threshold:
        return True
    if article:
        return 2 * x.lc <= x.c
    return before and x.tag in _TEXT and x.tag[0] == "h" and not x.lc


def main_text(html: str | None) -> str:
    """The article's text, blocks joined by one space; empty for a page without.

    The path leads from the body to the node of the greatest density sum. At every
    level of it the elements beside the path stay if their density reaches the least
    one on the path. A declared article or main on the path breaks ties: what lies
    outside it stays only if it is an article too."""
    root = parse(html or "")
    nodes = content(root)
    if not root.c:
        return ""
    # a paragraph or list item is a piece of content, not what holds it
    best = max((x for x in nodes if x.tag in _BLOCK and x.tag not in _PIECE), key=lambda x: x.total)
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    path.reverse()
    threshold = min(x.density for x in path)
    declared = next((i for i in range(len(path) - 1, -1, -1) if path[i].tag == "article"), None)
    if declared is None:
        declared = next((i for i in range(len(path) - 1, -1, -1) if path[i].tag == "main"), 0)
    article = False
    for level, (x, child) in enumerate(zip(path, path[1:])):
        article = article or x.tag == "article"
        mixed = any(isinstance(i, str) and i.strip() for i in x.items)
        kept, before = [], True
        for i in x.items:
            if i is child:
                kept.append(i)
                before = False
            elif level < declared:
                if not isinstance(i, str) and i.tag == "article" and i.density >= threshold:
                    kept.append(i)
            elif isinstance(i, str) or _stays(i, threshold, mixed, article, before):
                kept.append(i)
        x.items = kept
    return _blocks(root)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    * null or empty html, or no content: empty text, 0; pages are read whole;
    * broken markup: unclosed elements end with their parents, stray end tags and
      unfinished references stay out or stand as they are;
    * equal sums: the first node in page order;
    * null and repeated ids: a row each; an empty table gives no rows; other columns
      are ignored.
    """
    byte_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()),
                    batch.column("url").cast(pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )

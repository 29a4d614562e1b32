"""Main text of web pages: flat blocks, judged by a decision tree over words, links and neighbours.

A page is read as a flat row of text blocks: what stands between two block-level tags. Each block has
its number of words and its link density (share of words inside links), those of the block before and
after, whether it is a heading or a list item, and what encloses it: an article or main part, a part
named for something else (navigation, header, footer, aside, form), or a part whose class, id or role
names such a thing; and whether the page has an article or main part at all. A decision tree, trained here on the blocks of a few small labelled pages, tells
main text from the rest.

Scripts, styles, comments, titles and the like are no blocks. Character references are decoded and
white space becomes single spaces; blocks are joined by an empty line.

Defined cases: null or empty html gives an empty text; broken markup is read as far as it goes, an
unclosed script, style, textarea, title, iframe or comment hides the rest, other unclosed elements hide nothing; repeated rows are rows of their own; an empty table gives
an empty result. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callgauge.llm.registry import query, table

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|textarea|iframe|title)(?=[\s/>])(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Tags that end a text block, tags that enclose parts, and words in class, id and role names.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li link main menu meta nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page, as far as they are closed; these may hold others of their kind.
HIDDEN = frozenset("noscript template select svg object button".split())
PARTS = frozenset("article main section div nav header footer aside form ul ol dl table fieldset details dialog figure blockquote menu address".split())
MAIN_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice gdpr alert popup modal overlay "
    "comment comments reply replies discussion disqus nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets related recommended more "
    "share sharing social subscribe subscription newsletter signup login search form footer header masthead pagination pager tags legal copyright "
    "contentinfo complementary disclaimer toolbar".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
#: Words that make a name a state or a layout (``with-sidebar``, ``comments-open``), and names of parts that hold articles of others.
STATE_WORDS = frozenset("with without has no not is open opened closed enabled disabled on off".split())
LIST_WORDS = frozenset("comment comments reply replies discussion disqus related recommended".split())
#: A part around so many blocks at least, and around all blocks of the page, says nothing of them.
WRAPPER_BLOCKS = 3


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    item: bool
    main: int
    other: int


@dataclass(eq=False)
class _Open:
    """A part: whether it is a main one, whether something else, whether its tag says so, and the words that do (none for a form)."""

    tag: str
    main: bool
    other: bool
    firm: bool
    words: set[str]


def names_of(attributes: str) -> set[str]:
    """Words of class, id and role names; a name that tells a state is none."""
    names = [n for m in NAMES.finditer(attributes) for n in "".join(filter(None, m.groups())).lower().split()]
    parts = [set(re.split(r"[^a-z]+", n)) for n in names]
    return set().union(*(p for p in parts if not p & STATE_WORDS))


def enclosed(parts: tuple[_Open, ...], wrappers: set[_Open]) -> tuple[int, int]:
    """(main, other) of a block within ``parts``, outermost first.

    The innermost part that says something decides: an aside within an article is an aside, and an article
    within a form or a part that only a name speaks against is an article. Comments and teasers may be
    articles too: within a main part, or in a list of such, they are something else.
    """
    main = other = 0
    firm, words = False, set()
    for p in parts:
        if p.main and main >= 0 and not (p.other and (main or other)):
            weak = not firm and (p.tag == "main" or p.tag == "article" and not words & LIST_WORDS or words <= {""})
            if weak or not other:
                main, other = 1, 0
                continue
        if p.other and p not in wrappers:
            # below zero: something else within a main part, which no article inside it brings back
            main, other = (-1 if main else 0) if not other else main, 1
            firm, words = firm or p.firm, words | p.words
    return max(main, 0), other


@dataclass
class _Reader:
    parts: list[_Open] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    within: list[tuple[tuple[_Open, ...], bool]] = field(default_factory=list)
    links: int = 0
    tag: str = ""
    named_other: bool = False

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.pieces)).split())
        if text:
            linked = len(html.unescape(" ".join(self.linked)).split())
            words = len(text.split())
            self.blocks.append(Block(text, words, min(linked, words), self.tag[:1] == "h" and self.tag[1:].isdigit(), self.tag in ("li", "td", "th", "dt", "dd"), 0, 0))
            self.within.append((tuple(self.parts), self.named_other))
        self.pieces.clear()
        self.linked.clear()

    def text(self, part: str) -> None:
        if part:
            self.pieces.append(part)
            if self.links:
                self.linked.append(part)

    def element(self, closing: bool, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links = 0 if closing else 1
        elif tag == "br":
            self.pieces.append(" ")
        if tag not in BLOCKS:
            return
        self.flush()
        self.links = 0
        words = set() if closing or not attributes or tag in ("html", "body") else names_of(attributes)
        other = bool(words & OTHER_WORDS)
        self.tag, self.named_other = ("", False) if closing else (tag, other and tag not in PARTS)
        if tag not in PARTS:
            return
        if not closing:
            firm = tag in OTHER_TAGS and tag != "form"
            said = words & OTHER_WORDS | ({""} if tag == "form" else set())
            self.parts.append(_Open(tag, tag in MAIN_TAGS or (bool(words & MAIN_WORDS) and not other), tag in OTHER_TAGS or other, firm, said))
        elif any(p.tag == tag for p in self.parts):
            while self.parts.pop().tag != tag:
                pass

    def place(self) -> list[Block]:
        """The blocks, each with what encloses it."""
        wrappers: set[_Open] = set()
        if len(self.blocks) >= WRAPPER_BLOCKS:
            wrappers = {p for p in set(self.within[0][0]).intersection(*(parts for parts, _ in self.within)) if p.other and not p.firm}
        for block, (parts, named) in zip(self.blocks, self.within):
            block.main, block.other = enclosed(parts, wrappers)
            if named:
                block.other = 1
        return self.blocks


def hidden_spans(tokens: list[re.Match]) -> dict[int, int]:
    """Place of the end tag of each hidden element, by the place of its start tag.

    An element whose block ends first, or that has no end tag, is not closed and hides nothing.
    """
    stack: list[tuple[str, int]] = []
    open_tags: Counter = Counter()
    spans = {}
    for i, m in enumerate(tokens):
        tag = (m[3] or "").lower()
        if tag not in HIDDEN and tag not in PARTS:
            continue
        if m[2] != "/":
            if not (tag == "svg" and m[4].endswith("/")):
                stack.append((tag, i))
                open_tags[tag] += 1
        elif open_tags[tag]:
            while True:
                last, start = stack.pop()
                open_tags[last] -= 1
                if last == tag:
                    break
            if tag in HIDDEN:
                spans[start] = i
    return spans


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks of a page, in order."""
    page, reader, at = page or "", _Reader(), 0
    tokens = list(TOKEN.finditer(page))
    spans, until = hidden_spans(tokens), -1
    for i, m in enumerate(tokens):
        if i <= until:
            at = m.end()
            continue
        reader.text(page[at:m.start()])
        at = m.end()
        if i in spans:
            until = spans[i]
            reader.text(" ")
        elif m[3]:
            reader.element(m[2] == "/", m[3].lower(), m[4])
        elif m[1]:
            reader.text(" ")
    reader.text(page[at:])
    reader.flush()
    return reader.place()


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block: words and link density of it, the one before and the one after, its kind, what encloses it."""
    own = [(min(b.words, 200), b.linked / b.words) for b in blocks]
    around = [(0, 0.0), *own, (0, 0.0)]
    has_main = any(b.main for b in blocks)
    rows = [(*around[i + 1], *around[i], *around[i + 2], b.heading, b.item, b.main, b.other, b.main or not has_main) for i, b in enumerate(blocks)]
    return np.array(rows, float).reshape(len(blocks), 11)


# ---- decision tree ---------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """Binary tree by falling Gini impurity: a share of main text, or (feature, threshold, below, above)."""
    if depth == 0 or len(y) <= least or y.min() == y.max():
        return float(y.mean())

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return len(part) * p * (1 - p)

    best = None
    # features in an order of preference: what encloses a block first, for equal gains
    for f in (9, 10, 8, 1, 0, 3, 5, 2, 4, 6, 7):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            below = x[:, f] < t
            left = impurity(y[below]) + impurity(y[~below])
            if best is None or left < best[0] - 1e-12:
                best = (left, f, t)
    if best is None or best[0] >= impurity(y) - 1e-12:
        return float(y.mean())
    below = x[:, best[1]] < best[2]
    return best[1], float(best[2]), grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def judge(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


_LONG = "A long sentence about the matter that goes on for quite some time, so that it reads like prose and holds many words of many kinds. "
#: The labelled table: small pages whose blocks of main text carry the mark, and others that do not.
MARK = "§"
LABELLED = (
    f"""<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News of today</a></li></ul></nav><div class="ad">Buy now. {_LONG}</div>
    <article><h1>§A heading</h1><p>§{_LONG * 2}</p><p>§Short.</p><p>§{_LONG}<a href="/y">a link</a> and more.</p><ul><li>§An item</li><li>§{_LONG}</li></ul>
    <aside class="related"><a href="/z">Read on</a></aside></article><footer>&copy; example 2020. {_LONG}</footer>""",
    f"""<header><h1><a href="/">Site</a></h1><p>Slogan of the site</p></header><main><h2>§Title</h2><p>§{_LONG}</p><blockquote>§{_LONG}</blockquote><p>§End.</p>
    <section class="comments"><h3>Comments</h3><p>{_LONG}</p><p>I agree.</p></section></main><aside><p>{_LONG}</p><ul><li><a href="/a">One</a></li></ul></aside>""",
    f"""<div id="menu"><a href="/1">One</a> <a href="/2">Two</a></div><div id="content"><h1>§Title words here</h1><p>§{_LONG * 3}</p><p>§A line.</p></div>
    <div class="cookie-notice"><p>We use cookies. {_LONG}</p></div><div id="footer"><p>{_LONG}</p></div>""",
    f"""<div><p><a href="/1">One</a> | <a href="/2">Two</a> | <a href="/3">Three</a></p></div><div><p>§{_LONG * 3}</p><p>§{_LONG * 2}</p><p>§{_LONG}</p></div><div><p>Imprint</p></div>""",
    f"""<p><a href="/1">Back to the list of all pages</a></p><p>§{_LONG * 2}</p><p>§{_LONG}</p><form><p>Your name: {_LONG}</p></form><p class="copyright">All rights reserved.</p>""",
    f"""<article><header><h1>Site header in the article</h1></header><p>§{_LONG}</p><div class="share"><a href="/t">Share</a> this</div><p>§Yes.</p><table><tr><td>§A cell</td><td>§12</td></tr></table>
    <form><p>Subscribe to our letter</p></form><div class="advert">{_LONG}</div></article>""",
    """<article><h1>§One title</h1><p>§No.</p></article><div class="sidebar"><h2>Popular</h2><p>Words in the sidebar</p></div>""",
    f"""<div><p>Slogan of the site</p></div><article><h1>§A title</h1><p>§{_LONG}</p><p>§The <a href="/e">end</a>.</p><p>§Last words.</p></article>""",
    f"""<p>{_LONG}</p><p>The site of all sites</p><main><p>§{_LONG}</p><ul><li>§<a href="/l">A linked title of a book</a></li><li>§Two</li></ul><p>§{_LONG * 2}</p><p>§Over.</p></main><p>{_LONG * 2}</p>""",
    f"""<article><h2>§Words</h2><p>§First.</p><p>§{_LONG}</p></article><p>{_LONG}</p><p>More to come</p>""",
    """<main><h1>§Title</h1><p>§Words.</p></main>""",
    f"""<article><p>§{_LONG}</p><p>§Yes.</p></article>""",
    f"""<h1>§A page without parts</h1><p>§{_LONG}</p><p>§{_LONG * 2}</p><p>§{_LONG}</p><p>§And a last one that is long enough to be read as a part of the text.</p>""",
    f"""<div class="layout with-sidebar"><nav><a href="/">Home</a></nav><main><article class="post comments-open"><h1>§A title</h1><p>§{_LONG}</p><p>§Yes.</p></article></main>
    <div class="sidebar"><p>{_LONG}</p></div></div>""",
)


def trained_tree():
    """The tree grown on the labelled pages."""
    rows, labels = [], []
    for page in LABELLED:
        blocks = blocks_of(page)
        rows.append(features(blocks))
        labels += [b.text.startswith(MARK) for b in blocks]
    return grow(np.vstack(rows), np.array(labels, float))


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks)) if judge(tree, row) >= 0.5)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars): main text of every page's ``html``."""
    tree = trained_tree()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            columns = [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return pages.select(*keep, "html").mapInArrow(read, f"{schema}, text string, n_chars bigint")


@query("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))

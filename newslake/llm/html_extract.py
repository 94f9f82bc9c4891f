"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each block is described by its word
count and link density, those of its neighbours, and whether it stands in a
container that announces the article or the frame around it. A decision tree,
trained on a small labelled table of invented pages, keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose whole content is never text of the page, and of those the ones whose content is not markup.
SKIP = frozenset("script style template noscript iframe svg annotation annotation-xml canvas audio video select textarea datalist title head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag closes these open elements first.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
FRAME_TAGS = frozenset("nav aside footer form menu search dialog".split())
ARTICLE_TAGS = frozenset("article main".split())
# Words of class, id and role that announce the frame, and the article.
FRAME_WORDS = frozenset("ad ads adv advert advertisement adverts advertising alert banner bar breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown feedback footer gdpr hidden legal login masthead menu menubar message modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related reply replies respond search share sharing shop sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar trending widget complementary contentinfo navigation "
                        # the same in other languages
                        "anzeige werbung reklame kommentar kommentare publicite reclame commentaire commentaires anuncio publicidad comentario comentarios response responses".split())
# Of these, the words that also name what wraps a whole page or article; the others are never released.
HARD_WORDS = frozenset("adv advert advertisement adverts advertising comment comments commentlist consent cookie cookies contentinfo copyright disclaimer discussion disqus feedback footer gdpr hidden login newsletter promo promoted promotion recommended related reply replies respond signup sponsor sponsored subscribe subscription teaser trending "
                       "anzeige werbung reklame kommentar kommentare publicite reclame commentaire commentaires anuncio publicidad comentario comentarios response responses".split())
# After these a word names a state of the element and not the element: no-sidebar, has-nav.
STATES = frozenset("no non has have with without".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
HEAD_WORDS = frozenset("header head".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*>")
SPACES = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    frame: int  # open containers of the frame
    article: int  # open containers of the article
    heading: int
    marked: bool  # stands in an element with data-main, as in the labelled table
    soft: tuple[int, ...] = ()  # those of the open frame containers that may turn out to wrap the article

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _kind(tag: str, attributes: str, inside: bool) -> tuple[int, int, bool, bool, bool]:
    """Whether an element is of the frame or of the article, is hidden, is
    marked, and whether only a name (or a form) makes it one of the frame."""
    frame, article = int(tag in FRAME_TAGS), int(tag in ARTICLE_TAGS)
    soft = tag == "form"
    hidden = marked = False
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip(" /\n\t") else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                words = [x for x in re.split(r"[^a-z]+", name) if x]
                names |= {x for i, x in enumerate(words) if not i or words[i - 1] not in STATES}
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key == "data-main":
            marked = True
    if tag not in ("html", "body") and not article:
        if names & FRAME_WORDS:
            soft = (soft or not frame) and not names & HARD_WORDS
            frame = 1
        elif names & ARTICLE_WORDS:
            article = 1
    if not inside and (tag == "header" or names & HEAD_WORDS and tag not in HEADING) and not article:
        frame, soft = 1, False
    return frame, article, hidden, marked, soft


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a whole page in order. Character references are
    decoded, white space in a block is one space; unclosed and stray tags,
    cut-off pages, null and empty ones do no harm."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, int, int, bool, int]] = []  # open elements: tag, frame, article, marked, number of those that may wrap the article or -1
    frame = article = 0
    parts: list[str] = []
    linked: list[str] = []
    heading = link = wrappers = 0

    def flush():
        nonlocal heading
        text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, len(text.split(" ")), len(html.unescape("".join(linked)).split()), frame, article, heading, any(s[3] for s in stack), tuple(s[4] for s in stack if s[4] >= 0) if wrappers else ()))
        parts.clear()
        linked.clear()

    def close(i: int):
        nonlocal frame, article
        for _, f, a, _, _ in stack[i:]:
            frame -= f
            article -= a
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        m = TOKEN.match(page, lt) if lt >= 0 else None
        end = lt if m else (lt + 1 if lt >= 0 else n)  # a lone < is text
        if end > at:
            parts.append(page[at:end])
            if link:
                linked.append(page[at:end])
        if not m:
            at = end
            continue
        at = m.end()
        if not m[2]:
            if page.startswith("<![CDATA[", m.start()):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
                linked.append(" ")
            if tag in BLOCK:
                flush()
                if tag in HEADING:
                    heading = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("body", "html", "article", "main", "td", "th") and tag not in BLOCK:
                    break
            continue
        shut = m[3].rstrip().endswith("/") and tag not in BLOCK
        f, a, hidden, marked, soft = _kind(tag, m[3], article > 0)
        if (tag in SKIP or hidden or tag == "button" and f) and tag not in VOID:
            if tag in BLOCK:
                flush()
            if not shut:
                at = _past(page, at, tag, stack[-1][0] if stack else None)
            continue
        if tag == "br":
            parts.append(" ")
            linked.append(" ")
        if tag in BLOCK:
            flush()
            link = 0
            if stack and tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[tag]:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                        break
            elif stack and tag != "p" and tag in HEADING | {"div", "ul", "ol", "article", "section", "table"} and stack[-1][0] == "p":
                close(len(stack) - 1)
            elif tag == "p" and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            heading = 1 if tag in HEADING else 0 if tag in ("div", "p", "article", "section") else heading
        if tag == "a":
            link = 1
        if tag not in VOID and not shut and (tag in BLOCK or f or a or marked):
            stack.append((tag, f, a, marked, wrappers if soft and f else -1))
            wrappers += bool(soft and f)
            frame += f
            article += a
    flush()
    if wrappers:
        _release(out, wrappers)
    return out


def _release(found: list[Block], wrappers: int) -> None:
    """Of the elements that a name puts into the frame, those that wrap the
    article are none of it: those with a deeper article and no fewer words of
    it than all blocks outside the frame, and, if no article is outside the
    frame, those with most of the page's words. Words of links don't count."""
    size, own, depth = [0] * wrappers, [0] * wrappers, [0] * wrappers
    total = 0
    for b in found:
        n = b.words - b.linked
        total += n
        if b.frame == len(b.soft):
            for w in b.soft:
                size[w] += n
                own[w] += n if b.article else 0
                depth[w] = max(depth[w], b.article)
    free = None
    for w in sorted((w for w in range(wrappers) if size[w] or depth[w]), key=lambda w: (-own[w], -size[w], w)):
        if free is None:
            outside = [b for b in found if not b.frame and b.article]
            free = sum(b.words - b.linked for b in outside), max((b.article for b in outside), default=0)
        if depth[w] > free[1] and own[w] >= free[0] or not free[1] and 2 * size[w] > total:
            for b in found:
                if w in b.soft:
                    b.soft = tuple(x for x in b.soft if x != w)
                    b.frame -= 1
            free = None


def _past(page: str, at: int, tag: str, parent: str | None = None) -> int:
    """The place after the end tag that belongs to an element of which nothing
    is text; without an end tag, that of its parent or, in elements that hold
    no blocks, of the next block."""
    if tag in RAW:
        m = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
        return m.end() if m else len(page)
    depth, both = 1, re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
    for m in both.finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    if tag == "head":
        m = re.compile(r"<body\b", re.I).search(page, at)
        return m.start() if m else len(page)
    if tag not in SKIP:
        return at
    depth, block = 0, None
    for m in TAG.finditer(page, at):
        name = m[2].lower()
        if not m[1] and name in BLOCK and block is None:
            block = m.start()
            if parent is None or parent == "p" or parent in CLOSES or tag in ("svg", "select", "datalist"):
                break
        if name == parent:
            depth += -1 if m[1] else 1
            if depth < 0:
                return m.start()
    return len(page) if block is None else block


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "frame", "article", "heading")


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        p, q = (found[i - 1] if i else None), (found[i + 1] if i + 1 < len(found) else None)
        x[i] = (b.words, b.density, p.words if p else 0, p.density if p else 0, q.words if q else 0, q.density if q else 0, min(b.frame, 1), min(b.article, 1), b.heading)
    return x


@dataclass
class Tree:
    """A node of the decision tree; a leaf has no feature."""

    keep: bool
    feature: int = -1
    at: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.keep)
        below = x[:, self.feature] <= self.at
        out = np.empty(len(x), bool)
        out[below], out[~below] = self.low.predict(x[below]), self.high.predict(x[~below])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """A tree by the Gini index; of equal splits the one of the feature with
    the fewest values, then the first."""
    keep = bool(2 * y.sum() >= len(y))
    best = (np.inf, 0, -1, 0.0)
    if depth and 0 < y.sum() < len(y):
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for a, b in zip(values[:-1], values[1:]):
                low = x[:, j] <= (a + b) / 2
                impurity = sum(s.sum() * (m := y[s].mean()) * (1 - m) for s in (low, ~low))
                best = min(best, (round(impurity, 9), len(values), j, (a + b) / 2))
    if best[2] < 0:
        return Tree(keep)
    _, _, j, at = best
    low = x[:, j] <= at
    return Tree(keep, j, float(at), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


_LONG = "The council met on Monday and after a long debate agreed to repair the old bridge before the winter comes. "
# The labelled table: what stands above, in and below invented pages, in all
# combinations. Main blocks stand in elements with data-main.
ABOVE = [
    "",
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>World news</a></ul></nav><div class=ad>Buy the new garden chair today and save a lot of money.</div>",
    "<header><h1><a href=/>The Daily Paper</a></h1><p>News since 1950</p></header><div id=menu>Home News Sport</div>",
    "<p><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></p>",
    f"<div class=cookie-notice>We use cookies to make this site better for all readers.</div><aside><p>{_LONG}</p></aside>",
    # Without names: links alone, in rows and with short texts between them, tell the frame.
    "<div><a href=/a>Home</a></div><div><a href=/b>World news</a></div><div><a href=/c>Sport</a></div>",
    "<table><tr><td><a href=/a>Start</a><td>Suche nach Themen<td><a href=/b>Nachrichten</a> | <a href=/c>Wetter</a></table>",
]
MAIN = [
    f"<article data-main><h1>Bridge to be repaired</h1><p>{_LONG * 2}<p>It rained.<p>{_LONG}</p><ul><li>One point<li>Another point</ul><p><a href=/x>See the full plan here</a></p></article>",
    f"<main data-main><h1>Storm</h1><p>{_LONG * 3}</p><h2>After</h2><p>Yes.</p></main>",
    f"<table><tr><td data-main><p>{_LONG * 2}</p><p>{_LONG * 2}</p><p>{_LONG}</p></table>",
    f"<div data-main><p>{_LONG * 2}</p><p>{_LONG * 3}</p></div>",
    f"<div class=post-content data-main><p>{_LONG}</p><p>Short one.</p><blockquote>{_LONG}</blockquote></div>",
    f"<article><header data-main><h1>Title of it</h1></header><div data-main><p>{_LONG}</p><p>Brief.</p></div><div class=share>Share this</div><div class=newsletter><p>{_LONG}</p></div></article>",
    "<article data-main><h1>Hm</h1><p>Brief.</p></article>",
    "<article data-main><p>Only.</p></article>",
    "<article data-main><ul><li><a href=/1>A list of links</a><li><a href=/2>is an article too</a></ul></article>",
    # Without names: headings, short paragraphs and lists belong to the long paragraphs beside them.
    f"<div data-main><h1>Big title</h1><p>{_LONG * 2}</p><p>Yes.</p><ul><li>One point</li><li>Another point</li></ul></div>",
    f"<div data-main><h2>Kleine Nachricht</h2><p>{_LONG}</p><p>Ja.</p><p>{_LONG * 2}</p></div>",
    f"<div data-main><h1>Un titre</h1><p>Par un lecteur</p><p>{_LONG * 2}</p><h3>Suite</h3><p>Non.</p></div>",
    f"<div data-main><p>{_LONG}<a href=/x>with a link to another page</a>.</p><p>{_LONG}</p><p>Fin.</p></div>",
]
BELOW = [
    "",
    "<footer>&copy; The Paper. All rights reserved.</footer>",
    f"<section id=comments><h3>Comments</h3><p>{_LONG}</p><p>I do not agree.</p></section><footer><p>{_LONG}</p></footer>",
    "<p><a href=/c>Contact</a> <a href=/i>Imprint</a></p><p>Copyright 2001</p>",
    "<div class=sidebar><h3>Most read</h3><ul><li><a href=/1>Storm hits coast</a></ul></div><div>Last change: May</div>",
    f"<form><p>Write to us with your name</p></form><div class=related><p>{_LONG}</p></div><div><a href=/z>Top of page</a></div>",
    "<div><a href=/1>Storm hits the coast of the island and the old town again tonight say reporters</a></div><div><a href=/2>Mehr Meldungen</a></div><div>Copyright 2001</div>",
    "<div><a href=/1>Contact</a> - <a href=/2>Imprint</a> - <a href=/3>Legal</a></div>",
    "<div><a href=/1>Plus d'articles</a></div><div>Tous droits 2001</div><div><a href=/2>Haut de page</a></div>",
]
# Wrappers with names of the frame, around the main blocks and around all.
WRAPPER = ["<div class='layout no-sidebar'>", "<div class='right-sidebar container'>", "<div id=page class=has-nav><form id=search-page>"]
LABELLED = [f"<body>{a}{m}{b}</body>" for a in ABOVE for m in MAIN for b in BELOW]
LABELLED += [page for w in WRAPPER for m in MAIN for page in (f"<body>{w}{m}</div>{BELOW[1]}</body>", f"<body>{w}{ABOVE[1]}{m}{BELOW[4]}</div></body>")]


def train(labelled: list[str] = LABELLED) -> Tree:
    rows = [blocks(p) for p in labelled]
    return grow(np.concatenate([features(r) for r in rows]), np.array([b.marked for r in rows for b in r]))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with one more column, the main text of ``html_col``: kept
    blocks in page order, joined by two line ends; the empty string where there
    is none (null, empty or blank pages). Repeated rows get equal results; other
    columns stay; an empty table gives an empty one. Raises ValueError if the
    new column exists."""
    if into in pages.columns:
        raise ValueError(f"column {into} exists")
    tree = train()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([main_text(p, tree) for p in b.column(html_col).to_pylist()], pa.string())], [*b.schema.names, into])
    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(into, StringType())]))

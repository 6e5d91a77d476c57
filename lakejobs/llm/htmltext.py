"""HTML main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is split at its tags into leaf blocks: the text between block-level tags, with the block's open ancestors. Tags
and comments are read by HTML's own rules: a quote opens a value only after "=", elsewhere it is part of a name; comments
end with "-->" or "--!>", or at once as "<!-->". The time is linear in the page, however deep elements are nested;
observations look at the NEAR innermost ancestors. Inline
tags don't split. Text of scripts, styles, templates, comments, titles and the head is no block; a head without an end
tag ends at what can't stand in it. A block's observations are its
ancestors' tags and the words of their class, id and role attributes, what precedes it, and counts of its text (length,
share of link text, punctuation, position). Two labels, keep and drop; the weights of (observation, label) and of
(label, next label) are learnt by gradient ascent on the conditional likelihood (forward-backward), and a page is
decoded by Viterbi. All kept blocks, in page order, joined by line ends, are the text.

Labelled pages are those whose own mark-up says what the article is: exactly one <article> or <main>. Blocks in it are
labelled keep, unless a nav, header, footer, aside, form or the like stands between; the rest are labelled drop. The fit
takes at most max_pages of them (those of smallest hash of page id), every other one also with its sectioning elements as
plain divs, and a fixed set of small labelled pages for layouts without such tags.

Defined cases: null and empty pages have an empty text; broken mark-up is read as far as it goes (an open tag at the end
is dropped, unclosed blocks end with the page); character references are decoded, unknown ones stay; repeated rows are
read alike; an empty table gives no rows; extra columns are kept by extract(), but for one named __text, which is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import common

MAX_PAGES = 250
#: Blocks of a labelled page at most; longer pages don't train.
MAX_BLOCKS = 2000
#: Pages of the fixed rule that shows layouts without an article element.
SEED_PAGES = 320
#: Observations are hashed into so many weights.
WEIGHTS = 1 << 14
#: Ancestors that a block's observations look at, innermost first, and words of attributes that an element has, at most.
NEAR, ATTRIBUTE_WORDS = 40, 64

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style template head title".split())
RAW = frozenset("script style textarea title template iframe noembed noframes xmp".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
#: Elements whose own rules hold until one that HTML is read in again, and tags that end them.
FOREIGN = frozenset("svg math".split())
HTML_AGAIN = frozenset("foreignobject desc annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button textarea".split())
MARKERS = frozenset("article main".split())
#: Open elements that a tag closes, the innermost of them.
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SIBLINGS = frozenset(t for tags in _SIBLING.values() for t in tags)
_SCOPE = frozenset("ul ol dl table article section main body div".split())

_WS = r"[ \t\n\f\r]"
#: An attribute: a name (quotes are part of it) and, after "=", a value in quotes or up to white space or ">".
_ATTRIBUTE = re.compile(rf"""(=?[^ \t\n\f\r/>=]*+)(?:(?<=[^ \t\n\f\r/>]){_WS}*+={_WS}*+(?>"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r"'>][^ \t\n\f\r>]*+)|(?=>)|\Z))?+""")
#: Comments, other declarations, and tags: end mark, name, attributes, and ">" unless the page ends in the tag.
_TAG = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?>[ \t\n\f\r/]++|=?[^ \t\n\f\r/>=]++(?:{_WS}*+={_WS}*+(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r"'>][^ \t\n\f\r>]*+|(?=>)|\Z))?+|=)*+)(?:(>)|\Z)""",
    re.S,
)
#: Attributes whose words tell what an element is for.
_TELLING = frozenset("class id role itemprop".split())
#: What ends the content of a raw element.
_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I) for tag in RAW}
_WORDS = re.compile(r"[a-z]+")
_SECTION = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside)\b", re.I)
_SPACE = re.compile(r"[ \t\n\f\r\v   -     　\x1c-\x1f\x85]+")


#: Words of attributes that mark a block as not of the article, for labelling only.
_OUT = frozenset("nav menu header footer sidebar aside ad ads advert advertisement banner notice cookie consent comment comments form share social related breadcrumb breadcrumbs promo popup newsletter subscribe widget pagination".split())


def boilerplate(tag: str, words: tuple[str, ...]) -> bool:
    """Whether an element's own mark-up says that it isn't of an article, for labelling only."""
    return tag in BOILERPLATE or not _OUT.isdisjoint(words)


class Node:
    """An open element. What blocks need of their ancestors is taken over from the parent, so that no depth costs more."""

    __slots__ = ("tag", "words", "parent", "depth", "paragraph", "siblings", "foreign", "inside", "seen")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.depth = parent.depth + 1 if parent else 0
        #: Depth of the open p with inline elements only between; of the open siblings that tags close, by family.
        self.paragraph = self.depth if tag == "p" else parent.paragraph if parent and tag in INLINE else None
        own = {} if tag in _SCOPE or not parent else parent.siblings
        self.siblings = own | {f: self.depth for f, tags in _SIBLING.items() if tag in tags} if tag in _SIBLINGS else own
        #: Depth of the open svg or math element whose rules hold.
        self.foreign = self.depth if tag in FOREIGN else None if tag in HTML_AGAIN or not parent else parent.foreign
        #: For labels: in an article or main element (True, or False below what isn't of it), or in none.
        self.inside = parent.inside if parent else None
        if self.inside is None and tag in MARKERS:
            self.inside = True
        elif self.inside and boilerplate(tag, words):
            self.inside = False
        self.seen: tuple[int, ...] | None = None


@dataclass
class Block:
    text: str
    node: Node | None  # innermost open element
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Open ancestors, outermost first: tag, words of its attributes."""
        out, node = [], self.node
        while node:
            out.append((node.tag, node.words))
            node = node.parent
        return tuple(out[::-1])


def attribute_words(attributes: str) -> tuple[str, ...]:
    """The words, ATTRIBUTE_WORDS at most, of the attributes that tell what an element is for."""
    out: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1] and m[1].lower() in _TELLING:
            out += _WORDS.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(out[:ATTRIBUTE_WORDS])


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, without empty ones."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = skipping = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip(" ")
        if text:
            out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
        held.clear()
        linked = 0

    def close(k: int) -> None:
        """Close the open elements from depth k on."""
        nonlocal skipping
        for node in stack[k:]:
            opened[node.tag] -= 1
            skipping -= node.tag in SKIPPED
        del stack[k:]

    def end_head() -> None:
        if opened["head"]:
            close(next(k for k, node in enumerate(stack) if node.tag == "head"))

    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if skipping and stack[-1].tag in ("head", "noscript") and page[at:end].strip(" \t\n\f\r"):
            end_head()
        if end > at and not skipping:
            held.append(page[at:end])
            linked += (end - at) * (opened["a"] > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None or m[4] is None:  # no tag, or one that the page's end cuts
            continue
        tag = m[2].lower()
        block = tag not in INLINE
        if block:
            flush()
        elif tag == "br":
            held.append(" ")
        if m[1]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if skipping and tag not in IN_HEAD:
            end_head()
        if stack and stack[-1].foreign is not None and tag in BREAKOUT:
            close(stack[-1].foreign)
        if stack and tag in CLOSES_P and stack[-1].paragraph is not None:
            close(stack[-1].paragraph)
        elif stack and tag in _SIBLING and tag in stack[-1].siblings:
            close(stack[-1].siblings[tag])
        attributes = m[3]
        closed = attributes.endswith("/") and (not block or tag in FOREIGN or bool(stack) and stack[-1].foreign is not None)
        if tag in VOID or closed and _ends_itself(attributes):
            continue
        stack.append(Node(tag, attribute_words(attributes) if attributes else (), stack[-1] if stack else None))
        opened[tag] += 1
        skipping += tag in SKIPPED
        if tag in RAW:  # its content is no mark-up
            stop = _END[tag].search(page, at)
            if not skipping:
                held.append(page[at : stop.start() if stop else len(page)])
            at = stop.start() if stop else len(page)
    flush()
    return out


def _ends_itself(attributes: str) -> bool:
    """Whether the slash before ">" stands by itself and isn't the end of a value."""
    last = 0
    for m in _ATTRIBUTE.finditer(attributes):
        if m.end() > m.start():
            last = m.end()
    return last < len(attributes)


def _slot(name: str) -> int:
    return crc32(name.encode()) % WEIGHTS


class _Slots(dict):
    def __missing__(self, name: str) -> int:
        self[name] = out = _slot(name)
        return out


def _seen(node: Node | None, slots: dict[str, int]) -> tuple[int, ...]:
    """Numbers of what an element and its ancestors show, kept with it for all its blocks."""
    if node is None:
        return ()
    if node.seen is None:
        names, outer, inline, at = {}, [], None, node
        while at and node.depth - at.depth < NEAR:
            if at.tag in INLINE:
                inline = at.tag
            else:
                outer.append(at.tag)
                names[f"in {at.tag}"] = None
                names.update((f"has {w}", None) for w in at.words)
            at = at.parent
        found = list(names)
        if outer:
            found += [f"leaf {outer[0]}", f"leaf {outer[0]} {[inline] if inline else []}"]
            if len(outer) > 1:
                found.append(f"pair {outer[1]} {outer[0]}")
        node.seen = tuple(slots[x] for x in found)
    return node.seen


def observations(page: list[Block], slots: dict[str, int]) -> list[list[int]]:
    """Numbers of the observations of each block."""
    out = []
    for i, b in enumerate(page):
        n = len(b.text)
        share = b.linked / n
        names = [f"size {min(n.bit_length(), 10)}", f"links {int(share * 3.99)}", f"links {int(share * 3.99)} size {min(n.bit_length() // 2, 4)}", f"words {min(b.text.count(' ') // 4, 6)}"]
        names += [f"end {b.text[-1] if b.text[-1] in '.!?:,' else '-'}", f"sign {'©' in b.text}", f"place {min(i, 3)} {min(len(page) - 1 - i, 3)}"]
        out.append([*_seen(b.node, slots), *[slots[x] for x in names]])
    return out


@dataclass
class Field:
    """Weights of (observation, label), of (label, next label) and of the first label."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def potentials(self, found: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[x].sum(axis=0) for x in found]).reshape(len(found), 2)

    def decode(self, found: list[list[int]]) -> list[int]:
        if not found:
            return []
        p = self.potentials(found).tolist()
        (k0, k1), (m00, m01, m10, m11) = self.start.tolist(), self.move.ravel().tolist()
        a, b = k0 + p[0][0], k1 + p[0][1]
        back = []
        for x, y in p[1:]:
            from_a, from_b = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
            a, b = (b + m10 if from_a else a + m00) + x, (b + m11 if from_b else a + m01) + y
            back.append((from_a, from_b))
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _expected(p: list[list[float]], move: list[list[float]], start: list[float]) -> tuple[list[list[float]], list[list[float]], float]:
    """Chances of each block's labels and sums of those of neighbouring labels, by forward-backward; log of the sum over all paths."""
    (m00, m01), (m10, m11) = move
    ahead, scales, log = [], [], 0.0
    a, b = start
    for k, (x, y) in enumerate(p):
        a, b = (a * x, b * y) if k == 0 else ((a * m00 + b * m10) * x, (a * m01 + b * m11) * y)
        scale = a + b
        a, b, log = a / scale, b / scale, log + math.log(scale)
        ahead.append((a, b)), scales.append(scale)
    chances, pairs, c, d = [ahead[-1]], [0.0] * 4, 1.0, 1.0
    for k in range(len(p) - 2, -1, -1):
        right, left = p[k + 1][0] * c / scales[k + 1], p[k + 1][1] * d / scales[k + 1]
        a, b = ahead[k]
        pairs = [pairs[0] + a * m00 * right, pairs[1] + a * m01 * left, pairs[2] + b * m10 * right, pairs[3] + b * m11 * left]
        c, d = m00 * right + m01 * left, m10 * right + m11 * left
        chances.append((a * c, b * d))
    return chances[::-1], [pairs[:2], pairs[2:]], log


def fit(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, flat: float = 0.002) -> Field:
    """Conditional likelihood, page by page, with AdaGrad steps; the pages in a fixed shuffled order. It ends early when
    no page's mean log likelihood moves by more than flat from one epoch to the next."""
    model = Field(np.zeros((WEIGHTS, 2)), np.zeros((2, 2)), np.zeros(2))
    sums = Field(np.full((WEIGHTS, 2), 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3))
    rng = np.random.default_rng(3)
    ready = []
    for found, gold in pages:
        if found:
            slots, which = np.unique(np.concatenate([np.array(x) for x in found]), return_inverse=True)
            moves = np.zeros((2, 2))
            np.add.at(moves, (gold[:-1], gold[1:]), 1)
            ready.append((found, np.array(gold), slots, which, np.repeat(np.arange(len(found)), [len(x) for x in found]), moves))
    last = np.full(len(ready), -np.inf)
    for _ in range(epochs):
        now = np.zeros(len(ready))
        for k in rng.permutation(len(ready)).tolist():
            found, gold, slots, which, block, moves = ready[k]
            scores = np.stack([np.bincount(block, model.emit[slots, j][which], len(found)) for j in (0, 1)], axis=1)
            scores = np.clip(scores, -30, 30)
            chances, pairs, log = _expected(np.exp(scores).tolist(), np.exp(model.move).tolist(), np.exp(model.start).tolist())
            now[k] = (scores[np.arange(len(gold)), gold].sum() + (model.move * moves).sum() + model.start[gold[0]] - log) / len(found)
            gradient = -np.array(chances)
            gradient[np.arange(len(gold)), gold] += 1
            g = np.stack([np.bincount(which, gradient[block, j], len(slots)) for j in (0, 1)], axis=1) - decay * model.emit[slots]
            sums.emit[slots] += g**2
            model.emit[slots] += rate * g / np.sqrt(sums.emit[slots])
            for name, g in (("move", moves - np.array(pairs)), ("start", gradient[0])):
                total = getattr(sums, name)
                total += g**2
                getattr(model, name)[...] += rate * g / np.sqrt(total)
        if (np.abs(now - last) <= flat).all():
            break
        last = now
    return model


def own_labels(page: list[Block]) -> list[int] | None:
    """Labels by the page's own mark-up; None unless it is clear (blocks of an article or main element, and others)."""
    out = [int(b.node is not None and b.node.inside is True) for b in page]
    return out if 0 < sum(out) < len(out) else None


def seed_pages() -> list[tuple[str, str]]:
    """Small labelled pages: (html, article text), by a rule over layouts, for pages without an article element."""
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()

    def line(k: int, n: int) -> str:
        return " ".join(words[(k * 7 + i * (1 + k % 5)) % len(words)] for i in range(n)).capitalize() + "."

    drops = [
        '<nav><ul><li><a href="/a">{0}</a></li><li><a href="/b">{1}</a></li></ul></nav>', '<div class="menu"><a href="/a">{0}</a> <a href="/b">{1}</a></div>', '<header class="site-header"><h1>{0}</h1><p>{1}</p></header>',
        '<div id="header"><div class="logo">{0}</div></div>', '<div class="cookie-notice">{0} <button>OK</button></div>', '<div class="notice">{0}</div>', '<div class="ad">{0}</div>', '<div class="advert"><p>{0}</p></div>',
        '<header><h1>{0}</h1></header>', '<header><h1>{0}</h1><p>{1}</p></header>', '<div class="topbar nav">{0}</div>', '<div class="banner"><p>{0}</p><p>{1}</p></div>',
        '<aside><p>{0}</p></aside>', '<div class="widget"><h3>{0}</h3><p>{1}</p></div>', '<form><p>{0}</p><button>{1}</button></form>', '<div role="navigation"><a href="/n">{0}</a></div>',
        '<aside class="sidebar"><h3>{0}</h3><p>{1}</p></aside>', '<div id="sidebar"><h2>{0}</h2><ul><li><a href="/c">{1}</a></li></ul></div>', '<form action="/s"><label>{0}</label><input name="q"><p>{1}</p></form>',
    ]
    ends = [
        '<section class="comments"><h2>{0}</h2><div class="comment"><p>{1}</p></div></section>', '<div id="comments"><ul><li class="comment"><p>{0}</p></li><li class="comment"><p>{1}</p></li></ul></div>',
        '<section id="comments"><p>{0}</p><p>{1}</p></section>', '<div class="comments"><p>{0}</p></div>', '<div class="comment-list"><article class="comment"><p>{0}</p></article></div>', '<footer>{0}</footer>',
        '<div id="footer">{0}</div>', '<div class="newsletter"><p>{0}</p><form><p>{1}</p></form></div>', '<div class="tags"><a href="/t">{0}</a></div>', '<div class="discussion reply"><h3>{0}</h3><p>{1}</p></div>',
        '<footer><p>&copy; {0}</p></footer>', '<div class="footer">&copy; {0} {1}</div>', '<div class="related"><h3>{0}</h3><ul><li><a href="/r">{1}</a></li></ul></div>', '<div class="share social">{0}</div>',
    ]
    bodies = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div role="main"', "div", 'div class="wrap"', "section"]
    out, pick = [], Random(5)
    for k in range(SEED_PAGES):
        n = pick.randrange
        keep = [line(k, 2 + n(7)), *[line(k + j, pick.choice((1, 3, 6, 12, 25, 40))) for j in range(1, 3 + n(6))]]
        inner = f"<h1>{keep[0]}</h1>"
        for x in keep[1:]:
            inner += pick.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<p><a href='/l'>{}</a></p>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")).format(x)
            if n(12) == 0:  # a stray block inside the article
                inner += pick.choice(drops + ends).format(line(n(99), 1 + n(20)), line(n(99), 1 + n(20)))
        extra = lambda those, most: "".join(x.format(line(n(99), 1 + n(25)), line(n(99), 1 + n(25))) for x in pick.sample(those, 1 + n(most)))
        tag = pick.choice(bodies)
        page = f"{extra(drops, 4)}<{tag}>{inner}</{tag.split()[0]}>{extra(ends + drops[8:], 4)}"
        out.append((f"<html><body>{page if n(2) else f'<div class=page>{page}</div>'}</body></html>", "\n".join(keep)))
    return out


def seed_labels() -> list[tuple[list[Block], list[int]]]:
    out = []
    for page, text in seed_pages():
        found, left = blocks(page), text.split("\n")
        labels = []
        for b in found:
            hit = bool(left) and b.text == left[0] and not any(boilerplate(t, w) for t, w in b.path)
            labels.append(int(hit))
            if hit:
                left.pop(0)
        out.append((found, labels))
    return out


def without_hints(page: str) -> str:
    """The page with its sectioning elements as plain divs, as many layouts have them."""
    return _SECTION.sub(r"<\1div", page)


def examples(page: str, slots: dict[str, int]) -> list[tuple[list[list[int]], list[int]]]:
    """(observations, labels) of a page that labels itself, and of every other one (by a hash) also without sectioning
    elements, so that what is learnt doesn't rest on them alone. None of pages over MAX_BLOCKS blocks."""
    found = blocks(page)
    labels = own_labels(found) if len(found) <= MAX_BLOCKS else None
    if labels is None:
        return []
    out = [(observations(found, slots), labels)]
    if crc32(page.encode("utf-8", "replace")) % 2:
        bare = blocks(without_hints(page))
        if [b.text for b in bare] == [b.text for b in found]:
            out.append((observations(bare, slots), labels))
    return out


def train(pages: DataFrame, id_column: str = "page_id", column: str = "html", max_pages: int = MAX_PAGES) -> Field:
    """Fit on at most max_pages pages that label themselves, and the seed pages. The tasks read the pages; observations,
    of at most max_pages * MAX_BLOCKS blocks, come to the driver."""
    marked = pages.where(F.col(column).rlike(r"(?i)<(article|main)\b")).select(F.col(id_column).cast("string").alias("id"), F.col(column).alias("html"))
    chosen = common.smallest_hashes(marked.select("id").distinct(), "id", max_pages)  # ids first: pages are long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            for page in batch.column(batch.schema.get_field_index("html")).to_pylist():
                own = examples(page, slots)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.list_(pa.list_(pa.int32()))), pa.array([y for _, y in own], pa.list_(pa.int32()))], names=["x", "y"])

    rows = marked.join(F.broadcast(chosen), "id").select("html").mapInArrow(run, "x array<array<int>>, y array<int>")
    data = sorted((r["x"], r["y"]) for r in rows.limit(2 * max_pages).collect())
    slots = _Slots()
    data += [(observations(found, slots), labels) for found, labels in seed_labels()]
    return fit(data)


def main_text(page: str, model: Field, slots: dict[str, int]) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, model.decode(observations(found, slots)), strict=True) if keep)


def extract(pages: DataFrame, model: Field, column: str = "html", keep_html: bool = True) -> DataFrame:
    """pages with __text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in pages.schema if f.name != "__text" and (keep_html or f.name != column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            names = batch.schema.names
            keep = [names.index(f.name) for f in fields]
            out = pa.array([main_text(p, shared.value, slots) if p else "" for p in batch.column(names.index(column)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], out], names=[*[names[i] for i in keep], "__text"])
            if len(slots) > 200_000:
                slots.clear()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return pages.mapInArrow(run, ", ".join([*kept, "`__text` string"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_html_extraction: the main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, train(pages), keep_html=False)
    return out.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))

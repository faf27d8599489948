"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block is described by its word
count and link density, those of its two neighbours, and where it stands (heading, main container, before or
behind the page's main container, boilerplate by a tag, or by a name). A decision tree, grown by Gini impurity from
the blocks of the labelled pages in ``html_labels``, says which blocks are main text. What is hidden by an
attribute or an inline style is no text. A class, id or role marks boilerplate on any element, but only as a whole:
all of its parts must be such names or words of layout (``cookie-notice``, ``related-posts``, not ``related-work``).

Defined cases: null and empty pages give an empty text; pages cut off anywhere are read as far as they
go; a head ends where other than its own tags begins; unclosed skipped tags end at the next block-level tag,
unclosed scripts and styles with their container; unknown tags are inline; repeated pages give equal rows. Further
columns pass through under any name; one named like the result, whatever its case, is replaced. Time is linear in the
page's length.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_labels import labelled_pages
from .shared import mapped_rows, without

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^<]+|<)", re.S)
ANY_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Content that is no text.
SKIPPED = frozenset("script style noscript template title svg math iframe object canvas select textarea button audio video".split())
#: Those whose content has no tags.
RAW = frozenset("script style noscript title iframe textarea".split())
#: Tags of a head.
HEAD_TAGS = frozenset("html head title meta link base script style noscript template".split())
#: Tags that end a block.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(["article", "main"])
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
#: Parts of class, id and role values that mark boilerplate.
BOILER_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent gdpr notice alert newsletter subscribe subscription comment comments disqus reply replies "
    "share sharing social related recommended widget popup modal login signup pagination pager toolbar search complementary contentinfo".split()
)
#: Parts that say where or how something stands, beside which a name keeps its meaning.
LAYOUT_NAMES = frozenset(
    "site page main global primary secondary top bottom left right center middle upper lower first last sticky fixed mobile desktop wrap wrapper container inner outer box bar "
    "block area section region row col column grid panel module group list item items link links button buttons icon icons header head title body text content form field unit slot zone "
    "post posts article articles story stories entry blog media news signup thread small large big new".split()
)
#: Those that mark a part of a line too.
INLINE_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo cookie cookies".split())
#: Of these, the ones that hold articles of their own, which are no main text either.
STRONG_NAMES = frozenset("comment comments disqus reply replies related recommended".split())
#: Classes that say what a page has or how it stands, such as has-sidebar or nav-open.
STATE = re.compile(r"^(?:has|with|without|no|is)[-_]|[-_](?:open|opened|closed|active|visible|enabled|disabled)$")
HEADER_NAMES = frozenset(["header", "masthead", "topbar"])
MAIN_NAMES = frozenset(["article", "main", "content", "post", "entry", "story"])

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "boiler_tag", "boiler_name", "main", "ahead", "behind")


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: bool
    boiler_tag: bool
    boiler_name: bool
    main: bool


def _hides(attributes: str) -> bool:
    """Whether an element's attributes hide it."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for name, value in ANY_ATTRIBUTE.findall(low):
        value = value.strip("\"' ")
        if (name == "hidden" and value != "until-found") or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", value)):
            return True
    return False


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """The names that an element's class, id and role stand for, and all parts of them.

    A value stands for the boilerplate names in it if its other parts only say where or how something stands.
    """
    told: set[str] = set()
    parts: set[str] = set()
    if "=" in attributes:
        for match in ATTRIBUTE.finditer(attributes):
            for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", match[1] or match[2] or match[3] or "").lower().split():
                some = {x for x in re.split(r"[^a-z]+", token) if x}
                parts |= some
                if not STATE.search(token) and some <= BOILER_NAMES | HEADER_NAMES | LAYOUT_NAMES:
                    told |= some & (BOILER_NAMES | HEADER_NAMES)
                    if len(some) == 1:
                        told |= some
    return told, parts


@dataclass(frozen=True)
class Place:
    """What the open elements say of a block; strong: boilerplate that an article inside doesn't end."""

    boiler_tag: bool = False
    boiler_name: bool = False
    strong: bool = False
    main: bool = False
    hidden: bool = False


def _enter(tag: str, attributes: str, outer: Place) -> Place:
    """The place inside an element's start tag."""
    if tag not in BOILER_TAGS and tag not in MAIN_TAGS and tag != "header" and not attributes:
        return outer
    names, parts = _names(attributes)
    if tag == "blockquote":
        names = names - {"alert"}  # a loud quotation is one
    main = outer.main or tag in MAIN_TAGS or bool(parts & MAIN_NAMES and not names & BOILER_NAMES)
    hidden = outer.hidden or _hides(attributes)
    if tag in ("html", "body"):
        return Place(outer.boiler_tag, outer.boiler_name, outer.strong, outer.main or "main" in names, hidden)
    reset = tag in MAIN_TAGS and not outer.strong
    by_tag = tag in BOILER_TAGS or (tag == "header" and not outer.main)
    by_name = bool(names & (BOILER_NAMES if outer.main else BOILER_NAMES | HEADER_NAMES))
    strong = tag in BOILER_TAGS or bool(names & STRONG_NAMES)
    return Place(by_tag or (outer.boiler_tag and not reset), by_name or (outer.boiler_name and not reset), outer.strong or strong, main, hidden)


BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS | {'head'}))})\b", re.I)


def _skip_to(page: str, at: int, tag: str, outer: set[str], beyond: dict[str, int]) -> int:
    """Where a skipped tag that began before ``at`` ends. outer: tags of open containers; beyond: by tag, up to where it is known not to be closed."""
    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at) if at >= beyond.get(tag, 0) else None
    if end and tag in RAW:
        return end.end()
    if end:
        inside: list[str] = []
        where = at
        while where < end.start():
            match = TOKEN.match(page, where)
            name, closing = (match[2] or "").lower(), bool(match[1])
            if name == tag and not closing and tag in ("button", "select"):
                break
            if name in CONTAINERS and not closing:
                inside.append(name)
            elif name in CONTAINERS and name in inside:
                while inside.pop() != name:
                    pass
            elif name in CONTAINERS and name in outer:
                break
            where = match.end()
            if name in RAW and not closing and (raw := re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, where)):
                where = raw.end()
        else:
            return max(where, end.end())
        beyond[tag] = where
        found = BLOCK_TAG.search(page, at, where)
        return found.start() if found else where
    if at >= beyond.get(tag, 0):
        beyond[tag] = len(page)
    if tag in ("script", "style"):
        found = re.compile(rf"</(?:{'|'.join(sorted(outer | {'head'}))})\b|<body\b", re.I).search(page, at)
    else:
        found = BLOCK_TAG.search(page, at)
    return found.start() if found else len(page)


LINK_TAG = re.compile(r"<(/?)a\b", re.I)


def _inline_end(page: str, at: int, tag: str) -> int:
    """Where an inline element that began before ``at`` ends: behind its end tag, at the next block-level tag at the latest."""
    edge = BLOCK_TAG.search(page, at)
    stop, depth = edge.start() if edge else len(page), 1
    for match in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at, stop):
        depth += -1 if match[1] else 1
        if not depth:
            return match.end()
    return stop


def blocks(page: str) -> list[Block]:
    """The flat list of text blocks."""
    found: list[Block] = []
    stack: list[tuple[str, Place]] = [("", Place())]
    open_tags: Counter[str] = Counter()
    beyond: dict[str, int] = {}
    texts: list[str] = []
    linked: list[str] = []
    in_head, in_link, heading = False, False, False
    own: Place | None = None  # of the open paragraph or heading
    link_end = 0  # up to where a link reaches whose end tag is the next one

    def flush():
        if texts:
            text = " ".join(htmllib.unescape("".join(texts)).split())
            place = own or stack[-1][1]
            if text and not place.hidden:
                words = text.count(" ") + 1
                share = len(htmllib.unescape("".join(linked)).split()) / words if linked else 0.0
                found.append(Block(text, words, min(1.0, share), heading, place.boiler_tag, place.boiler_name, place.main))
            texts.clear()
            linked.clear()

    at, size = 0, len(page)
    while at < size:
        match = TOKEN.match(page, at)
        begin, at = at, match.end()
        if match[4] is not None:
            if in_head and not match[4].strip():
                continue
            in_head = False
            texts.append(match[4])
            if in_link or begin < link_end:
                linked.append(match[4] + " ")
            continue
        if match[2] is None:
            continue
        tag, closing = match[2].lower(), bool(match[1])
        if tag == "head":
            in_head = not closing
        elif in_head and tag not in HEAD_TAGS:
            in_head = False
        if tag in SKIPPED:
            if not closing and not match[3].endswith("/"):
                at = _skip_to(page, at, tag, set(+open_tags), beyond)
        elif tag == "br":
            texts.append(" ")
        elif tag in BLOCKS:
            flush()
            in_link, own = False, None
            if tag in HEADINGS or tag == "p":
                heading = tag != "p" and not closing
                own = None if closing else _enter(tag, match[3], stack[-1][1])
            elif tag in CONTAINERS:
                heading = False
                if not closing:
                    stack.append((tag, _enter(tag, match[3], stack[-1][1])))
                    open_tags[tag] += 1
                elif open_tags[tag]:
                    while (gone := stack.pop()[0]) != tag:
                        open_tags[gone] -= 1
                    open_tags[tag] -= 1
        elif not closing and not match[3].endswith("/") and match[3] and (_hides(match[3]) or _names(match[3])[0] & INLINE_NAMES):
            at = _inline_end(page, at, tag)
        elif tag == "a":
            end = None if closing else LINK_TAG.search(page, at)
            if end and end[1]:
                link_end = end.start()
            in_link = not closing and not (end and end[1])
    flush()
    return found


def table(found: list[Block]) -> np.ndarray:
    """Block x FEATURES."""
    rows = np.zeros((len(found), len(FEATURES)))
    inside = [k for k, b in enumerate(found) if b.main and not b.boiler_tag and not b.boiler_name]
    first = inside[0] if inside else len(found)
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
        near = (before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0)
        rows[k] = (b.words, b.links, *near, b.heading, b.boiler_tag, b.boiler_name, b.main, bool(inside) and k < first, k > first and not b.main)
    return rows


class DecisionTree:
    """Binary splits feature <= threshold by Gini impurity, to pure leaves or ``depth``."""

    def __init__(self, depth: int = 6, least: int = 1):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(np.asarray(x, float), np.asarray(y, float), self.depth)
        return self

    def _grow(self, x, y, depth):
        share = y.mean()
        if depth == 0 or share in (0.0, 1.0):
            return float(share)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for low, high in zip(values[:-1], values[1:]):
                cut = (low + high) / 2
                left = x[:, f] <= cut
                n, m = left.sum(), (~left).sum()
                if min(n, m) < self.least:
                    continue
                p, q = y[left].mean(), y[~left].mean()
                impurity = n * p * (1 - p) + m * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut)
        if best is None:
            return float(share)
        _, f, cut = best
        left = x[:, f] <= cut
        return (f, float(cut), self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node, rows):
            if isinstance(node, float):
                out[rows] = node
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                walk(node[2], rows[left])
                walk(node[3], rows[~left])

        walk(self.root, np.arange(len(x)))
        return out >= 0.5


def labelled_table(pages) -> tuple[np.ndarray, np.ndarray]:
    """(block x FEATURES, 1 for main text) of labelled pages."""
    features, labels = [], []
    for page, main in pages:
        found = blocks(page)
        features.append(table(found))
        labels += [float(b.text in main) for b in found]
    return np.concatenate(features), np.array(labels)


@lru_cache(maxsize=1)
def default_tree() -> DecisionTree:
    return DecisionTree(least=4).fit(*labelled_table(labelled_pages()))


def main_text(page: str | None, tree: DecisionTree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree.predict(table(found))) if keep)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text", tree: DecisionTree | None = None) -> DataFrame:
    """The rows with the main text in place of the page; a column already named ``out`` is replaced."""
    tree = tree or default_tree()

    def run(batches, kept):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column("_in")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "_out"])

    return mapped_rows(pages, without(pages, html, out), html, run, "_out string", [out])


def op9_html_blocks(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")

"""Main text of web pages by scoring their trees.

Every paragraph earns points for its length and its commas, less its share of link text, and
passes them to its ancestors: all to its parent, half to the grandparent, less further up.
The container with most points, or the article or main element around it, is the article;
siblings that score well beside it, or are headings or plain paragraphs, are kept with it.
Elements that never belong to an article (by tag, or by a mark in their class or id) are left out
before that; a mark is passed over where the element holds most of the page, or, if only a part
of its name, where it is prose inside the article.

A page is one row and is read by itself, so pages need no shuffle and a lost executor costs
its unfinished tasks. Defined results: a null or empty page, and one without text, give the
empty text; text outside all elements counts as a paragraph; unclosed and misplaced tags are
closed where the next block begins; repeated rows are separate pages; an empty table gives no
rows; nulls in other columns stay; extra columns are not carried.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.shared import table
from tidewash.llm.tokens import slices

#: Elements whose content is left out whatever the page says of them.
LEFT_OUT = frozenset(
    "head script style noscript template iframe object svg math canvas nav footer aside button select textarea "
    "input dialog audio video map".split()
)
#: Their content is text up to their own end tag, never markup.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "html body article main section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary hgroup fieldset center form hr".split()
) | LEFT_OUT
#: Blocks that are paragraphs: their points go to the element around them.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption summary address".split())
ARTICLES = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of these is closed by the next of the same kind.
CLOSED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer comment comments disqus discussion replies cookie cookies consent gdpr notice notices alert popup modal overlay "
    "promo promoted sponsor sponsored share sharing social related recommended newsletter subscribe signup login search pagination pager".split()
)
#: Words that say where or how such an element stands; a name of other words besides may mean something else.
NEUTRAL = frozenset(
    "slot box bar list link links widget wrapper container section block area item inner outer form button buttons icons posts stories articles "
    "site page top bottom left right global primary secondary header title body content thread entry count heading text author meta unit zone".split()
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


NO_MARK, STATE, MARK = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "mark", "points", "chars", "links", "mass", "articles")

    def __init__(self, tag: str, parent: Node | None, mark: int = NO_MARK):
        self.tag, self.parent, self.mark, self.points, self.chars, self.links, self.mass = tag, parent, mark, 0.0, 0, 0, 0.0
        self.articles = 0  # unmarked ones from here on down

    def in_article(self) -> bool:
        node = self.parent
        while node is not None and node.tag not in ARTICLES:
            node = node.parent
        return node is not None


def mark_of(tag: str, attributes: str) -> int:
    """What the class, id and role of an element say: nothing, a mark among other words, or a mark."""
    if not attributes or tag in ("html", "body"):
        return NO_MARK
    if HIDDEN.search(attributes):
        return MARK
    found = NO_MARK
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if any(w in MARKS for w in words):
                found = max(found, MARK if all(w in MARKS or w in NEUTRAL for w in words) else STATE)
    return found


def blocks_of(page: str) -> list[tuple[Node, str, int]]:
    """(element, text, characters inside links) of every block that is not left out by its tag, in page order."""
    root = Node("#root", None)
    stack, found = [root], []
    held: list[str] = []
    linked = links = at = 0
    skipping: list[str] = []  # the open elements from one that is left out on

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            found.append((stack[-1], text, min(linked, len(text))))
        held.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not skipping:
            text = html.unescape(raw)
            held.append(text)
            linked += len(text.strip()) if links else 0

    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        take(page[at : m.start() if m else end])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW and not closing:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if skipping:
            if not closing:
                if tag not in VOID:
                    skipping.append(tag)
                continue
            if tag in skipping:
                while skipping.pop() != tag:
                    pass
                continue
            if tag not in BLOCKS or all(node.tag != tag for node in stack):
                continue
            skipping.clear()  # the end of an element around the one left out, which was never closed
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            held.append(" ")
        elif tag not in BLOCKS:
            if not closing and tag not in VOID and mark_of(tag, attributes) == MARK:
                skipping.append(tag)  # inside a line of text, which goes on behind it
        else:
            flush()
            links = 0
            if closing:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), None)
                if depth is not None:
                    del stack[depth:]
                continue
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the item before
                if stack[k].tag == "p" or stack[k].tag in CLOSED_BY_NEXT.get(tag, ()):
                    del stack[k:]
                elif stack[k].tag not in PARAGRAPHS or tag in ("li", "p"):
                    break
            if tag in VOID:
                continue
            if tag in LEFT_OUT or tag == "header" and not any(node.tag in ARTICLES for node in stack):
                skipping.append(tag)
                continue
            node = Node(tag, stack[-1], MARK if tag == "form" else mark_of(tag, attributes))
            stack.append(node)
            if tag in ARTICLES and node.mark == NO_MARK:
                for around in stack:
                    around.articles += 1
    flush()
    return found


def points_of(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def without_marked(found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside marked elements.

    A mark does not count for an element around the article: one that holds most of the page's
    text, and all its article and main elements or only a name that has other words besides. Nor
    does such a name for prose inside the article.
    """
    root_mass, articles = 0.0, 0
    for node, text, linked in found:
        points, up = points_of(text, linked), node
        root_mass += points
        while up is not None:
            up.mass += points
            up.chars += len(text)
            up.links += linked
            articles = max(articles, up.articles)
            up = up.parent

    def is_gone(node: Node) -> bool:
        if node.mark == NO_MARK or node.tag in ARTICLES:
            return False
        if node.mass >= 0.5 * root_mass and (0 < node.articles == articles or node.mark == STATE or node.tag == "form"):
            return False
        return not (node.mark == STATE and node.links < 0.2 * node.chars and node.in_article())

    known: dict[int, bool] = {}

    def gone(node: Node | None) -> bool:
        path = []
        while node is not None and id(node) not in known:
            path.append(node)
            node = node.parent
        out = known[id(node)] if node is not None else False
        for one in reversed(path):
            out = known[id(one)] = out or is_gone(one)
        return out

    return [x for x in found if not gone(x[0])]


def main_text(page: str | None) -> str:
    """Blocks of the article, one a line."""
    everything = blocks_of(page or "")
    found = without_marked(everything)
    if not found:
        return ""
    nodes: dict[int, Node] = {}
    for node, _, _ in everything:
        while node is not None:
            node.points, node.chars, node.links = 0.0, 0, 0
            node = node.parent
    for node, text, linked in found:
        points = points_of(text, linked)
        up, share, level = (node.parent if node.tag in PARAGRAPHS else node), 1.0, 0
        while up is not None:
            nodes[id(up)] = up
            up.chars += len(text)
            up.links += linked
            up.points += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level) if level < 5 else 0.0
            up = up.parent

    def score(node: Node) -> float:
        bonus = 1.5 if node.tag in ARTICLES else 1.0
        return bonus * node.points * (1 - node.links / node.chars)

    best = max(nodes.values(), key=score)  # the first of equals, which is the inner one
    around = best
    while around is not None and around.tag not in ARTICLES:
        around = around.parent
    best = around or best  # its headline may stand outside the part with most points
    least = 0.2 * score(best)

    def kept(node: Node, text: str, linked: int) -> bool:
        below = None
        while node is not best:
            if node.parent is None:
                return False
            if node.parent is best.parent:  # a sibling of the article
                below = node
                break
            node = node.parent
        if below is None:
            return True
        if below.tag in PARAGRAPHS:
            return linked < 0.25 * len(text) and (len(text) > 80 or text[-1:] in ".!?" or below.tag in HEADINGS)
        return id(below) in nodes and score(below) >= max(least, 1e-9)

    return "\n".join(text for node, text, linked in found if kept(node, text, linked))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page) for page in batch["html"].to_pylist()]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    wanted = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return wanted.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

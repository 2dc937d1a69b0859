"""Main text of web pages by composite text density.

A page is scanned once, tag by tag with the states of HTML's own attribute syntax, and a DOM of its nodes is built with the
usual implied end tags. Every node gets its link-adjusted characters per tag; a node's score is the sum of its children's
densities. The least density on the path from the highest score to the body is the threshold, and of the nodes that reach
it the one with the largest score is the main subtree, widened to what holds it as long as that reaches the threshold and
adds more text than links. Lists of elements, roles and class words tell what is left out of it; a class word alone never
removes an element that holds an article or most of the page's text. Pages are handled one by one beside the scan.

Defined results: null, empty or tagless-but-blank html has the empty text; a page without any markup is its own text; an
unclosed tag, comment or script takes the rest of the page with it; elements nest to any depth; a header is left out wherever
it stands, in an article too (its heading with it); a null page_id is returned; repeated rows are all returned; an empty table gives an empty result; only the id, url
and html columns are read.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements whose content isn't markup, and others whose content is never text of the page.
RAW = ("script", "style", "textarea", "iframe", "noframes", "noembed", "title")
HIDDEN = ("noscript", "template", "svg", "canvas", "object", "select", "audio", "video", "math")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Boilerplate by element, by role and by a word of class or id.
BOILERPLATE_TAGS = {"nav", "header", "footer", "aside", "button", "dialog", "menu", "head", *RAW, *HIDDEN}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
BOILERPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs "
    "header footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice notification popup modal overlay "
    "comment comments reply replies discussion disqus respond newsletter subscribe subscription signup login search form toolbar pagination pager skip".split()
)
#: Elements that don't break a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of the key closes an open element of the value within the same block.
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}}
_NOTHING, _P = frozenset(), frozenset({"p"})
_SCOPES = set("article aside body div section table ul ol dl td th blockquote main nav header footer form html".split())

#: End tags that don't reach beyond the block they stand in.
_WEAK_ENDS = INLINE | {"p", "li"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    """One element. ``parts`` holds texts and children in order; the counts cover the whole subtree once counted.

    ``skip``: left out with all below; ``doubt``: would be, by a class word or as a form, if it doesn't hold the main text.
    """

    __slots__ = ("chars", "doubt", "holds", "link_chars", "link_tags", "name", "parent", "parts", "skip", "tags")

    def __init__(self, name: str, parent: Node | None, skip: bool = False, doubt: bool = False):
        self.name, self.parent, self.parts, self.skip, self.doubt = name, parent, [], skip, doubt
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.holds = False


def _left_out(name: str, attrs: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it may be."""
    if name in BOILERPLATE_TAGS:
        return True, False
    doubt = name == "form"
    if attrs:
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attrs.get("style", "").lower()):
            return True, False
        if (role := attrs.get("role")) and BOILERPLATE_ROLES.intersection(role.lower().split()):
            return True, False
        if name not in ("body", "html", "article", "main"):
            doubt = doubt or any(not BOILERPLATE_WORDS.isdisjoint(_WORD.findall(attrs[k].lower())) for k in ("class", "id") if k in attrs)
    return False, doubt


def _attributes(page: str, at: int) -> tuple[int, dict[str, str], bool] | None:
    """(place behind the tag, attributes, whether it closes itself) of a tag whose name ends at ``at``; None if it never ends."""
    attrs: dict[str, str] = {}
    while True:
        gap = _GAP.match(page, at).end()
        if gap == len(page):
            return None
        if page[gap] == ">":
            return gap + 1, attrs, gap > at and page[gap - 1] == "/"
        at = _KEY.match(page, gap).end()
        key, value = page[gap:at].lower(), ""
        if m := _IS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                if (end := page.find(quote, at + 1)) < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                end = _BARE.match(page, at).end()
                value, at = page[at:end], end
        attrs.setdefault(key, value)


def tags(page: str) -> Iterator[str | tuple[str, dict[str, str] | None, bool]]:
    """Texts, and (name, attributes, closes itself) of start tags or (name, None, False) of end tags, in one pass."""
    at = begin = 0
    while (lt := page.find("<", at)) >= 0:
        kind = page[lt + 1 : lt + 2]
        closing = kind == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m and not (kind and kind in "!?/"):
            at = lt + 1  # an ordinary character
            continue
        if lt > begin:
            yield page[begin:lt]
        if not m:
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 2)
                at = stop + 3 if stop >= 0 else len(page)
            else:
                stop = page.find(">", lt)
                at = stop + 1 if stop >= 0 else len(page)
            begin = at
            continue
        got = _attributes(page, m.end())
        if got is None:
            return
        at, attrs, alone = got
        name = m[0].lower()
        if closing:
            yield name, None, False
        elif name in _RAW_END:
            stop = _RAW_END[name].search(page, at)
            at = stop.start() if stop else len(page)  # its end tag closes nothing
        else:
            yield name, attrs, alone
        begin = at
    if begin < len(page):
        yield page[begin:]


class _Open:
    """The open elements, and at which depths each name and each scope stands, so no tag has to walk up the tree."""

    def __init__(self, root: Node):
        self.path, self.at, self.scopes = [root], {}, []

    def enter(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.path))
        if node.name in _SCOPES:
            self.scopes.append(len(self.path))
        self.path.append(node)

    def leave(self, depth: int) -> None:
        """Close the element at ``depth`` and all below."""
        while len(self.path) > depth:
            self.at[self.path.pop().name].pop()
        while self.scopes and self.scopes[-1] >= depth:
            self.scopes.pop()

    def end(self, name: str) -> None:
        if at := self.at.get(name):
            if name not in _WEAK_ENDS or not self.scopes or at[-1] > self.scopes[-1] or name in _SCOPES:
                self.leave(at[-1])

    def close(self, names: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``names`` that no scope of another name parts from here."""
        if not any(self.at.get(n) for n in names):
            return
        k = len(self.scopes) - 1
        while k >= 0 and self.path[self.scopes[k]].name in names:  # these are closed below
            k -= 1
        wall = self.scopes[k] if k >= 0 else 0
        found = [at[i] for n in names if (at := self.at.get(n)) and (i := bisect_right(at, wall)) < len(at)]
        if found:
            self.leave(min(found))


def parse(page: str) -> Node:
    """The DOM below a root node, of any depth, in time linear in the page."""
    root = Node("#root", None)
    open_ = _Open(root)
    for t in tags(page):
        here = open_.path[-1]
        if t.__class__ is str:
            here.parts.append(t)
            continue
        name, attrs, alone = t
        if name in ("html", "!doctype"):
            continue
        if attrs is None:
            open_.end(name)
            continue
        if closes := _SIBLINGS.get(name, _NOTHING) | (_P if name in _CLOSES_P else _NOTHING):
            open_.close(closes)
            here = open_.path[-1]
        child = Node(name, here, *_left_out(name, attrs))
        here.parts.append(child)
        if name not in VOID and not alone:
            open_.enter(child)
    return root


def _postorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in node.parts if x.__class__ is Node)
    return out[::-1]


def _count(nodes: list[Node]) -> None:
    """Characters, link characters, tags and link tags of each node's subtree, without what is left out."""
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        if n.skip:
            continue
        n.holds = n.name in ("article", "main")
        for x in n.parts:
            if x.__class__ is Node:
                if not x.skip:
                    n.chars += x.chars
                    n.tags += x.tags + 1
                    n.link_chars += x.link_chars
                    n.link_tags += x.link_tags + (x.name == "a")
                    n.holds = n.holds or x.holds
            else:
                n.chars += len(x) - x.count(" ") - x.count("\n")
        if n.name == "a":
            n.link_chars = n.chars


def _settle(root: Node, nodes: list[Node]) -> None:
    """Decide the doubtful nodes: one that holds the article, or without one most of the text outside links, stays."""
    if any(n.doubt for n in nodes):
        plain = root.chars - root.link_chars
        for n in nodes:
            most = not root.holds and 5 * (n.chars - n.link_chars) > 4 * plain
            n.skip = n.skip or (n.doubt and not n.holds and not most)
        _count(nodes)
    for n in reversed(nodes):  # parents first
        n.skip = n.skip or (n.parent is not None and n.parent.skip)


def density(n: Node, body_ratio: float) -> float:
    """Characters per tag, falling with the share of characters and tags in links."""
    if not n.chars:
        return 0.0
    tags, links, link_tags, plain = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1), max(n.chars - n.link_chars, 1)
    base = math.log(n.chars / plain * n.link_chars + body_ratio * n.chars + math.e)
    return n.chars / tags * math.log(max(n.chars / links * tags / link_tags, 1.0) + math.e, max(base, math.e))


def main_node(root: Node, nodes: list[Node]) -> Node:
    """The main subtree: the largest sum of children's densities among the nodes that reach the body path's threshold."""
    ratio = root.link_chars / root.chars if root.chars else 0.0
    dense = {n: density(n, ratio) for n in nodes if not n.skip}
    if not dense or not root.chars:
        return root
    score = {n: sum(dense[x] for x in n.parts if x.__class__ is Node and not x.skip) for n in dense}
    peak = max(dense, key=lambda n: (score[n], n.chars))
    least, node = dense[peak], peak
    while node.name != "body" and node.parent is not None:
        node = node.parent
        least = min(least, dense[node])
    best = max((n for n in dense if dense[n] >= least), key=lambda n: (score[n], n.chars))
    # a block by itself, or a part of an article, stands for what holds it
    out, up = best, best
    while up.parent is not None:
        up = up.parent
        if dense[up] < least:
            break
        more, links = up.chars - out.chars, up.link_chars - out.link_chars
        if up.name in ("article", "main") or (up.name != "body" and up.parent is not None and 2 * links <= more):
            out = up
    return out


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below a node, in page order, references decoded and white space made single."""
    run: list[str] = []
    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if x.__class__ is str:
            run.append(x)
        elif x is None:
            if text := " ".join(html.unescape("".join(run)).split()):
                yield text
            run.clear()
        elif not x.skip:
            edge = x.name not in INLINE
            if edge:
                stack.append(None)
            stack.extend(reversed(x.parts))
            if edge:
                stack.append(None)
    if text := " ".join(html.unescape("".join(run)).split()):
        yield text


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = _postorder(root)
    _count(nodes)
    _settle(root, nodes)
    return " ".join(blocks(main_node(root, nodes)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x.as_py()) for x in b.column("html")]
        chars = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), chars], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))

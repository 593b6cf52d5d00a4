"""Main text of web pages by composite text density.

A page becomes a tree. Menus, forms, scripts and other parts that name themselves (by tag or
role) are cut. So are reader comments, adverts and notices of cookies that a class, id or label names, in
whatever tag and however much of the page they hold. Of blocks, those go as well whose name is one of a wider list: a
whole token, or a compound of nothing but such names and words like "box"; not if they are wrappers, that is hold an
article, a main or a first-level heading, and not if no text were left without them: then the
densities decide. Every node gets its characters and tags, and those inside links;
its composite density is characters per tag, adjusted for links:

    d = C/T * log_b(C*T / (LC*LT)),   b = ln(C/nLC * LC + LCb/Cb * C + e)

with nLC = C - LC, and LCb, Cb of the body; counts of zero are taken as one. The score of a
node is the sum of its children's densities. Of the nodes whose own density reaches the
threshold, which is the least density on the path from the body to the node of the largest
score, the one with the largest score is the main part. Its text is given block by block.

Edge cases: null or empty html gives an empty text; broken markup is closed where the next
block begins; a page without a body is taken whole; rows that repeat a ``page_id`` are all
kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CUT_TAGS = frozenset("head script style noscript template nav footer aside form fieldset legend label output progress meter button select input textarea iframe object embed svg canvas audio video dialog menu title noembed noframes xmp map datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav footer footers header masthead topbar comment comments commentlist respond disqus replies cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright legal disclaimer login search skip teaser teasers trending".split()
)
#: Names that cut any element, with whatever other words.
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsored comment comments commentlist commenters disqus respond replies discussion discussions cookie cookies consent gdpr".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist commenters disqus respond replies discussion discussions".split())
#: Words that say of a name how things stand with it: the element isn't the part itself.
STATES = frozenset("no has have with without open opened closed enabled disabled free off on status count counter support supported loaded ready active allowed".split())
#: Words that make compounds with names.
COMPANIONS = frozenset(
    "site page main global top bottom left right primary secondary post posts article articles entry story stories news blog content wrapper wrap container box block area section inner outer list lists links link item items bar button buttons icon icons panel row col column unit slot text title heading mobile desktop sticky fixed reader readers user users visitor visitors guest guests customer customers thread body form".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
KEEP_TAGS = frozenset("html body main article".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}

_MARKUP = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    """An element: its tag, children (nodes and strings), and counts once measured."""

    __slots__ = ("chars", "children", "cut", "density", "holds", "least", "link_chars", "link_tags", "linked", "named", "parent", "score", "tag", "tags")

    def __init__(self, tag: str, cut: bool = False, named: bool = False):
        self.tag, self.cut, self.named, self.children = tag, cut, named, []


def _cut(tag: str, attrs: str, inside: bool) -> bool:
    """Whether a part shows by tag, role or style that it is other than main text."""
    if tag in CUT_TAGS or (tag == "header" and not inside):
        return True
    if not attrs or tag in KEEP_TAGS:
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in CUT_ROLES:
            return True
    return False


def _named(tag: str, attrs: str, inside: bool) -> str:
    """What a class, id or label says: "sure" if the element is cut, "name" if it is unless it is a wrapper, else nothing."""
    if not attrs or tag in ("html", "body", "main"):
        return ""
    found = ""
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        if name not in ("class", "id", "aria-label", "itemprop") or (name == "id" and tag in HEADINGS):
            continue
        value = "".join(values).lower()
        for word in [value] if name == "aria-label" else value.split():
            parts = _NAME.findall(word)
            if STATES.intersection(parts):
                continue
            # The ids of sections are often made from their headings.
            own = SURE_NAMES if name != "id" or tag != "section" else COMMENT_NAMES
            plain = all(p in CUT_NAMES or p in SURE_NAMES or p in COMPANIONS or p.isdigit() for p in parts)
            if own.intersection(parts) and (plain or (tag != "article" and name in ("class", "id"))):
                return "sure"
            if "header" in parts and (inside or len(parts) > 1):
                parts = [p for p in parts if p != "header"]
            if plain and name != "itemprop" and CUT_NAMES.intersection(parts) and tag not in INLINE and tag not in ("article", "h1") and (name != "id" or tag != "section"):
                found = "name"
    return found


def _cut_named(root: Node) -> None:
    """Cut the named parts but for wrappers: those that hold an article, a main or a first-level heading."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.cut)
    for node in reversed(order):
        node.holds = any(isinstance(c, Node) and not c.cut and (c.holds or c.tag in ("article", "main", "h1")) for c in node.children)
    cut = [node for node in order if node.named and not node.holds]
    for node in cut:
        node.cut = True
    if cut and not blocks(_find(root, "body") or root):
        for node in cut:
            node.cut = False


class _Open:
    """The open elements; for every tag, where its elements stand, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of ``tags``; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, at: int) -> None:
        """Close the element at a place and all in it."""
        for node in self.stack[at:]:
            self.places[node.tag].pop()
        del self.stack[at:]


def _tag_end(html: str, at: int, quotes: bool) -> int:
    """Place of the ``>`` that ends a tag, outside of quotes if they count; -1 if there is none."""
    while quotes and (m := _QUOTED.search(html, at)):
        if m[0] == ">":
            return m.start()
        at = html.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1 if quotes else html.find(">", at)


def parse(html: str) -> Node:
    """A tree of the page, in time that grows with its length however broken it is.

    End tags without a start are dropped, missing ones supplied. Once a quote is found that nothing
    closes, quotes no longer hide the end of a tag; a tag without any end is text.
    """
    root = Node("#root")
    opened = _Open(root)
    at, n, quotes, no_end, named = 0, len(html), True, len(html), False
    while at < n:
        start = html.find("<", at)
        text = html[at : start if start >= 0 else n]
        if text:
            opened.stack[-1].children.append(text)
        if start < 0:
            break
        m = _MARKUP.match(html, start) if start < no_end or html[start + 1 : start + 2] in ("!", "?") else None
        if m is None:
            opened.stack[-1].children.append("<")
            at = start + 1
            continue
        if not m["tag"]:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = html.find(close, m.end())
            if m[0] == "<![CDATA[":
                opened.stack[-1].children.append(html[m.end() : end if end >= 0 else n])
            at = end + len(close) if end >= 0 else n
            continue
        end = _tag_end(html, m.end(), quotes)
        if end < 0 and quotes:
            quotes, end = False, _tag_end(html, m.end(), False)
        if end < 0:
            no_end = start
            continue
        at, tag, attrs = end + 1, m["tag"].lower(), html[m.end() : end]
        if m["end"]:
            if places := opened.places.get(tag):
                opened.close(places[-1])
            continue
        if tag in BLOCKS and (places := opened.places.get("p")):
            opened.close(places[-1])  # an open paragraph ends where a block begins
        if tag in CLOSES and (place := opened.last(CLOSES[tag])) > opened.last(_SCOPES[tag]):
            opened.close(place)
        inside = bool(opened.places.get("article") or opened.places.get("main"))
        name = _named(tag, attrs, inside) if attrs else ""
        node = Node(tag, name == "sure" or _cut(tag, attrs, inside), name == "name")
        named = named or node.named
        opened.stack[-1].children.append(node)
        if tag in RAW:
            raw = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = raw.end() if raw else n
        elif tag not in VOID and (tag in BLOCKS or not attrs.endswith("/")):
            opened.push(node)  # a slash closes void and unknown elements only
    if named:
        _cut_named(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Counts of every kept node, and its parent; returns the nodes, parents first."""
    order, todo = [], [(root, None, False)]
    while todo:
        node, parent, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        own, inner = 0, []
        for c in node.children:
            if isinstance(c, str):
                own += len("".join(c.split()))
            elif not c.cut:
                inner.append((c, node, linked))
        todo += inner
        node.parent, node.linked, node.chars, node.tags = parent, linked, own, 0
        node.link_chars, node.link_tags = (own, 0) if linked else (0, 0)
    for node in reversed(order[1:]):
        parent = node.parent
        parent.chars += node.chars
        parent.tags += node.tags + 1
        parent.link_chars += node.link_chars
        parent.link_tags += node.link_tags + node.linked
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite density of a node's counts; ``ratio`` is the body's share of characters in links."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(c / max(c - link_chars, 1) * link_chars + ratio * c + math.e)
    own = c / t * math.log(max(c * t / (lc * lt), 1.0000001))
    return own / max(math.log(base), 1e-6) if base > 1.0001 else own


def main_part(root: Node) -> Node:
    """The subtree of the largest sum of densities whose own density reaches the threshold."""
    body = _find(root, "body") or root
    order = _measure(body)
    ratio = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        node.score, node.least = 0.0, node.density if node.parent is None else min(node.density, node.parent.least)
    for node in order[1:]:
        node.parent.score += node.density
    for node in order:
        if not node.score and any(isinstance(c, str) and c.strip() for c in node.children):
            node.score = node.density
    top = max(order, key=lambda x: x.score)
    main = max((node for node in order if node.density >= top.least), key=lambda x: x.score)
    # Of a part inside an article (or main), the whole innermost article is the part: its title and
    # first lines often stand in wrappers of their own.
    above, at = None, main
    while at is not None and at.tag not in ("article", "main"):
        at = above = at.parent
    return above if above is not None and main.tag != "body" else main


def _find(root: Node, tag: str) -> Node | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            return node
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return None


def blocks(main: Node) -> list[str]:
    """Texts of the part's blocks in page order, white space in each made single blanks."""
    out, run = [], []

    def flush():
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [main]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.cut:
            continue
        elif x.tag in BLOCKS:
            flush()
            todo.append(None)
            todo.extend(reversed(x.children))
        else:
            if x.tag in ("br", "td", "th", "img"):
                run.append(" ")
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    return "\n".join(blocks(main_part(parse(html))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                cols = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")

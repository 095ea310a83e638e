"""Main text of web pages by composite text density.

Each page becomes a small DOM tree. For every node the density is its characters per tag, with the
characters and tags of links counted against it; a node's score is the sum of its children's densities.
The subtree of the largest score is the core of the page. The least density on the path from the body to it
is the threshold: subtrees of the body that reach it belong to the text as well, others don't. Parts whose
tag or role says that they are not the article (menus, adverts, forms) never do; a core inside an article or
main element grows to that element. A class or id that says so is evidence only: the part is dropped unless it
holds an article or main element or, on pages whose articles are all in such parts or that have none, the
core of the whole tree or most of the body's text. Names of states (has-sidebar, fixed-header) say nothing, nor do
names with a word that is not of layout (social-science). Of equal scores the first node in page order is the core.

Blocks are in page order, white space inside a block is one space, blocks are joined by an empty line.
Nulls: a null html is an empty page and gives the empty text. Repeated rows are done one by one, an empty
table gives no rows. Broken markup never fails: a tag that the page ends in is dropped, an open comment or
script goes to the end of the page. The time is linear in the page, whatever its nesting; a page is one row and so
has to fit a task. Columns besides page_id, url and html are ignored, whatever they are called.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
DROPPED = frozenset("head script style noscript nav footer aside form iframe template textarea select option button input label fieldset legend svg math object embed video audio canvas map dialog menu noembed noframes xmp title search".split())
IMPLIED = {"li": (["li"], ["ul", "ol", "menu", "dir"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]), "tr": (["tr", "td", "th"], ["table", "tbody", "thead", "tfoot"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]), "option": (["option"], ["select"])}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination "
    "sidebar sidebars aside rail footer header masthead topbar toolbar comment comments respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations skip widget widgets form search copyright legal disclaimer tags tagcloud".split()
)
#: Words that go with these in a name without changing what it means.
COMPANIONS = frozenset(
    "area bar bars block body bottom box btn button buttons card cards center column col container content contents count cta desktop dropdown feed fixed full global group half heading holder icon icons image inline inner item items js layer layout left level "
    "lightbox link links list lists main mobile nested new outer page pane panel permalink policy post posts primary right row secondary section sections site slot small stack sticky sub tab tabs thread title top unit user users view wide wrap wrapper entry article top".split()
)
#: First words of names that tell a state of the element.
STATES = frozenset("has no not with without fixed is".split())
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I | re.S)
_NAME_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "density", "score", "named")

    def __init__(self, tag: str, parent: "Node | None") -> None:
        self.tag, self.parent, self.kids, self.named = tag, parent, [], False
        if parent is not None:
            parent.kids.append(self)


class Open:
    """The open elements, with the places of each tag, so that the nearest one is found at once at any depth."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        """Closes all elements from place `to` on."""
        while len(self.nodes) > to:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def nearest(self, *tags: str) -> int:
        """The place of the innermost one, 0 if there is none (0 is the root, which is never closed)."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close_inline(self, tag: str) -> None:
        """Closes an element unless another block has begun in it."""
        here = self.nearest(tag)
        if here and self.blocks[-1] <= here:
            self.cut(here)


def _is_other(tag: str, attributes: str, inside: bool) -> bool:
    """Not of the article by its element or role. A header inside an article is its own."""
    if tag in DROPPED:
        return True
    if tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if m.start() and not attributes[m.start() - 1].isspace() and attributes[m.start() - 1] not in "\"'/":
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _is_named(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the class or id names a part that isn't of the article: by such a word alone or with words of layout, but
    not with others (share-buttons does, social-science doesn't)."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in ("class", "id") or m.start() and not attributes[m.start() - 1].isspace() and attributes[m.start() - 1] not in "\"'/":
            continue
        for word in value.split():
            parts = [p.lower() for p in _NAME_PARTS.split(word) if p]
            if parts and parts[0] not in STATES and all(p in NAMES or p in COMPANIONS or len(p) == 1 for p in parts) and any(p in NAMES and not (inside and p == "header") for p in parts):
                return True
    return False


def parse(page: str) -> Node:
    """The tree of what may be of the article; text is in nodes of the tag ''."""
    root = Node("html", None)
    stack = Open()
    stack.push(root)
    at, n = 0, len(page)
    skip: list[str] = []  # open elements of a part that is dropped
    skipped: Counter[str] = Counter()

    def text(value: str) -> None:
        if value and not skip:
            Node("", stack.nodes[-1]).chars = html.unescape(value)

    def unskip() -> str:
        skipped[skip[-1]] -= 1
        return skip.pop()

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page.find("<", at)
            while rest >= 0 and not (page[rest + 1 : rest + 2].isalpha() or page[rest + 1 : rest + 2] in ("/", "!", "?")):
                rest = page.find("<", rest + 1)
            loose = _LOOSE.match(page, rest) if rest >= 0 else None
            if loose is None:
                text(page[at:])
                break
            m = loose
        else:  # a tag with an odd quote is read up to the next >
            lone = page.find("<", at, m.start())
            while lone >= 0:
                loose = _LOOSE.match(page, lone)
                if loose is not None:
                    m = loose
                    break
                lone = page.find("<", lone + 1, m.start())
        text(page[at : m.start()])
        at = m.end()
        if m.re is _TOKEN and m[2] is None:
            if m[0].startswith("<![CDATA["):
                pass
            continue
        if not m[4]:  # the page ends inside the tag
            break
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if skip:
                if skipped[tag]:
                    while skip and unskip() != tag:
                        pass
                elif tag in ("body", "html", "article", "main"):
                    skip.clear()
                    skipped.clear()
                    here = stack.nearest(tag)
                    if here:
                        stack.cut(here)
                continue
            if tag == "br":
                text(" ")
                continue
            if tag not in BLOCKS:
                stack.close_inline(tag)
            elif here := stack.nearest(tag):
                stack.cut(here)
            continue
        own = attributes.rstrip().endswith("/")
        if skip:
            if tag in RAW:
                at = _raw_end(page, at, tag)
            elif tag not in VOID:
                if tag == skip[-1] and tag in ("li", "p", "option", "dt", "dd"):
                    unskip()
                skip.append(tag)
                skipped[tag] += 1
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "hr", "img") and not (tag == "wbr"):
                if tag == "hr":
                    stack.close_inline("p")
                    Node("hr", stack.nodes[-1])
                else:
                    text(" ")
            continue
        if tag in CLOSES_P:
            stack.close_inline("p")
        if tag in IMPLIED:
            closes, within = IMPLIED[tag]
            while (here := stack.nearest(*closes)) > stack.nearest(*within):
                stack.cut(here)
                if tag != "tr":
                    break
        if tag in RAW:
            at = _raw_end(page, at, tag)
            continue
        if tag in ("html", "body") and stack.at.get(tag):
            continue
        if tag == "body":
            stack.cut(1)
        inside = stack.nearest("article", "main") > 0
        if _is_other(tag, attributes, inside):
            if not (own and tag in ("svg", "math")):
                skip.append(tag)
                skipped[tag] += 1
            continue
        node = Node(tag, stack.nodes[-1])
        node.named = _is_named(tag, attributes, inside)
        stack.push(node)
    return root


def _raw_end(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        if n.tag:
            todo.extend(reversed(n.kids))
    return out


def weigh(root: Node) -> None:
    """Characters, tags and density of every node, and the sum of its children's densities."""
    nodes = _order(root)
    for n in reversed(nodes):
        if not n.tag:
            continue
        n.tags = sum(1 + k.tags for k in n.kids if k.tag)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in n.kids if k.tag)
        own = sum(len(k.chars.strip()) for k in n.kids if not k.tag)
        n.chars = own + sum(k.chars for k in n.kids if k.tag)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in n.kids if k.tag)
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(nodes):
        if not n.tag:
            continue
        free = n.chars - n.link_chars
        if n.chars == 0:
            n.density = 0.0
        else:
            base = math.log(n.chars / (free or 1) * n.link_chars + share * n.chars + math.e)
            n.density = n.chars / (n.tags or 1) * math.log(max(1.0, n.chars / (n.link_chars or 1) * (n.tags or 1) / (n.link_tags or 1))) / base
        n.score = sum(k.density for k in n.kids if k.tag)


def _drop_named(root: Node) -> None:
    """Takes out the parts that names tell from the article, but for those that the weighed tree speaks for."""
    nodes = [n for n in _order(root) if n.tag]
    if not any(n.named for n in nodes):
        return
    weigh(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    kept, under, plain = set(), set(), False  # under: in a named part
    for n in nodes:
        if n.named or n.parent in under:
            under.add(n)
        if n.tag in ("article", "main"):
            plain = plain or n not in under and n.chars > 0
            while n is not None and n not in kept:
                kept.add(n)
                n = n.parent
    if not plain:
        n = max((n for n in _order(body) if n.tag), key=lambda n: n.score)
        while n is not None:
            kept.add(n)
            n = n.parent
        kept.update(n for n in nodes if 2 * n.chars > body.chars)
    for n in nodes:
        n.kids = [k for k in n.kids if not k.tag or not k.named or k in kept]


def core(root: Node) -> list[Node]:
    """The subtrees of the text, in page order."""
    _drop_named(root)
    weigh(root)
    nodes = [n for n in _order(root) if n.tag]
    body = next((n for n in nodes if n.tag == "body"), root)
    inside = [n for n in _order(body) if n.tag]
    best = max(inside, key=lambda n: n.score)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    article = [n for n in path if n.tag in ("article", "main")]
    if article:
        return [article[-1]]
    threshold = min(n.density for n in path)
    if best is body or len(path) == 1:
        return [body]
    return [k for k in body.kids if not k.tag or k is path[-2] or k.density >= threshold]


def blocks(parts: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            out.append(line)

    todo: list[object] = list(reversed(parts))
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif not n.tag:
            held.append(n.chars)
        elif n.tag in BLOCKS:
            end()
            todo.append(None)
            todo.extend(reversed(n.kids))
        else:
            todo.extend(reversed(n.kids))
    end()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(core(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length for every page."""
    short_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)

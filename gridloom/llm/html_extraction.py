"""Main text of HTML pages by composite text density.

The page becomes a tree whose nodes count characters, tags, link characters and link tags of their subtree. A node's
composite density is (C / T) * log(C T / (LC LT)) to the base ln(C LC / nLC + LCb C / Cb + e), where nLC are the
characters outside links and b is the body. The densities of a node's children are summed; the threshold is the least
density on the path from the node of the largest sum to the body, and the subtree of largest sum at or above the
threshold is the main text. A text that is split over siblings is
their parent's: the choice climbs while a sibling at or above the threshold holds a fair share of text outside links. What is
never main text by its element is cut before counting; what a class word marks is cut too, and so are forms, dialogs and
asides, unless they hold an article or most of the page's text: there the density decides.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow

# HTML's element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CUT = frozenset("nav footer script style noscript iframe template svg button select textarea input title head menu object applet canvas map audio video".split())
#: Elements that are cut like those that a class word marks: some pages have their whole text in one.
WRAPPERS = frozenset("aside form dialog".split())
#: Words of class, id and role that mark menus, adverts, notices, sidebars and reader comments.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar sidebars aside footer masthead topbar toolbar comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations widget widgets login signup search "
    "complementary contentinfo alert".split()
)
#: Those of reader comments, which are often articles themselves and may be longer than the text they belong to.
READER_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Which open elements an opening tag ends, by HTML's rules of optional end tags.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPH_WALL = frozenset("button caption html td th table object".split())
#: Comments, declarations and tags. Quotes count after = only; one that is never closed is a plain character, and a tag that
#: is never closed runs to the end of the page, as browsers have it. No part can match what another can, and none gives back
#: what it took, so that a page is read in linear time.
_MARK = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[^a-z]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none(?![\w-])", re.I)


class Node:
    """An element: its parent, children and texts in page order, and the counts of its subtree."""

    __slots__ = ("chars", "cut", "density", "holds", "kids", "link_chars", "lines", "link_tags", "marks", "name", "parts", "plain", "total", "up")

    def __init__(self, name: str, up: Node | None, cut: bool, marks: set[str] | None = None):
        self.name, self.up, self.cut, self.marks = name, up, cut, marks
        self.parts: list[str | Node] = []
        self.kids: list[Node] = []
        self.chars = self.link_chars = self.link_tags = 0
        self.total = 0
        self.density = 0.0


def _attributes(attrs: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of several by one name the first, as browsers have it."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), "".join(values))
    return out


def _is_cut(name: str, attrs: dict[str, str], inside: bool) -> bool:
    return name in CUT or name == "header" and not inside or "hidden" in attrs or bool(_NOT_SHOWN.search(attrs.get("style", "")))


def _marks(name: str, attrs: dict[str, str]) -> set[str] | None:
    """The words of CUT_WORDS in an element's class, id and role, and its name if it is a wrapper."""
    named = " ".join(attrs[x] for x in ("class", "id", "role") if x in attrs)
    found = CUT_WORDS.intersection(_PARTS.split(named.lower())) if named else set()
    return (found | {name} if name in WRAPPERS else found) or None


#: What an end tag of an inline element doesn't reach over.
INLINE_WALL = ("article", "main", "body", "table")


def parse(html: str) -> Node:
    """The tree of a page; broken markup is repaired by the rules of optional and missing end tags.

    stack has the open elements from the root on, where the places of those of each name in it, so that no tag searches the
    open elements one by one.
    """
    root = Node("html", None, False)
    stack, pos, lower = [root], 0, None
    where: dict[str, list[int]] = {}

    def last(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    def close(place: int) -> None:
        while len(stack) > place:
            where[stack.pop().name].pop()

    while True:
        mark = _MARK.search(html, pos)
        text = html[pos : mark.start() if mark else len(html)]
        if text:
            stack[-1].parts.append(text)
        if not mark:
            return root
        pos = mark.end()
        name = mark["name"]
        if name is None:
            if mark[0].startswith("<![CDATA["):
                stack[-1].parts.append(mark[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if mark["end"]:
            place = last((name,))
            if place and (name in BLOCK or place > last(INLINE_WALL)):
                close(place)
            elif name == "br":
                stack[-1].parts.append(" ")
            continue
        if name == "html" and len(stack) == 1:
            continue
        if name in BLOCK and (place := last(("p",))) > last(PARAGRAPH_WALL):
            close(place)
        if name in CLOSES:
            ends, walls = CLOSES[name]
            wall = last(walls)
            found = [at[k] for e in ends if (at := where.get(e)) and (k := bisect_right(at, wall)) < len(at)]
            if found:
                close(min(found))
        if name in ("body", "main") and where.get("head"):
            close(where["head"][-1])
        inside = bool(where.get("article") or where.get("main"))
        attrs = _attributes(mark["attrs"]) if mark["attrs"] else {}
        node = Node(name, stack[-1], _is_cut(name, attrs, inside), _marks(name, attrs))
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if name in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]+", lambda m: m[0].lower(), html)
            stop = lower.find(f"</{name}", pos)
            pos = len(html) if stop < 0 else (html.find(">", stop) + 1 or len(html))
        elif name not in VOID and not mark["attrs"].endswith("/"):
            where.setdefault(name, []).append(len(stack))
            stack.append(node)


def _cut_marked(root: Node) -> None:
    """Cut the elements that a class word marks, but none that holds an article or main, or most of the page's text
    outside links. An aside may hold articles that are not the page's, so that only its length counts. An article marked as
    a reader comment does not count; where the page has another article or main,
    neither does the length of reader comments, nor that of an element of no more pieces of text than it (an advert)."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.name == "a"
        node.plain = 0 if linked else sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.lines = int(node.plain > 0)
        node.holds = node.name in ("article", "main") and not (node.marks and node.marks & READER_WORDS)
        stack.extend((k, linked) for k in node.kids if not k.cut)
    if not any(n.marks for n in order):
        return
    most = 0
    for node in reversed(order):
        if node.holds:
            most = max(most, node.lines if node.name in ("article", "main") else 0)
        if node.up is not None:
            node.up.lines += node.lines
            node.up.plain += node.plain
            node.up.holds |= node.holds
    for node in order:
        if node.marks and (not node.holds or node.name == "aside") and node.name not in ("body", "html", "article", "main"):
            long = 2 * node.plain > root.plain
            node.cut = not long or root.holds and (node.lines <= most or bool(node.marks & READER_WORDS))


def _count(root: Node) -> list[Node]:
    """Fill in the counts from the leaves up; the nodes that are not cut, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.kids = [k for k in node.kids if not k.cut]
        stack.extend(reversed(node.kids))
    for node in reversed(order):
        node.chars += sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        if node.name == "a":
            node.link_chars = node.chars
        for kid in node.kids:
            node.chars += kid.chars
            node.total += kid.total + 1
            node.link_tags += kid.link_tags + (kid.name == "a")
            node.link_chars += kid.chars if node.name == "a" else kid.link_chars
    return order


def _densities(order: list[Node], body: Node) -> None:
    all_links, all_chars = body.link_chars, max(1, body.chars)
    for node in order:
        c, t = node.chars, max(1, node.total)
        if not c:
            continue
        links, tags = max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + all_links / all_chars * c + math.e)
        ratio = c / links * t / tags
        node.density = c / t * (math.log(ratio) / math.log(base) if ratio > 1 and base > 1 else 1.0 if ratio > 1 else 0.0)


#: Share of the chosen subtree's text outside links that a sibling needs to be a further part of the same text.
FURTHER = 0.25


def _continues(node: Node, best: Node, least: float) -> bool:
    """Whether a sibling of best is a further part of its text: dense enough, long enough and not mostly links."""
    text = node.chars - node.link_chars
    return node is not best and node.density >= least and text >= FURTHER * (best.chars - best.link_chars) > 0 and 2 * node.link_chars < node.chars


def main_node(root: Node) -> Node | None:
    """The subtree of the largest density sum at or above the threshold of its path to the body."""
    _cut_marked(root)
    order = _count(root)
    body = next((n for n in order if n.name == "body"), root)
    if body.chars < root.chars:  # text outside the body belongs to the page
        body = root
    _densities(order, body)
    sums = {id(n): sum(k.density for k in n.kids) or n.density for n in order}
    best = max(order, key=lambda n: sums[id(n)], default=None)
    if best is None or not root.chars:
        return None
    least, node = best.density, best
    while node is not None and node is not body.up:
        if node.chars:
            least = min(least, node.density)
        node = node.up
    fit = [n for n in order if n.density >= least]
    best = max(fit, key=lambda n: sums[id(n)], default=best)
    while best.up is not None and best.name not in BLOCK:
        best = best.up
    while best.up is not None and best.name == "p":  # one paragraph outweighs its siblings: the text is their parent
        best = best.up
    while best.up is not None and best is not body and any(_continues(k, best, least) for k in best.up.kids):
        best = best.up
    whole = best
    while whole is not None and whole.name not in ("article", "main"):
        whole = whole.up
    return whole or best


def blocks(node: Node) -> list[str]:
    """The texts of the subtree's blocks in page order, character references decoded and white space folded."""
    out, run = [], []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        at, k = stack.pop()
        if k == 0 and at.name in BLOCK:
            flush()
        while k < len(at.parts):
            part = at.parts[k]
            k += 1
            if isinstance(part, str):
                run.append(unescape(part))
            elif part.name == "br":
                run.append(" ")
            elif not part.cut:
                stack.append((at, k))
                stack.append((part, 0))
                break
        else:
            if at.name in BLOCK:
                flush()
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page, one line a block; empty if there is none."""
    if not html:
        return ""
    node = main_node(parse(html))
    return "\n".join(blocks(node)) if node is not None else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield batch.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, any others) with text and n_chars (code points) in place of html.

    A null or empty page, or one without main text, gives an empty text; broken markup is repaired; columns by the
    names of the results are replaced; repeated rows stay repeated.
    """
    pages = pages.drop("text", "n_chars").withColumn("html", F.col("html").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html")
    return in_arrow(pages, _extract, f"{schema}, text string, n_chars long")

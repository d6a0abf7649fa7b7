"""Main text of web pages by composite text density.

A page becomes a tree of elements. Every node gets its number of characters
and tags below it, and those inside links. The composite density of a node is
its characters per tag, lowered where much of the text is link text:

    c / t * log_b((c / lc) * (t / lt)),   b = ln(c / nlc * lc + LC / C * c + e)

with c, t characters and tags, lc, lt those in links, nlc = c - lc, and C, LC
of the body. A node's density sum adds up its children's densities. The
threshold is the least density on the path from the node with the greatest
density sum up to the body; content is, inside every subtree that reaches the
threshold, the subtree of the greatest density sum.

Before densities are counted, elements that are not article text by their
kind are cut out: scripts, styles, forms, menus, footers, asides, site
headers, and elements whose role, class or id names them as adverts, notices,
comments, sidebars and so on. The result is all chosen subtrees in page order.
Two of them are widened: one inside a marked article (``article`` or ``main``)
to the whole article, and outside articles a paragraph or inline element to
its block container below the body. If the body itself has the greatest sum
and nothing chosen is in an article, the whole body is the result.

Defined results: null, empty and text-less pages give an empty text; broken
markup (unclosed, stray or cut-off tags) is read as browsers do for blocks;
repeated rows are read row by row; other columns are ignored. Pages are
processed one by one inside their task, in small Arrow batches.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from costlens.llm.common import small_batches

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style template noscript form button select option textarea input nav footer aside dialog menu head title iframe object embed svg canvas audio video map xmp noembed noframes".split()
)
ARTICLES = frozenset(("article", "main"))
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 br b i em strong span a".split())
BLOCKS = frozenset(
    "address article blockquote body br center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An open element of the key ends where one of the values begins (up to the barrier).
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Roles, and words of class or id, of what is not article text.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|"
    r"sidebar|side-bar|aside|widget|related|recommended|recommendations|"
    r"comment|comments|commentlist|disqus|respond|replies|"
    r"cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|footer|copyright|masthead|site-header|page-header|topbar|toolbar|skip|search)(?:$|[\s_-]|\d)",
    re.I,
)
#: Names that tell of such a part elsewhere on the page.
ABOUT = re.compile(r"(?:^|(?<=[\s]))(?:no|has|have|with|without|hide|show|single)[-_]\S+", re.I)
# End of the fixed values.

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _dropped(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not inside_article:
        return True
    if attributes and "=" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role" and value.strip().lower() in ROLES:
                return True
            if name in ("class", "id") and tag not in ("body", "html", "main") and NOT_ARTICLE.search(ABOUT.sub("", value)):
                return True
            if name == "aria-hidden" and value.lower() == "true":
                return True
    return tag not in VOID and bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes)) if attributes else False


def parse(page: str) -> Node:
    root = Node("html", None)
    stack = [root]
    open_tags: Counter[str] = Counter()  # spares looking down deep stacks in vain
    at, size = 0, len(page)

    def push(node: Node) -> None:
        stack.append(node)
        open_tags[node.tag] += 1

    def pop_from(i: int) -> None:
        for node in stack[i:]:
            open_tags[node.tag] -= 1
        del stack[i:]

    def close(names: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        if not any(open_tags[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                pop_from(i)
                return
            if stack[i].tag in barriers:
                return

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        m = TOKEN.match(page, lt)
        if not m:  # a plain "<"
            stack[-1].children.append(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            stack[-1].children.append(page[at:lt])
        at = m.end()
        end_tag, tag, attributes = m.group(1), m.group(2), m.group(3)
        if end_tag:
            name = end_tag.lower()
            if name == "br":
                stack[-1].children.append(Node("br", stack[-1]))
            elif name == "p":
                close(("p",), ("td", "th", "table", "button", "article", "body"))
            elif name not in ("html", "body"):
                inline = name not in BLOCKS and name not in DROPPED
                # An inline end tag does not close a block that it overlaps.
                for i in range(len(stack) - 1, 0, -1) if open_tags[name] else ():
                    if stack[i].tag == name:
                        pop_from(i)
                        break
                    if inline and (stack[i].tag in BLOCKS or stack[i].tag in DROPPED):
                        break
            continue
        if not tag:
            continue  # a comment, doctype or processing instruction
        name = tag.lower()
        if name in ("html", "body"):
            if len(stack) == 1 and name == "body":
                push(_add(Node("body", stack[-1])))
            continue
        if name == "head" and open_tags["body"]:
            continue
        if name in CLOSES_P:
            close(("p",), ("td", "th", "table", "button", "article", "body"))
        if name in IMPLIED_END:
            close(*IMPLIED_END[name])
        if stack[-1].tag == "head" and name not in ("meta", "link", "title", "script", "style", "base", "noscript", "template"):
            pop_from(len(stack) - 1)
        inside = bool(open_tags["article"] or open_tags["main"])
        node = _add(Node(name, stack[-1], _dropped(name, attributes or "", inside)))
        if name in VOID or (attributes or "").endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            gt = page.find(">", end.start()) if end else -1
            at = size if gt < 0 else gt + 1
            continue
        push(node)
    return root


def _add(node: Node) -> Node:
    node.parent.children.append(node)
    return node


def _walk(root: Node) -> list[Node]:
    """All kept nodes, parents before children (no recursion: pages nest deep)."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.dropped)
    return order


def _count(root: Node) -> list[Node]:
    order = _walk(root)
    for node in reversed(order):
        node.chars = sum(len(WHITE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        for c in node.children:
            if isinstance(c, Node) and not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    return order


def _densities(order: list[Node], body: Node) -> None:
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t = node.chars, max(1, node.tags)
        if not c:
            continue
        lc, lt = max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * lc + ratio * c + math.e)
        node.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)))
    for node in order:
        node.sum = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped)


def _best(node: Node) -> Node:
    """The subtree of the greatest density sum in ``node``'s subtree."""
    return max(_walk(node), key=lambda x: x.sum)


def main_nodes(root: Node) -> list[Node]:
    bodies = [c for c in root.children if isinstance(c, Node) and c.tag == "body"]
    body = bodies[0] if bodies else root
    order = _count(body)
    if not body.chars:
        return []
    _densities(order, body)
    top = _best(body)
    threshold, node = top.density, top
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    chosen, todo = [], [body]
    while todo:
        node = todo.pop()
        children = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        # The body itself always reaches its path's least density: look below.
        if node is not body and node.density >= threshold and node.chars:
            chosen.append(_best(node) if node.sum else node)
        elif node is not body or children:
            todo.extend(reversed(children))  # in page order
    widened = [_widened(node, body) for node in chosen]
    if not chosen or top is body and not any(x.tag in ARTICLES for x in widened):
        return [body]  # the body is itself the subtree of the greatest sum
    # Nodes inside other chosen ones go; the rest is in page order.
    ids = {id(x) for x in widened}
    kept: dict[int, Node] = {}
    for node in widened:
        up = node.parent
        while up is not None and id(up) not in ids:
            up = up.parent
        if up is None:
            kept[id(node)] = node
    return list(kept.values())


def _widened(node: Node, body: Node) -> Node:
    """The outermost marked article around a chosen node; outside articles a
    chosen paragraph or inline element stands for its block container, short
    of the body, and any other node for itself."""
    outer, up = None, node
    while up is not None:
        if up.tag in ARTICLES:
            outer = up
        up = up.parent
    if outer is not None:
        return outer
    up = node
    while up is not None and up is not body and up.tag in PARAGRAPHS:
        up = up.parent
    return node if up is None or up is body else up


def blocks_of(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            one = WHITE.sub(" ", html.unescape("".join(text))).strip()
            if one:
                out.append(one)
            text.clear()

    for top in nodes:
        flush()
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                text.append(x)
            elif not x.dropped:
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
    flush()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks_of(main_nodes(parse(page))))


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars."""
    small_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        _task, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )

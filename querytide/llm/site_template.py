"""Main text of web pages, with the site's own template removed.

Each page becomes a tree of its block elements. Every element that could still be boilerplate is hashed with all it
contains; Spark counts for each host on how many different pages a subtree occurs, and subtrees that recur on many of
them are deleted from the host's pages. What the page itself marks as no article (navigation, footers, forms, adverts
and so on, by element, role, class or id) goes too, and where a page has an article or main element, only that is read.
Prose inside it (paragraphs, headings, quotations, lists, tables) is never taken for template: passages may recur.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import as_bytes, lists
from querytide.session import stored

#: A subtree is template if so many different pages of its host have it, however many pages the host has.
MIN_PAGES = 5
#: Elements nested deeper become neighbours; their text stays in order.
DEPTH = 200
_BATCH_BYTES = 4 << 20

# Kinds of elements.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption hr".split())
_BLOCK = _PROSE | set("html body div section article main header footer nav aside form fieldset legend address details summary dialog menu center button select option label svg math object audio video canvas head".split())
_DROPPED = set("nav footer aside form dialog menu button select svg math object audio video canvas head".split())
_CELLS = {"td", "th", "option"}
#: An opening tag of the key ends open elements of the value, up to the nearest element that holds such items.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert[a-z]*|banner|sponsor[a-z]*|promo[a-z]*|nav|navbar|navigation|menu|breadcrumbs?|sidebar"
    r"|widgets?|footer|masthead|site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|notice|notification|alert"
    r"|newsletter|subscri(?:be|ption)|signup|login|popup|modal|overlay|share|sharing|social|related|recommend[a-z]*"
    r"|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|search|skip-?link|copyright)(?![a-z])"
)
_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_UNENDED = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """A block element: its name, what stands in it in order (text, or nodes), and what its attributes tell."""

    __slots__ = ("name", "kids", "parent", "depth", "out", "main", "holds_main", "kind", "hash")

    def __init__(self, name: str, parent: Node | None, attributes: str = "") -> None:
        self.name, self.parent, self.kids, self.hash = name, parent, [], 0
        self.depth, self.holds_main = parent.depth + 1 if parent else 0, False
        self.out, self.main, self.kind = name in _DROPPED, name in ("article", "main"), ""
        if attributes and "=" in attributes or "hidden" in attributes:
            found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
            self.kind = found.get("class", "") + " " + found.get("id", "")
            role = found.get("role", "")
            if role in ("main", "article") or found.get("itemprop") == "articlebody":
                self.main = True
            hidden = "hidden" in found or found.get("aria-hidden") == "true"
            hidden = hidden or "display:none" in found.get("style", "").replace(" ", "")
            self.out = self.out or hidden or role in _ROLES or bool(_NAMES.search(self.kind))
            if self.out:
                self.main = False
        while self.main and parent and not parent.holds_main:
            parent.holds_main, parent = True, parent.parent


def parse(source: str) -> Node:
    """The tree of block elements. Inline elements only leave their text; text is still encoded."""
    root = top = Node("", None)
    at, size = 0, source.rfind(">") + 1
    rest, source = source[size:], source[:size]
    while at < size:
        tag = _TAG.search(source, at)
        if tag is None:
            top.kids.append(source[at:])
            break
        if tag.start() > at:
            top.kids.append(source[at : tag.start()])
        at = tag.end()
        end, name, attributes = tag.group(1, 2, 3) if tag[2] else tag.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if end:
            if name in _BLOCK:
                node = top
                while node.parent and node.name != name:
                    node = node.parent
                if node.parent:
                    top = node.parent
            continue
        if name in _RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = closing.end() if closing else size
        elif name == "br":
            top.kids.append(" ")
        elif name in _BLOCK and name not in _VOID:
            if name in _ENDS:
                ends, holders = _ENDS[name]
                node = top
                while node.parent and node.name not in holders:
                    if node.name in ends:
                        top = node.parent
                    node = node.parent
            elif top.name == "p":
                top = top.parent
            elif name in ("div", "section", "article", "main", "header", "footer", "nav", "aside", "form"):
                node = top
                while node.parent and node.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    node = top = node.parent
            while top.depth >= DEPTH:
                top = top.parent
            node = Node(name, top, attributes)
            top.kids.append(node)
            top = node
        elif name == "hr":
            top.kids.append(Node("hr", top))
    top.kids.append(_UNENDED.split(rest, maxsplit=1)[0])
    return root


def _kept(node: Node, inside: bool) -> bool:
    """Whether the page's own marks leave the element in."""
    if node.name in ("html", "body") or node.main:
        return True
    if node.name == "header" and not inside:
        return node.holds_main
    return not node.out or (node.name not in _DROPPED and node.holds_main)


def _hash(node: Node, inside: bool, found: list[int]) -> int:
    """The hash of a subtree; hashes of subtrees that may be template are added to `found`."""
    parts, candidates = [node.name, node.kind.strip()], []
    for kid in node.kids:
        if isinstance(kid, Node):
            parts.append(f"<{_hash(kid, inside or kid.main, candidates):x}>")
        elif text := " ".join(kid.split()):
            parts.append(text)
    node.hash = value = xxhash.xxh3_64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) >> 1
    if len(parts) > 2:
        found += candidates
        if _may_be_template(node, inside):
            found.append(value)
    return value


def _may_be_template(node: Node, inside: bool) -> bool:
    if node.name in ("", "html", "body") or node.main or node.holds_main:
        return False
    return not (inside and node.name in _PROSE)


def subtrees(source: str) -> list[int]:
    """The different hashes of a page's subtrees that may be template."""
    found: list[int] = []
    _hash(parse(source), False, found)
    return sorted(set(found))


def _prune(node: Node, inside: bool, template: set[int]) -> None:
    kids = []
    for kid in node.kids:
        if isinstance(kid, Node):
            here = inside or kid.main
            if not _kept(kid, inside):
                continue
            if kid.hash in template and _may_be_template(kid, here):
                continue
            _prune(kid, here, template)
        kids.append(kid)
    node.kids = kids


def _read(node: Node, blocks: list[list[str]]) -> None:
    cell = node.name in _CELLS
    if cell:
        blocks[-1].append(" ")
    else:
        blocks.append([])
    for kid in node.kids:
        if isinstance(kid, Node):
            _read(kid, blocks)
        else:
            blocks[-1].append(kid)
    if not cell:
        blocks.append([])


def _mains(node: Node) -> list[Node]:
    """The outermost article elements, or else the outermost main elements."""
    out: list[Node] = []
    for kid in node.kids:
        if isinstance(kid, Node):
            out += [kid] if kid.main else _mains(kid)
    return out


def _articles(node: Node) -> list[Node]:
    mains = _mains(node)
    inner = [a for m in mains if m.name == "main" for a in _mains(m)]
    return [m for m in mains if m.name != "main"] + inner or mains


def main_text(source: str, template: set[int]) -> str:
    """The text of a page's article: blocks in page order, joined by an empty line."""
    root = parse(source)
    if template:
        _hash(root, False, [])
    _prune(root, False, template)
    blocks: list[list[str]] = []
    for node in _articles(root) or [root]:
        _read(node, blocks)
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def templates(pages: DataFrame) -> DataFrame:
    """host, page and hashes: the subtrees of each different page that recur on MIN_PAGES different pages of its host.

    `pages` has host, page (a hash of the html) and html. Pages that are alike count once, so that copies of a page make
    no template of it. Counts are combined before the shuffle and joined to the subtrees of each page, so a row is as
    bounded as a page, whatever the host has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtrees(text.decode("utf-8", "replace")) for text in as_bytes(batch.column(2))]
            flat = np.array([x for f in found for x in f], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(flat, np.array([len(f) for f in found], np.int64), pa.int64())],
                names=["host", "page", "hashes"],
            )

    found = pages.select("host", "page", "html").mapInArrow(run, "host string, page long, hashes array<long>")
    different = found.groupBy("host", "page").agg(F.first("hashes").alias("hashes"))
    # Written first, so that the exchange of the join is its own and AQE can split a subtree of very many pages.
    each = stored(different.select("host", "page", F.explode("hashes").alias("hash")), "subtrees")
    counts = each.groupBy("host", "hash").count().filter(F.col("count") >= MIN_PAGES).select("host", "hash")
    common = each.join(stored(counts, "recurring"), ["host", "hash"])
    return common.groupBy("host", "page").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    Returns page_id, url, text (empty where there is none) and n_chars (code points), one row per row of `pages`. A null
    page is empty. Pages whose URL is null or has no host share the host of no name. Repeated rows count once as pages
    of their host and are each returned. Other columns are left out, so their names cannot clash."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        host.alias("host"),
    ).withColumn("page", F.xxhash64("html"))
    # Written first, so that Spark broadcasts the lists only if they are small and splits a page with very many copies.
    known = stored(templates(rows), "templates")
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, texts = 0, 0, []
            for i, (page, hashes) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3), strict=True)):
                texts.append(main_text(page.decode("utf-8", "replace"), set(hashes.as_py() or ())))
                size += len(page)
                if size >= _BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, len(texts)),
                            batch.column(1).slice(first, len(texts)),
                            pa.array(texts, pa.string()),
                            pa.array([len(t) for t in texts], pa.int64()),
                        ],
                        names=["page_id", "url", "text", "n_chars"],
                    )
                    first, size, texts = i + 1, 0, []

    joined = rows.join(known, ["host", "page"], "left")
    return joined.select("page_id", "url", "html", "hashes").mapInArrow(run, schema)

"""Main text of web pages by site template removal.

1. Each page is parsed into a tree as browsers do it roughly: void elements, raw text (script,
   style), comments, implied ends of paragraphs and list items, stray end tags.
2. Every block element's subtree is hashed (its tag and, in order, its texts and its children's
   hashes). Spark counts on how many pages of a host each hash stands; a subtree on at least
   ``MIN_PAGES`` pages and ``SHARE`` of the host's pages belongs to the site's template. So
   does a container (``div``, ``ul``, ...) of one section, language or rotation: one on at
   least ``MANY_PAGES`` pages that differ and ``MANY_SHARE`` of the host's pages. Copies of a
   page count once there, as all of a page's own text recurs with it.
   Every block is counted, whatever its markup says of it.
3. A page's text is that of its article (else its main element, else its body) without
   template subtrees and without what its markup itself calls something else: navigation,
   headers and footers of the page, asides, forms, notices, adverts, comments of readers.
   Paragraphs, headings, list items and the like within an article are the page's own words
   and stay, however often the site repeats them; so does a subtree with half of the article.
   Class, id and role say so as whole names (``comments``) or as parts of one that states no
   condition (``post-comments``, but not ``comments-open`` or ``no-sidebar``). They never speak
   of headings, of what holds the page's first article (else its main element), or, as parts of
   a name, of what holds most of the page's text.

Counts are partial sums, so one host with a third of all pages is no large group, and a host's
template has at most a page's elements / MANY_SHARE hashes. The join of pages with their host's
template is Spark's choice by size.

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed, empty blocks dropped, the rest joined by one ``\\n`` in page order.

Edge cases: null or empty html has an empty text; a page without a host (null url, or no
``://``) has no template; a page that is repeated is one page for the counts if page_id and
html are equal, and comes back as often as it is there; broken markup never raises, and an
unclosed comment, script or style ends with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.scratch import small_batches, written
from lathe.llm.url_filter import host_of

MIN_PAGES = 10
SHARE = 0.5
MANY_PAGES = 20
MANY_SHARE = 0.02

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Fixed values of HTML: elements without content, with raw text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Elements that end an open paragraph, and the elements that end an open one of their kind.
_ENDS_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody tfoot thead title tr".split()) | {"li", "dd", "dt"}
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: What is not the article: elements, and words of a class, id or role.
ASIDE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select input textarea object dialog menu canvas audio video".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus respond reply replies "
    "share sharing social related recommended widget toolbar pagination pager search login contentinfo complementary".split()
)
_HEADER = frozenset(["header"])
#: Parts of a name that state a condition of the page or its layout: ``has-sidebar``, ``comments-closed``.
_CONDITIONS = frozenset("no not has have with without is are open opened closed enabled disabled layout off hide hidden".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside an article: what can be template.
_CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center address menu".split())


class Node:
    """An element: its children are nodes and texts."""

    __slots__ = ("tag", "names", "parent", "children", "key", "size")

    def __init__(self, tag: str, names: frozenset, parent: Node | None) -> None:
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node | str] = []
        self.key = self.size = 0


def _class_names(attributes: str) -> frozenset:
    """The classes, id and role, each whole."""
    if "=" not in attributes:
        return frozenset()
    return frozenset(" ".join(a or b or c for _, a, b, c in _NAMES.findall(attributes)).lower().split())


def _says(names: frozenset, words: frozenset) -> tuple[bool, bool]:
    """Whether a name is one of ``words``, and whether one has such a part and states no condition."""
    whole, part = bool(names & words), False
    for name in names - words:
        parts = set(re.split(r"[^a-z0-9]+", name))
        part |= bool(parts & words and not parts & _CONDITIONS)
    return whole, part


def parse(html: str) -> list[Node]:
    """All elements in page order; the first is a root without a tag."""
    root = Node("", frozenset(), None)
    nodes, at, here, n = [root], 0, root, len(html)
    open_: dict[str, int] = {}

    def close(node: Node) -> Node:
        """Leave everything up to and with ``node``."""
        nonlocal here
        while True:
            open_[here.tag] -= 1
            left, here = here, here.parent
            if left is node:
                return here

    def nearest(tags: set[str], within: set[str]) -> Node | None:
        if not any(open_.get(t) for t in tags):
            return None
        node = here
        while node is not root and node.tag not in within:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            here.children.append(html[at:])
            break
        if lt > at:
            here.children.append(html[at:lt])
        after = html[lt + 1 : lt + 2]
        if after == "!" and html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if after and after in "!?":
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if after == "/" or after.isalpha() and after.isascii():  # a tag that never ends, or no tag at all
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                here.children.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m.group(2).lower()
        if m.group(1):
            if tag == "br":
                here.children.append(" ")
            elif open_.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag == "br" or tag == "wbr":
            here.children.append(" " if tag == "br" else "")
            continue
        if tag in _ENDS_P and open_.get("p"):
            p = nearest({"p"}, {"button", "table", "td", "th"})
            if p:
                close(p)
        if tag in _SIBLINGS:
            other = nearest(_SIBLINGS[tag], _SCOPES[tag])
            if other:
                close(other)
        if tag == "body" and open_.get("head"):
            close(nearest({"head"}, set()))
        node = Node(tag, _class_names(m.group(3)), here)
        here.children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
            stop = end.start() if end else n
            if tag in ("title", "textarea"):
                node.children.append(html[at:stop])
            close_at = html.find(">", stop)
            at = n if not end or close_at < 0 else close_at + 1
        elif tag not in VOID and not (m.group(3).endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span", "td", "th")):
            here = node
            open_[tag] = open_.get(tag, 0) + 1
    return nodes


def _inside(node: Node, tag: str) -> bool:
    while node is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _holders(nodes: list[Node]) -> set[int]:
    """The ids of the page's first article (else main element) outside of what its tags call
    something else, and of all that holds it: never the page's asides."""
    barred: set[int] = set()
    found: dict[str, Node] = {}
    for node in nodes:
        if node.tag in ASIDE_TAGS or node.parent is not None and id(node.parent) in barred:
            barred.add(id(node))
        elif node.tag in ("article", "main") and node.size:
            found.setdefault(node.tag, node)
    node, out = found.get("article") or found.get("main"), set()
    while node is not None:
        out.add(id(node))
        node = node.parent
    return out


def _aside(node: Node, article: bool, holders: set[int], size: int) -> bool:
    """Whether the markup says that this is not the article; ``size``: the page's text."""
    if node.tag in ASIDE_TAGS or node.tag == "header" and not article:
        return True
    if not node.names or node.tag in ("", "html", "body", "main") or node.tag in _HEADINGS or id(node) in holders:
        return False
    whole, part = _says(node.names, ASIDE_WORDS if article else ASIDE_WORDS | _HEADER)
    return whole or part and 2 * node.size <= size


def _clean(text: str) -> str:
    return " ".join((unescape(text) if "&" in text else text).split())


def _measure(nodes: list[Node]) -> None:
    """Hash and text size of each subtree, children first."""
    for node in reversed(nodes):
        digest, size = xxhash.xxh3_64(node.tag.encode()), 0
        for child in node.children:
            if isinstance(child, str):
                text = _clean(child)
                if text:
                    digest.update(b"\x01" + text.encode("utf-8", "surrogatepass"))
                    size += len(text)
            elif child.size:
                digest.update(b"\x02" + child.key.to_bytes(8, "little"))
                size += child.size
        node.key, node.size = digest.intdigest(), size


def _roots(nodes: list[Node]) -> tuple[list[Node], set[int]]:
    """The elements that hold the main text, and the ids of those that are out of it."""
    out: set[int] = set()
    holders = _holders(nodes)
    for node in nodes:
        parent = node.parent
        if parent is not None and id(parent) in out or _aside(node, _inside(parent, "article") if parent else False, holders, nodes[0].size):
            out.add(id(node))
    for tag in ("article", "main"):
        found = [x for x in nodes if x.tag == tag and id(x) not in out]
        if tag == "main" and not found:
            found = [x for x in nodes if any("main" in re.split(r"[^a-z0-9]+", c) for c in x.names) and id(x) not in out and x.tag in BLOCKS]
        found = [x for x in found if x.size and not (x.parent and _inside(x.parent, tag))]
        if found:
            return found, out
    return nodes[:1], out


def _candidates(html: str) -> tuple[set[int], set[int]]:
    """Hashes of the blocks that may be template, and of the containers among them."""
    nodes = parse(html)
    _measure(nodes)
    found = [x for x in nodes if x.size and x.tag in BLOCKS and x.tag not in ("html", "head", "body")]
    return {x.key for x in found}, {x.key for x in found if x.tag in _CONTAINERS}


def subtrees(html: str) -> set[int]:
    """Hashes of the blocks that may be template: all with text."""
    return _candidates(html)[0]


def main_text(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text; ``template``: hashes of subtrees to leave out."""
    if not html:
        return ""
    nodes = parse(html)
    _measure(nodes)
    roots, out = _roots(nodes)
    blocks: list[str] = []
    for root in roots:
        text: list[str] = []

        def end(text=text) -> None:
            block = _clean("".join(text))
            if block:
                blocks.append(block)
            text.clear()

        stack: list[tuple[Node, int]] = [(root, 0)]
        while stack:
            node, i = stack.pop()
            if i == len(node.children):
                if node.tag in BLOCKS:
                    end()
                continue
            stack.append((node, i + 1))
            child = node.children[i]
            if isinstance(child, str):
                text.append(child)
                continue
            if id(child) in out:
                if child.tag in BLOCKS:
                    end()
                continue
            whole = root.size if root.tag else 0
            if template and child.key in template and child.size and (not whole or child.tag in _CONTAINERS and 2 * child.size < whole):
                end()
                continue
            if child.tag in BLOCKS:
                end()
            elif child.tag in ("td", "th"):
                text.append(" ")
            stack.append((child, 0))
        end()
    return "\n".join(blocks)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of each page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                host, page, body, texts = (batch.column(i).slice(lo, 128) for i in range(4))
                both = [_candidates(t) for t in texts.to_pylist()]
                # containers first
                found = [[x - 2**63 for part in (boxes, every - boxes) for x in sorted(part)] for every, boxes in both]
                yield pa.record_batch([host, page, body, pa.array(found, pa.list_(pa.int64())), pa.array([len(b) for _, b in both], pa.int32())], names=["host", "page", "body", "keys", "boxes"])

    known = rows.where("host <> '' AND html IS NOT NULL AND html <> ''")
    once = F.xxhash64("page_id", "html").alias("page")
    body = F.xxhash64("html").alias("body")
    seen = known.select("host", once, body, "html").mapInArrow(hashes, "host string, page long, body long, keys array<long>, boxes int")
    # a repeated page counts once
    seen = written(seen.groupBy("host", "page").agg(*[F.first(c).alias(c) for c in ("body", "keys", "boxes")]), "subtrees")
    sizes = seen.groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    bodies = seen.groupBy("host", "body").agg(F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("boxes").alias("boxes"))
    counted = bodies.select("host", "copies", "boxes", F.posexplode("keys").alias("at", "key")).groupBy("host", "key")
    counted = counted.agg(F.sum("copies").alias("n"), F.count_if(F.col("at") < F.col("boxes")).alias("n_boxes")).where(F.col("n") >= min_pages)
    many = (F.col("n_boxes") >= many_pages) & (F.col("n_boxes") >= F.col("n_pages") * many_share)
    common = counted.join(sizes, "host").where((F.col("n") >= F.col("n_pages") * share) | many)
    template = written(common.groupBy("host").agg(F.collect_set("key").alias("template")), "template")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                page, address, source, keys = (batch.column(i).slice(lo, 128) for i in range(4))
                found = [main_text(t or "", {k + 2**63 for k in own or ()}) for t, own in zip(source.to_pylist(), keys.to_pylist(), strict=True)]
                yield pa.record_batch([page, address, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(template, "host", "left").select("page_id", "url", "html", "template")
    kind = dict(rows.dtypes)["page_id"]
    return joined.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages, without the template of their site.

A page is read once, into the pieces of text of its tree: each with the hashes of the block
subtrees (``div``, ``section``, lists, tables, paragraphs, headings and the like) that hold it.
A subtree is hashed by tag, text and children. One that stands on at least ``LEAST_PAGES`` pages
of its host with different surroundings is template, whatever its share of the pages. A template
container (``div``, ``section``, a list or table of nothing but links and the like) goes with all
it holds. Prose recurs, too (a license line, a one-word paragraph), so paragraphs, headings, lists
and tables that recur go only at the beginning or end of a page without an article, and in an
article never. The surroundings are the page's text less every subtree that recurs: copies of one
page, or one article under rotating notices, are one. Hosts with fewer pages have no template. What a page's tags and roles mark as no part of an article goes, too: navigation,
headers and footers of the site, sidebars, adverts, forms, scripts and styles. Names in classes
mark notices and reader comments, which differ from page to page; they hold for elements with
less than half of the page's text (comments: nine tenths), so no name costs a page its article.

The text is that of the ``article`` or ``main`` elements that are left, or of the body if none
is. Pieces are written and read back; as long as the templates of all hosts are few, which is
measured, they are sent to every task, and else each page meets its own by a shuffled join.

A null or blank page has the empty text, and an empty table none; very long pages are read
whole; a host is the part of the url between ``//`` and the next ``/``, ``?`` or ``#``, and pages
without one form one host; rows that repeat a page_id and html count as one page and are each
returned; columns other than page_id, url and html may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .hashing import BYTE_VALUES, mix, powers
from .storage import materialize

LEAST_PAGES = 5
#: Template subtrees of all hosts (two longs each) that are sent to every task, at most.
MOST_SENT = 100_000

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
CONTAINERS = frozenset("div section aside nav header footer ul ol dl table form fieldset figure details menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CUT = frozenset("nav footer aside form script style noscript template iframe button select option textarea input svg math canvas object embed audio video menu dialog head title".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: Names, as whole parts of a class or id, of what differs from page to page and so is no template.
CUT_NAMES = frozenset(
    """ad ads advert adverts advertisement sponsored promo banner cookie consent notice notices newsletter subscribe sidebar
    breadcrumb breadcrumbs pagination share sharing related recommended""".split()
)
COMMENT_NAMES = frozenset("comment comments disqus respond replies reply".split())
#: Shares of the page's text from which on an element is not cut by such names; readers may write more than the author.
MOST_NAMED, MOST_COMMENTS = 0.5, 0.9
#: Blocks that go as a whole where they recur; other blocks are prose, unless all their text is links.
BOXES = frozenset("div section aside nav header footer form fieldset details menu".split())
#: An open element of the first kind ends where one of the second begins.
BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
HASHED = CONTAINERS.union(BLOCKS)
ENDED_BY = {
    "p": frozenset(BLOCKS), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]),
}
#: Implied ends do not reach past these.
FENCES = frozenset("table ul ol dl div article section body main".split())

_token = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_attribute = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_name_parts = re.compile(r"[^a-z]+")
_host = re.compile(r"//([^/?#]*)")


class Node:
    __slots__ = ("tag", "children", "cut", "named")

    def __init__(self, tag: str, cut: bool, named: float):
        self.tag, self.cut, self.named, self.children = tag, cut, named, []


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, float]:
    """Whether tag, role or visibility cuts an element, and below which share of the text its names do."""
    if tag in CUT or tag == "header" and not in_article:
        return True, 0.0
    if not attributes or tag in ("html", "body", "main"):
        return False, 0.0
    named = 0.0
    for m in _attribute.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name in ("class", "id"):
            parts = _name_parts.split(value)
            named = max(named, 0.0 if CUT_NAMES.isdisjoint(parts) else MOST_NAMED, 0.0 if COMMENT_NAMES.isdisjoint(parts) else MOST_COMMENTS)
        elif name == "role" and value in CUT_ROLES or name == "aria-hidden" and value == "true":
            return True, 0.0
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes)), named


def parse(page: str) -> Node:
    """The tree of a page: children are nodes and strings, character references decoded."""
    root = Node("#root", False, 0.0)
    stack, at, articles = [root], 0, 0
    search, n = _token.search, len(page)
    while at < n:
        m = search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    articles -= sum(x.tag in ("article", "main") for x in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag in INLINE | {"p"}:
                    break
            continue
        for i in range(len(stack) - 1, 0, -1):
            open_tag = stack[i].tag
            if tag in ENDED_BY.get(open_tag, ()):
                del stack[i:]
                break
            if open_tag in FENCES or open_tag not in ENDED_BY and open_tag not in INLINE:
                break
        node = Node(tag, *_marks(tag, m[3], articles > 0))
        stack[-1].children.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW and tag not in CONTAINERS and tag not in INLINE and tag != "p":
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        articles += tag in ("article", "main")
        stack.append(node)
    return root


def _hash(text: str) -> int:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    total = (BYTE_VALUES[raw] * powers(0x9E3779B97F4A7C15, len(raw))).sum(dtype=np.uint64) + np.uint64(len(raw))
    return int(mix(np.array([total], np.uint64))[0].view(np.int64))


def _in_order(root: Node) -> list[Node]:
    """Parents before children, without recursion: pages may nest deeply."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return order


def cut_names(order: list[Node]) -> None:
    """Cut what its names mark, unless it holds too much of the page's text."""
    if not any(node.named for node in order):
        return
    length: dict[int, int] = {}
    for node in reversed(order):
        length[id(node)] = 0 if node.cut else sum(length[id(c)] if isinstance(c, Node) else len(c.strip()) for c in node.children)
    for node in order:
        node.cut |= length[id(node)] < node.named * length[id(order[0])]


def subtree_hashes(order: list[Node]) -> tuple[dict[int, int], dict[int, int], set[int]]:
    """By the id of its node: the hash of every block's subtree that has text, and of the shown
    text that a block (or the root) has outside of its inner blocks; and the nodes whose text, if
    any, is in links."""
    root = order[0]
    found: dict[int, int] = {}
    own: dict[int, int] = {}
    linked: set[int] = set()
    content: dict[int, str] = {}
    outside: dict[int, str] = {}
    for node in reversed(order):
        parts = [content.pop(id(c)) if isinstance(c, Node) else " ".join(c.split()) for c in node.children]
        inner = "\x1f".join(p for p in parts if p)
        rest = [p if isinstance(c, str) else outside.pop(id(c)) for c, p in zip(node.children, parts, strict=True)]
        text = "" if node.cut else "\x1f".join(p for p in rest if p)
        if node.tag == "a" or all(id(c) in linked if isinstance(c, Node) else not c.strip() for c in node.children):
            linked.add(id(node))
        if node.tag in HASHED and inner or node is root:
            h = _hash(f"{node.tag}\x1e{inner}") if node is not root else 0
            if node is not root:
                found[id(node)] = h
            if text:
                own[id(node)] = _hash(text)
            inner, text = f"#{h}", ""
        content[id(node)] = f"<{node.tag}>{inner}" if inner else ""
        outside[id(node)] = text
    return found, own, linked


def read(page: str) -> tuple[list[tuple[str, tuple[int, ...], tuple[int, ...], bool]], dict[int, int], int]:
    """What a page holds: its pieces of text in order, each with the containers and the blocks of
    prose that hold it and whether it is in an ``article`` or ``main``; its distinct shown subtrees
    with the hash of the text each has outside of inner ones; and the xor of all those texts."""
    root = parse(page)
    order = _in_order(root)
    cut_names(order)
    hashes, own, linked = subtree_hashes(order)
    out: list[tuple[str, tuple[int, ...], tuple[int, ...], bool]] = []
    parts: dict[int, int] = {}
    inner_parts: dict[int, int] = {}  # those in an article
    prose_total, articles = 0, False  # texts of an article's prose
    held: list[str] = []
    none: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    # A node is met with the subtrees and the part of the page it lies in; None ends it.
    stack: list[tuple[Node | str | None, tuple[tuple[int, ...], tuple[int, ...]], bool]] = [(root, none, False)]

    def close(chain: tuple[tuple[int, ...], tuple[int, ...]], main: bool) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, *chain, main))

    while stack:
        node, chain, main = stack.pop()
        if isinstance(node, str):
            held.append(node)
        elif node is None:
            close(chain, main)
        elif node.cut:
            held.append(" ")
        else:
            inside = main or node.tag in ("article", "main")
            block = hashes.get(id(node))
            if block is not None or inside != main:
                close(chain, main)
                inner = chain
                if block is not None:
                    box = node.tag in BOXES or id(node) in linked
                    if box:
                        inner = ((*chain[0], block), chain[1])
                    elif not inside:
                        inner = (chain[0], (*chain[1], block))
                    if box or not inside:
                        (inner_parts if inside else parts)[block] = own.get(id(node), 0)
                    else:
                        prose_total ^= own.get(id(node), 0)
                        articles = True
                stack.append((None, inner, inside))
                stack.extend((c, inner, inside) for c in reversed(node.children))
            else:
                space = [] if node.tag in INLINE else [(" ", chain, main)]
                stack += space
                stack.extend((c, chain, main) for c in reversed(node.children))
                stack += space
    close(none, False)
    # Beside an article, other text is no part of the surroundings.
    articles |= bool(inner_parts)
    total = prose_total if articles else own.get(id(root), 0)
    parts = dict.fromkeys(parts, 0) | inner_parts if articles else parts
    for x in parts.values():
        total ^= x
    return out, parts, total


def host_of(url: str | None) -> str:
    m = _host.search(url or "")
    return m[1].lower() if m else ""


def page_key() -> Column:
    return F.xxhash64("page_id", "html")


PARSED = "page_id long, url string, host string, page long, total long, parts array<struct<hash: long, own: long>>, texts array<struct<text: string, within: array<long>, prose: array<long>, main: boolean>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, host, page (its key), total, parts and texts, as ``read`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            hosts, totals, n_parts, hashes, own, n_texts, texts, mains = [], [], [0], [], [], [0], [], []
            chains: tuple[list[int], list[int]] = [], []
            ends: tuple[list[int], list[int]] = [0], [0]
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found, parts, total = read(page or "")
                hosts.append(host_of(url))
                totals.append(total)
                hashes += parts.keys()
                own += parts.values()
                n_parts.append(len(hashes))
                for text, within, prose, main in found:
                    texts.append(text)
                    mains.append(main)
                    for held, end, chain in zip(chains, ends, (within, prose), strict=True):
                        held += chain
                        end.append(len(held))
                n_texts.append(len(texts))
            longs = lambda x: pa.array(x, pa.int64())
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            within, prose = (lists(end, longs(held)) for end, held in zip(ends, chains, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(hosts, pa.string()), batch.column(3), longs(totals),
                    lists(n_parts, pa.StructArray.from_arrays([longs(hashes), longs(own)], ["hash", "own"])),
                    lists(n_texts, pa.StructArray.from_arrays([pa.array(texts, pa.string()), within, prose, pa.array(mains, pa.bool_())], ["text", "within", "prose", "main"])),
                ],
                names=["page_id", "url", "host", "page", "total", "parts", "texts"],
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), page_key().alias("page"))
    return source.mapInArrow(run, PARSED)


def templates(rows: DataFrame, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """The template subtrees of each host, (host, hash), and where they stand, (host, page, hash);
    ``rows`` is what ``parsed`` gives."""
    every = rows.select("host", "page", "total", F.explode("parts").alias("x")).select("host", "page", "total", "x.hash", "x.own")
    # Repeated rows count here, not below: this only narrows what is looked at.
    often = every.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("host", "hash")
    hits = materialize(every.join(often, ["host", "hash"], "left_semi").distinct())
    around = hits.groupBy("host", "page").agg(F.first("total").bitwiseXOR(F.bit_xor("own")).alias("around"))
    template = materialize(
        hits.join(around, ["host", "page"]).groupBy("host", "hash").agg(F.count_distinct("around").alias("n"))
        .where(F.col("n") >= least_pages).select("host", "hash")
    )
    return template, hits.select("host", "page", "hash")


def text_of(texts: Column, template: Column) -> Column:
    """The pieces outside of template containers: those in an article if there are any, else all
    from the first to the last that is no template prose."""

    def bound(f):  # once for the value of an expression, not wherever it is named
        return lambda x: F.transform(F.array(x), f)[0]

    left = F.when(template.isNull(), texts).otherwise(F.filter(texts, lambda x: ~F.arrays_overlap(x["within"], template)))

    def trimmed(x: Column) -> Column:
        own = F.transform(x, lambda y: ~F.coalesce(F.arrays_overlap(y["prose"], template), F.lit(False)))
        ends = bound(lambda o: F.struct(F.array_position(o, True).alias("first"), F.array_position(F.reverse(o), True).alias("last")))(own)
        inner = lambda e: F.when(e["first"] == 0, F.slice(x, 1, 0)).otherwise(F.slice(x, e["first"].cast("int"), (F.size(x) - e["first"] - e["last"] + 2).cast("int")))
        return bound(inner)(ends)

    kept = bound(lambda x: F.when(F.exists(x, lambda y: y["main"]), F.filter(x, lambda y: y["main"])).when(template.isNull(), x).otherwise(trimmed(x)))(left)
    return F.array_join(F.transform(kept, lambda x: x["text"]), " ")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = materialize(parsed(pages))
    template, hits = templates(rows, least_pages)
    texts = rows.select("page_id", "url", "host", "page", "texts")
    if template.count() <= MOST_SENT:
        own = template.groupBy(F.col("host").alias("of_host")).agg(F.collect_list("hash").alias("template"))
        joined = texts.join(F.broadcast(own), F.col("host") == F.col("of_host"), "left")
    else:
        own = hits.join(template, ["host", "hash"], "left_semi").groupBy(F.col("host").alias("of_host"), F.col("page").alias("of_page")).agg(F.collect_list("hash").alias("template"))
        joined = texts.join(own.hint("merge"), (F.col("page") == F.col("of_page")) & (F.col("host") == F.col("of_host")), "left")
    return joined.select("page_id", "url", text_of(F.col("texts"), F.col("template")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))

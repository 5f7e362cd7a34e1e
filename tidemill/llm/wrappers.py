"""Main text of web pages: wrappers of hosts, inferred as union-free regular expressions over block tags and texts."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import groups_of
from tidemill.plans.session import cut_lineage

# Hosts whose wrappers a task holds, wrappers that meet in one merge, and nodes that a wrapper may have.
HELD = 1000
FAN_IN = 16
NODES = 2000
# Wrappers of all hosts are broadcast up to this many bytes, else joined with salted pages.
BROADCAST_BYTES = 32 << 20
SALT = 32
# The main part holds at least this share of the text around it.
SHARE = 0.5
# Elements nested deeper than this are read as if they ended at once.
DEPTH = 200
# A text that all of at least so many pages of a host have alike belongs to the template.
TEMPLATE_PAGES = 5

# Element names and the words of class, id and role that name furniture.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    *("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark"),
    *("nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"),
}
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "address", "summary"}
FURNITURE = {"head", "nav", "footer", "aside", "form", "header", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas", "map"}
FURNITURE_WORDS = {
    *("ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent"),
    *("notice", "notices", "notification", "alert", "sidebar", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "footer", "masthead"),
    *("comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "share", "sharing", "social", "related", "recommended"),
    *("newsletter", "subscribe", "subscription", "login", "signup", "search", "popup", "modal", "overlay", "widget", "toolbar", "pagination", "pager"),
    *("contentinfo", "complementary"),
}
# Words of a class name that tell how a page is laid out, not what the element is ("with-sidebar").
LAYOUT_WORDS = {"no", "not", "has", "with", "without", "hide", "show", "is"}
# Elements that end where one of the others begins, looked for up to the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(>|\Z)|</[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
WORD = re.compile(r"[a-z]+")


class Node:
    """An element, or with the label "#text" a text between elements.

    In a wrapper a node may be optional or repeated, stands for ``pages`` pages, and a text that isn't
    alike on all of them is a slot (None). ``mass`` counts the characters outside links.
    """

    __slots__ = ("kids", "label", "many", "mass", "optional", "pages", "text")

    def __init__(self, label: str, kids: list | None = None, text: str | None = None, mass: int = 0, pages: int = 1, optional: bool = False, many: bool = False):
        self.label, self.kids, self.text, self.mass, self.pages, self.optional, self.many = label, kids or [], text, mass, pages, optional, many

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]

    def furniture(self, inside: bool = False) -> bool:
        """Whether its name says that it isn't main text; ``inside`` the main part a header holds its title."""
        tag, _, names = self.label.partition(".")
        if tag in ("article", "main"):
            return False
        return (tag in FURNITURE and not (inside and tag == "header")) or not FURNITURE_WORDS.isdisjoint(names.split("."))

    def dump(self) -> list:
        return [self.label, [k.dump() for k in self.kids], self.text, self.mass, self.pages, int(self.optional), int(self.many)]

    @staticmethod
    def load(x: list) -> Node:
        return Node(x[0], [Node.load(k) for k in x[1]], x[2], x[3], x[4], bool(x[5]), bool(x[6]))


def label_of(tag: str, attributes: str) -> str:
    """Name of an element and, behind dots, the words of its class, id and role."""
    words = []
    for m in ATTRIBUTE.finditer(attributes) if "=" in attributes or "hidden" in attributes else ():
        name = (m[1] or m[3]).lower()
        if name in ("class", "id", "role"):
            parts = [WORD.findall(part) for part in m[2].lower().split()]
            words += [w for part in parts if LAYOUT_WORDS.isdisjoint(part) for w in part]
        elif name == "hidden" or (name == "style" and "display:none" in m[2].replace(" ", "").lower()):
            words.append("modal")
    return ".".join([tag, *dict.fromkeys(words)])


def parse(page: str) -> Node:
    """The page as a tree of block elements and texts; inline tags vanish, as do comments, scripts and styles.

    Ends that are left out are supplied: a block ends a paragraph, an item the item before it. An end
    without a beginning is ignored.
    """
    root = Node("html")
    stack, pieces = [root], []
    linked, linked_chars, deeper = False, 0, 0

    def flush() -> None:
        nonlocal linked_chars
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                if stack[-1].label == "head":
                    stack.pop()
                stack[-1].kids.append(Node("#text", text=text, mass=max(0, len(text) - linked_chars)))
            pieces.clear()
        linked_chars = 0

    def say(text: str) -> None:
        nonlocal linked_chars
        pieces.append(text)
        if linked:
            linked_chars += len(text)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = size if close is None else close.start()
            continue
        if tag in INLINE:
            if tag == "a":
                linked = not m[1]
            elif tag == "br":
                say(" ")
            continue
        if tag in RAW or tag in ("html", "body"):
            if tag == "body" and stack[-1].label == "head":
                flush()
                stack.pop()
            continue
        flush()
        if m[1]:
            if deeper:
                deeper -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            linked = False
            continue
        if tag in VOID:
            continue
        if stack[-1].label == "head":
            stack.pop()
        if stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()
        ends, bounds = ENDS.get(tag, ((), ()))
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        node = Node(label_of(tag, m[3]))
        if len(stack) > DEPTH:
            deeper += 1
            continue
        stack[-1].kids.append(node)
        stack.append(node)
    flush()
    return root


def merge(a: Node, b: Node) -> Node:
    """The smallest wrapper here that covers both: texts that differ become slots, kids are aligned."""
    text = a.text if a.text == b.text else None
    return Node(a.label, merge_kids(a.kids, b.kids, a.pages, b.pages), text, a.mass + b.mass, a.pages + b.pages, a.optional or b.optional, a.many or b.many)


def merge_kids(a: list[Node], b: list[Node], a_pages: int, b_pages: int) -> list[Node]:
    """Align two sequences; what only one of them has becomes optional."""
    names = [x.label for x in a], [x.label for x in b]
    if names[0] == names[1]:
        return [merge(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for block in SequenceMatcher(None, *names, autojunk=False).get_matching_blocks():
        for x in [*a[i : block.a], *b[j : block.b]]:
            x.optional = True
            out.append(x)
        out += [merge(x, y) for x, y in zip(a[block.a : block.a + block.size], b[block.b : block.b + block.size])]
        i, j = block.a + block.size, block.b + block.size
    return fold(out)


def as_one(a: Node, b: Node) -> Node:
    """Two neighbours of one page as one repeated node."""
    text = a.text if a.text == b.text else None
    pages = max(a.pages, b.pages)
    kids = merge_kids(a.kids, b.kids, a.pages, b.pages)
    return Node(a.label, kids, text, a.mass + b.mass, pages, a.optional and b.optional, True)


def fold(kids: list[Node], longest: int = 4) -> list[Node]:
    """Repeated groups of up to ``longest`` neighbours, folded into their first occurrence."""
    for size in range(1, longest + 1):
        out: list[Node] = []
        for node in kids:
            out.append(node)
            while len(out) >= 2 * size and [x.label for x in out[-size:]] == [x.label for x in out[-2 * size : -size]]:
                again = out[-size:]
                del out[-size:]
                out[-size:] = [as_one(x, y) for x, y in zip(out[-size:], again)]
        kids = out
    return kids


def folded(node: Node) -> Node:
    """A page's tree with its repeated groups folded: the wrapper of this page alone."""
    return Node(node.label, fold([folded(k) for k in node.kids]), node.text, node.mass, node.pages, node.optional, node.many)


def size_of(node: Node) -> int:
    return 1 + sum(map(size_of, node.kids))


def pruned(node: Node, nodes: int = NODES) -> Node:
    """Without the optional parts that fewest pages have, until few enough nodes are left.

    Only the description of the host gets shorter; pages are read whole whatever their wrapper covers.
    """
    least = 2
    while size_of(node) > nodes and least <= 2 * node.pages:

        def cut(x: Node, least=least) -> None:
            x.kids = [k for k in x.kids if not k.optional or k.pages >= least]
            for k in x.kids:
                cut(k)

        cut(node)
        least *= 2
    return node


def weigh(node: Node, inside: bool = False) -> int:
    """Characters of a wrapper's text outside links and furniture."""
    if node.furniture(inside):
        return 0
    return node.mass + sum(weigh(k, inside) for k in node.kids)


def main_path(wrapper: Node) -> list[str]:
    """Labels from the root's kids down to the smallest part that still has most of the text around it.

    An article is taken as a whole.
    """
    path, node = [], wrapper
    while True:
        total = weigh(node)
        by: dict[str, list[Node]] = {}
        for k in node.kids:
            # repeated parts are items of the main part, unless they are articles
            if k.tag not in LEAF and k.label != "#text" and not k.furniture() and (not k.many or k.tag in ("article", "main")):
                by.setdefault(k.label, []).append(k)
        weights = {label: sum(map(weigh, nodes)) for label, nodes in by.items()}
        best = max(weights, key=lambda x: (weights[x], x), default=None)
        if best is None or not total or weights[best] < SHARE * total or node.tag == "article":
            return path
        path.append(best)
        nodes = by[best]
        node = nodes[0] if len(nodes) == 1 else Node(best, [k for n in nodes for k in n.kids], None, sum(n.mass for n in nodes), max(n.pages for n in nodes))


def mains(page: Node, path: list[str]) -> list[Node]:
    level = [page]
    for label in path:
        level = [k for node in level for k in node.kids if k.label == label]
    return level


def template_texts(wrapper: Node, path: list[str]) -> set[str]:
    """Texts of the main part that every page of the host has alike, beside slots that hold most of it."""
    found: set[str] = set()
    slots = fixed = 0

    def walk(node: Node, always: bool) -> None:
        nonlocal slots, fixed
        always = always and not node.optional and node.pages == wrapper.pages
        if node.label == "#text":
            if node.text is not None and always and not node.many:
                found.add(node.text)
                fixed += node.mass
            else:
                slots += node.mass
        for k in node.kids:
            walk(k, always)

    for part in mains(wrapper, path):
        walk(part, True)
    return found if wrapper.pages >= TEMPLATE_PAGES and slots > fixed else set()


def blocks(node: Node, template: set[str]) -> Iterator[str]:
    for k in node.kids:
        if k.label == "#text":
            if k.text not in template:
                yield k.text
        elif not k.furniture(inside=True):
            yield from blocks(k, template)


class Reader:
    """Extracts the main text of one host's pages."""

    def __init__(self, wrapper: Node | None):
        self.path = main_path(wrapper) if wrapper else []
        self.template = template_texts(wrapper, self.path) if wrapper else set()

    def __call__(self, page: Node) -> list[str]:
        parts = mains(page, self.path)
        if not any(weigh(p, True) for p in parts):
            # a page that its host's wrapper doesn't fit is read by its own
            parts = mains(page, main_path(folded(page)))
        return [b for p in parts for b in blocks(p, self.template)]


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host and task, or some where a task meets many hosts."""
    held: dict[str, Node] = {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            new = folded(parse(page or ""))
            held[host] = pruned(merge(held[host], new)) if host in held else new
            if len(held) > HELD:
                yield _wrapper_rows(held)
                held = {}
    if held:
        yield _wrapper_rows(held)


def _wrapper_rows(held: dict[str, Node]) -> pa.RecordBatch:
    text = [json.dumps(w.dump(), ensure_ascii=False, separators=(",", ":")) for w in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(text, pa.string())], names=["host", "wrapper"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups_of(batches, ["host", "bucket"]):
        whole = None
        for text in group.column("wrapper").to_pylist():
            new = Node.load(json.loads(text))
            whole = new if whole is None else pruned(merge(whole, new))
        yield _wrapper_rows({group.column("host")[0].as_py(): whole})


def host_of(url: Column) -> Column:
    """Host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One wrapper per host: (host, wrapper), the latter as JSON.

    Each task aligns its pages of a host one after the other; only the wrappers move, and those of one host are merged
    in groups of bounded size until one is left.
    """
    level = cut_lineage(pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("html")).mapInArrow(_infer, "host string, wrapper string"))
    while True:
        counts = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return level
        buckets = F.ceil(F.col("n") / F.lit(FAN_IN)).cast("long")
        dealt = level.join(counts, "host").withColumn("bucket", F.pmod(F.xxhash64("wrapper"), buckets))
        merged = dealt.select("host", "bucket", "wrapper").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "wrapper")
        level = cut_lineage(merged.mapInArrow(_unite, "host string, wrapper string"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    readers: dict[str, Reader] = {}
    for batch in batches:
        rest = batch.schema.names[:-3]
        out = []
        for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in batch.schema.names[-3:])):
            if host not in readers:
                if len(readers) > HELD:
                    readers.clear()
                readers[host] = Reader(Node.load(json.loads(wrapper)) if wrapper else None)
            out.append("\n\n".join(readers[host](parse(page or ""))))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, pa.string())], names=[*rest, "text"])


def extract_text(pages: DataFrame, keep: Iterable[str] = ("page_id", "url"), url: str = "url", page: str = "html") -> DataFrame:
    """The main text of every page: the columns ``keep``, and ``text`` with blocks joined by two line breaks.

    Pages of one host are made by one template. Their streams of block tags and texts are aligned into a wrapper:
    differing texts become slots, neighbours that repeat become repeated groups, parts that some pages lack
    become optional. In the wrapper, the smallest part that holds most of the host's text outside links and furniture
    (navigation, forms, notices, adverts, comments, by element and class names) is the main part; texts in it
    that all pages have alike, if there are at least five, belong to the template. Each page then gives the blocks of its main part,
    in order, less furniture and template. A page that doesn't fit is read by its own wrapper.

    Wrappers are broadcast if they are small (their bytes are counted), else joined with pages dealt out by a salt.
    Null, empty or broken pages give what they have, an empty text at least; a null or odd address belongs to the host "".
    Repeated rows are kept. An empty table gives no rows. A page has to fit into a task. Other columns are dropped.
    """
    wrappers = infer_wrappers(pages, url, page)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    kept = list(keep)
    names = [f"_{k}" for k in range(len(kept))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("html"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(wrappers), "host", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("html", *names), F.lit(SALT)))
        joined = salted.join(wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["host", "salt"], "left")
    schema = ", ".join([*[f"{n} {pages.schema[c].dataType.simpleString()}" for c, n in zip(kept, names)], "text string"])
    found = joined.select(*names, "host", "html", "wrapper").mapInArrow(_extract, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], "text")

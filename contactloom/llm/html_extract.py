"""Main text of web pages by site template removal.

A page is parsed leniently, in one pass, into a tree.  All its block subtrees are hashed
from the leaves up, by their tags and texts, and Spark counts for every host on how many
pages *of different content* a subtree occurs.  What recurs is the host's template and is
deleted.  Two rules say what recurs, by where the subtree stands:

* Beside the page's content: on ``MIN_PAGES`` pages whose contents differ.
* Inside it, where pages can share passages: besides, on ``SHARE`` of the host's different
  pages, and on this host more than on all others together.  Pages are told apart by
  their longest text block outside the subtree, so near copies of an article count once and stay
  whole; a passage that travels between hosts is none's template.

A page's content, for this purpose, is its articles, else its main element, else the
smallest element that holds over half of its text outside links.  An element that holds
the content is never template.

Tags decide only what counts can't, such as a menu that is seen once: of what is left,
navigation, headers, footers, asides, forms and the like go, lists of links outside
articles, and elements whose role, or whose class or id as a whole, names such a part
(``cookie-notice``, but not ``side-effects``).  Then the articles are taken if the page has
any, in page order, else the main element, else the body.

Text blocks are joined in page order by one line feed; white space inside a block
becomes one space; character references are decoded; ``br`` is white space.

The (host, subtree) template keys go to the extraction as a broadcast while there are
at most ``MAX_BROADCAST`` of them (8 bytes each); beyond that they are joined to the
pages, which are known by 128 bits of their host and html.  Both ways give the same texts.

Defined cases: null html is empty and gives an empty text; a page without a host
belongs to the empty host; truncated markup is read as far as it goes, a quote that is
never closed ends with its tag; repeated rows are extracted alike; extra columns are
carried and replaced where an output column has their name.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import cut, without
from contactloom.llm.url_filter import host_of
from contactloom.shipping import ship

MIN_PAGES = 3
#: Share of a host's different pages on which a subtree inside the content is template.
SHARE = 0.5
MAX_BROADCAST = 500_000
SALTS = 16

# HTML elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg iframe object canvas textarea select title".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr br img".split()
)
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption dt dd td th tr table tbody ol".split())
MAIN = {"article", "main"}
DROPPED = set("head nav header footer aside form menu dialog button fieldset".split()) | RAW
# Roles, and words of which a whole class or id name must consist (one of the first kind at least).
ROLES = set("navigation banner contentinfo complementary search dialog alert".split())
PART = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
NEUTRAL = set("area articles bar block bottom box buttons container form inner left links list main outer page panel posts right section site top wrap wrapper".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_CLOSES_P = TEXT_BLOCKS | MAIN | DROPPED | {"div", "section", "ul", "dl", "hr", "address", "details", "figure"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOP = {"ul", "ol", "table", "dl", "div", "section", "article", "body", "select"}


def _names_a_part(name: str) -> bool:
    words = [w for w in re.split(r"[-_\d]+", name.lower()) if w]
    return any(w in PART for w in words) and all(w in PART or w in NEUTRAL for w in words)


class Node:
    __slots__ = ("tag", "attrs", "children", "noise", "hash", "size", "plain", "linked")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.noise = tag in DROPPED or bool(attrs) and self._noisy(attrs)

    def _noisy(self, attrs: str) -> bool:
        if self.tag in MAIN | {"body", "html"}:
            return "comment" in attrs.lower() and any(_names_a_part(v) for n, v in self._values(attrs) if n in ("class", "id"))
        return any(
            n == "hidden" or (n == "role" and v.lower() in ROLES) or (n in ("class", "id") and any(map(_names_a_part, v.split())))
            for n, v in self._values(attrs)
        )

    @staticmethod
    def _values(attrs: str):
        return ((n.lower(), v.strip("\"'")) for n, v in _ATTR.findall(attrs))


class _Open:
    """The open elements, with the places of every kind, so that each tag is handled in constant time."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.fixed, self.stops = [root], {}, [0], [0], [0]

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(k)
        for kind, places in ((node.tag not in INLINE, self.blocks), (node.tag in MAIN or node.tag == "body", self.fixed), (node.tag in _STOP, self.stops)):
            if kind:
                places.append(k)

    def close(self, k: int) -> None:
        """Close the element at place ``k`` and all inside it."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()
        for places in (self.blocks, self.fixed, self.stops):
            while places and places[-1] >= k:
                places.pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def parse(html: str) -> list[Node]:
    """All elements of a page in page order, the root first.  Every character is looked at a bounded number of times."""
    root = Node("html", "")
    nodes, open_ = [root], _Open(root)
    n, at = len(html), 0
    last_quote = {q: html.rfind(q) for q in "\"'"}
    quotes = True  # until a tag was read to the end of the page in vain
    while at < n:
        here = html.find("<", at)
        if here < 0:
            here = n
        if here > at:
            open_.stack[-1].children.append(html[at:here])
        if here == n:
            break
        if html.startswith("<!--", here):
            end = html.find("-->", here + 4)
            at = n if end < 0 else end + 3
            continue
        closing = html.startswith("/", here + 1)
        named = _NAME.match(html, here + 1 + closing)
        if named is None:
            if html[here + 1 : here + 2] in ("!", "?", "/"):
                end = html.find(">", here)
                at = n if end < 0 else end + 1
            else:  # a plain character
                open_.stack[-1].children.append("<")
                at = here + 1
            continue
        end = named.end()
        while quotes:
            m = _IN_TAG.search(html, end)
            if m is None:
                quotes = False
            elif m[1] is None:
                end = m.start()
                break
            elif m.end() > last_quote[m[1]]:
                end = html.find(">", m.end())
                break
            else:
                end = html.index(m[1], m.end()) + 1
        if not quotes:
            end = html.find(">", named.end())
        if end < 0:  # the page ends inside a tag
            break
        attrs = html[named.end() : end]
        at = end + 1
        tag = named[0].lower()
        if closing:
            k = open_.last(tag)
            if k > 0 and not (tag in INLINE or tag == "p") or k > open_.fixed[-1]:
                open_.close(k)
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P and open_.last("p") > 0 and open_.last("p") == open_.blocks[-1]:
            open_.close(open_.last("p"))
        if tag in _SAME:
            k = open_.last(*_SAME[tag])
            if k > open_.stops[-1]:
                first = min(p for t in _SAME[tag] for p in open_.at.get(t, ())[-1:] if p > open_.stops[-1])
                open_.close(first)
        node = Node(tag, attrs.strip())
        open_.stack[-1].children.append(node)
        nodes.append(node)
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        open_.push(node)
    return nodes


def measure(nodes: list[Node]) -> None:
    """Hashes and text sizes of all subtrees, children before their parents."""
    for node in reversed(nodes):
        parts, size, plain, linked = [node.tag.encode()], 0, 0, 0
        if node.tag not in RAW:
            for x in node.children:
                if isinstance(x, str):
                    if text := " ".join(x.split()):
                        parts.append(text.encode("utf-8", "replace"))
                        size, plain = size + len(text), plain + len(text)
                elif x.size:
                    parts.append(x.hash)
                    size, linked = size + x.size, linked + x.linked
                    plain += 0 if x.noise else x.plain
        node.size, node.plain, node.linked = size, 0 if node.tag == "a" else plain, size if node.tag == "a" else linked
        node.hash = xxhash.xxh64_digest(b"\x00".join(parts))


def _outermost(nodes: list[Node], tag: str) -> list[Node]:
    """Elements of a kind that stand in no other one and in no part that tags drop."""
    found, todo = [], [nodes[0]]
    while todo:
        x = todo.pop()
        if x.tag == tag and not x.noise:
            found.append(x)
        elif not x.noise or x is nodes[0]:
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return found


def content_of(nodes: list[Node]) -> list[Node]:
    """The elements that hold the page's content: see above."""
    found = _outermost(nodes, "article") or _outermost(nodes, "main")
    if found:
        return found
    node = nodes[0]
    while True:
        inner = [c for c in node.children if isinstance(c, Node) and c.plain * 2 > nodes[0].plain and not (c.noise or c.tag in INLINE or c.tag in TEXT_BLOCKS)]
        if not inner:
            return [node]
        node = inner[0]


class Page:
    """A parsed page: its content, its candidates for template, and what tells it apart from others."""

    def __init__(self, html: str | None):
        self.nodes = parse(html or "")
        measure(self.nodes)
        self.content = content_of(self.nodes)
        #: places of elements inside the content, and its text blocks by the place of their element
        self.span: dict[int, tuple[int, int]] = {}
        self.holds = {id(self.nodes[0])}
        said: dict[int, list[str]] = {}
        path: list[Node] = []
        heads, at = {id(x) for x in self.content}, 0
        todo: list = [(self.nodes[0], False, None)]
        while todo:
            x, inside, block = todo.pop()
            if x is None:
                done = path.pop()
                if id(done) in self.span:
                    self.span[id(done)] = (self.span[id(done)][0], at)
            elif isinstance(x, str):
                if inside:
                    said.setdefault(block, []).append(x)
            else:
                if id(x) in heads:
                    self.holds.update(map(id, path), [id(x)])
                inside = (inside or id(x) in heads) and not (x.noise and id(x) not in heads)
                path.append(x)
                if inside and x.tag not in INLINE:
                    block, at = at, at + 1
                    self.span[id(x)] = (block, at)
                todo.append((None, inside, None))
                if x.tag not in RAW:
                    todo.extend((c, inside, block) for c in reversed(x.children))
        texts = {k: " ".join("".join(t).split()) for k, t in said.items()}
        self.said = [t for _, t in sorted(texts.items()) if t]
        # The longest text block before and from every place on, so that any element's outside is found at once.
        order = sorted((k for k, t in texts.items() if t), key=lambda k: (-len(texts[k]), texts[k]))
        rank = np.full(at + 1, len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self._before = np.r_[len(order), np.minimum.accumulate(rank)]
        self._from = np.minimum.accumulate(rank[::-1])[::-1]
        self._texts = [texts[k] for k in order]

    def signature(self) -> int:
        """Hash of the whole content."""
        return xxhash.xxh64_intdigest("\n".join(self.said).encode("utf-8", "replace"))

    def outside(self, node: Node | None = None) -> int:
        """Hash of the content's longest text block outside an element; 0 if there is none."""
        first, end = self.span.get(id(node), (0, 0))
        best = int(min(self._before[first], self._from[end]))
        return xxhash.xxh64_intdigest(self._texts[best].encode("utf-8", "replace")) if best < len(self._texts) else 0

    def candidates(self):
        """(element, hash, whether it stands inside the content) of subtrees that can be template."""
        for x in self.nodes:
            if x.size and x.tag not in INLINE and x.tag not in RAW and id(x) not in self.holds:
                yield x, int.from_bytes(x.hash, "big"), id(x) in self.span

    def blocks(self, template: set | frozenset = frozenset(), tags: bool = True) -> list[str]:
        """Text blocks without template; ``tags=False`` shows what the counts alone leave of the body."""
        gone = {id(x) for x, *key in self.candidates() if tuple(key) in template} if template else set()
        heads = self.content if tags and self.content[0].tag in MAIN else [self.nodes[0]]
        out: list[str] = []
        current: list[str] = []

        def flush() -> None:
            text = " ".join(unescape("".join(current)).split())
            current.clear()
            if text:
                out.append(text)

        for head in heads:
            todo: list = [head]
            while todo:
                x = todo.pop()
                if x is None:
                    flush()
                elif isinstance(x, str):
                    current.append(x)
                elif x.tag == "br":
                    current.append(" ")
                elif id(x) in gone or x.tag in RAW or tags and (x.noise or self._menu(x)) and x is not head:
                    if x.tag not in INLINE:
                        flush()
                elif x.tag in INLINE:
                    todo.extend(reversed(x.children))
                else:
                    flush()
                    todo.append(None)
                    todo.extend(reversed(x.children))
            flush()
        return out

    def _menu(self, x: Node) -> bool:
        """A list of links outside articles."""
        return x.tag in ("ul", "ol") and self.content[0].tag not in MAIN and len(x.children) > 2 and 0 < x.size == x.linked


def extract(html: str | None, template: set | frozenset = frozenset(), tags: bool = True) -> str:
    return "\n".join(Page(html).blocks(template, tags))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _site(host: str) -> int:
    return _signed(xxhash.xxh64_intdigest(host.encode("utf-8", "replace")))


def _subtree_batches(batches):
    """Rows (site, subtree, inside, content) of every page's candidates; a row without subtree is the page among its host's."""
    for batch in batches:
        rows = set()
        for host, html in zip(batch.column("__host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                page, site = Page(html), _site(host)
                whole = _signed(page.signature())
                rows.add((site, None, True, _signed(page.outside())))
                for x, h, inside in page.candidates():
                    rows.add((site, _signed(h), inside, _signed(page.outside(x)) if inside else whole))
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["site", "subtree", "inside", "content"])


def _key(site, subtree, inside):
    """64-bit key of a site's subtree, for integers or arrays of them."""
    x = np.asarray(site).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(subtree).astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(inside).astype(np.uint64)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _key_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_key(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("site", "subtree", "inside")]))], ["key"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(site, subtree, inside) of the subtrees that are template, by the two rules above.  The result is read more than once."""
    found = ship(pages).select(host_of(F.col("url")).alias("__host"), "html").mapInArrow(
        _subtree_batches, "site long, subtree long, inside boolean, content long"
    )
    counted = cut(
        found.distinct().groupBy("site", "subtree", "inside").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("inside"))
    )
    sites = counted.where("subtree IS NULL").select("site", F.col("n").alias("of"))
    inner = counted.where(F.col("inside") & F.col("subtree").isNotNull())
    often = inner.where(F.col("n") >= min_pages).join(sites, "site").where(F.col("n") >= F.col("of") * share)
    everywhere = inner.groupBy("subtree").agg(F.sum("n").alias("total"))
    own = often.join(everywhere, "subtree").where(F.col("n") * 2 > F.col("total"))
    return cut(own.select("site", "subtree", "inside").unionByName(counted.where("NOT inside").select("site", "subtree", "inside")))


def _extract_batches(names: list[str], keys, per_page: bool):
    def run(batches):
        known = None if per_page else np.asarray(keys.value)
        for batch in batches:
            sets = batch.column("__keys").to_pylist() if per_page else None
            texts = []
            for i, (host, html) in enumerate(
                zip(batch.column("__host").to_pylist(), batch.column("__html").to_pylist(), strict=True)
            ):
                page = Page(html)
                own = np.sort(np.array(sets[i] or [], dtype=np.int64)) if per_page else known
                template = frozenset()
                if len(own) and (found := [(h, inside) for _, h, inside in page.candidates()]):
                    asked = _key(_site(host), [_signed(h) for h, _ in found], [x for _, x in found])
                    hit = own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] == asked
                    template = frozenset(f for f, h in zip(found, hit, strict=True) if h)
                texts.append("\n".join(page.blocks(template)))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f"__c{k}") for k in range(len(names))],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                [*names, "text", "n_chars"],
            )

    return run


def _page_keys(batches):
    """Rows (page, key) of a page's subtrees."""
    for batch in batches:
        rows: list = []
        for a, b, host, html in zip(*[batch.column(c).to_pylist() for c in ("__a", "__b", "__host", "__html")], strict=True):
            found = {(h, inside) for _, h, inside in Page(html).candidates()}
            if found:
                keys = _key(_site(host), [_signed(h) for h, _ in found], [x for _, x in found])
                rows.extend((a, b, k) for k in keys.tolist())
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["__a", "__b", "key"])


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST, share: float = SHARE) -> DataFrame:
    """``pages`` with text and n_chars."""
    rest = without(pages, {"text", "n_chars"})
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    schema = pages.select(*rest).schema.add("text", "string").add("n_chars", "long")
    plain = pages.select(
        *[c.alias(f"__c{i}") for i, c in enumerate(rest)], host_of(F.col("url")).alias("__host"), F.col("html").alias("__html")
    )
    found = templates(pages, min_pages, share).mapInArrow(_key_batches, "key long")
    some = found.limit(max_broadcast + 1).toArrow()["key"].to_numpy()
    if len(some) <= max_broadcast:
        keys = pages.sparkSession.sparkContext.broadcast(np.unique(some))
        return plain.mapInArrow(_extract_batches(names, keys, False), schema)
    # Too many to broadcast: each page gets its own keys, over salted keys of the template table.
    plain = plain.withColumns({"__a": F.xxhash64("__host", "__html"), "__b": F.xxhash64("__html", F.lit(7), "__host")})
    own = plain.mapInArrow(_page_keys, "__a long, __b long, key long").distinct().withColumn("salt", F.pmod("__a", F.lit(SALTS)))
    salted = found.distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sets = own.join(salted, ["key", "salt"]).groupBy("__a", "__b").agg(F.collect_list("key").alias("__keys"))
    return plain.join(sets, ["__a", "__b"], "left").mapInArrow(_extract_batches(names, None, True), schema)


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", "n_chars")

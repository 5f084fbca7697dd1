"""Main-text extraction: a site style tree per host, and removal of its low-importance branches."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ROW, Workspace, addressed, join_groups, map_rows, small_batches
from tarn.llm.repeats import BUFFER, GRAM, gram_hashes

# Names and words of the HTML vocabulary.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
BLOCKS = CLOSES_P | {
    "body", "button", "caption", "dd", "dialog", "dt", "figcaption", "frameset", "head", "hgroup", "html", "legend", "li",
    "menu", "optgroup", "option", "search", "summary", "tbody", "td", "tfoot", "th", "thead", "tr",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "body", "html"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head"}
FOREIGN_TAGS = {"dialog", "head"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Names of what is never part of an article, wherever it stands.  A name alone marks no article that stands by itself.
FOREIGN_WORDS = {
    "ad", "ads", "adsense", "adslot", "advert", "adverts", "advertisement", "advertising", "comment", "commentform",
    "commentlist", "comments", "disqus", "newsletter", "promo", "promotion", "recommended", "related", "replies", "respond",
    "sponsor", "sponsored",
}
#: Names of a site's furniture; an article inside such an element is an article all the same.
FURNITURE_WORDS = {
    "alert", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookiebar", "cookies", "copyright", "footer",
    "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "notice", "overlay", "pager", "pagination",
    "popup", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "subscribe", "toolbar", "topnav",
    "widget", "widgets",
}
#: With one of these a name tells of a layout ("has-sidebar").
LAYOUT_WORDS = {"has", "layout", "no", "with", "without"}
HEADER_WORDS = {"global", "header", "main", "page", "site", "top"}
MAIN = {"article", "main"}

P, NAV, NONE = {"p"}, {"nav"}, set()
P_SCOPES = SCOPES | {"div", "section", "td", "li", "blockquote"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag or opens a quoted value in it.
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def attributes(rest: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(rest):
        value = m[2] or ""
        found.setdefault(m[1].lower(), entities.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return found


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page's text, start and end tags; each character is looked at a bounded number of times.

    Comments, declarations and what raw elements hold are left out; of a tag
    without an end nothing is left.
    """
    at, size, unclosed = 0, len(source), set()
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", "", source[at:]
            return
        follow = source[lt + 1 : lt + 2]
        ending = follow == "/"
        m = NAME.match(source, lt + 1 + ending)
        if m is None and follow not in ("!", "?", "/"):
            yield "text", "", source[at : lt + 1]
            at = lt + 1
            continue
        if lt > at:
            yield "text", "", source[at:lt]
        if m is None:
            closing = "-->" if source.startswith("<!--", lt) else "]]>" if source.startswith("<![CDATA[", lt) else ">"
            stop = source.find(closing, lt + 2)
            at = size if stop < 0 else stop + len(closing)
            continue
        stop = m.end()
        while True:
            s = STOP.search(source, stop)
            if s is None:
                return
            if s[1] is None:
                break
            stop = s.end()
            if s[1] not in unclosed:
                closed = source.find(s[1], stop)
                if closed < 0:
                    unclosed.add(s[1])
                else:
                    stop = closed + 1
        tag, at = m[0].lower(), s.end()
        yield "end" if ending else "start", tag, source[m.end() : s.start()]
        if tag in RAW and not ending:
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            at = over.end() if over else size


@dataclass(slots=True)
class Element:
    """``foreign``: boilerplate that no article inside it can leave; ``unseen``: by more than a name.

    ``key`` names the branch: the tags from the root, each with its class, id
    and role names and whether it is hidden.  ``inside``: whether it or an element around it is an
    article, a foreign one too.
    """

    tag: str
    key: int
    above: tuple[int, int]
    boilerplate: bool = False
    main: bool = False
    foreign: bool = False
    unseen: bool = False
    inside: bool = False
    open: bool = True


@dataclass(slots=True)
class Block:
    key: int
    boilerplate: bool
    main: bool
    text: str


@dataclass
class Page:
    """A page's text blocks in order, and of each branch the tags of its children and the two branches above it.

    ``articles``: for each outermost article, seen ones only, whether the name of an element around it is foreign.
    """

    blocks: list[Block] = field(default_factory=list)
    children: dict[int, list[str]] = field(default_factory=lambda: defaultdict(list))
    above: dict[int, tuple[int, int]] = field(default_factory=dict)
    articles: list[bool] = field(default_factory=list)
    leaves: bool = False

    @property
    def marked(self) -> bool:
        return any(b.main and not b.boilerplate for b in self.blocks)

    def furniture(self) -> set[int]:
        """The branches that the page itself declares to be none of its article."""
        marked = self.marked
        return {b.key for b in self.blocks if b.boilerplate or (marked and not b.main)}


def signed_hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >= 1 << 63 else value


@dataclass(frozen=True, slots=True)
class Names:
    """What an element's attributes say of it, whatever stands around it."""

    sign: str = ""
    role: str = ""
    hidden: bool = False
    foreign: bool = False
    furniture: bool = False
    header: bool = False


PLAIN = Names()


def names_of(rest: str) -> Names:
    if not rest.strip(" /"):
        return PLAIN
    return _short_names(rest) if len(rest) < 500 else _names(rest)


def _names(rest: str) -> Names:
    found = attributes(rest)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    role = found.get("role", "").lower()
    names = " ".join(filter(None, (found.get("class"), found.get("id"))))
    words = set(WORDS.findall(f"{CAMEL.sub(' ', names)} {names}".lower())) if names else set()
    sign = "".join(f".{w}" for w in sorted(words)) + (f"@{role}" if role else "") + ("~" if hidden else "")
    layout = bool(words & LAYOUT_WORDS)
    header = "header" in words and words <= HEADER_WORDS
    return Names(sign, role, hidden, bool(words & FOREIGN_WORDS) and not layout, bool(words & FURNITURE_WORDS) and not layout, header)


_short_names = lru_cache(maxsize=1 << 12)(_names)


def element(tag: str, rest: str, parent: Element, leaves: bool) -> Element:
    """A new element; with ``leaves`` an article is one whatever the elements around it are named."""
    names = names_of(rest) if rest else PLAIN
    outermost = not parent.main and (tag in MAIN or names.role == "main")
    unseen = parent.unseen or names.hidden or tag in FOREIGN_TAGS
    foreign = unseen or (parent.foreign and not (leaves and outermost))
    if tag in ("html", "body", "main"):
        noise = False
    else:
        foreign = foreign or (names.foreign and not outermost)
        noise = (
            names.furniture
            or tag in BOILERPLATE_TAGS
            or names.role in BOILERPLATE_ROLES
            or ((tag == "header" or names.header) and not parent.main)
        )
    starts = outermost and not foreign
    boilerplate = foreign or ((parent.boilerplate or noise) and not starts)
    main = parent.main or starts
    key = signed_hash(f"{parent.key:x}/{tag}{names.sign}")
    inside = parent.inside or main or (foreign and tag in MAIN)
    return Element(tag, key, (parent.key, parent.above[0]), boilerplate, main, foreign, unseen, inside)


class Stack:
    """Open elements, with the places of each tag's, so that a search among them takes no walk."""

    def __init__(self, root: Element):
        self.elements = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]

    @property
    def top(self) -> Element:
        return self.elements[-1]

    @property
    def holder(self) -> Element:
        """The innermost open block element."""
        return self.elements[self.blocks[-1]]

    def push(self, made: Element) -> None:
        self.places[made.tag].append(len(self.elements))
        if made.tag in BLOCKS:
            self.blocks.append(len(self.elements))
        self.elements.append(made)

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element with one of the tags; -1 if there is none."""
        best = -1
        for tag in tags:
            if (places := self.places.get(tag)) and places[-1] > best:
                best = places[-1]
        return best

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.elements) > place:
            gone = self.elements.pop()
            if gone.open:
                self.places[gone.tag].pop()
            if self.blocks[-1] == len(self.elements):
                self.blocks.pop()

    def end_inline(self, tag: str) -> None:
        """Close the innermost inline element of a tag, if no block stands in it; those inside it stay open."""
        place = self.last({tag})
        if place > self.blocks[-1]:
            self.elements[place].open = False
            self.places[tag].pop()
            while not self.top.open:
                self.elements.pop()


def parse(source: str) -> Page:
    """Blocks and branches of a page; its only article is one whatever the elements around it are named."""
    page = _parse(source, False)
    return _parse(source, True) if page.articles == [True] else page


def _parse(source: str, leaves: bool) -> Page:
    """One reading; unclosed and misplaced tags are mended as browsers do for the common cases."""
    page, stack = Page(leaves=leaves), Stack(Element("", 0, (0, 0)))
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                holder = stack.holder
                page.blocks.append(Block(holder.key, holder.boilerplate, holder.main, text))
                page.above.setdefault(holder.key, holder.above)

    def close(tags: set[str], scopes: set[str]) -> None:
        place = stack.last(tags)
        if place > 0 and stack.last(scopes) < place:
            flush()
            stack.cut(place)

    for kind, tag, rest in tokens(source):
        if kind == "text":
            parts.append(entities.unescape(rest))
        elif kind == "end":
            if tag in BLOCKS:
                close({tag}, MAIN if tag in ("p", "div", "li") else NONE)
            else:
                stack.end_inline(tag)
        elif tag in RAW:
            if tag == "select":
                parts.append(" ")
        elif tag in VOID:
            parts.append(" ")
        else:
            if tag in BLOCKS:
                flush()
                if tag in CLOSES_P:
                    close(P, P_SCOPES)
                if tag in SIBLINGS:
                    close(SIBLINGS[tag], SCOPES)
                if tag in MAIN:
                    close(NAV, MAIN)
            parent = stack.top
            made = element(tag, rest, parent, leaves)
            if not made.unseen and (made.main and not parent.main or made.foreign and tag in MAIN and not parent.inside):
                page.articles.append(made.foreign)
            page.children[parent.key].append(tag)
            if not (rest.endswith("/") and tag in BLOCKS):
                stack.push(made)
    flush()
    return page


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def site_of(url: str | None, page: Page) -> str:
    """The tree that a page belongs to: its host's, for pages that mark an article or for those that do not."""
    return host_of(url) + (" named" if page.leaves else "") + (" marked" if page.marked else "")


def main_text(page: Page, noisy: frozenset[int] | set[int]) -> str:
    """A page's text without its noisy branches."""
    return "\n".join(b.text for b in page.blocks if b.key not in noisy)


def copy_name(page: Page) -> int:
    """A name that pages with one article share, and mostly those with nearly the same: the least hash of its 32-byte strings."""
    marked = page.marked
    text = "\n".join(b.text for b in page.blocks if b.main and not b.boilerplate or not marked)
    data = text.encode("utf-8", "surrogatepass")
    if len(data) < GRAM:
        return signed_hash(text)
    held = np.frombuffer(data, dtype=np.uint8)
    least = min(int(gram_hashes(held[at : at + BUFFER + GRAM - 1]).min()) for at in range(0, len(held) - GRAM + 1, BUFFER))
    return least - (1 << 64) if least >= 1 << 63 else least


#: Features of a branch on a page: what it holds and how, the layouts of the two branches above it, its content, and whether it is declared furniture.
FEATURES = ("own", "parent", "grandparent", "content", "furniture")


def branch_features(page: Page) -> dict[int, tuple[int, ...]]:
    """The features of each branch of a page that holds text."""
    texts: dict[int, list[str]] = defaultdict(list)
    for block in page.blocks:
        texts[block.key].append(block.text)
    furniture, layouts = page.furniture(), {}

    def layout(key: int) -> int:
        if key not in layouts:
            layouts[key] = signed_hash(" ".join(page.children.get(key, ())))
        return layouts[key]

    found = {}
    for key, held in texts.items():
        size = sum(map(len, held)).bit_length()
        above = page.above[key]
        own = signed_hash(f"{layout(key)} {size}")
        found[key] = (own, layout(above[0]), layout(above[1]), signed_hash("\n".join(held)), int(key in furniture))
    return found


def site_nodes(texts: DataFrame) -> DataFrame:
    """(row, site, key, copy, features): the branches of each page of (row, url, html) that hold text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for part in small_batches(batches, 64):
            rows = []
            for k, (url, source) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                page = parse(source or "")
                site, copy = site_of(url, page), copy_name(page)
                rows += [(k, site, key, copy, features) for key, features in branch_features(page).items()]
            place, *columns = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0).take(place), *columns], ["row", "site", "key", "copy", "features"])

    return map_rows(texts.select("row", "url", "html"), f"row {ROW}, site string, key long, copy long, features array<long>", work)


def noisy_branches(nodes: DataFrame, *, threshold: float, trust: float, layouts: int, declared: bool) -> DataFrame:
    """(site, key): the branches of each site's style tree that are of low importance.

    A feature's entropy over a branch's pages is in units of the logarithm of
    their number (1: all differ), for layouts of ``layouts`` at most.  With few
    pages it says little: each value counts as if ``trust`` pages more had made
    it 1.  A branch's importance is its content's entropy times that of the
    layout at or above it, whichever varies most: a slot of a template is filled
    anew on each page, but its layout stays.  What pages declare counts as
    evidence of layout: all of it for a marked article, none for furniture; with
    ``declared`` false entropy alone decides.

    Only counts are aggregated, first where the rows are: neither a host's pages
    nor its tree is collected, so a host with a third of all pages is like any
    other.  Copies of an article count once.
    """
    once = nodes.groupBy("site", "key", "copy").agg(*(F.min(F.element_at("features", k + 1)).alias(f) for k, f in enumerate(FEATURES)))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f).alias("v")) for k, f in enumerate(FEATURES))))
    counts = once.select("site", "key", named.alias("x")).groupBy("site", "key", "x").agg(F.count("*").alias("n"))
    sums = counts.groupBy("site", "key", F.col("x.f").alias("f")).agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("x.v").alias("most")
    )
    m = F.col("m").cast("double")
    entropy = F.greatest(F.log("m") - F.col("s") / m, F.lit(0.0))
    unit = F.log(F.when(F.col("f") < 3, F.least(m, F.lit(float(layouts)))).otherwise(m))
    share = F.when(m > 1, F.least(entropy / unit, F.lit(1.0))).otherwise(1.0)
    value = sums.select("site", "key", "f", "most", ((trust + m * share) / (trust + m)).alias("value"))
    branch = value.groupBy("site", "key").agg(
        F.max(F.when(F.col("f") < 3, F.col("value"))).alias("layout"),
        F.max(F.when(F.col("f") == 3, F.col("value"))).alias("content"),
        F.max(F.when(F.col("f") == 4, F.col("most"))).alias("furniture"),
    )
    layout = F.col("layout")
    if declared:
        layout = F.when(F.col("furniture") > 0, 0.0).when(F.col("site").endswith(" marked"), 1.0).otherwise(layout)
    return branch.where(F.col("content") * layout < threshold).select("site", "key")


def extract_main_text(
    pages: DataFrame,
    *,
    threshold: float = 0.4,
    trust: float = 8.0,
    layouts: int = 64,
    declared: bool = True,
    broadcast_bytes: int = 8 << 20,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Extract each page's main text.

    Pages of one host are merged into a site style tree, one for pages that mark
    an article and one for those that do not.  A branch's importance is the
    entropy of its content and layout over the host's pages (``noisy_branches``);
    what HTML, roles or names declare to be menus, headers, footers, sidebars,
    notices, adverts, forms or comments, and what stands outside a marked
    article, has none.  Branches of low importance are removed from each page;
    nothing else is, and no text is kept or removed but by the tree.  With
    ``declared`` false names and marks are not looked at, which takes hosts with
    many pages.

    Returns ``page_id``, ``url``, ``text`` (one line per block) and ``n_chars``.
    Null or empty html gives an empty text; a url without a host joins the host
    of no name; null ids and repeated rows are carried as they are; pages of any
    size and depth are read in time in proportion; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    texts = addressed(pages).pick(page_id=id_col, url=url_col, html=html_col)
    texts = texts.withColumn("url", F.col("url").cast("string")).withColumn("html", F.col("html").cast("string"))
    schema = f"page_id {texts.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    with Workspace(pages.sparkSession) as ws:
        nodes = ws.table(site_nodes(texts))
        noisy = ws.table(noisy_branches(nodes, threshold=threshold, trust=trust, layouts=layouts, declared=declared))
        size = noisy.agg(F.sum(F.octet_length("site") + 16)).first()[0] or 0
        if size <= broadcast_bytes:
            sites: dict[str, set[int]] = defaultdict(set)
            for r in noisy.collect():
                sites[r.site].add(r.key)
            return map_rows(texts.select("page_id", "url", "html"), schema, _extractor(dict(sites)))
        # Of a tree too large to send to all tasks each page gets its own branches.
        sizes = ws.table(nodes.groupBy("site", "key").agg(F.count("*").alias("n")).join(noisy, ["site", "key"]))
        own = join_groups(nodes.select("row", "site", "key"), sizes, ["site", "key"], "n", nodes.count())
        keys = ws.deliver(own.groupBy("row").agg(F.collect_list("key").alias("noisy")))
    joined = texts.join(keys.hint("shuffle_hash"), "row", "left").select("page_id", "url", "html", "noisy")
    return map_rows(joined, schema, _extractor(None))


def _extractor(sites: dict[str, set[int]] | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: set[int] = set()
        for part in small_batches(batches, 256):
            urls, sources = part.column(1).to_pylist(), part.column(2).to_pylist()
            own = [None] * len(urls) if sites is not None else part.column(3).to_pylist()
            texts = []
            for url, source, noisy in zip(urls, sources, own, strict=True):
                page = parse(source or "")
                texts.append(main_text(page, set(noisy or ()) if sites is None else sites.get(site_of(url, page), none)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return work

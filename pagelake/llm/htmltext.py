"""Main text of web pages: site templates go by recurring element subtrees.

Every page is cut into blocks of text. Elements that by their name, role or a whole class
or id are menus, headers, footers, sidebars, notices, adverts, forms or comments are left
out, unless they hold an article or, by class or id only, most of the page's text. Where a
page has a main element, only that and articles are read. The subtrees of the remaining
containers are hashed from the leaves up and counted per host; a subtree that many pages
of a host share is a template and its blocks are deleted.

Two hashes are counted: that of the whole subtree, text included, and on pages that mark
an article that of the shape of containers outside of it: names, classes, ids and the
kinds of blocks below, runs of equal ones as one. A menu whose entries differ from page
to page has one shape. A shape is a template unless its containers hold more than half of
the text of the pages they are on, or hold the page's first heading.

Inside a marked article only containers can be templates. Paragraphs, headings and lists'
items there are the author's own words, also when other articles quote the same ones.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import stored

MIN_PAGES = 5  # different pages of a host that share a template, at least
MIN_SHARE = 0.05  # and at least this share of the host's pages
ENOUGH = 24  # or so many pages, however large the host is

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.DOTALL,
)
UNCLOSED = re.compile(r"<!--.*|<!\[CDATA\[(.*)|(\Z.)(.)(.)", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
# Elements that begin a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("center details div dl figure ol section table ul".split())
# Containers that may be templates by their shape.
SHAPED = CONTAINERS | frozenset("address aside fieldset footer form header nav".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript template svg math iframe button select menu dialog textarea "
    "title head object audio video canvas map datalist input label optgroup option xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Whole classes and ids.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav "
    "footer masthead comment comments respond disqus share sharing social related recommended newsletter "
    "subscribe signup login search pagination pager popup modal overlay toolbar widget skip "
    "cookie-notice cookie-banner cookie-consent comment-list comment-form comment-body".split()
)
ARTICLE_WORDS = frozenset("comment comments comment-body ad ads advert advertisement promo sponsored related recommended teaser".split())
# Dropped by name, unless the main text is in them.
SOFT = frozenset("nav footer aside form".split())
# An open element of the first kind ends where one of the second begins.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]),
    "p": BLOCKS,
}
SCOPES = frozenset("table td th ul ol dl div article section main body blockquote".split())


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def unwanted(tag: str, attrs: dict[str, str], in_article: bool, names: bool = True) -> int:
    """Whether an element is no part of the main text by its name, role, state or class.

    0 if it may be; 1 if it is none unless it holds an article, 2 unless it holds one or
    most of the page's text, 3 whatever it holds. Without ``names`` only the last is told.
    """
    if tag in DROPPED and tag not in SOFT:
        return 3
    role = attrs.get("role", "").lower()
    if tag in ("html", "body", "main") or role == "main":
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return 3
    if re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return 3
    if not names:
        return 0
    if tag == "form":  # some sites put the whole page into one
        return 2
    if tag in DROPPED:
        return 1
    words = set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())
    if tag == "article":
        return 2 if words & ARTICLE_WORDS else 0
    if tag == "header":
        return 0 if in_article else 1
    if role in ROLES:
        return 1
    if "header" in words:
        return 0 if in_article else 2
    return 2 if words & WORDS else 0


class Page:
    """One page's blocks, and its containers with the hashes of their subtree and their blocks.

    ``blocks`` holds ``(text, place)``, ``elements`` ``(tag, hash, shape, first, last, place)``;
    the shape is None where the container holds a main heading. The place is 2 inside an article, 1 inside a main element only, else 0. ``rescued`` holds
    the numbers of unwanted elements, in page order, that hold the main text: a page read
    with them as ``kept`` has it.
    """

    def __init__(self, source: str, kept: frozenset[int] = frozenset(), names: bool = True):
        self.blocks: list[tuple[str, int]] = []
        self.elements: list[tuple[str, int, int | None, int, int, int]] = []
        self.articles = self.mains = 0
        self._words: list[str] = []
        # tag, digest of the block it is in, first block, dropped, counts as article, counts as main, what was
        # known when an unwanted element began, kind, shape, shape of the last block in it, main headings before,
        # place here of the innermost element with a shape
        self._open: list[list] = []
        self._kept, self._names = kept, names
        self._headings = 0  # main headings so far
        self._begun = 0  # elements
        self._hard = 0  # open elements that are never read
        self._size = self._marks = 0  # characters and articles so far outside of those
        self._named: list[tuple[int, int, int]] = []  # number, characters, kind of unwanted elements
        self._count: Counter[str] = Counter()  # open elements by name
        self._at = {"dropped": 0, "article": 0, "main": 0}
        self.rescued: set[int] = set()
        self._read(source)
        self.rescued.update(n for n, size, kind in self._named if kind == 2 and 2 * size > self._size)

    def _flush(self) -> None:
        if self._words:
            line = " ".join("".join(self._words).split())
            self._words.clear()
            if line:
                self.blocks.append((line, 2 if self._at["article"] else 1 if self._at["main"] else 0))
                if self._open:
                    self._open[-1][1].update(b"\x01" + line.encode("utf-8", "replace"))

    def _text(self, text: str) -> None:
        if self._hard:
            return
        text = html.unescape(text)
        self._size += len("".join(text.split()))
        if not self._at["dropped"]:
            self._words.append(text)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self._words.append(" ")
        kind = unwanted(tag, attrs, bool(self._at["article"] or self._at["main"]), self._names)
        named = None
        self._begun += 1
        if kind in (1, 2):
            named = self._begun, kind, self._size, self._marks
            if self._begun in self._kept:
                kind = 0
        dropped = kind > 0
        self._hard += kind == 3
        article = tag == "article" and not dropped
        main = (tag == "main" or attrs.get("role", "").lower() == "main") and not dropped
        if not self._hard:
            self._marks += article or main
        if not self._at["dropped"]:
            self.articles += article
            self.mains += main
        if self._open and (tag not in BLOCKS or self._at["dropped"]):
            digest, shape = self._open[-1][1], None  # what is in it counts as the block's around it
        else:
            label = f"{tag}|{attrs.get('class', '')}|{attrs.get('id', '')}".encode("utf-8", "replace")
            digest, shape = xxhash.xxh64(label), xxhash.xxh64(label, seed=1)
        self._count[tag] += 1
        shaped = len(self._open) if shape else self._open[-1][11]
        self._open.append(
            [tag, digest, len(self.blocks), dropped, article, main, named, kind, shape, None, self._headings, shaped])
        self._headings += tag == "h1"
        for name, on in (("dropped", dropped), ("article", article), ("main", main)):
            self._at[name] += on

    def _end(self) -> None:
        tag, digest, first, dropped, article, main, named, kind, shape, _, headings, _ = self._open[-1]
        if tag in BLOCKS:
            self._flush()
        self._open.pop()
        self._count[tag] -= 1
        for name, on in (("dropped", dropped), ("article", article), ("main", main)):
            self._at[name] -= on
        self._hard -= kind == 3
        if named:
            number, why, size, marks = named
            if self._marks > marks:
                self.rescued.add(number)
            self._named.append((number, self._size - size, why))
        if dropped or self._at["dropped"]:
            return
        if tag in BLOCKS and self._open:
            self._open[-1][1].update(b"\x02" + digest.digest())
            self._add_shape(shape)
        if tag in BLOCKS and first < len(self.blocks) and tag not in ("html", "body", "main", "article"):
            place = 2 if self._at["article"] else 1 if self._at["main"] else 0
            form = shape.intdigest() if shape and headings == self._headings else None
            self.elements.append((tag, digest.intdigest(), form, first, len(self.blocks), place))

    def _add_shape(self, shape) -> None:
        """Tell the innermost open block the shape of a block in it; runs of equal ones count once."""
        around = self._open[self._open[-1][11]]
        code = shape.digest() if shape else b""
        if code != around[9]:
            around[8].update(code)
            around[9] = code

    def _close_before(self, tag: str) -> None:
        """End what the start of ``tag`` ends by itself."""
        if not any(self._count[name] for name, begun in ENDED_BY.items() if tag in begun):
            return
        for n in range(len(self._open) - 1, -1, -1):
            name = self._open[n][0]
            if tag in ENDED_BY.get(name, ()):
                while len(self._open) > n:
                    self._end()
                return
            if name in SCOPES:
                return

    def _read(self, source: str) -> None:
        at, size, last = 0, len(source), source.rfind(">")
        endless: set[str] = set()
        while at < size:
            # Past the last ">" no tag can be complete: what looks like one is text.
            match = TOKEN.search(source, at) if at <= last else UNCLOSED.search(source, at)
            if match is None:
                self._text(source[at:])
                break
            if match.start() > at:
                self._text(source[at : match.start()])
            at = match.end()
            cdata, closing, tag, rest = match.groups()
            if tag is None:
                if cdata:
                    self._text(html.escape(cdata, quote=False))
                continue
            tag = tag.lower()
            if closing:
                if self._count[tag]:
                    while self._open[-1][0] != tag:
                        self._end()
                    self._end()
                continue
            if tag in RAW:
                if not rest.endswith("/") and tag not in endless:
                    end = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(source, at)
                    if end:
                        at = end.end()
                    elif tag in ("script", "style", "textarea", "title"):
                        at = size
                    else:
                        endless.add(tag)
                continue
            if tag in BLOCKS:
                self._close_before(tag)
            attrs = attributes(rest) if rest.strip(" /") else {}
            self._start(tag, attrs)
            if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
                self._end()
        self._flush()
        while self._open:
            self._end()


class Read(NamedTuple):
    """The blocks of a page's main part, and what may be a template in it.

    ``elements`` holds ``(hash, shape or None, first, last)``, ``shapes`` the characters
    in all containers of a shape.
    """

    blocks: list[str]
    elements: list[tuple[int, int | None, int, int]]
    shapes: dict[int, int]


def read_page(source: str, names: bool = True) -> Read:
    """What a page holds by itself, before templates are known."""
    page = Page(source, names=names)
    if page.rescued:
        page = Page(source, frozenset(page.rescued), names)
    least = 1 if any(place and page.mains for _, place in page.blocks) else 0
    number, written, chosen, blocks = [0], [0], [0], []
    for line, place in page.blocks:
        if place >= least:
            blocks.append(line)
        number.append(len(blocks))
        written.append(written[-1] + len(line))
        chosen.append(chosen[-1] + (place == 2))
    elements, shapes = [], Counter()
    for tag, digest, shape, first, last, place in page.elements:
        lo, hi = number[first], number[last]
        if place < least or lo == hi:
            continue
        beside = page.articles and not place and chosen[first] == chosen[last]
        form = shape - (1 << 63) if beside and tag in SHAPED and shape is not None else None
        if form is not None:
            shapes[form] += written[last] - written[first]
        able = CONTAINERS if place == 2 or place and not page.articles else BLOCKS
        if tag in able:
            elements.append((digest - (1 << 63), form, lo, hi))
    return Read(blocks, elements, shapes)


_ELEMENT = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("s", T.LongType()),
    T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
_SHAPE = T.StructType([T.StructField("s", T.LongType()), T.StructField("held", T.LongType())])


def _parsed(batches: Iterator[pd.DataFrame], names: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [read_page(t, names) for t in batch["html"]]
        batch = batch.drop(columns="html")
        batch["blocks"] = [page.blocks for page in found]
        batch["elements"] = [[{"h": h, "s": s, "lo": lo, "hi": hi} for h, s, lo, hi in page.elements] for page in found]
        batch["shapes"] = [[{"s": s, "held": held} for s, held in page.shapes.items()] for page in found]
        batch["size"] = [sum(map(len, page.blocks)) for page in found]
        batch["body"] = [xxhash.xxh64_intdigest("\n".join(page.blocks).encode("utf-8", "replace")) - (1 << 63) for page in found]
        yield batch


def main_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH,
    names: bool = True,
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    Blocks come in page order, joined by one line feed; character references are decoded
    and white space in a block is one blank. A null or empty page has an empty text. A
    null url, or one without a host, shares the empty host. Pages of a host with the same
    text count once when templates are counted. Repeated rows are all returned; extra
    columns are ignored. Only pages that hold containers are joined with the templates;
    the others' text never moves. Without ``names`` templates alone decide, besides
    scripts, controls and hidden elements.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    source = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kinds = [pages.schema["page_id"], pages.schema["url"], T.StructField("host", T.StringType()),
             T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("elements", T.ArrayType(_ELEMENT)),
             T.StructField("shapes", T.ArrayType(_SHAPE)), T.StructField("size", T.LongType()), T.StructField("body", T.LongType())]
    parsed = source.mapInPandas(lambda batches: _parsed(batches, names), T.StructType(kinds))
    parsed = stored(parsed.withColumn("row", F.monotonically_increasing_id()), "html-parsed")

    once = parsed.select("host", "body", F.explode(F.array_distinct("elements.h")).alias("h")).distinct()
    counts = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    sizes = parsed.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    shaped = parsed.select("host", "body", "size", F.explode("shapes").alias("e")).groupBy("host", "body", "e.s").agg(
        F.max("e.held").alias("held"), F.max("size").alias("size"))
    forms = shaped.groupBy("host", F.col("s").alias("h")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("held").alias("held"), F.sum("size").alias("size"))
    forms = forms.filter((F.col("pages") >= min_pages) & (2 * F.col("held") <= F.col("size")))
    templates = stored(
        counts.union(forms.select("host", "h", "pages")).join(sizes, "host")
        .filter((F.col("pages") >= enough) | (F.col("pages") >= min_share * F.col("all_pages")))
        .select("host", "h").distinct(),
        "html-templates")

    nested = parsed.filter(F.size("elements") > 0)
    spans = nested.select("row", "host", F.explode("elements").alias("e")).select(
        "row", "host", F.explode(F.array_compact(F.array("e.h", "e.s"))).alias("h"), "e.lo", "e.hi")
    cut = spans.join(templates, ["host", "h"]).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    rest = F.filter("blocks", lambda b, i: ~F.exists("cut", lambda c: (i >= c["lo"]) & (i < c["hi"])))
    left = nested.join(stored(cut, "html-cuts"), "row", "left").withColumn(
        "blocks", F.when(F.col("cut").isNull(), F.col("blocks")).otherwise(rest))
    plain = parsed.filter(F.size("elements") == 0)
    columns = ["page_id", "url", "blocks"]
    text = F.array_join("blocks", "\n")
    return plain.select(columns).union(left.select(columns)).select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))

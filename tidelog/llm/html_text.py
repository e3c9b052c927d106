"""Main text of web pages by removal of site templates.

1. Each page is parsed into its elements; every block element gets a hash of its subtree (tags and
   text). Spark counts, per host, on how many different pages a subtree stands: pages with the
   same text are copies and count once.
2. Subtrees that stand on many pages of their host are its template, and are deleted, and so are
   elements whose tag, role or class names what is no content: menus, page headers and footers,
   sidebars, notices, adverts, forms, scripts, styles, reader comments. Classes and ids are
   compared as wholes. What holds the page's only main, or its only articles if they outweigh all
   other text, is no such element, unless the articles are comments or cards.
3. The text of what is left is taken block by block. If a page marks its content (article, else
   main; main with its articles, if most of its text stands beside them), only that counts; there, running text that other pages have too is content all the
   same, and only recurring subtrees that consist of links are deleted.

Pages are parsed once to count and once to extract. A page needs the templates of its host only
if one of its blocks may belong to one; only such pages meet by host. The templates of a host are
few, since each stands on a given part of its pages.

Cases: a NULL or empty page has no text; a NULL url, or one without a host, is of the host '';
broken markup is read as browsers do in the main (unclosed elements end with their parents, tags
that were never opened are ignored); repeated rows are extracted each, and however many copies
there are of a page, nothing of it is a template for that.
"""

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A subtree is a template if it stands on so many pages of its host, and on this part of them.
LEAST_PAGES = 4
LEAST_SHARE = 0.2
# Part of a subtree's text that is links, if it may be deleted within marked content.
LINKS = 0.7

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p "
    "pre section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body html option td th tr tbody thead tfoot".split())
# An element of the first kind ends an open one of the others, up to the given parents.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tfoot tr td th", "table"),
    "option": ("option", "select"),
}
ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in ENDS.items()}
NO_CONTENT = frozenset(
    "head nav footer aside form button select menu dialog svg canvas object audio video map".split()
) | RAW
# Articles in these are cards or comments.
NO_WRAPPERS = NO_CONTENT - {"form"}
# No content unless they stand within marked content.
PAGE_ONLY = frozenset(["header"])
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus reply replies respond pagination pager skip toolbar widget".split()
)
PAGE_NAMES = frozenset("header masthead topbar".split())
# Usual compounds of these, as whole classes or ids.
COMPOUNDS = frozenset(
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle google-ad nav-bar nav-menu main-nav "
    "main-menu main-navigation site-nav site-navigation post-navigation side-bar left-sidebar right-sidebar "
    "sidebar-left sidebar-right widget-area site-footer page-footer cookie-banner cookie-bar cookie-consent "
    "cookie-notice gdpr-banner newsletter-form newsletter-signup share-buttons share-links social-links "
    "social-share related-posts related-articles recommended-posts comment-list comment-form comments-area "
    "comments-section comment-respond skip-link".split()
)
PAGE_COMPOUNDS = frozenset("site-header page-header header-note header-bar top-bar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # A quote opens a value only behind an equals sign; a value without quotes ends at white space.
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_CARDS = re.compile("comment|reply|replies|respond|disqus|related|recommended|promo", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE) for tag in RAW}


@dataclass
class Element:
    tag: str
    dropped: bool
    marked: str | None  # the kind of marked content it stands in
    in_main: bool = False
    number: int = -1  # place among the page's start tags
    own_drop: bool = False  # dropped for itself, not for what it stands in
    attributes: str = ""  # of such an element
    parts: list = field(default_factory=list)  # what its hash is made of
    length: int = 0
    in_links: int = 0
    hash: int | None = None
    above: "Element | None" = None  # the block element it stands in
    node: int | None = None  # its place, or that of the nearest above it, among what may be a template


@dataclass
class Block:
    text: str
    marked: str | None
    in_main: bool
    element: Element | None  # the block element it stands in


def _is_no_content(tag: str, attributes: str, marked: str | None) -> bool:
    if tag in NO_CONTENT or tag in PAGE_ONLY and not marked:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        # Ids of headings and sections are made from their titles.
        if name == "class" or name == "id" and tag not in HEADINGS:
            names = set(value.replace("_", "-").split())
            compounds = name == "class" or tag != "section"
            if names & NAMES or compounds and names & COMPOUNDS:
                return True
            if not marked and (names & PAGE_NAMES or compounds and names & PAGE_COMPOUNDS):
                return True
    return False


class Page:
    """The blocks of a page that may be content, and its block elements with their hashes.

    The start tags numbered in `kept` are not dropped.
    """

    def __init__(self, source: str, kept: frozenset[int] = frozenset()):
        self.kept = kept
        self.n_tags = 0
        self.has_main = False
        # Numbers of the dropped elements that hold a main or an article.
        self.around = {"main": set(), "article": set()}
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self.text: list[str] = []
        self.stack = [Element("", False, None)]
        self.n_open: Counter[str] = Counter()
        self._parse(source)

    def _parse(self, source: str) -> None:
        place = 0
        while True:
            found = _TAG.search(source, place)
            self._add(source[place : found.start() if found else len(source)])
            if not found:
                break
            place = found.end()
            closing, tag, rest = found.group(1, 2, 3)
            if tag is None:
                closing, tag, rest = found.group(4, 5, 6)
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
                continue
            self._open(tag, rest)
            if tag in RAW and not rest.endswith("/"):
                end = _RAW_END[tag].search(source, place)
                place = end.start() if end else len(source)
        self._end_block()
        while len(self.stack) > 1:
            self._pop()

    def _add(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        top = self.stack[-1]
        if not top.dropped:
            self.text.append(text)
        if text.strip():
            top.parts.append(" ".join(text.split()))
            top.length += len(text)
            if top.tag == "a":
                top.in_links += len(text)

    def _end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.marked, top.in_main, self._block_element()))

    def _block_element(self) -> Element | None:
        top = self.stack[-1]
        return top if top.tag in BLOCKS else top.above

    def _open(self, tag: str, rest: str) -> None:
        if tag in ENDS_P:
            self._end_open(frozenset(["p"]), frozenset("button table td th caption".split()))
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        if tag in BLOCKS:
            self._end_block()
        elif tag in ("br", "wbr", "img", "input"):
            self.text.append(" ")
        if tag in VOID:
            return
        above = self.stack[-1]
        marked, in_main = above.marked, above.in_main
        number = self.n_tags
        self.n_tags += 1
        own_drop = number not in self.kept and _is_no_content(tag, rest, marked)
        dropped = above.dropped or own_drop
        kind = None
        if tag == "article":
            kind = "article"
        elif tag == "main" or "main" in rest and re.search(r"role\s*=\s*[\"']?main\b", rest):
            kind = "main"
        if kind and not dropped:
            marked = kind if kind == "article" else marked or kind
            in_main = in_main or kind == "main"
            self.has_main = self.has_main or kind == "main"
        elif kind and not own_drop:
            around = [e for e in self.stack if e.own_drop]
            if kind == "main" or not any(e.tag in NO_WRAPPERS or _CARDS.search(e.attributes) for e in around):
                self.around[kind].update(e.number for e in around)
        element = Element(tag, dropped, marked, in_main, number, own_drop, rest if own_drop else "", above=self._block_element())
        self.stack.append(element)
        self.n_open[tag] += 1
        if rest.endswith("/") and tag not in BLOCKS:
            self._pop()

    def _end_open(self, tags: frozenset, parents: frozenset) -> None:
        if not any(self.n_open[tag] for tag in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                self._end_block()
                while len(self.stack) > depth:
                    self._pop()
                if len(tags) == 1:
                    return
            elif tag in parents or tag in BLOCKS and tag not in ("p", "div", "address"):
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if not self.n_open[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[depth].tag
            if open_tag == tag:
                while len(self.stack) > depth:
                    self._pop()
                return
            # An inline end tag does not reach over blocks.
            if tag not in BLOCKS and tag not in RAW and open_tag in BLOCKS:
                return

    def _pop(self) -> None:
        element = self.stack.pop()
        self.n_open[element.tag] -= 1
        above = self.stack[-1]
        above.length += element.length
        above.in_links += element.length if above.tag == "a" else element.in_links
        if element.length:
            content = f"{element.tag}({','.join(element.parts)})"
            if element.tag in BLOCKS:
                element.hash = xxhash.xxh64_intdigest(content) - 2**63
                self.elements.append(element)
                content = f"{element.tag}:{element.hash}"
            above.parts.append(content)
        element.parts = []


def _may_be_template(element: Element) -> bool:
    """Running text of marked content is content wherever else it stands."""
    if element.hash is None or element.tag in ("html", "body"):
        return False
    if element.marked and not element.dropped:
        return element.tag not in ("article", "main") and element.in_links >= LINKS * element.length
    return True


def _length(blocks: Iterable[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _parsed(source: str | None) -> Page:
    """A page, without dropping what holds its only main, or its only articles if they outweigh other text."""
    page = Page(source or "")
    if page.around["main"] and not page.has_main:
        page = Page(source, frozenset(page.around["main"]))
    if page.around["article"] and all(b.marked != "article" for b in page.blocks):
        other = Page(source, page.kept | page.around["article"])
        if _length(b for b in other.blocks if b.marked == "article") > _length(page.blocks):
            page = other
    return page


def _content(page: Page) -> list[Block]:
    """The blocks of what the page marks as content; all if it marks nothing."""
    in_main = [b for b in page.blocks if b.in_main]
    if _length(b for b in in_main if b.marked == "main") > _length(b for b in page.blocks if b.marked == "article"):
        return in_main
    kinds = {b.marked for b in page.blocks}
    kind = "article" if "article" in kinds else "main" if "main" in kinds else None
    return [b for b in page.blocks if kind is None or b.marked == kind]


def content_blocks(source: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """Texts of the blocks that may be content, and the subtrees they go with.

    Each block has the place of the nearest subtree around it that may be a template, or -1; the
    subtrees have their hashes and the place of the next one around them, which comes before them.
    """
    texts, own, hashes, around = [], [], [], []
    for block in _content(_parsed(source)):
        path, element = [], block.element
        while element is not None and element.node is None:
            path.append(element)
            element = element.above
        node = -1 if element is None else element.node
        for inner in reversed(path):
            if _may_be_template(inner):
                hashes.append(inner.hash)
                around.append(node)
                node = len(hashes) - 1
            inner.node = node
        texts.append(block.text)
        own.append(node)
    return texts, own, hashes, around


def subtree_hashes(source: str | None) -> tuple[int, set[int]]:
    """Hash of the text of a page that may be content, and of its subtrees that may be templates."""
    page = _parsed(source)
    text = "\n".join(b.text for b in _content(page))
    return xxhash.xxh64_intdigest(text) - 2**63, {e.hash for e in page.elements if _may_be_template(e)}


def _count_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, texts, hashes = [], [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            text, trees = subtree_hashes(source)
            # One row without a hash counts the page itself.
            own = [None, *sorted(trees)]
            hosts += [host] * len(own)
            texts += [text] * len(own)
            hashes += own
        columns = [pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(hashes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "page", "hash"])


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32())
    for batch in batches:
        pages = [content_blocks(source) for source in batch.column("html").to_pylist()]
        lists = [pa.array([page[i] for page in pages], pa.list_(kind)) for i, kind in enumerate(kinds)]
        rest = [batch.column(n) for n in batch.schema.names if n != "html"]
        names = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*rest, *lists], [*names, "texts", "own", "hashes", "around"])


@F.pandas_udf(T.StringType())
def _without_templates(texts: pd.Series, own: pd.Series, hashes: pd.Series, around: pd.Series, templates: pd.Series) -> pd.Series:
    """Joins the blocks of each page that stand in no template of its host; NULL for NULLs."""
    found = []
    for words, nodes, trees, outers, known in zip(texts, own, hashes, around, templates, strict=True):
        if known is None:
            found.append(None)
            continue
        known, gone = set(known.tolist()), []
        for tree, outer in zip(trees.tolist(), outers.tolist(), strict=True):
            gone.append(tree in known or outer >= 0 and gone[outer])
        found.append("\n\n".join(text for text, node in zip(words, nodes.tolist(), strict=True) if node < 0 or not gone[node]))
    return pd.Series(found, dtype=object)


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without user and port; '' if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def site_templates(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE
) -> DataFrame:
    """(host, templates): hashes of the subtrees on many different pages; takes the columns host and html."""
    rows = pages.select("host", "html").mapInArrow(_count_rows, "host string, page bigint, hash bigint")
    counts = rows.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    n_pages = counts.filter("hash is null").select("host", F.col("n").alias("n_pages"))
    often = counts.filter(F.col("hash").isNotNull() & (F.col("n") >= least_pages)).join(n_pages, "host")
    often = often.filter(F.col("n") >= F.col("n_pages") * least_share)
    # Each stands on a part of the pages at least, so a host has few of them.
    return often.groupBy("host").agg(F.collect_set("hash").alias("templates"))


def main_texts(
    pages: DataFrame,
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: id, url, text and n_chars."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        host_of(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    templates = site_templates(rows, least_pages, least_share)
    blocks = rows.mapInArrow(
        _block_rows,
        f"id {kind}, url string, host string, texts array<string>, own array<int>, hashes array<bigint>, around array<int>",
    )
    # Pages without a doubtful block need no templates: they are dealt out by themselves.
    alone = F.concat(F.lit("/"), F.xxhash64("id", "url", F.size("texts")).cast("string"))
    keyed = blocks.withColumn("key", F.when(F.size("hashes") > 0, F.col("host")).otherwise(alone))
    joined = keyed.join(templates.select(F.col("host").alias("key"), "templates"), "key", "left")
    # Only pages of hosts with templates are sent through Python once more.
    doubtful = F.col("templates").isNotNull()
    sent = [F.when(doubtful, F.col(c)) for c in ("texts", "own", "hashes", "around", "templates")]
    text = F.coalesce(_without_templates(*sent), F.array_join("texts", "\n\n"))
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).select(
        "*", F.length("text").cast("bigint").alias("n_chars")
    )

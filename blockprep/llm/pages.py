"""Main text of web pages, with the templates of their sites removed.

Each page is read into a flat list of tags and texts with its elements as ranges.  Block
elements outside articles are hashed with all inside them, and Spark counts for each host on
how many different pages an element stands: one that stands on at least ``PAGES`` and on a
share ``SHARE`` of the host's is the site's template and is deleted.  Pages of equal or nearly
equal text count once (MinHash bands on the text that is left without templates, components of
pages that share a band), so that a copied or slightly edited story is no template of its
copies.  Inside the articles that are taken nothing is deleted for its hash.

Before that, elements that say what they are by tag, role or class (navigation, forms, adverts,
comments and so on) are deleted.  A class or id says so by its first or last word, so that
``no-sidebar`` or ``related-work`` say nothing.  Where this would leave less than ``LITTLE`` of a
page's text, elements that hold more than half of it stay, whatever their names, unless these
name adverts, comments or notices of consent.

The main text is that of the articles in page order, or of the main elements if there is no
article or they hold little of their text (less than ``LITTLE``), else of the body.

Where pages are mostly template, they count as near copies and the template stays.

NULL and empty pages have no text.  Pages without an URL share the empty host.  Rows equal in
id and html get equal texts.  Broken markup is read as far as it goes: paragraphs and list
items end where the next one begins, stray end tags are ignored, open elements end with the
page, and so does a tag that the page's end cuts.  Reading takes time in proportion to the
page, whatever its depth and quotes.  An empty table gives no rows.  Columns named like a new
one are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprep.llm.common import utf8, with_columns
from blockprep.llm.components import stars
from blockprep.llm.minhash import band_hashes, bin_values, shingle_sets
from blockprep.sources.storage import new_path

#: An element that stands on so many different pages of a host, and on this share of them, is a template.
PAGES, SHARE = 5, 0.25
#: Articles of less than this part of the main elements' text are not the page's main text, and names
#: that leave less than this part of a page's text are not believed.
LITTLE = 0.25
#: Templates of all hosts go to every task up to this size; beyond it each page is joined with its own.
#: A host has at most 1 / ``SHARE`` times as many as its pages have blocks on average.
BROADCAST_BYTES = 32 << 20
#: Bins in a band of a page's text: texts of similarity 0.5 share one in 16 cases, of 0.85 in 99 of 100.
BAND = 8

# Elements by what they do to the text around them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp math".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
ITEM_SCOPE = set("ul ol menu dl select table article section div body html".split())
# Start tags, the open element that they end if it is the nearest, and what hides it from them.
ENDING = (
    (ENDS_P, {"p"}, {"button", "table", "td", "th"}),
    ({"li"}, {"li"}, ITEM_SCOPE),
    ({"dt", "dd"}, {"dt", "dd"}, ITEM_SCOPE),
    ({"option"}, {"option"}, ITEM_SCOPE),
    ({"tr"}, {"tr", "td", "th"}, ITEM_SCOPE),
    ({"td", "th"}, {"td", "th"}, ITEM_SCOPE),
)
HASHED = BLOCK - {"article", "body", "br", "hr", "html", "legend", "main", "option"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
GONE = set(
    "head script style noscript template textarea title iframe svg math nav aside footer button select "
    "dialog menu object canvas audio video map input".split()
)
# Elements that may also hold a whole page.
DOUBTFUL = {"form", "search"}
GONE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
GONE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share "
    "comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup "
    "popover promo promotion promoted related replies reply responses search share sharing sidebar signin signup "
    "skip social sponsor sponsored subscribe subscription toc toolbar topbar tracking widget widgets".split()
)

# Names of adverts, comments and consent, which say so as first word too, and are believed in any case.
SURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus gdpr newsletter pagination replies sponsor sponsored".split()
)
NEGATIONS = set("has no non not with without".split())
WRAPPERS = set(
    "area bar block body bottom box button buttons col column container content form group holder inner item items "
    "left links list outer panel right row section slot top unit wrap wrapper".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_WORDS = re.compile(r"[a-z]{2,}")
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _by_tag() -> tuple[dict[str, list[int]], dict[str, list[tuple[int, bool]]]]:
    """Of each tag: which rules it sets off, and for which it is (or else hides) what they end."""
    sets_off: dict[str, list[int]] = {}
    marks: dict[str, list[tuple[int, bool]]] = {}
    for rule, (starts, ends, scope) in enumerate(ENDING):
        for tag in starts:
            sets_off.setdefault(tag, []).append(rule)
        for tag in ends | scope:
            marks.setdefault(tag, []).append((rule, tag in ends))
    return sets_off, marks


_SETS_OFF, _MARKS = _by_tag()


class Page:
    """Tags and texts of a page in order, and its elements as ranges of them."""

    def __init__(self, source: str) -> None:
        self.items: list[str] = []  # "<tag", ">tag" or "=text"
        self.tag: list[str] = []
        self.first: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.attributes: list[str] = []
        self._open: list[int] = []
        self._near = [(-1,) * len(ENDING)]  # of each open element: the depth of what a rule would end
        self._depths: dict[str, list[int]] = {}  # of each tag: where it is open
        self._read(source)

    def _text(self, text: str) -> None:
        if text:
            self.items.append("=" + text)

    def _start(self, tag: str, attributes: str) -> None:
        for rule in _SETS_OFF.get(tag, ()):
            self._close_to(self._near[-1][rule])
        depth, near = len(self._open), self._near[-1]
        if marks := _MARKS.get(tag):
            changed = list(near)
            for rule, ended in marks:
                changed[rule] = depth if ended else -1
            near = tuple(changed)
        self.parent.append(self._open[-1] if self._open else -1)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.first.append(len(self.items))
        self.end.append(-1)
        self.items.append("<" + tag)
        self._open.append(len(self.tag) - 1)
        self._near.append(near)
        self._depths.setdefault(tag, []).append(depth)

    def _close_to(self, depth: int) -> None:
        """End the open element at this depth, if there is one, and all inside it."""
        while 0 <= depth < len(self._open):
            self._finish()

    def _finish(self) -> None:
        node = self._open.pop()
        self._near.pop()
        self._depths[self.tag[node]].pop()
        self.items.append(">" + self.tag[node])
        self.end[node] = len(self.items)

    def _read(self, source: str) -> None:
        at = 0
        while match := _TAG.search(source, at):
            self._text(source[at : match.start()])
            at = match.end()
            closing, tag, attributes = match.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._close_to((self._depths.get(tag) or [-1])[-1])
                continue
            self._start(tag, attributes)
            if tag in VOID or (tag in RAW and attributes.endswith("/")):
                self._finish()
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else len(source)
                self._finish()
        self._text(source[at:])
        while self._open:
            self._finish()

    def digests(self) -> list[int]:
        """Of each block element with text: a hash of all inside it, attributes aside; else 0.

        An element's hash takes those of the blocks in it, so that each item is read once.
        """
        out, node = [0] * len(self.tag), -1
        stack: list[tuple[int, list[str], list[bool]]] = [(-1, [], [])]
        for item in self.items:
            node += item[0] == "<"
            name = item[1:]
            if item[0] == "=":
                if words := " ".join(name.split()):
                    stack[-1][1].append("=" + words)
                    stack[-1][2].append(True)
            elif name not in HASHED:
                stack[-1][1].append(item)
            elif item[0] == "<":
                stack.append((node, [item], []))
            else:
                own, parts, has_text = stack.pop()
                digest = hashlib.blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest()
                stack[-1][1].append("#" + digest.hex())
                if has_text:
                    out[own] = int.from_bytes(digest, "little", signed=True)
                    stack[-1][2].append(True)
        return out

    def lengths(self, skipped: list[bool]) -> list[int]:
        """Of each element, and last of the page: the characters of text in it outside skipped elements."""
        sizes = [len("".join(i[1:].split())) if i[0] == "=" else 0 for i in self.items]
        for n, skip in enumerate(skipped):
            if skip and not (self.parent[n] >= 0 and skipped[self.parent[n]]):
                width = self.end[n] - self.first[n]
                sizes[self.first[n] : self.end[n]] = [0] * width
        total = [0, *accumulate(sizes)]
        return [total[e] - total[f] for f, e in zip(self.first, self.end)] + [total[-1]]

    def within(self, names: set[str]) -> list[bool]:
        """Of each element: is it, or does it stand in, one of these?"""
        out: list[bool] = []
        for tag, parent in zip(self.tag, self.parent):
            out.append(tag in names or (parent >= 0 and out[parent]))
        return out


def block_hashes(page: Page) -> list[int]:
    """Distinct hashes of the page's blocks with text outside articles."""
    skipped = page.within(RAW | {"head", "article"})
    return sorted({d for d, skip in zip(page.digests(), skipped) if d and not skip})


def contents(texts: list[str]) -> tuple[list[int], np.ndarray]:
    """A hash of each text's set of shingles, 0 if it is empty, and the bands of the set."""
    sets = shingle_sets(*utf8(pa.array(texts, pa.string())))
    whole = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else 0 for s in sets]
    return whole, band_hashes(bin_values(sets), BAND)


def _name_says(name: str) -> int:
    """Does a class name or id say that its element is not main text?  2: surely, 1: perhaps."""
    words = _WORDS.findall(name)
    if not words or words[0] in NEGATIONS:
        return 0
    if words[0] in SURE_WORDS:
        return 2
    while words and words[-1] in WRAPPERS:
        words.pop()
    last = words[-1] if words else ""
    return 2 if last in SURE_WORDS else int(last in GONE_WORDS)


def _attributes_say(tag: str, text: str, in_article: bool) -> int:
    said = int(bool(_HIDDEN.search(_QUOTED.sub("", text))))
    for name, *values in _ATTRIBUTE.findall(text):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role" and value.strip() in GONE_ROLES:
            said = max(said, 1)
        # The id of a heading, or of an article's section, is a place to link to and tells its subject.
        elif name == "class" or (name == "id" and tag not in HEADINGS and not (in_article and tag == "section")):
            said = max([said, *map(_name_says, value.split())])
    return said


def _gone(page: Page, in_article: list[bool]) -> list[bool]:
    """Of each element: does it, or one around it, say that it is not main text?"""
    titles = [0, *accumulate(tag in ("h1", "h2") for tag in page.tag)]
    says = []
    for node, (tag, attributes) in enumerate(zip(page.tag, page.attributes)):
        said = 2 if tag in GONE else int(tag in DOUBTFUL)
        if tag == "header":
            last = bisect_left(page.first, page.end[node])
            said = int(not (in_article[node] and titles[last] > titles[node]))
        elif said < 2 and attributes and tag not in ("html", "body", "main"):
            said = max(said, _attributes_say(tag, attributes, in_article[node]))
        says.append(said)

    def inherited(least: int) -> list[bool]:
        out: list[bool] = []
        for said, parent in zip(says, page.parent):
            out.append(said >= least or (parent >= 0 and out[parent]))
        return out

    gone = inherited(1)
    if any(gone):
        held, left = page.lengths(inherited(2)), page.lengths(gone)[-1]
        if left < LITTLE * held[-1]:
            says = [0 if said == 1 and 2 * own > held[-1] else said for said, own in zip(says, held)]
            gone = inherited(1)
    return gone


def main_text(source: str | Page, templates: set[int]) -> str:
    """The blocks of the page's main text, one to a line."""
    page = Page(source) if isinstance(source, str) else source
    in_article = page.within({"article"})
    dead = _gone(page, in_article)
    if templates:
        for node, digest in enumerate(page.digests()):
            parent = page.parent[node]
            dead[node] |= (parent >= 0 and dead[parent]) or (digest in templates and not in_article[node])

    def outermost(nodes: list[int], names: list[bool]) -> str:
        tops = [n for n in nodes if not dead[n] and (page.parent[n] < 0 or not names[page.parent[n]])]
        return "\n".join(filter(None, (_blocks(page, dead, page.first[n], page.end[n]) for n in tops)))

    articles = outermost([n for n, tag in enumerate(page.tag) if tag == "article"], in_article)
    is_main = [tag == "main" or 'role="main"' in text for tag, text in zip(page.tag, page.attributes)]
    in_main: list[bool] = []
    for own, parent in zip(is_main, page.parent):
        in_main.append(own or (parent >= 0 and in_main[parent]))
    main = outermost([n for n, own in enumerate(is_main) if own], in_main)
    if articles and len(articles) >= LITTLE * len(main):
        return articles
    return main or _blocks(page, dead, 0, len(page.items))


def _blocks(page: Page, gone: list[bool], first: int, end: int) -> str:
    skip = {page.first[n]: page.end[n] for n, dead in enumerate(gone) if dead}
    blocks, parts, at = [], [], first
    while at < end:
        if at in skip:
            at = skip[at]
            parts.append(" ")
            continue
        item = page.items[at]
        at += 1
        if item[0] == "=":
            parts.append(item[1:])
        elif item[1:] in BLOCK:
            blocks.append(parts)
            parts = []
    blocks.append(parts)
    cleaned = (" ".join(entities.unescape("".join(block)).split()) for block in blocks)
    return "\n".join(block for block in cleaned if block)


def _templates(seen: DataFrame, least: int, share: float) -> DataFrame:
    """(_host, hash) of elements on enough different pages; near copies are one page."""
    inside = seen.select(F.col("_content").alias("u"), F.explode("_bands").alias("band")).distinct()
    shared = inside.groupBy("band").agg(F.min("u").alias("v"), F.max("u").alias("most")).where("v < most")
    roots = stars(inside.join(shared, "band").select("u", "v").distinct())
    # Equal pages are one row before they meet their component and before their blocks are rows.
    found = seen.select("_host", F.col("_content").alias("u"), "_hashes").distinct().join(roots, "u", "left")
    found = found.select("_host", "_hashes", F.coalesce("v", "u").alias("page"))
    pages = found.select("_host", "page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("pages"))
    blocks = found.select("_host", "page", F.explode("_hashes").alias("hash")).distinct()
    counted = blocks.groupBy("_host", "hash").agg(F.count(F.lit(1)).alias("n"))
    enough = counted.where(F.col("n") >= least).join(pages, "_host").where(F.col("n") >= F.col("pages") * share)
    return enough.select("_host", "hash")


def extract_text(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    into: str = "text",
    page_id: str = "page_id",
    least: int = PAGES,
    share: float = SHARE,
) -> DataFrame:
    """All rows with the page's main text."""
    names = [c for c in pages.columns if c.lower() not in (into.lower(), "_page", "_host", "_templates", "_content", "_bands", "_hashes")]
    pages = pages.select(*[F.col(f"`{c}`") for c in names]).select(
        "*",
        F.struct(F.col(f"`{page_id}`").alias("id"), F.xxhash64(F.col(f"`{html}`")).alias("hash")).alias("_page"),
        F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), _HOST, 1), F.lit(""))).alias("_host"),
    )

    def make_hashes() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            read = [Page(x or "") for x in piece.column(html).to_pylist()]
            whole, bands = contents([main_text(page, set()) for page in read])
            bands = [b if w else [] for w, b in zip(whole, bands.tolist())]
            longs = pa.list_(pa.int64())
            return [pa.array(whole, pa.int64()), pa.array(bands, longs), pa.array([block_hashes(p) for p in read], longs)]

        return work

    fields = [("_content", "long"), ("_bands", "array<long>"), ("_hashes", "array<long>")]
    path = new_path(pages.sparkSession, "page-hashes")
    with_columns(pages.select("_page", "_host", html), html, fields, make_hashes, without=(html,)).write.parquet(path)
    seen = pages.sparkSession.read.parquet(path)
    templates = new_path(pages.sparkSession, "page-templates")
    by_host = _templates(seen, least, share).groupBy("_host").agg(F.collect_list("hash").alias("_templates"))
    by_host.write.parquet(templates)
    by_host = pages.sparkSession.read.parquet(templates)
    size = by_host.agg(F.sum(F.size("_templates") * 8 + F.octet_length("_host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(by_host), "_host", "left")
    else:
        recurring = by_host.select("_host", F.explode("_templates").alias("hash"))
        own = seen.select("_page", "_host", F.explode("_hashes").alias("hash")).join(recurring, ["_host", "hash"])
        own = own.groupBy("_page").agg(F.collect_set("hash").alias("_templates"))
        # A page's identity may hold a NULL id, which equals itself here.
        joined = pages.join(own.withColumnRenamed("_page", "_own"), F.col("_page").eqNullSafe(F.col("_own")), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in names], "_templates")

    def make_text() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(piece: pa.RecordBatch) -> list[pa.Array]:
            known = piece.column("_templates").to_pylist()
            sources = piece.column(html).to_pylist()
            return [pa.array([main_text(s or "", set(t or ())) for s, t in zip(sources, known)], pa.string())]

        return work

    return with_columns(joined, html, [(into, "string")], make_text, without=("_templates",))

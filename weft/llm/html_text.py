"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices, small_batches

# Element names of the HTML standard, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math canvas".split())
FURNITURE_TAGS = frozenset(
    "nav header footer aside form dialog menu search button select datalist option head object audio video".split()
) | RAW
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense advertorial banner banners sponsor sponsored "
    "sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar "
    "sidebars rail aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login signin register search searchbox "
    "comment comments commentlist disqus respond replies share sharing social related recommended "
    "recommendations widget widgets pager pagination paging copyright disclaimer skip".split()
)
# Words that may stand beside one of those in a compound name ("site-footer", "related-posts").
COMPANIONS = frozenset(
    "area bar block body bottom box button buttons card container content form global group header holder inner "
    "item items left link links list main message module outer page panel policy post posts primary right row "
    "section secondary site slot stories articles text thread title top unit wrap wrapper".split()
)
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p li td th dt dd pre blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE_TAGS = frozenset("html body main article".split())
WHOLE = frozenset("# html body".split())
#: An open element of the key's name ends where one of the listed elements begins.
ENDED_BY = {
    "p": BLOCK - {"li", "td", "th", "tr", "dt", "dd", "tbody", "thead", "tfoot", "option"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
PUNCTUATION = re.compile(r"[,.;:!?…،。，、；：！？¿¡]")

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))")
WORD = re.compile(r"[a-z]+")

#: The smoothing kernel over neighbouring blocks, the share of the mean score (by characters) that a
#: path must reach, and what a path's ratio is worth where an element on it is named as furniture.
SMOOTHING = (0.25, 0.5, 0.25)
THRESHOLD = 0.5
NAMED = 0.0001
#: A path with this share of its text in links, and with less than one mark of punctuation to a block, is a list of links.
LINKS = 0.5


class Element:
    """An open element: its tag path as a number, the block it is in, and its span in page order."""

    __slots__ = ("tag", "parent", "path", "depth", "serial", "last", "block", "gate", "out", "named", "article", "linked")

    def __init__(self, tag: str, parent: Element | None, path: int, serial: int, out: bool, named: bool):
        self.tag, self.parent, self.path, self.serial, self.last = tag, parent, path, serial, serial
        self.depth = parent.depth + 1 if parent else 0
        self.out = out or (parent is not None and parent.out)
        self.named = named or (parent is not None and parent.named)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.linked = tag == "a" or (parent is not None and parent.linked)
        edge = parent is None or tag in BLOCK or self.out != parent.out or self.named != parent.named
        self.block = self if edge else parent.block
        self.gate = self if parent is None or tag in ENDED_BY or tag in SCOPES else parent.gate


#: Elements beyond which an end tag is not implied.
SCOPES = frozenset("table ul ol dl article section div body".split())


class Block:
    __slots__ = ("element", "text", "linked", "marks")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, min(linked, len(text))
        self.marks = len(PUNCTUATION.findall(text))


def names_furniture(tag: str, attributes: str) -> bool:
    """Whether a class or id names furniture: one of the words, alone or only with their companions."""
    if not attributes or tag in PAGE_TAGS:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for whole in (a or b or c).lower().split():
                words = WORD.findall(whole)
                if not FURNITURE_WORDS.isdisjoint(words) and all(w in FURNITURE_WORDS or w in COMPANIONS for w in words):
                    return True
    return False


def is_outside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the page's markup itself says that an element is no part of an article, or not shown."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return True
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value.strip() in FURNITURE_ROLES or name == "aria-hidden" and value == "true":
            return True
    return bool(attributes) and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) is not None


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, each with the element that holds it."""
    out: list[Block] = []
    paths: dict[tuple[int, str, bool], int] = {}
    root = top = Element("#", None, 0, 0, False, False)
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    holder, linked, serial = root, 0, 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(holder, text, linked))
            parts.clear()
        linked = 0

    def close_element(e: Element) -> Element:
        """Close ``e`` and all that is open in it."""
        x = top
        while x is not e.parent:
            x.last = serial
            open_tags[x.tag] -= 1
            x = x.parent
        return x

    at = 0
    while True:
        m = TOKEN.search(page, at)
        run = page[at : m.start()] if m else page[at:]
        if run:
            if not parts:
                holder = top.block
            run = html.unescape(run) if "&" in run else run
            parts.append(run)
            if top.linked:
                linked += len(run)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                holder = holder if parts else top.block
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag in BLOCK or top.out or top.named:
                close_block()
            if open_tags.get(tag):
                e = top
                while e.tag != tag:
                    e = e.parent
                top = close_element(e)
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(tag)}\s*+[^>]*+>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            close_block()
            e = top.gate
            while e.parent and not (e.tag in ENDED_BY and tag in ENDED_BY[e.tag]) and e.tag not in SCOPES:
                e = e.parent.gate
            if e.parent and e.tag not in SCOPES:
                top = close_element(e)
        if tag in VOID:
            continue
        outside, named = is_outside(tag, attributes, top.article), names_furniture(tag, attributes)
        if outside and not top.out or named and not top.named:
            close_block()
        serial += 1
        path = paths.setdefault((top.path, tag, named), len(paths) + 1)
        top = Element(tag, top, path, serial, outside, named)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    close_block()
    while top is not None:
        top.last = serial
        top = top.parent
    return out


class Path:
    """What the blocks of one tag path hold together."""

    __slots__ = ("chars", "marks", "linked", "blocks")

    def __init__(self):
        self.chars = self.marks = self.linked = self.blocks = 0

    def ratio(self, named: bool) -> float:
        """Text to a block, raised by punctuation and lowered by links."""
        plain = 1 - self.linked / self.chars
        return self.chars / self.blocks * (1 + self.marks / self.blocks) * plain * plain * (NAMED if named else 1)

    def link_list(self) -> bool:
        return self.linked > LINKS * self.chars and self.marks < self.blocks


def path_scores(found: list[Block]) -> tuple[list[float], dict[int, Path]]:
    """A score for each block and the totals of each path.

    Text and punctuation are added up by path. The ratios of the blocks' paths are smoothed along
    the page, and each block's smoothed ratio is fused with its path's own by the geometric mean;
    the square root brings the score back to the scale of a block's length.
    """
    paths: dict[int, Path] = {}
    for b in found:
        p = paths.setdefault(b.element.path, Path())
        p.chars += len(b.text)
        p.marks += b.marks
        p.linked += b.linked
        p.blocks += 1
    own = [paths[b.element.path].ratio(b.element.named) for b in found]
    left, mid, right = SMOOTHING
    last = len(own) - 1
    smooth = [left * own[max(i - 1, 0)] + mid * x + right * own[min(i + 1, last)] for i, x in enumerate(own)]
    return [(x * y) ** 0.25 for x, y in zip(own, smooth, strict=True)], paths


def lowest_common(a: Element, b: Element) -> Element:
    """The deepest element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def content(found: list[Block]) -> list[bool]:
    """Which blocks are the article's.

    A path whose mean score reaches THRESHOLD of the page's mean (by characters) holds content: all
    its blocks are chosen. The region of the article is the deepest element that holds them, or
    the article or main element around it, and a first heading before it that shares an element
    with it other than the whole page; on a page without such an element it runs from the first
    chosen block, or the headings right before it, to the last. In the region blocks that aren't
    chosen stay too (headings, items, short lines) unless their path is a list of links or is named as
    furniture, or they stand before the first heading or after the last chosen block in an element
    that isn't made for text, on a path without punctuation. A heading stays with what it heads.
    """
    scores, paths = path_scores(found)
    sums: dict[int, float] = {}
    for b, s in zip(found, scores, strict=True):
        sums[b.element.path] = sums.get(b.element.path, 0.0) + s
    bar = THRESHOLD * sum(s * len(b.text) for b, s in zip(found, scores, strict=True)) / sum(len(b.text) for b in found)
    good = {p for p, s in sums.items() if s >= bar * paths[p].blocks}
    chosen = [b.element.path in good for b in found]
    at = [i for i, c in enumerate(chosen) if c]
    first, last = at[0], at[-1]
    inner = [found[i].element for i in at]
    region = lowest_common(min(inner, key=lambda e: e.serial), max(inner, key=lambda e: e.serial))
    while region.parent and region.tag in FLOW:
        region = region.parent  # what stands beside a single paragraph belongs to it
    around = region
    while around and around.tag not in ("article", "main"):
        around = around.parent
    region = around or region
    title = next((b.element for b in found[:first] if b.element.tag == "h1" and not paths[b.element.path].link_list()), None)
    if title and not around:
        wider = lowest_common(title, region)
        region = region if wider.tag in WHOLE else wider
    if region.tag in WHOLE:
        while first and found[first - 1].element.tag in HEADINGS:
            first -= 1
        inside = [first <= i <= last for i in range(len(found))]
    else:
        inside = [region.serial <= b.element.serial <= region.last for b in found]
    top = next((i for i in range(first) if inside[i] and found[i].element.tag in HEADINGS), first)
    keep = []
    for i, b in enumerate(found):
        p = paths[b.element.path]
        other = not b.element.named and not p.link_list() and (top <= i <= last or b.element.tag in FLOW or p.marks > 0)
        keep.append(chosen[i] or inside[i] and other)
    follows = False  # whether the next block that is no heading stays, and is in the same region
    for k in range(len(found) - 1, -1, -1):
        if found[k].element.tag not in HEADINGS:
            follows = keep[k]
        elif found[k].element.tag != "h1" and not chosen[k]:
            keep[k] = keep[k] and follows
    return keep


def main_text(page: str) -> str:
    """The article's blocks joined by line ends, chosen by ``content``.

    Elements that the markup itself sets apart (navigation, page headers and footers, asides, forms,
    hidden ones) are left out first; class and id names only lower a path's ratio.
    """
    found = [b for b in blocks(page) if not b.element.out]
    if not found:
        return ""
    return "\n".join(b.text for b, k in zip(found, content(found), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    Defined cases: null and empty html give empty text; pages without any text outside what the markup
    sets apart give empty text; elements may be nested to any depth; nothing is cut from long pages; a null url stays null; repeated
    rows are extracted alike; an empty table gives no rows; extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    source = pages.select(pages[id_col].alias("id"), pages["url"].alias("url"), pages[html_col].alias("html"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    return source.mapInArrow(lean(run), f"id {id_type}, url string, text string, n_chars long").withColumnRenamed("id", id_col)

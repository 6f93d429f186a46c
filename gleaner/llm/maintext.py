"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser hands over tags and text; each block-level tag ends a line. A line has
its text, the tags it was made of, its linked characters and the container it stands in. Its ratio
is unlinked text over tags; lines in menus, forms, notices and the like have ratio 0. Ratios are
smoothed by a Gaussian over neighbouring lines, and lines above a threshold (a share of the standard
deviation) cluster into content regions. The regions choose the container: an article or main
element that holds one, else the deepest element that holds all their dense lines, or one
around it that has region text of its own beside them. All lines of that container outside menus, forms,
notices, adverts and comments are the main text, so that a short paragraph between long ones is kept.

What is no main text is told by tags, roles, hiding attributes and the words of class and id, and by place,
never by size. Outside an article any marking word drops its element; inside one each word of the
class or id has to be a mark or a word for a part of a page (`share-buttons`, but not `share-prices`). An element
around all articles of the page isn't marked by its class, comments and related pages excepted. Inline elements
are dropped alike. Of an article's own header its headings stay. Where nothing is left, the text is empty.

Edge cases: a null or empty page, and one without unlinked text, has the empty text; text outside
any markup is one block; rows with a null id, a null url and repeated rows pass through; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that end a line. Block-level elements of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold other blocks and are tracked as containers.
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header html iframe main menu nav noscript ol section select svg table template ul button textarea object audio video canvas search".split())
#: Elements whose text is never main text.
DROPPED = frozenset("aside audio button canvas dialog fieldset footer form head iframe menu nav noscript object search select svg template textarea title video".split())
#: Words of a class or an id that mark menus, notices, adverts, forms, comments and the like.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Marks that count around articles too, words that undo the marks after them, and words for parts of a page.
ALWAYS = frozenset("comment comments disqus recommended related replies reply respond".split())
UNDONE = frozenset("has no with without".split())
PARTS = frozenset("area article bar block bottom box btn button buttons container content entry footer form header icon icons inline inner item items left link links list main module outer page panel post right row section slot small text title top unit wrap wrapper".split())
#: Inline elements of forms, whose text is never main text, and inline elements without an end.
CONTROLS = frozenset("datalist label meter option output progress".split())
EMPTY = frozenset("area base br col embed img input link meta param source track wbr".split())
_HIDING = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Conditional sections, which the parser can't read.
_SECTION = re.compile(r"<!\[(?!CDATA\[)[^>]*>")
SIGMA, SHARE = 1.5, 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset(["hr"])
#: Elements that end an open one of these.
ALONE = {k: group for group in (frozenset(["li"]), frozenset(["dd", "dt"]), frozenset(["td", "th"])) for k in group} | {"tr": frozenset(["td", "th", "tr"])}


@dataclass
class Box:
    """A container: its element, the one around it, whether its text can't be main text."""

    tag: str
    parent: Box | None
    dropped: bool  # by tag or attribute, or in such an element
    article: Box | None = None
    marks: frozenset[str] = frozenset()
    heads: bool = False  # an article's own header, of which headings stay
    articles: int = 0  # articles and main elements in it and below, outside dropped and always marked ones
    depth: int = 0
    dense: int = 0
    inside: bool = False


@dataclass
class Line:
    box: Box
    text: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0
    heading: bool = False


def named(attrs: list[tuple[str, str | None]], whole: bool) -> set[str]:
    """Words of class and id that mark what is no main text; whole: only of names that consist of marks and words for parts."""
    found = set()
    for token in (t for name, value in attrs if name in ("class", "id") and value for t in value.split()):
        marks, rest = set(), False
        for word in (w.lower() for w in _WORDS.findall(token)):
            if word in UNDONE:
                break
            if word in MARKS:
                marks.add(word)
            else:
                rest |= word not in PARTS
        if not (whole and rest):
            found |= marks
    return found


def unseen(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether role, style, aria or hidden attributes say that this is no main text."""
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() in ROLES:
            return True
        if name == "aria-hidden" and value and value.strip().lower() == "true":
            return True
        if name == "style" and value and _HIDING.search(value):
            return True
    return any(name == "hidden" for name, _ in attrs)


class Lines(HTMLParser):
    """Collects a page's lines from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.box = Box("", None, False)
        self.boxes = [self.root]  # a box comes after the one around it
        self.open: Counter[str] = Counter()
        self.lines = [Line(self.root)]
        self.link = 0
        self.heading = ""
        self.muted: list[str] = []  # a dropped inline element and those of its kind in it

    def _leave(self) -> None:
        self.open[self.box.tag] -= 1
        self.box = self.box.parent

    def _new(self) -> None:
        last = self.lines[-1]
        if last.text:
            self.lines.append(Line(self.box))
        else:
            last.box, last.tags = self.box, last.tags + 1
        self.lines[-1].heading = bool(self.heading)
        self.muted.clear()  # no inline element goes on beyond a block

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS or tag in CONTAINERS
        while block and self.box.parent is not None and (self.box.tag == "p" or tag in ALONE and self.box.tag in ALONE[tag]):
            self._leave()  # a marked element whose end tag is left out
        inside = self.box.article
        words = set() if tag in HEADINGS or tag in EMPTY else named(attrs, inside is not None or not block)
        if tag in CONTAINERS or block and tag not in VOID and (words or unseen(attrs)):
            plain = tag in ("html", "body", "main") or (tag == "article" and inside is None)
            heads = tag == "header" and inside is not None
            dropped = self.box.dropped or tag in DROPPED or (tag == "header" and not heads) or (not plain and unseen(attrs))
            if plain:
                words = ALWAYS & named(attrs, True) if tag == "article" else set()
            box = Box(tag, self.box, dropped, inside, frozenset(words), heads or self.box.heads, depth=self.box.depth + 1)
            self.boxes.append(box)
            self.open[tag] += 1
            # the outermost article counts, or a main element without one
            if not dropped and (tag == "article" and (inside is None or inside.tag == "main") or tag == "main" and inside is None):
                box.article = box
            self.box, self.link = box, 0
        if tag in HEADINGS:
            self.heading = tag
        if not block and tag not in EMPTY and (self.muted or words or tag in CONTROLS or unseen(attrs)):
            if not self.muted or self.muted[0] == tag:
                self.muted.append(tag)
        if tag in BLOCKS or tag in CONTAINERS:
            self._new()
            if tag == "title":
                self.lines[-1].box = Box("title", self.box, True)
        else:
            self.lines[-1].tags += 1
            if tag == "br":
                self.lines[-1].text.append(" ")
            elif tag == "a":
                self.link = 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in ("br", "hr", "img", "input", "meta", "link", "p"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.heading:
            self.heading = ""
        if self.muted and self.muted[0] == tag:
            self.muted.pop()
        if tag in CONTAINERS or tag in BLOCKS and self.box.tag == tag:
            if self.open[tag]:  # an end tag without its start is ignored
                while self.box.tag != tag:
                    self._leave()
                self._leave()
            self.link = 0
        if tag in BLOCKS or tag in CONTAINERS:
            self._new()
        else:
            self.lines[-1].tags += 1
            if tag == "a":
                self.link = 0

    def handle_data(self, data: str) -> None:
        if self.muted or self.cdata_elem in ("script", "style"):
            return
        line = self.lines[-1]
        line.text.append(data)
        if self.link:
            line.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's remaining weights count alone."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(_SECTION.sub("", html))
    parser.close()
    return _select(parser)


def _judge(parser: Lines) -> None:
    """Drop what marks say, and all in it: boxes come after those around them."""
    for box in reversed(parser.boxes[1:]):
        box.articles += box.article is box
        if not box.marks & ALWAYS and not box.dropped:
            box.parent.articles += box.articles
    for box in parser.boxes[1:]:
        around = box.articles and box.articles == parser.root.articles and box.article is not box and not box.marks & ALWAYS
        box.dropped |= box.parent.dropped or bool(box.marks) and not around


def _select(parser: Lines) -> str:
    _judge(parser)
    rows = []
    for line in parser.lines:
        text = _SPACE.sub(" ", "".join(line.text)).strip()
        if text and not line.box.dropped and (line.heading or not line.box.heads):
            rows.append((line, text))
        elif text:
            rows.append((line, ""))
    if not any(text for _, text in rows):
        return ""
    # a single block has no neighbours to differ from
    raw = np.array([max(0, len(text) - line.linked) / line.tags if text else 0.0 for line, text in rows])
    ratio = smooth(raw)
    border = SHARE * float(ratio.std())
    region, core = ratio >= border, raw >= border
    articles: list[Box] = []
    direct: set[int] = set()
    for (line, text), on, dense in zip(rows, region, core, strict=True):
        if not (on and text):
            continue
        size = max(1, len(text) - line.linked)
        if len(text) > line.linked:
            direct.add(id(line.box))
        if line.box.article is not None:
            articles.append(line.box.article)
        line.box.dense += size if dense else 0
    for box in reversed(parser.boxes[1:]):
        box.parent.dense += box.dense
    if articles:
        # several articles of one page
        chosen = [b for b in articles if b.tag == "article"] or articles
    else:
        deepest = max((b for b in parser.boxes if b.dense == parser.root.dense), key=lambda b: b.depth)
        above = deepest  # the highest element around it that has region text of its own, as a heading or lead
        while above.parent is not None:
            above = above.parent
            if id(above) in direct:
                deepest = above
        chosen = [deepest]
    for box in chosen:
        box.inside = True
    for box in parser.boxes[1:]:
        box.inside |= box.parent.inside
    return "\n\n".join(text for line, text in rows if text and line.box.inside)


def main_text(html: Column) -> Column:
    """The main text of a column of pages."""

    @F.pandas_udf("string")
    def udf(col: pd.Series) -> pd.Series:
        return pd.Series([extract(h) if isinstance(h, str) else "" for h in col], dtype=object)

    return udf(html)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), main_text(F.col(html).cast("string")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))

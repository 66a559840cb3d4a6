"""The main text of web pages: parser events become lines, lines with much text a tag are content, and the region that holds them is the article.

1. The standard library's parser streams a page's events. Block elements end lines; a line knows its text, its characters outside links, its tags and
   the container (a sectioning element) that it stands in. What an element's name, role or class says to be a menu, header, footer, sidebar, notice,
   advert, form, script, style or comment is boilerplate: its lines have a ratio of zero and are never shown.
2. Text-to-tag ratios, one a line, are smoothed by a Gaussian, so that a short line between long ones isn't lost and a long one among links
   doesn't stand out; lines at or above the threshold, the smoothed ratios' standard deviation, are the content cluster.
3. The region is the article or main element that holds most characters of the cluster; without such elements it is found by going down from the page's
   root as long as one container holds nearly all of them. All lines of the region but boilerplate are the text, however short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released

#: Standard deviation of the smoothing, in lines, and the share of the cluster that a container must hold to be gone into.
SIGMA, HOLDS = 1.5, 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article aside body center div footer form header html main nav section td th".split())
BLOCKS = SECTIONS | frozenset("address blockquote caption dd details dialog dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head hgroup hr legend li menu ol option p pre search summary table tbody tfoot thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold an article's text; a header inside an article is judged by its class alone.
BARRED = frozenset("aside button canvas dialog footer form head header iframe input menu nav noscript object script search select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or an id.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter "
    "subscribe subscription signup login signin sidebar aside menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead footer toolbar pagination pager share sharing social "
    "related recommended recommendations comment comments commentlist discussion disqus replies reply respond form search searchbox skip".split()
)
#: Elements that a start tag of the name ends, if one is open in the same container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_WORD = re.compile(r"[a-z]+|[0-9]+")


def _barred(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in BARRED and not (tag == "header" and in_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and (value or "").strip().lower() in ROLES:
            return True
        if name in ("class", "id") and value and not NAMES.isdisjoint(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())):
            return True
    return False


class Lines(HTMLParser):
    """The lines of a page by its parser's events. Each: [text, characters outside links, tags, container, whether it is boilerplate, whether it is a heading]"""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []
        #: Of each container its parent and its element's name; 0 is the page.
        self.parent, self.kind = [-1], ["page"]
        #: Open elements: (name, container, whether boilerplate, whether in an article, whether its block is boilerplate)
        self.open: list[tuple[str, int, bool, bool, bool]] = [("page", 0, False, False, False)]
        self.count: Counter[str] = Counter()
        self._text: list[str] = []
        self._free = self._tags = 0
        self._link = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What looks like a marked section is a comment, as in browsers; the base class raises for unknown ones."""
        return self.parse_bogus_comment(i, report)

    def _end_line(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        if text:
            _, container, _, _, barred = self.open[-1]
            heading = any(x[0] in HEADINGS for x in self.open[-4:])
            self.lines.append((text, self._free, self._tags, container, barred, heading))
            self._tags = 0
        self._text, self._free = [], 0

    def _pop(self, to: int) -> None:
        for name, *_ in self.open[to:]:
            self.count[name] -= 1
        del self.open[to:]

    def _close(self, names: tuple[str, ...], barriers: frozenset[str]) -> bool:
        """Close the innermost open element of these names, unless a barrier stands before it."""
        if not any(self.count[n] for n in names):
            return False
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name in names:
                self._pop(i)
                return True
            if name in barriers:
                return False
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._end_line()
            self._link = 0
            if self.count["p"]:
                self._close(("p",), SECTIONS)
            if tag in ENDS:
                self._close(ENDS[tag], SECTIONS - {"td", "th"} | {"table", "ul", "ol", "dl"})
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        _, container, barred, in_article, block = self.open[-1]
        if tag in SECTIONS:
            self.parent.append(container)
            self.kind.append(tag if tag != "div" or ("role", "main") not in attrs else "main")
            container = len(self.kind) - 1
        barred = barred or _barred(tag, attrs, in_article)
        self.open.append((tag, container, barred, in_article or tag in ("article", "main"), barred if tag in BLOCKS else block))
        self.count[tag] += 1
        self._link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._end_line()
            self._link = 0
            if self.open[-1][0] == tag:
                self._pop(len(self.open) - 1)
            else:
                self._close((tag,), frozenset())
        elif self.count[tag]:
            self._link -= tag == "a" and self._link > 0
            barred = self.open[-1][2]
            if self._close((tag,), BLOCKS) and barred and not self.open[-1][2]:
                self._text.append(" ")

    def handle_data(self, data: str) -> None:
        _, _, barred, _, block = self.open[-1]
        if barred and not block:
            return  # boilerplate inside a line
        self._text.append(data)
        if not self._link:
            self._free += len(data)

    def close(self) -> None:
        """As in browsers, a tag or comment that the page's end cuts off is nothing. (The base class would look for its end again from each of its characters.)"""
        rest = self.rawdata
        if not self.cdata_elem and rest and not re.match("<[a-zA-Z/!?]", rest):
            self.handle_data(unescape(rest))
        self._end_line()


_REACH = int(np.ceil(3 * SIGMA))
_KERNEL = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / SIGMA) ** 2)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios under a Gaussian; at the ends its weights within the page count as one."""
    around = lambda x: np.convolve(x, _KERNEL)[_REACH : _REACH + len(x)]
    return around(ratios) / around(np.ones(len(ratios)))


def main_text(html: str | None) -> str:
    """The article of a page, its blocks parted by an empty line."""
    page = Lines()
    page.feed(html or "")
    page.close()
    lines = page.lines
    if not lines:
        return ""
    ratio = np.array([0.0 if barred else free / max(tags, 1) for _, free, tags, _, barred, _ in lines])
    smooth = smoothed(ratio)
    cluster = (smooth >= smooth.std()) & (ratio > 0)
    weight = np.zeros(len(page.kind))
    for line, chosen in zip(lines, cluster, strict=True):
        if chosen:
            weight[line[3]] += line[1]
    for k in range(len(weight) - 1, 0, -1):  # a container's number is above its parent's
        weight[page.parent[k]] += weight[k]
    own = {line[3] for line in lines if not line[4]}
    for k in range(len(weight) - 1, 0, -1):
        if k in own:
            own.add(page.parent[k])
    named = [k for kind in ("article", "main") for k in sorted(own, key=lambda k: (-weight[k], k)) if page.kind[k] == kind]
    trimmed = not named
    if named:
        region = named[0]
    else:
        region, inner = 0, [[] for _ in weight]
        for k in range(1, len(weight)):
            inner[page.parent[k]].append(k)
        while weight[0] and (deeper := next((k for k in inner[region] if weight[k] >= HOLDS * weight[0]), None)) is not None:
            region = deeper
    inside = np.zeros(len(weight), bool)
    inside[region] = True
    for k in range(region + 1, len(weight)):
        inside[k] = inside[page.parent[k]]
    shown = np.array([inside[line[3]] and not line[4] for line in lines])
    if trimmed and (seeds := np.flatnonzero(shown & cluster)).size:
        first, last = int(seeds[0]), int(seeds[-1])
        while first and (lines[first - 1][5] and shown[first - 1]):
            first -= 1
        shown[:first] = shown[last + 1 :] = False
    return "\n\n".join(line[0] for line, s in zip(lines, shown, strict=True) if s)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page's whole html.

    A null or empty html, and one without an article, gives an empty text. Repeated rows give repeated results, a null page_id or url stays. Other columns, also
    of the names of results, are not read. An empty table gives no rows. Each page is read by itself, so nothing is shuffled."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(released(_texts), "page_id long, url string, text string, n_chars long")

"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The parser's events give lines, one for each block of text, each with its characters and the tags met since the line
before. Ratios of characters to tags are smoothed along the page and split into two clusters, on every page. Lines stand in
regions (article, main, section, div, body); lines inside menus, headers, footers, asides, forms, scripts and styles are never
content. Article and main elements are the content if they hold most of the upper cluster's characters; if not, the regions
in which more than half of the characters fall in the upper cluster are. A region is taken whole, so that short paragraphs stay.

Elements named as adverts, notices, sidebars, reader comments and the like are left out, too, but a name alone never removes an
article or an element with most of the upper cluster: such a one stays if it has an article or three upper lines, and
articles outside of it have less than a tenth of its characters. A name with parts that say nothing (user-comments) is judged by the figures
of its element: it goes if it holds no article, little of the upper cluster, and is mostly links, mostly of the lower cluster, or behind the body.

A null or empty page has empty text, as has one without content. Equal rows give equal results. No rows give no rows. Other
columns are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cirrostrat.runtime import small_batches

#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose ends matter, as they hold regions or what is left out.
NESTED = frozenset("article aside body dialog div footer form header main menu nav section table ul ol dl figure button select textarea noscript template svg title head iframe object".split())
#: Elements that are never content.
LEFT_OUT = frozenset("aside dialog footer form header menu nav button select textarea noscript template svg title head iframe object script style".split())
#: Further elements that can be left out by name, role or `hidden`. Those but span end where another block begins.
TRACKED = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 span".split())
ITEMS = frozenset("li dt dd".split())
ENDED_BY_ITEM, ENDED_BY_BLOCK = TRACKED - {"span"}, TRACKED - ITEMS - {"span"}
#: Class and id names, what may stand beside them in a name, and what tells the state of something else, as in no-sidebar or comment-open.
LEFT_OUT_NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
BESIDE_NAMES = frozenset("area bar block bottom box button buttons card container global google inner item items left links list message outer page policy post posts primary right secondary section signup site slot top unit widgets wrap wrapper".split())
STATES = frozenset("no non not has have with without is are on off open closed show hide hidden active enabled disabled enable disable free".split())
LEFT_OUT_ROLE = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"})
#: A tag that the page ends inside of.
CUT_TAG = re.compile(r"<[/A-Za-z!?][^<>]*\Z")
HOLDERS = frozenset({"article", "main", "section", "div", "body"})


def named_out(names: str) -> int:
    """2 if one of the names, each taken whole, is that of something beside the content; 1 if a part of one is, and no other part tells more."""
    found = 0
    for name in names.lower().split():
        parts = {x for x in re.split(r"[-_]+|\d+", re.sub(r"\d+x\d+", "", name)) if x}
        if parts & LEFT_OUT_NAMES and not parts & STATES:
            found = max(found, 2 if parts <= LEFT_OUT_NAMES | BESIDE_NAMES else 1)
    return found


class Lines(HTMLParser):
    """Collects [text, tags, region, in an article, left out, characters in links] for each block, and the lines of elements that names would leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []
        self.open: list[tuple[str, bool, int, list[str] | None]] = []
        self.regions, self.region, self.articles, self.out, self.seen = 0, [0], 0, 0, False
        #: By element: its first line, the line after its last, and how sure its name is; the open ones.
        self.named: list[list[int]] = []
        self.names: list[int] = []
        self.linked, self.in_link = 0, False
        self.text: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.region[-1], self.articles > 0, self.out > 0, min(self.linked, len(text))))
            self.tags = self.linked = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in LEFT_OUT:
            self.end_line()
            if tag in BLOCKS:
                self._end_tracked(ENDED_BY_ITEM if tag in ITEMS else ENDED_BY_BLOCK)
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.in_link = True
        self.tags += 1
        if tag not in NESTED and tag not in TRACKED:
            return
        if tag in ("article", "main", "body") and not self.seen:
            while self.open and any(out or name for _, out, name, _ in self.open):  # an element that was never closed
                self._pop()
            self.seen = tag != "body"
        out, name = tag in LEFT_OUT, 0
        if attrs and not out and tag not in ("body", "html"):
            named = dict(attrs)
            out = (named.get("role") or "").lower() in LEFT_OUT_ROLE or "hidden" in named
            name = 0 if out else named_out(f"{named.get('class') or ''} {named.get('id') or ''}")
            name = 0 if name == 1 and tag not in NESTED else name
        aside = self.text if tag == "span" and (out or name) else None  # the line goes on behind it
        if aside is not None:
            self.text = []
        self.open.append((tag, out, name, aside))
        self.out += out
        self.articles += tag in ("article", "main")
        self.regions += 1
        self.region.append(self.regions if tag in HOLDERS else self.region[-1])
        if name:
            self.names.append(len(self.named))
            self.named.append([len(self.lines), 0, name])

    def _pop(self) -> None:
        tag, out, name, aside = self.open[-1]
        if tag != "span" or aside is not None:
            self.end_line()
        self.open.pop()
        self.region.pop()
        self.out -= out
        self.articles -= tag in ("article", "main")
        if name:
            self.named[self.names.pop()][1] = len(self.lines)
        self.in_link = self.in_link and tag not in NESTED
        if aside is not None:
            self.text = aside

    def _end_tracked(self, tags: frozenset[str]) -> None:
        """End the outermost of such elements inside the innermost element of NESTED."""
        depth = len(self.open)
        while depth and self.open[depth - 1][0] in TRACKED:
            depth -= 1
        found = next((i for i in range(depth, len(self.open)) if self.open[i][0] in tags), len(self.open))
        while len(self.open) > found:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in LEFT_OUT:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.in_link = False
        if tag in NESTED and any(x[0] == tag for x in self.open):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag in TRACKED:
            self._end_innermost(tag)

    def _end_innermost(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] not in TRACKED:
                return
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return

    def handle_data(self, data: str) -> None:
        if self.cdata_elem not in ("script", "style"):
            self.text.append(data)
            self.linked += len(data) * self.in_link

    def finish(self) -> None:
        self.close()
        self.end_line()
        while self.open:
            self._pop()
        self.end_line()


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters."""
    at = values.mean()
    for _ in range(50):
        upper = values > at
        if not upper.any() or upper.all():
            return float(values.min())
        now = (values[upper].mean() + values[~upper].mean()) / 2
        if now == at:
            break
        at = now
    return float(at)


def in_upper(rate: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Lines in the upper cluster of the page or, where none of those in question is, in their own."""
    upper = rate >= threshold(rate)
    return upper if (upper & among).any() else rate >= threshold(rate[among])


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(CUT_TAG.sub("", html or ""))
    parser.finish()
    lines = parser.lines
    inside = np.array([not x[4] for x in lines], bool)
    if not inside.any():
        return ""
    size = np.array([len(x[0]) for x in lines])
    rate = smoothed(size / np.maximum(1, [x[1] for x in lines]))
    article = np.array([x[3] for x in lines], bool)
    if parser.named:
        inside &= ~_left_out_by_name(parser.named, size, np.array([x[5] for x in lines]), article, inside, in_upper(rate, inside) & inside)
        if not inside.any():
            return ""
    upper = in_upper(rate, inside) & inside
    allowed = np.flatnonzero(inside)
    if 2 * size[upper & article].sum() > size[upper].sum():
        return "\n".join(lines[i][0] for i in allowed if article[i])
    regions = np.array([x[2] for x in lines])
    kept = 2 * np.bincount(regions, size * upper) > np.bincount(regions, size * inside)
    return "\n".join(lines[i][0] for i in allowed if not kept.any() or kept[regions[i]])


def _left_out_by_name(named: list[list[int]], size: np.ndarray, linked: np.ndarray, article: np.ndarray, inside: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The lines of elements that go by their name and figures. An element has lines first to end; sums over them are differences of prefix sums."""
    first, end, sure = np.array(named).T
    over = lambda values: (sums := np.concatenate(([0], np.cumsum(values))))[end] - sums[first]

    def covered(some: np.ndarray) -> np.ndarray:
        steps = np.bincount(first[some], minlength=len(size) + 1) - np.bincount(end[some], minlength=len(size) + 1)
        return np.cumsum(steps)[:-1] > 0

    unnamed = inside & ~covered(sure > 0)
    chars, high, articles = over(size * inside), over(size * upper), over(article & inside) > 0
    most = 2 * high > (size * upper).sum()
    stays = most & (articles | (over(upper) >= 3)) & (10 * (size * (article & unnamed)).sum() < chars)
    body = np.flatnonzero(upper & unnamed)
    behind = first > (body[-1] if len(body) else len(size))
    whole = over(article & inside) == over(inside)  # inside of an article, or all of it one
    unlike = (2 * over(linked * inside) >= chars) | (2 * high < chars) | behind
    doubtful = (sure == 1) & ~((~articles | whole) & ~most & unlike)
    return covered(~stays & ~doubtful)


def extract_text(pages: DataFrame, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """The columns of `pages` without `html_col`, and the main text as `out` (in place of a column of that name)."""
    small_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (html_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(map(main_text, batch.column(html_col).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), texts], [*(f.name for f in kept), out])

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))

"""Main text of HTML pages by smoothed text-to-tag ratios.

The standard library's parser streams events. Text between block tags is a *line*;
its text-to-tag ratio is its characters over the tags met in it, RATIO at most. The
ratios, in page order, are smoothed with a Gaussian and parted into two clusters by a
threshold; where the clusters' means lie close, all lines are one. The lines of the upper
cluster choose the region: the innermost container
that holds them all, out to the article or main element around it. Every line of the
region is content, short ones too.

Markup only vetoes. Elements that are never content (scripts, menus, page headers
and footers, hidden parts ...) lose their lines. Those that are so by habit (forms,
sidebars, and containers with a class, id or role that names such a part) lose
theirs as well, but not one that holds over half of the upper cluster. A class name
counts if all its words are such names, or tell of place or form: ``cookie-notice``,
``site-footer``, but neither ``no-sidebar`` nor ``ad-free``. Inside an article, names
that may as well be topics (social, search, copyright, navigation ...) veto only what has
no line of prose, so ratios decide there. Where articles hold
over half of a wider region's cluster, what stands beside them is vetoed.

Defined results: null and empty pages give empty text, as do pages of vetoed lines
alone. If no line outside of vetoed elements is in the upper cluster, all such lines
choose the region. Of containers that hold the same lines the innermost counts. White
space in a line becomes one blank; lines are joined by a line feed. Broken markup
never fails: character references may have any number of digits, tags close as browsers
close them, unknown declarations are comments,
and a tag, comment or declaration that the page's end cuts gives no text. Time and
memory grow in line with the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches
from .textbatch import arrow_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split())
CELL = frozenset(("td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that are no content wherever they stand.
OUTSIDE = frozenset("audio button canvas embed footer head iframe input menu nav noscript object script search select style svg template textarea title video".split())
#: Elements that are none by habit.
HABIT = frozenset(("aside", "dialog", "form"))
#: Words of a class, id or role that name parts which are no content by habit.
NAMED = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar aside complementary widget widgets related recommended share sharing social comment comments commentlist disqus respond replies menu navbar nav navigation breadcrumb breadcrumbs pagination pager toolbar masthead footer contentinfo copyright login search dialog".split())
#: Words that may stand beside them in a name.
FORM = frozenset("area bar block bottom box buttons container entry footer form global header inner item items left links list page panel post posts primary right secondary section site sub top wrap wrapper".split())
#: Of the names those that also are topics: in an article only the ratios tell a section on them from such a part.
TOPICS = frozenset("alert banner dialog login menu nav navbar navigation breadcrumb breadcrumbs pager pagination copyright search share sharing social sponsor sponsored signup subscription toolbar widget widgets".split())
ROOTS = frozenset(("article", "main"))
#: Elements that the words of a class or id may name; those of the rest are slugs and styles.
NAMEABLE = (BLOCK | CELL) - HEADINGS - ROOTS - {"html", "body", "p"}
#: Names of what readers write: as much prose as content has, so the clusters can't tell it from content.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Elements that can be a region of their own.
CONTAINERS = (BLOCK | {"#page"}) - HEADINGS - {"p", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "tr", "tbody", "thead", "tfoot", "caption", "figcaption"}
#: End tags a new block implies: an open element of the key's values that no block but p has followed.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "body": ("head",)}
_WORDS = re.compile(r"[a-z0-9]+")
_MARKUP = re.compile(r"<[a-zA-Z/!?]")
#: Decimal references longer than any character's.
_LONG_REFERENCE = re.compile(r"&#0*([0-9]*)")
SIGMA = 1.0
#: A line of so many characters a tag is prose; a larger ratio says no more, so a very long line doesn't raise the threshold.
RATIO = 100.0
#: What a line of prose has at least.
PROSE = 15.0
#: Two clusters are two if the lower one's mean is at most this share of the upper one's.
APART = 0.6


class Lines(HTMLParser):
    """Parser events to lines and the tree of elements that they stand in.

    Elements are numbered in page order, 0 is the page; ``parent`` has each one's
    parent, so a pass over the numbers, up or down, replaces walks along paths.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, element, whether it may be content
        self.names, self.parent = ["#page"], [0]
        self.outside, self.in_root = [False], [False]
        self.habit: dict[int, bool] = {}  # elements that are no content by habit: whether as comments
        self.topics: list[int] = []  # of them, those inside an article whose names may as well be topics
        self.titled = [False]  # a header in an article, and what stands in it without another veto
        self.open = [0]
        self.places: dict[str, list[int]] = defaultdict(list)  # where in ``open`` each element name stands
        self.blocks, self.solid = [0], [0]  # where blocks stand, and blocks other than p
        self.text: list[str] = []
        self.tags = 0

    def read(self, page: str) -> Lines:
        if "&#" in page:  # numbers of very many digits can't be converted
            page = _LONG_REFERENCE.sub(lambda m: m[0] if len(m[0]) < 12 else f"&#{m[1]}" if 0 < len(m[1]) < 8 else "&#0" if not m[1] else "&#9999999", page)
        self.feed(page)
        if self.cdata_elem is None and _MARKUP.match(self.rawdata):
            self.rawdata = ""  # cut by the end
        self.close()
        self.flush()
        return self

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.open[-1], not self.outside[self.open[-1]]))
                self.tags = 0
            self.text = []

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in CELL:
            self.text.append(" ")
        if tag in BLOCK or tag in OUTSIDE:
            self.flush()
        if tag in BLOCK:
            if self._last("p") > self.solid[-1]:
                self._pop(self._last("p"))
            for name in IMPLIED.get(tag, ()):
                if self._last(name) == self.solid[-1]:
                    self._pop(self.solid[-1])
        above = self.open[-1]
        outside, in_root = self.outside[above], self.in_root[above]
        number = len(self.names)
        titled = False
        if not outside or self.titled[above]:
            hidden = tag in OUTSIDE - {"header"} or self._hidden(tag, attrs)
            words = self._named(tag, attrs)
            titled = in_root and not hidden and not words and tag not in HABIT and (tag == "header" or self.titled[above])
            if not outside:
                outside = hidden or tag == "header"
                if not outside and (words or tag in HABIT):
                    self.habit[number] = not COMMENTS.isdisjoint(words)
                    if in_root and words and words <= TOPICS:
                        self.topics.append(number)
            elif tag in HEADINGS and titled:
                outside = False  # an article's own title
        self.titled.append(titled)
        self.names.append(tag)
        self.parent.append(above)
        self.outside.append(outside)
        self.in_root.append(in_root or tag in ROOTS)
        place = len(self.open)
        self.open.append(number)
        self.places[tag].append(place)
        if tag in BLOCK:
            self.blocks.append(place)
            if tag != "p":
                self.solid.append(place)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        block = tag in BLOCK or tag in OUTSIDE
        if block:
            self.flush()
        place = self._last(tag)
        if place > 0 and (block or place > self.blocks[-1]):
            self._pop(place)

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _pop(self, place: int) -> None:
        """Close what is open from ``place`` on."""
        while len(self.open) > place:
            self.places[self.names[self.open.pop()]].pop()
        for held in (self.blocks, self.solid):
            while held[-1] >= place:
                held.pop()

    @staticmethod
    def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body") or tag in ROOTS:
            return False
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()) for name, value in attrs)

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
        """The words that name the element as no content."""
        found: set[str] = set()
        if tag not in ("html", "body") and tag not in ROOTS:
            for name, value in attrs:
                if value and (name == "role" or (name in ("class", "id") and tag in NAMEABLE)):
                    for words in map(_WORDS.findall, value.lower().split()):
                        if NAMED.issuperset(w for w in words if w not in FORM):
                            found.update(w for w in words if w in NAMED)
        return found

    def up(self, values: list[float]) -> list[float]:
        """Each element's value with those of all inside it."""
        out = list(values)
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def down(self, marked: set[int]) -> list[bool]:
        """Elements that are marked or inside one that is."""
        out = [False] * len(self.names)
        for n in range(len(out)):
            out[n] = n in marked or out[self.parent[n]]
        return out

    def per_element(self, values: list[float]) -> list[float]:
        """A value of each line summed by its element."""
        out = [0.0] * len(self.names)
        for (_, _, n, _), x in zip(self.lines, values, strict=True):
            out[n] += x
        return out


def smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = max(1, round(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between two clusters on a line: the means' middle, moved until it stays. 0 if the means lie close."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    low, high = values[values < cut], values[values >= cut]
    if len(low) and len(high) and low.mean() > APART * high.mean():
        return 0.0  # one cluster
    return min(cut, float(values.max()))


def ratios(parser: Lines) -> np.ndarray:
    """Each line's text-to-tag ratio."""
    return np.minimum([len(text) / max(1, tags) for text, tags, _, _ in parser.lines], RATIO)


def vetoed(parser: Lines, upper: list[float]) -> list[bool]:
    """Elements that are no content by habit, with what is in them. ``upper``: each line's length if it is in the upper cluster.

    One that holds over half of the cluster is content, if no article or main that has
    text stands free of such elements. Of several articles in it the longest counts, and
    comments in it do not, unless they have the page's title.
    """
    out = parser.down(set(parser.habit))
    if any(may and parser.in_root[n] and not out[n] for _, _, n, may in parser.lines):
        return out
    titled = parser.up([name in ("main", "h1") for name in parser.names])
    remarks = parser.down({n for n, comments in parser.habit.items() if comments and not titled[n]})
    weight = parser.up([0.0 if r else w for w, r in zip(parser.per_element(upper), remarks, strict=True)])
    longest = [0.0] * len(weight)  # article or main inside each element
    for n in range(len(weight) - 1, 0, -1):
        inside = max(longest[n], weight[n] if parser.names[n] in ROOTS else 0.0)
        longest[parser.parent[n]] = max(longest[parser.parent[n]], inside)
    return parser.down({n for n in parser.habit if 2 * (longest[n] or weight[n]) <= weight[0] or not weight[n]})


def region(parser: Lines, far: list[float]) -> list[bool]:
    """Elements of the region that the lines of length ``far`` (0: another line) choose."""
    names, parent = parser.names, parser.parent
    count = parser.up(parser.per_element([float(x > 0) for x in far]))
    chosen = max(n for n in range(len(names)) if count[n] == count[0])  # numbers grow inward
    while names[chosen] not in CONTAINERS:
        chosen = parent[chosen]
    around = chosen
    while around and names[around] not in ROOTS:
        around = parent[around]
    if around:
        return parser.down({around})
    inside = parser.down({chosen})
    mass = parser.up(parser.per_element(far))
    roots = {n for n in range(len(names)) if inside[n] and names[n] in ROOTS and mass[n] and not parser.in_root[parent[n]]}
    return parser.down(roots) if 2 * sum(mass[n] for n in roots) > mass[0] else inside


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines().read(html)
    ok = [may for *_, may in parser.lines]
    if not any(ok):
        return ""
    ratio = ratios(parser)
    smooth = smoothed(ratio)
    cut = threshold(smooth)
    upper = (smooth >= cut).tolist()
    size = [len(text) for text, *_ in parser.lines]
    if parser.topics:
        prose = parser.up(parser.per_element(((ratio >= cut) & (ratio >= PROSE)).astype(float).tolist()))
        for n in parser.topics:
            if prose[n]:
                del parser.habit[n]
    if parser.habit:
        out = vetoed(parser, [float(s * (up and may)) for s, up, may in zip(size, upper, ok, strict=True)])
        ok = [may and not out[n] for may, (_, _, n, _) in zip(ok, parser.lines, strict=True)]
    # lines that only their neighbours lift into the cluster do not say how far the region goes
    for choice in ((ratio >= cut) & upper, upper, np.ones(len(ok), bool)):
        far = [float(s * (up and may)) for s, up, may in zip(size, choice, ok, strict=True)]
        if any(far):
            break
    else:
        return ""
    inside = region(parser, far)
    return "\n".join(text for (text, _, n, _), may in zip(parser.lines, ok, strict=True) if may and inside[n])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page; rows that repeat stay. One pass, no shuffle."""
    bounded_batches(pages.sparkSession)
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            text = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars long")

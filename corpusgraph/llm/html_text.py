"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events into lines, one per block of the page, each with
its text length, its number of tags and the elements around it. The ratios of text to tags,
smoothed with a Gaussian, fall into two clusters, parted by a threshold that is fitted to the
page; the lines of the upper one are its content. The content tells which element is the page's
main one, and lines of lower ratio belong to the text where the content surrounds them or they
stand near it in its element. Structural marks (menu, footer, form, advert, comments ...) only
veto: their lines have no ratio and are never text.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import map_text, packed, strings, unpacked

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BESIDE = frozenset("nav footer aside form script style noscript template head title select button textarea iframe object svg canvas menu dialog option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td blockquote html".split())
#: Words of class, id and role values that set an element apart from the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget\w*|complementary|contentinfo|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: An open paragraph ends where one of these starts; an open item where its like starts.
#: The parts of a tag: its name, what may open or close it, and its attributes.
TAG_NAME = re.compile(r"[^\t\n\r\f />\x00]*")
TAG_STEP = re.compile(r"=[\t\n\r\f ]*+(?:\"[^\">]*+\"|'[^'>]*+'|\"[^\"]*+\"(?=[\t\n\r\f />])|'[^']*+'(?=[\t\n\r\f />]))|>")
ATTRIBUTE = re.compile(r"([^\t\n\r\f />=\"'][^\t\n\r\f />=]*+)(?:[\t\n\r\f ]*+=[\t\n\r\f ]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\t\n\r\f >]++)))?+")
ENDS_P = BLOCK - {"option", "optgroup"}
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


#: An open paragraph isn't looked for beyond these.
WALLS = CONTAINERS | {"ul", "ol", "table", "dl"}
MAIN = ("article", "main")


class Lines(HTMLParser):
    """Blocks of text in page order, with what the choice needs to know of each. Its time grows with
    the page's length, however deep or broken the page is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, element number, set apart
        self.where: dict[str, list[int]] = {}  # the depths at which a tag is open
        self.walls: list[int] = []
        self.sealed = 0  # open elements that are set apart, headers aside
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []
        self.apart: list[bool] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []  # of each container the next one around it, or -1
        self.spans: list[list[int]] = []  # of each container its first line and the line behind its last
        self.inside: list[int] = []  # the innermost container at each depth, from -1 for none
        self._now: list[str] = []
        self._tags = self._links = 0
        self._in_link = 0

    # --- parsing

    def feed(self, data: str) -> None:
        """Takes a whole page. What follows its last `>` can hold no tag and is text."""
        cut = data.rfind(">") + 1
        self._last_comment, self._last_section = data.rfind("-->", 0, cut), data.rfind("]]>", 0, cut)
        super().feed(data[:cut])
        rest, self.rawdata = self.rawdata + data[cut:], ""
        if rest:
            self.handle_data(rest if self.cdata_elem else unescape(rest))
        self._flush()
        self._close(0)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that is never closed is only its mark: what follows is read as if it weren't there."""
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        return self.rawdata.find("-->", i + 4) + 3 if i + 4 <= self._last_comment else i + 4

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i) and i < self._last_section:
            return self.rawdata.find("]]>", i) + 3
        return self.rawdata.find(">", i) + 1

    def check_for_whole_start_tag(self, i: int) -> int:
        """The end of the tag at i: the first `>` outside quoted values, which open behind `=` and close in the page."""
        for m in TAG_STEP.finditer(self.rawdata, i + 1):
            if m.group() == ">":
                return m.end()
        return self.rawdata.find(">", i) + 1

    def parse_starttag(self, i: int) -> int:
        end = self.check_for_whole_start_tag(i)
        own = self.rawdata[i + 1 : end - 1]
        name = TAG_NAME.match(own).group()
        attrs = [(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), ""))) for m in ATTRIBUTE.finditer(own, len(name))] if len(own) > len(name) else []
        tag = name.lower()
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return end

    # --- lines

    def _flush(self) -> None:
        text = " ".join("".join(self._now).split())
        if text:
            self.texts.append(text)
            self.tags.append(self._tags)
            self.links.append(self._links)
            self.apart.append(bool(self.open) and self.open[-1][2])
        elif self.tags:
            self.tags[-1] += self._tags
        self._now, self._tags, self._links = [], 0, 0

    def _open(self, tag: str, apart: bool) -> None:
        k = len(self.open)
        number = self.inside[-1] if self.inside else -1
        if tag in CONTAINERS:
            self.parents.append(number)
            self.kinds.append(tag)
            number = len(self.kinds) - 1
            self.spans.append([len(self.texts), -1])
        self.inside.append(number)
        self.open.append((tag, number, apart))
        self.where.setdefault(tag, []).append(k)
        if tag in WALLS:
            self.walls.append(k)
        self.sealed += apart and tag != "header"

    def _close(self, at: int) -> None:
        self._flush()
        while len(self.open) > at:
            tag, number, apart = self.open.pop()
            self.inside.pop()
            self.where[tag].pop()
            if tag in WALLS:
                self.walls.pop()
            if tag in CONTAINERS:
                self.spans[number][1] = len(self.texts)
            self.sealed -= apart and tag != "header"

    def _depth(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def _is_apart(self, tag: str, attrs: list[tuple[str, str]]) -> bool:
        inside = bool(self.open) and self.open[-1][2]
        if tag in HEADINGS and inside and not self.sealed:
            # a heading in an article's own header is the article's
            return self._depth(*MAIN) < 0
        if inside or tag in BESIDE or tag == "header":
            return True
        if tag in ("html", "body", *MAIN):
            return False
        for k, v in attrs:
            if (k in ("class", "id", "role") and MARKS.search(v)) or k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and HIDDEN.search(v)):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag in BLOCK or tag in BESIDE:
            self._flush()
            self._tags += 1
            if tag in ENDS_P:
                like = self._depth("p", *LIKE.get(tag, ()))
                # a wall of the tag's own kind is what ends
                wall = self.walls[-1] if self.walls else -1
                if like >= 0 and like >= wall:
                    self._close(like)
            self._open(tag, self._is_apart(tag, attrs))
            return
        self._tags += 1
        if tag == "a":
            self._in_link = 1
        elif tag in ("br", "hr"):
            self._now.append(" ")
            if tag == "hr":
                self._flush()
        elif tag not in VOID and attrs and self._is_apart("span", attrs):
            self._flush()
            self._open(tag, True)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "a":
            self._in_link = 0
        at = self._depth(tag)
        if at >= 0 and (tag in (*MAIN, "body", "html") or at > self._depth(*MAIN, "body")):
            self._close(at)

    def handle_data(self, data: str) -> None:
        self._now.append(data)
        if self._in_link:
            self._links += len(data)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """x under a Gaussian of sigma lines, cut at three sigma, with its weight renewed at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weigh = lambda v: np.convolve(v, kernel)[reach : reach + len(v)]
    return weigh(x) / weigh(np.ones(len(x)))


def threshold(smooth: np.ndarray) -> float:
    """Where the smoothed ratios part into two clusters: the cut that leaves the least spread within them.

    Ratios are compared by their logarithms, as content has ratios of many sizes. Of equal cuts the
    lowest stands; where all are equal there is one cluster, and every line is in it.
    """
    x = np.sort(np.log1p(smooth))
    if x[-1] - x[0] < 1e-9:
        return 0.0
    n = np.arange(1, len(x))
    left, total = np.cumsum(x)[:-1], x.sum()
    between = (left / n - (total - left) / (len(x) - n)) ** 2 * n * (len(x) - n)
    between[np.diff(x) < 1e-9] = -1
    k = int(np.argmax(between))
    return float(np.expm1((x[k] + x[k + 1]) / 2))


def content_lines(page: Lines, sigma: float) -> np.ndarray:
    """Which lines are in the upper cluster. Lines that are set apart, or of link text, have no ratio."""
    length = np.array([len(t) for t in page.texts], float)
    none = np.array(page.apart, bool) | (np.array(page.links) > 0.6 * length)
    smooth = smoothed(np.where(none, 0.0, length / np.maximum(1, page.tags)), sigma)
    return (smooth >= threshold(smooth)) & ~none


def home_of(page: Lines, content: np.ndarray) -> int:
    """The container that the content tells to be the main one; -1 for the page itself.

    It is the innermost article or main with nine tenths of the content's text, else the innermost
    element with all of it (not a quotation or a table cell, which are parts of a text).
    """
    total = np.concatenate([[0], np.cumsum(np.where(content, [len(t) for t in page.texts], 0))])
    best, whole = -1, -1
    for k, (a, b) in enumerate(page.spans):  # a container opens after those around it
        mass = total[b] - total[a]
        if page.kinds[k] in MAIN and mass >= 0.9 * total[-1]:
            best = k
        if page.kinds[k] not in ("blockquote", "td") and mass == total[-1]:
            whole = k
    return best if best >= 0 else whole


def choose(page: Lines, sigma: float = 1.0) -> list[int]:
    """The indices of the lines of the main text.

    Content lines (see content_lines) of the main element are kept, and so are all between the first
    and the last of them, and in an article the rest of it too. Elsewhere lines beyond the ends are
    kept within three sigma lines, as far as the smoothing reaches. Content lines outside the main
    element are kept as well. Vetoed lines, and runs of three or more lines of link text, as menus
    are, never are. A page with content nowhere, such as one of a single short line, keeps all lines
    that aren't vetoed.
    """
    free = np.flatnonzero(~np.array(page.apart, bool))
    if not len(free):
        return []
    content = content_lines(page, sigma)
    if not content.any():
        return free.tolist()
    home = home_of(page, content)
    a, b = page.spans[home] if home >= 0 else (0, len(page.texts))
    own = np.flatnonzero(content[a:b]) + a
    if home < 0 or page.kinds[home] not in MAIN:
        reach = max(1, int(3 * sigma))
        a, b = max(a, own[0] - reach), min(b, own[-1] + 1 + reach)
    listed = in_lists(np.array(page.links) > 0.6 * np.array([len(t) for t in page.texts]))
    return [k for k in free.tolist() if content[k] or (a <= k < b and not listed[k])]


def in_lists(linked: np.ndarray) -> np.ndarray:
    """Which lines of link text stand in a run of three or more such lines, as menus do."""
    edge = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
    out = np.zeros(len(linked) + 1, np.int64)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if b - a >= 3:
            out[a:b] = 1
    return out[:-1].astype(bool)


def main_text(html: str, sigma: float = 1.0) -> str:
    """The main text of a page: its blocks joined by line feeds, white space in a block as one space."""
    page = Lines()
    page.feed(html)
    return "\n".join(page.texts[k] for k in choose(page, sigma))


def extract_text(pages: DataFrame, keep: list[str], html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """keep columns, text and n_chars (code points) of each page; a null or empty page has text ''.

    Pages of one line, without tags or of menus only are defined as in `choose`. Rows that repeat
    are returned as often; other columns are ignored.
    """

    def work(data, offsets, _):
        texts = [main_text(x, sigma) if x else "" for x in strings(data, offsets)]
        return {"text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)}

    own = pages.select(packed(keep), F.col(html_col).alias("__html"))
    out = map_text(own, "__html", ["__keep"], "text string, n_chars long", work)
    return out.select(*unpacked(keep, ["text", "n_chars"]), "text", "n_chars")

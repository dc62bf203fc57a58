"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. They become lines (the text of one block element), each with
its text-to-tag ratio: characters outside links over the tags met. A Gaussian smooths the ratios along the page, and
a threshold from their spread parts the lines in two clusters. The lines of the upper cluster vote with their text
for the container that holds most of it: the article, or else the main element, with the winning share, whole; where
there is none, the deepest container with that share, and from there its parents while what they add is mostly text
of the upper cluster. The blocks of that region are the main text, so short paragraphs and headlines inside it stay.
Elements that never hold an article (menus, footers, forms, scripts, adverts, comments,
notices, hidden ones, by tag or by the words of class, id and role) give no lines at all. Within article and main hidden
elements and formulas stay, and a word decides only as a whole class name or role; a block with it as a part of a class, or in its id, goes only where most of its
text is links, unless it names reader comments. Lists of links stay there.

Null or empty html, and pages without text, give the empty text. Comments begin and end where the parser is in text, as in
browsers, so none begins in a script, a style, an attribute, a textarea or a title. Marked sections are comments, and a
comment or tag that the page's end cuts off is none of the text. Work grows with a page's length, however deep it nests. Character references are decoded, white space within
a block becomes one space, blocks are joined by one space in page order. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import map_batches, table

SIGMA = 1.0
#: The threshold is this many standard deviations of the smoothed ratios.
SPREADS = 0.5
#: A region must hold this share of the upper cluster's text.
REGION_SHARE = 0.6
#: A region outside article and main grows to its parent where this share of what that adds is text of the upper cluster.
ADDED_SHARE = 0.5
#: What a character within article or main elements weighs.
ARTICLE_WEIGHT = 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title nav footer aside form script style noscript template iframe object canvas svg select button textarea dialog menu audio video map datalist annotation annotation-xml".split())
BLOCKS = frozenset("html body address article aside blockquote br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body article main section div td blockquote".split())
#: An opening tag of these closes an open p.
ENDS_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "figcaption", "summary"}
#: Elements that an opening tag ends no p across, and p itself.
EDGES = frozenset("article section div td body li p".split())
DOCTYPE = re.compile(r"\A\s*<!doctype[^>\[]*\[[^\]]*\]\s*>", re.I)
CUT_TAG = re.compile(r"<[a-z/!?]", re.I)
#: How a comment ends; one may be empty before it has really begun.
COMMENT_END, EMPTY_COMMENT = re.compile("--!?>"), re.compile("<!---?>")
#: Elements whose content is text up to their end tag. The last two count as such only where that comes.
RAW, RAW_IF_ENDED = ("script", "style"), ("textarea", "title")
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|pop-up|modal|overlay|newsletter|subscri\w+|signup"
    r"|share|sharing|social|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|toolbar|comments?|commentlist|respond|reply|replies|disqus"
    r"|related|recommend\w*|pagination|pager|widget|widgets|search|login|skip|contentinfo|complementary|dialog|copyright|adsbygoogle)(?:$|[\s_-])",
    re.I,
)
#: Names of the readers' comments, which are no part of an article they stand in.
COMMENTS = re.compile(r"(?:comments?|commentlist|respond|disqus)(?:$|[_-])", re.I)
LISTS = frozenset("dl ol ul".split())
#: Within an article a block with a doubtful name is left out where this share of its text is links.
LINKED_SHARE = 0.5
#: Whole class names of a page's header, which may not hold the article's own.
HEADERS = frozenset("header site-header page-header global-header top-header".split())
#: Beginnings of class names that say something about a container's surroundings.
ABOUT = ("has-", "no-", "with-", "without-")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line(NamedTuple):
    """The text of a block with the tags met before its end, its characters in links, its container, and whether within an article."""

    text: str
    tags: int
    links: int
    container: int
    inside: bool


class Element(NamedTuple):
    """An open element; ``container`` is its number or 0."""

    tag: str
    container: int
    out: bool
    doubt: bool


class Lines(HTMLParser):
    """Turns parser events into lines. Work and memory grow with the page's length, however deep its elements are nested."""

    def __init__(self, hints: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.hints = hints  # whether class, id and role count
        self.open: list[Element] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag's open elements are
        self.edges: list[int] = []  # where the open p elements are, and those that an opening tag ends no p across
        self.left_out = self.inside = 0
        self.parts: list[str] = []
        self.tags = self.link_chars = 0
        # of each container number, 0 standing for the page: its tag, and the container around it, whose number is less
        self.kinds, self.parents = [""], [0]
        self.here = 0
        self.lines: list[Line] = []
        self.sums = [(0, 0)]  # characters, and those in links, of the first lines
        self.doubts: list[int] = []  # where the lines of each open doubtful block begin
        self.last_ends: dict[str, int] = {}  # where the last end tag of each element of `RAW_IF_ENDED` is

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.link_chars, self.here, self.inside > 0))
            self.sums.append((self.sums[-1][0] + len(text), self.sums[-1][1] + self.link_chars))
            self.tags = self.link_chars = 0
        self.parts = []

    CDATA_CONTENT_ELEMENTS = RAW + RAW_IF_ENDED

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        name = self.cdata_elem
        if name in RAW_IF_ENDED:
            if name not in self.last_ends:
                self.last_ends[name] = max((m.start() for m in re.finditer(rf"</\s*{name}\s*>", self.rawdata, re.I)), default=-1)
            if self.last_ends[name] < end:
                self.clear_cdata_mode()
        return end

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment ends as in browsers; one that does not goes to the page's end."""
        found = EMPTY_COMMENT.match(self.rawdata, i) or COMMENT_END.search(self.rawdata, i + 4)
        return found.end() if found else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section such as <![if x]> or <![CDATA[ is a comment up to the next >, as in browsers."""
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER or tag == "header" and not self.inside:
            return True
        for name, value in attrs:
            if not self.inside and (name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value or "")):
                return True
            if self.hints and name in ("class", "id", "role") and value and tag not in ("html", "body", "article", "main"):
                names = [x for x in value.lower().split() if not x.startswith(ABOUT)]
                if not self.inside:
                    if UNWANTED.search(" ".join(names)) or HEADERS.intersection(names):
                        return True
                elif name != "id" and any(map(UNWANTED.fullmatch, names)) or name != "role" and (tag in CONTAINERS or tag in LISTS) and any(map(COMMENTS.match, names)):
                    return True
        return False

    def doubtful(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether a block within an article has a name that may be one of its surroundings."""
        return self.hints and self.inside > 0 and tag in BLOCKS and tag not in VOID and tag not in ("body", "article", "main") and any(n in ("class", "id") and v and UNWANTED.search(v) for n, v in attrs)

    def settle(self) -> None:
        """Ends a doubtful block: its lines go where most of their text is links."""
        at = self.doubts.pop()
        (chars, links), (all_chars, all_links) = self.sums[at], self.sums[-1]
        if all_links - links > LINKED_SHARE * (all_chars - chars):
            del self.lines[at:], self.sums[at + 1 :]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P and not self.left_out and self.edges and self.open[self.edges[-1]].tag == "p":
                self.leave(self.edges[-1])
        self.tags += 1
        if tag in VOID:
            return
        out, number = self.unwanted(tag, attrs), 0
        if tag in CONTAINERS:
            number = len(self.kinds)
            self.kinds.append(tag)
            self.parents.append(self.here)
            self.here = number
        self.left_out += out
        doubt = self.doubtful(tag, attrs)
        self.inside += tag in ("article", "main")
        if doubt:
            self.doubts.append(len(self.lines))
        self.places[tag].append(len(self.open))
        if tag in EDGES:
            self.edges.append(len(self.open))
        self.open.append(Element(tag, number, out, doubt))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def leave(self, at: int) -> None:
        """Closes the open element at ``at`` and all within it."""
        while len(self.open) > at:
            element = self.open.pop()
            self.places[element.tag].pop()
            if element.tag in EDGES:
                self.edges.pop()
            if element.doubt:
                self.settle()
            self.left_out -= element.out
            self.inside -= element.tag in ("article", "main")
            if element.container:
                self.here = self.parents[element.container]

    def finish(self) -> None:
        """After the page's end: its last line, and the blocks that were never closed."""
        self.flush()
        while self.doubts:
            self.settle()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.places[tag]:
            self.leave(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.left_out:
            self.parts.append(data)
            if self.places["a"]:
                self.link_chars += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian that is cut at three deviations and normalised at the page's ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def menus(lines: list[Line]) -> np.ndarray:
    """Lines that are links in runs of three or more."""
    link = np.array([n.links >= 0.9 * len(n.text) for n in lines] + [False])
    found = np.zeros(len(lines), bool)
    start = None
    for k, is_link in enumerate(link):
        if is_link and start is None:
            start = k
        if not is_link and start is not None:
            found[start:k] = k - start >= 3
            start = None
    return found


def below(parents: list[int], own: np.ndarray, values: np.ndarray) -> list[float]:
    """For each container the sum of the values of the lines in it, at any depth; ``own`` is each line's container."""
    sums = np.bincount(own, values, len(parents)).tolist()
    for c in range(len(parents) - 1, 0, -1):
        sums[parents[c]] += sums[c]
    return sums


def main_region(parser: Lines, plain: np.ndarray, upper: np.ndarray, menu: np.ndarray) -> int:
    """The container of the main text: the outermost article, or else main, that holds the upper cluster, or else by the lines.

    0 stands for the whole page.
    """
    lines, kinds, parents = parser.lines, parser.kinds, parser.parents
    own = np.array([n.container for n in lines])
    inside = np.array([n.inside for n in lines])
    weight = np.where(upper, np.maximum(plain, 1) * np.where(inside, ARTICLE_WEIGHT, 1), 0)
    votes = below(parents, own, weight)
    depth = [0] * len(parents)
    for c in range(1, len(parents)):
        depth[c] = depth[parents[c]] + 1
    held = [c for c in range(1, len(parents)) if votes[c] >= REGION_SHARE * votes[0]]
    for kind in ("article", "main"):
        whole = [c for c in held if kinds[c] == kind]
        if whole:
            return min(whole, key=depth.__getitem__)
    region = max(held, key=lambda c: (depth[c], votes[c]), default=0)
    if below(parents, own, inside)[region]:
        return region
    text = below(parents, own, np.where(menu, 0, [len(n.text) for n in lines]))
    good = below(parents, own, np.where(menu | ~upper, 0, plain))
    while region and parents[region]:
        parent = parents[region]
        if good[parent] - good[region] < ADDED_SHARE * (text[parent] - text[region]):
            break
        region = parent
    return region


def whole_markup(html: str) -> str:
    """``html`` without a tag that its end cuts off, and without a document type's list in brackets."""
    html = DOCTYPE.sub("", html, count=1)
    tag = CUT_TAG.search(html, html.rfind(">") + 1)
    return html[: tag.start()] if tag else html


def main_text(html: str | None) -> str:
    """The main text of a page."""
    source = whole_markup(html or "")
    for hints in (True, False):  # names may mislead: without any line left they are not heeded
        parser = Lines(hints)
        parser.feed(source)
        parser.close()
        parser.finish()
        if parser.lines:
            break
    else:
        return ""
    lines = parser.lines
    plain = np.array([max(0, len(n.text) - n.links) for n in lines], float)
    ratios = smoothed(plain / np.maximum(1, [n.tags for n in lines]))
    upper = (ratios >= SPREADS * ratios.std()) & (plain > 0)
    if not upper.any():
        upper = np.ones(len(lines), bool)
    menu = menus(lines)
    region = main_region(parser, plain, upper, menu)
    if parser.kinds[region] in ("article", "main"):
        menu[:] = False  # an article's own lists of links
    within = [region == 0]
    for c in range(1, len(parser.parents)):
        within.append(c == region or within[parser.parents[c]])
    return " ".join(n.text for n, out in zip(lines, menu, strict=True) if not out and within[n.container])


def extract_main_text(df: DataFrame, html: Column, *keys: str) -> DataFrame:
    """Columns ``keys``, ``text`` (never null) and ``n_chars`` (code points) for every row."""
    source = df.select(F.struct(*[df[f"`{k}`"] for k in keys]).alias("keys"), html.alias("html"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["keys", "text", "n_chars"])

        return apply

    return map_batches(source, make, f"keys {source.schema['keys'].dataType.simpleString()}, text string, n_chars long").select("keys.*", "text", "n_chars")


def op4_html_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages, F.col("html"), "page_id", "url")

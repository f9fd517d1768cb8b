"""Main text of web pages by parser events, text-to-tag ratios, smoothing and clustering."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What a page doesn't show as text, and forms.
DROPPED = frozenset("button canvas datalist embed fieldset form head iframe input label map noscript object option output progress script select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset("article body div main section table td".split())
CONTENT = frozenset("article main".split())
#: Ends of an open <p> or <li>, as the HTML standard implies them.
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
MARGINS = frozenset("aside footer menu nav".split())


def _words(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?:^|[\s_-])(?:{words.replace(' ', '|')})(?:$|[\s_-]|\d)", re.IGNORECASE)


# Words of class, id and role that name adverts, comments and margins, and others that often stand beside the main text.
_NAMED = _words("ad ads adv advert adverts advertisement advertising comment comments disqus footer masthead nav navbar navigation promoted replies responses sidebar sponsor sponsored contentinfo complementary")
_LIKELY = _words("banner breadcrumb breadcrumbs consent cookie cookies disclaimer dropdown gdpr header login menu modal newsletter notice notices notification pager pagination popup promo related search share sharing signup skip social subscribe toolbar widget")
_REPLY = re.compile("comment|reply|replies", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGMA = 1.0
#: Evidence in favour of a region. What the text-to-tag ratios say is at most RATIO either way, and alone decides where nothing
#: else speaks; standing in an article or main element, or beside one, links as half of the text in one, a likely name (half of it in one), and a margin element or a plain name add to it.
RATIO, INSIDE, BESIDE, LINKED, LIKELY, NAMED = 1.6, 1.5, -0.7, -1.2, -1.6, -3.2


@dataclass
class Line:
    """A block of text: the tags met in it, its characters in links, its region, the one that this may belong to, what is known of it by its elements, and whether it is in an article or main element."""

    text: str
    tags: int
    linked: int
    region: int
    root: int
    prior: float
    content: bool


class Lines(HTMLParser):
    """Gathers lines from parser events; holds only the open elements and the line at hand.

    Each container is a region, and so are elements that their names or kinds set apart.  In an article or main element, other containers may belong to its region.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int, float, bool]] = []  # tag, dropped, region, root, prior, content
        self.count: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.regions = 0

    def state(self) -> tuple[bool, int, int, float, bool]:
        return self.open[-1][1:] if self.open else (False, 0, 0, 0.0, False)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, *self.state()[1:]))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.state()[0]:
            self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_open("p", CLOSES_P - {"p"})
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            self.close_open(tag, REGIONS | {"ul", "ol", "dl", "tr", "select"} - {tag})
        dropped, region, root, prior, content = self.state()
        names = " ".join(_CAMEL.sub("-", v) for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs)
        dropped = dropped or hidden or tag in DROPPED
        own = self.evidence(tag, names, content)
        if tag in CONTENT and not content and not own:
            own, content = INSIDE, True
        if own or tag in REGIONS:
            self.regions += 1
            region, prior = self.regions, prior + own
            root = root if content and not own else region
        self.open.append((tag, dropped, region, root, prior, content))
        self.count[tag] += 1

    @staticmethod
    def evidence(tag: str, names: str, content: bool) -> float:
        """What an element's kind and names say of its text."""
        if tag in ("html", "body") or (tag in CONTENT and not _REPLY.search(names)):
            return 0.0
        if tag in MARGINS or tag in CONTENT or (tag == "header" and not content) or _NAMED.search(names):
            return NAMED
        return (LIKELY / 2 if content else LIKELY) if _LIKELY.search(names) else 0.0

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.close_open(tag, frozenset())
        if not self.state()[0]:
            self.tags += 1

    def close_open(self, tag: str, barrier: frozenset[str]) -> None:
        """Close the nearest open element of this name and all in it, unless a barrier stands before; without one of the name nothing is looked through."""
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS:
                    self.flush()
                self.count.subtract(x[0] for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in barrier:
                return

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.parts.append(data)
            self.linked += len("".join(data.split())) * bool(self.count["a"])

    def close(self) -> None:
        super().close()
        self.flush()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the ends repeated."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def two_clusters(values: np.ndarray) -> float:
    """The threshold between two clusters of values: where their means are equally far, found by moving it there until nothing changes side."""
    at = float(values.mean())
    while True:
        low, high = values[values < at], values[values >= at]
        if not len(low):
            return float(values.min())
        to = float(low.mean() + high.mean()) / 2
        if ((values < to) == (values < at)).all():
            return to
        at = to


def select(lines: list[Line], sigma: float = SIGMA) -> list[Line]:
    """Lines of the content regions.

    The logarithms of the lines' ratios of characters to tags are smoothed, and a threshold parts them in two clusters.  How far a
    region's mean, by characters, lies above it is the evidence of the ratios, to which that of elements and names is added; regions of a sum of zero or
    more are content, with all their lines.  Beside an article or main element the ratios must say a little more; within one, a container is judged by itself
    if half of its text or more is links, and else with the whole, so that tables and short lists stay.
    """
    if not lines:
        return []
    size = np.array([len(x.text) for x in lines], dtype=float)
    ratios = smooth(np.log(size / np.maximum(1, [x.tags for x in lines])), sigma)
    above = ratios - two_clusters(ratios)
    _, region = np.unique([x.region for x in lines], return_inverse=True)
    links = (np.bincount(region, [x.linked for x in lines]) * 2 >= np.bincount(region, size))[region]
    _, region = np.unique([x.region if own else x.root for x, own in zip(lines, links)], return_inverse=True)
    mean = np.bincount(region, above * size) / np.bincount(region, size)
    beside = any(x.content and x.prior > 0 for x in lines)
    known = np.array([x.prior + (LINKED * own if x.content else BESIDE * beside) for x, own in zip(lines, links)])
    good = np.clip(mean, -RATIO, RATIO)[region] + known >= -1e-9
    return [x for x, g in zip(lines, good) if g]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    return "\n".join(x.text for x in select(parser.lines))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text joins the blocks of the page's main text by one newline, in page order, with character references decoded and
    white space in a block as one space; nothing of a chosen block is dropped or cut.
    Forms, scripts, styles and hidden elements aren't text.  Menus, headers, footers, sidebars, notices, adverts and
    reader comments are regions that the sum of three kinds of evidence leaves out: their text-to-tag ratios, their elements, and the words of class, id and role.

    Null or empty html has empty text; ids and urls pass as they are, also null or repeated ones.
    Unclosed elements end where the HTML standard or the page ends them.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Text-extraction jobs: tables of raw documents to tables of extracted ones, in Arrow batches."""

from __future__ import annotations

import email
import email.policy
import re
from collections import Counter
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import subject_slug

# Elements that never close, and those that end a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
PAGE_DROPS = frozenset("script style nav header footer noscript".split())


_REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)?")


def ended_references(html: str | None) -> str:
    """html whose parser will read only references that end with a semicolon, as those of XML do; HTML also reads &amp, &lt and others without it."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or f"{m[1]};" in html5) else "&amp;" + m[0][1:], html or "")


class _Text(HTMLParser):
    """Lines of text outside dropped elements; with a preferred element in the page, of that alone."""

    def __init__(self, drops: frozenset[str], prefer: str | None = None, drop_class: str | None = None, hidden: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.drops, self.prefer, self.drop_class, self.hidden = drops, prefer, re.compile(drop_class) if drop_class else None, hidden
        self.stack: list[tuple[str, bool, bool]] = []
        self.open: Counter[str] = Counter()
        self.lines: dict[bool, list[list[str]]] = {False: [[]], True: [[]]}
        self.links: list[tuple[str, str, str]] = []
        self.href: str | None = None
        self.anchor: list[str] = []

    def at(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def flush(self) -> None:
        for lines in self.lines.values():
            if lines[-1]:
                lines.append([])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        a = dict(attrs)
        if tag == "a":
            self.close_link()
            self.href = a.get("href") or ""
        if tag in VOID:
            return
        dropped, inside = self.at()
        names = f"{a.get('class') or ''} {a.get('id') or ''}"
        dropped = dropped or tag in self.drops or bool(self.drop_class and self.drop_class.search(names)) or (self.hidden and bool(re.search(r"display:\s*none|visibility:\s*hidden", a.get("style") or "")))
        self.stack.append((tag, dropped, inside or tag == self.prefer))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "a":
            self.close_link()
        if self.open[tag]:
            last = None
            while last != tag:
                last = self.stack.pop()[0]
                self.open[last] -= 1

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.anchor.append(data)
        dropped, inside = self.at()
        if not dropped:
            self.lines[False][-1].append(data)
            if inside:
                self.lines[True][-1].append(data)

    def close_link(self) -> None:
        if self.href is not None:
            region = next((t for t, _, _ in reversed(self.stack) if t in ("nav", "header", "footer", "aside", "article", "main")), "body")
            self.links.append((region, self.href, " ".join("".join(self.anchor).split())))
        self.href, self.anchor = None, []

    def text(self) -> str:
        chosen = self.lines[True] if any(map(any, self.lines[True])) else self.lines[False]
        return "\n".join(t for t in (" ".join("".join(x).split()) for x in chosen) if t)


def _parsed(html: str | None, *args, **more) -> _Text:
    p = _Text(*args, **more)
    p.feed(html or "")
    p.close()
    p.flush()
    return p


def slices(batches: Iterator[pa.RecordBatch], column: str, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut after about target bytes of a column, so what a task makes of a batch doesn't grow with its rows; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + target, side="right")))
            yield batch.slice(i, j - i)
            i = j


def _texts(column: str, name: str, of: Callable[[str | None], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            out = pa.array([of(x) for x in batch.column(column).to_pylist()], pa.string())
            rest = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], out], names=[*rest, name])

    return run


def extract_article_text(pages: DataFrame, ended: bool = False) -> DataFrame:
    """(page_id, text): a page's article element, else its body, less scripts, styles, navigation, header and footer; one line for each block.

    With ended, character references without a semicolon are left as they are.
    """
    rows = pages.select("page_id", "html")
    return rows.mapInArrow(_texts("html", "text", lambda x: _parsed(ended_references(x) if ended else x, PAGE_DROPS, "article").text()), "page_id long, text string")


# Headings whose sections aren't read, and those that are not text themselves.
SKIPPED_SECTIONS, UNSPOKEN_HEADINGS = ("sponsor", "sponsors", "timestamps"), ("transcript",)
_STAMP = r"\(?\d{1,2}:\d{2}(?::\d{2})?\)?"


def posts_to_text(posts: DataFrame, skipped: tuple[str, ...] = SKIPPED_SECTIONS) -> DataFrame:
    """(post_id, text) of (post_id, html): without time stamps and without the sections of exactly these headings.

    A skipped section ends with the next heading of its level or a higher one.  Blocks are parted by an empty line.
    """

    def of(html: str | None) -> str:
        out, level = [], None
        html = re.sub(rf"(?is)<em[^>]*>\s*{_STAMP}\s*</em>", "", html or "")
        # Pieces alternate between what stands outside headings, and (level, heading).
        pieces = re.split(r"(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h\1>", html)
        for i in range(0, len(pieces), 3):
            if level is None:
                out += [x for x in _parsed(pieces[i], PAGE_DROPS).text().split("\n") if x]
            if i + 2 < len(pieces):
                own, heading = int(pieces[i + 1]), re.sub(rf"^{_STAMP}\s*[–-]\s*", "", _parsed(pieces[i + 2], PAGE_DROPS).text().replace("\n", " ")).strip()
                if heading.lower() in skipped:
                    level = own
                elif level is None or own <= level:
                    level = None
                    if heading and heading.lower() not in UNSPOKEN_HEADINGS:
                        out.append(heading)
        return "\n\n".join(out)

    return posts.select("post_id", "html").mapInArrow(_texts("html", "text", of), "post_id long, text string")


def emails_to_text(mails: DataFrame) -> DataFrame:
    """(mail_id, text) of (mail_id, html): newsletter mail as text to be spoken, without hidden elements; footnotes are inlined by scripts.inline_footnotes."""
    rows = mails.select("mail_id", "html")
    return rows.mapInArrow(_texts("html", "text", lambda x: _parsed(x, frozenset(["script", "style", "head"]), None, None, True).text()), "mail_id long, text string")


def extract_region_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, region, href, label): links of a page by the region that they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = [(p, i, *link) for p, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for i, link in enumerate(_parsed(html, PAGE_DROPS).links)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "place", "region", "href", "label"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, place int, region string, href string, label string")


def extract_section_links(docs: DataFrame, heading: str) -> DataFrame:
    """(doc_id, place, href, label, context) of (doc_id, html): links of what follows a heading, as readers.SectionLinks finds them."""
    from .readers import SectionLinks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = [(d, *x) for d, html in zip(batch.column("doc_id").to_pylist(), batch.column("html").to_pylist()) for x in SectionLinks(heading).read(html).rows()]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "place", "href", "label", "context"])

    return docs.select("doc_id", "html").mapInArrow(run, "doc_id long, place int, href string, label string, context string")


def split_sections(posts: DataFrame, key: str, html: str, mark: str, skip: str | None = None) -> DataFrame:
    """(key, section, html): a post cut at each mark, what stands before the first left out, and so sections that begin with skip."""
    rows = posts.select(key, F.posexplode(F.split(F.col(html), r"\Q" + mark + r"\E")).alias("section", "html")).where("section > 0")
    return rows.where(~F.startswith(F.col("html"), F.lit(skip))) if skip else rows


def extract_urls(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, url): addresses in a text in the order of their first mention, without punctuation at the end."""
    urls = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"https?://[^\s<>\"']+"), 0), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))
    return docs.select(key, F.posexplode(F.array_distinct(urls)).alias("place", "url")).withColumn("place", F.col("place") + 1)


def _decoded(part) -> str:
    """A part's text; an unknown character set is read as UTF-8, and what can't be read is replaced."""
    payload = part.get_payload(decode=True) or b""
    try:
        return payload.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def read_emails(spark: SparkSession, path: str) -> DataFrame:
    """Mail files at path or below it: path, subject, subject_slug, date (9999-12-31 where there is none), sender, list_post, the first HTML part and the first plain one."""

    def of(raw: bytes) -> tuple[str, str, str, str, str, str]:
        m = email.message_from_bytes(raw, policy=email.policy.default)
        try:
            date = parsedate_to_datetime(str(m["Date"])).strftime("%Y-%m-%d")
        except (TypeError, ValueError):
            date = "9999-12-31"
        first = lambda kind: next((_decoded(p) for p in m.walk() if p.get_content_type() == kind), "")
        return str(m["Subject"] or ""), date, str(m["From"] or ""), str(m["List-Post"] or ""), first("text/html"), first("text/plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            cols = list(zip(*[of(x) for x in batch.column("content").to_pylist()])) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array(c, pa.string()) for c in cols]], names=["path", "subject", "date", "sender", "list_post", "html", "plain"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return rows.mapInArrow(run, "path string, subject string, date string, sender string, list_post string, html string, plain string").withColumn("subject_slug", subject_slug(F.col("subject")))


def infer_source_url(mails: DataFrame, redirects: DataFrame, post_pattern: str = r"https?://[^\s<>\"']+/p/[a-z0-9-]+") -> DataFrame:
    """mails (mail_id, body, list_post, subject_slug, site) with source_url and source_from: a post address in the text, else the List-Post header, else a known redirect of a link in the text, else the site with the subject's slug.

    redirects (url, target) is a table of what links lead to; none is followed here.
    """
    nonblank = lambda c: F.nullif(c, F.lit(""))
    direct = nonblank(F.regexp_extract("body", f"({post_pattern})", 1))
    header = nonblank(F.regexp_extract(F.coalesce("list_post", F.lit("")), r"<(https?://[^>]+)>", 1))
    links = extract_urls(mails.withColumnRenamed("body", "text"), "mail_id")
    led = links.join(redirects, "url").groupBy("mail_id").agg(F.min_by("target", "place").alias("_led"))
    guess = F.when(F.length(F.coalesce("site", F.lit(""))) > 0, F.concat(F.col("site"), F.lit("/p/"), F.lower("subject_slug")))
    rows = mails.join(led, "mail_id", "left")
    source: Column = F.when(direct.isNotNull(), "direct").when(header.isNotNull(), "list_post").when(F.col("_led").isNotNull(), "redirect").when(guess.isNotNull(), "subject")
    return rows.withColumns({"source_url": F.coalesce(direct, header, F.col("_led"), guess), "source_from": source}).drop("_led")

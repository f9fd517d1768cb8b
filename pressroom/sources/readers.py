"""Readers of mail and of papers: HTML events to text, in one pass and in time proportional to the text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .extract import VOID, ended_references, slices

_NOTE = re.compile(r"footnote-\d+")
_HIDDEN = re.compile(r"display:\s*none")
# Elements that begin a paragraph of speech, and what is said around a quotation.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
QUOTE_BEGINS, QUOTE_ENDS = "\n\nBlock quote begins.\n", "\n\nBlock quote ends.\n"
# Elements of papers that aren't read, classes that aren't, and elements that stand for their captions.
UNREAD = frozenset("script style nav math img".split())
UNREAD_CLASSES = {"ltx_note": None, "ltx_bibliography": "section", "ltx_biblist": "ul"}
CAPTIONS = {"figure": "figcaption", "table": "caption"}


class _Tree(HTMLParser):
    """Open elements as a stack; an end tag closes the nearest open element of its name and all within it, and one of no open element is passed over at once."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple] = []
        self.open: Counter[str] = Counter()

    def entered(self, tag: str, attrs: dict[str, str | None]) -> tuple:
        """What is kept of an element while it is open."""
        raise NotImplementedError

    def left(self, tag: str, kept: tuple) -> None:
        raise NotImplementedError

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        kept = self.entered(tag, dict(attrs))
        if tag in VOID:
            self.left(tag, kept)
        else:
            self.stack.append((tag, kept))
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.left(tag, self.entered(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        tag, kept = self.stack.pop()
        self.open[tag] -= 1
        self.left(tag, kept)
        return tag

    def read(self, html: str | None):
        self.feed(html or "")
        self.close()
        while self.stack:
            self.pop()
        return self


class MailText(_Tree):
    """The spoken text of a newsletter.

    Hidden elements, scripts and styles go.  Nothing is read after the end of the last footnote (a div with id footnote-n),
    but for the ends of quotations that it stands in.  Quotations are announced, paragraphs and headings begin after an empty line.
    """

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.unread = 0
        self.notes = 0
        self.quotes = 0
        self.cut: tuple[int, int] | None = None

    def entered(self, tag: str, attrs: dict[str, str | None]) -> tuple:
        if self.unread or tag in ("script", "style") or _HIDDEN.search(attrs.get("style") or ""):
            self.unread += 1
            return True, 0
        note = 0
        if tag == "div" and _NOTE.fullmatch(attrs.get("id") or ""):
            self.notes += 1
            note, self.cut = self.notes, None
        if tag == "blockquote":
            self.out.append(QUOTE_BEGINS)
            self.quotes += 1
        if tag in PARAGRAPHS:
            self.out.append("\n\n")
        return False, note

    def left(self, tag: str, kept: tuple) -> None:
        unread, note = kept
        if unread:
            self.unread -= 1
            return
        if tag == "blockquote":
            self.out.append(QUOTE_ENDS)
            self.quotes -= 1
        if note and note == self.notes:
            self.cut = len(self.out), self.quotes

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.out.append(data)

    def text(self) -> str:
        n, quotes = self.cut or (len(self.out), 0)
        return spoken_lines("".join(self.out[:n]) + QUOTE_ENDS * quotes)


def spoken_lines(text: str) -> str:
    """Text without soft line breaks (an = before the end of a line, with the empty lines after it), with single spaces and single empty lines."""
    lines, soft = [], None
    rows = text.split("\n")
    for i, row in enumerate(rows):
        if soft is not None:
            if not row.strip() and i + 1 < len(rows):
                continue
            row, soft = soft + row, None
        bare = row.rstrip()
        if bare.endswith("=") and i + 1 < len(rows):
            soft = bare[:-1]
        else:
            row = re.sub(r"\s+", " ", row).rstrip()
            if row or not lines or lines[-1]:
                lines.append(row)
    return "\n".join(lines if soft is None else [*lines, re.sub(r"\s+", " ", soft).rstrip()]).strip()


class PaperText(_Tree):
    """The text of a paper's article, piece by piece of its mark-up.

    Scripts, navigation, formulas, images, notes and the bibliography go.  A figure, or a table outside of one, stands for its first caption.
    """

    def __init__(self) -> None:
        super().__init__()
        self.pieces: dict[bool, list[str]] = {False: [], True: []}
        self.unread = 0
        self.article = 0
        self.seen_article = False
        self.stands_for: str | None = None
        self.caption: list[str] | None = None
        self.captioned = 0

    def entered(self, tag: str, attrs: dict[str, str | None]) -> tuple:
        classes = (attrs.get("class") or "").split()
        unread = bool(self.unread) or tag in UNREAD or any(c in UNREAD_CLASSES and UNREAD_CLASSES[c] in (None, tag) for c in classes)
        self.unread += unread
        first = tag == "article" and not self.seen_article and not unread
        if first:
            self.seen_article, self.article = True, 1
        replaced = not unread and self.stands_for is None and tag in CAPTIONS
        if replaced:
            self.stands_for, self.caption, self.captioned = CAPTIONS[tag], None, 0
        caption = not unread and not replaced and self.stands_for == tag and self.caption is None
        if caption:
            self.caption, self.captioned = [], 1
        return unread, first, replaced, caption

    def left(self, tag: str, kept: tuple) -> None:
        unread, first, replaced, caption = kept
        self.unread -= unread
        if caption:
            self.captioned = 0
        if replaced:
            self.stands_for = None
            self.keep(" ".join(self.caption or []))
        if first:
            self.article = 0

    def keep(self, text: str) -> None:
        if text := text.strip():
            self.pieces[False].append(text)
            if self.article:
                self.pieces[True].append(text)

    def handle_data(self, data: str) -> None:
        if self.unread:
            return
        if self.stands_for is None:
            self.keep(data)
        elif self.captioned and data.strip():
            self.caption.append(data.strip())

    def text(self) -> str:
        text = "\n\n".join(self.pieces[self.seen_article])
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


class SectionLinks(_Tree):
    """Links of the first paragraph, list item or list after the heading that contains given words, with the sentence that each stands in.

    The heading's words are told apart without case.  Links without address or text give no row.
    """

    def __init__(self, heading: str) -> None:
        super().__init__()
        self.heading, self.state = heading.lower(), "before"
        self.title: list[str] | None = None
        self.words: list[str] = []
        self.links: list[tuple[str, list[str]]] = []

    def entered(self, tag: str, attrs: dict[str, str | None]) -> tuple:
        held = False
        if self.state == "before" and re.fullmatch("h[1-6]", tag) and self.title is None:
            self.title, held = [], True
        elif self.state == "found" and tag in ("p", "ul", "ol"):
            self.state, held = "inside", True
        elif self.state == "inside" and tag == "a":
            self.links.append((attrs.get("href") or "", []))
        return (held,)

    def left(self, tag: str, kept: tuple) -> None:
        if not kept[0]:
            return
        if self.state == "before":
            self.state = "found" if self.heading in "".join(self.title).lower() else "before"
            self.title = None
        elif self.state == "inside":
            self.state = "after"

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        if self.state == "inside":
            self.words.append(data)
            if self.open["a"] and self.links:
                self.links[-1][1].append(data)

    def rows(self) -> Iterator[tuple[int, str, str, str]]:
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", " ".join("".join(self.words).split()))]
        place = 0
        for href, words in self.links:
            label = " ".join("".join(words).split())
            if href and label:
                yield place, href, label, next((s for s in sentences if label in s), label)
                place += 1


def _texts(reader: type[MailText] | type[PaperText], key: str, ended: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [reader().read(ended_references(x) if ended else x).text() for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return run


def mail_to_speech(mails: DataFrame) -> DataFrame:
    """(mail_id, text) of (mail_id, html): newsletters as MailText reads them; footnotes are inlined by scripts.inline_footnotes.  Null gives an empty text."""
    return mails.select("mail_id", "html").mapInArrow(_texts(MailText, "mail_id"), "mail_id long, text string")


def papers_to_text(pages: DataFrame, ended: bool = False) -> DataFrame:
    """(page_id, text) of (page_id, html): papers as PaperText reads them, pieces parted by an empty line.  Null gives an empty text.

    With ended, character references without a semicolon are left as they are.
    """
    return pages.select("page_id", "html").mapInArrow(_texts(PaperText, "page_id", ended), "page_id long, text string")

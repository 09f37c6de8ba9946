"""Blocks and metadata of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Elements that make a block, and those without readable text.
BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "pre", "td", "th", "dd", "dt", "caption", "div"}
SKIP = {"script", "style", "head", "nav", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOTES = {"footnote", "rearnote", "endnote", "note", "doc-footnote", "doc-endnote"}
HEAD_CHARS = 262_144
#: pages whose blocks a task holds at once
PAGES = 128
BLOCK_SCHEMA = "block_idx int, kind string, level int, text string, anchors array<string>"


class _Walker(HTMLParser):
    """Text between the edges of block elements becomes a block, with the kind of the innermost."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.skipped = 0
        self.text: list[str] = []
        self.anchors: list[str] = []
        self.blocks: list[tuple[int, str, int | None, str, list[str]]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            kind, level = "body", None
            for tag, note in reversed(self.open):
                if note:
                    kind = "footnote"
                    break
            else:
                tags = [t for t, _ in self.open if t in BLOCK]
                last = tags[-1] if tags else ""
                if len(last) == 2 and last[0] == "h" and last[1].isdigit():
                    kind, level = "heading", int(last[1])
                elif last in ("figcaption", "caption"):
                    kind = "caption"
            self.blocks.append((len(self.blocks), kind, level, text, list(self.anchors)))
            self.anchors.clear()

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self.skipped += tag in SKIP
            return
        if tag in SKIP:
            self.skipped = 1
            return
        if tag in BLOCK or tag in ("article", "section", "ul", "ol", "table", "tr", "body", "footer", "aside", "figure"):
            self.flush()
            # a paragraph ends where the next block begins
            if tag in BLOCK and self.open and self.open[-1][0] == "p":
                self.open.pop()
        elif tag == "br":
            self.text.append(" ")
        known = dict(attrs)
        if known.get("id"):
            self.anchors.append(known["id"])
        note = bool(NOTES & set(f"{known.get('epub:type') or ''} {known.get('role') or ''}".split()))
        if tag not in VOID:
            self.open.append((tag, note))

    def handle_endtag(self, tag):
        if self.skipped:
            self.skipped -= tag in SKIP
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if any(t in BLOCK or t in ("article", "section", "ul", "ol", "table", "tr", "body", "footer", "aside", "figure") for t, _ in self.open[i:]):
                    self.flush()
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.skipped:
            self.text.append(data)


def blocks_of(html: str) -> list[tuple[int, str, int | None, str, list[str]]]:
    walker = _Walker()
    walker.feed(html)
    walker.close()
    walker.flush()
    return walker.blocks


def html_blocks(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """A row for each block of each page; pages without text have none."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + PAGES] for whole in batches for at in range(0, len(whole), PAGES)):
            rows = [(k, *b) for k, html in batch.itertuples(index=False) if html for b in blocks_of(html)]
            yield pd.DataFrame(rows, columns=[key, "block_idx", "kind", "level", "text", "anchors"]).astype({"level": "Int32"})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInPandas(of, f"`{key}` {kind}, {BLOCK_SCHEMA}")


def html_contents(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Contents entries of a page's headings."""
    return blocks.where("kind = 'heading'").select(key, F.col("text").alias("label"), (F.col("level") - 1).alias("depth"), F.col("block_idx").alias("start_block"))


def _blank(text: str) -> str:
    """text with each run of what HTML counts as white space made one blank, and none at its ends."""
    return re.sub(r"[ \t\n\f\r]+", " ", text).strip(" ")


def usual_references(text: str) -> str:
    """text with the references that every page has to use (&amp; and &lt;) read; all others stay as they are written."""
    return text.replace("&amp;", "&").replace("&lt;", "<")


class _Head(HTMLParser):
    """Title, language and author of a page, wherever its tags put their attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str | None] = {"title": None, "lang": None, "author": None}
        self.title: list[str] | None = None

    def __call__(self, text: str, decode: Callable[[str], str] | None) -> dict[str, str | None]:
        """What text has; with decode the references in it are kept as written, and decode reads them."""
        self.feed(text if decode is None else text.replace("&", "&amp;"))
        return self.found if decode is None else {n: v and (_blank(decode(v)) or None) for n, v in self.found.items()}

    def _put(self, name: str, value: str | None) -> None:
        value = _blank(value or "")
        if value and self.found[name] is None:
            self.found[name] = value

    def handle_starttag(self, tag, attrs):
        own = {k: v for k, v in reversed(attrs)}  # of a repeated attribute the first counts
        if tag == "html":
            self._put("lang", own.get("lang"))
        elif tag == "title" and self.title is None:
            self.title = []
        elif tag == "meta" and (own.get("name") or "").strip().lower() == "author":
            self._put("author", own.get("content"))

    def handle_endtag(self, tag):
        if tag == "title" and self.title:
            self._put("title", "".join(self.title))

    def handle_data(self, data):
        if self.title is not None and self.found["title"] is None:
            self.title.append(data)


def head_of(html: str, decode: Callable[[str], str] | None = None) -> dict[str, str | None]:
    """title, lang and author from the first HEAD_CHARS characters of a page; a title that is not closed there is none.

    decode reads the character references in them; without it all of HTML's are read, also those without a semicolon.
    """
    return _Head()(html[:HEAD_CHARS], decode)


def html_biblio(pages: DataFrame, key: str = "page_id", column: str = "html", decode: Callable[[str], str] | None = None) -> DataFrame:
    """(key, title, lang, author, truncated): metadata in the first 256 Ki characters of each page; see head_of."""

    @pandas_udf("title string, lang string, author string")
    def heads(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([head_of(t or "", decode) for t in texts], columns=["title", "lang", "author"])

    found = pages.select(key, heads(F.substring(column, 1, HEAD_CHARS)).alias("h"), (F.char_length(column) > HEAD_CHARS).alias("truncated"))
    return found.select(key, "h.title", "h.lang", "h.author", "truncated")

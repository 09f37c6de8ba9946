"""Files as rows: which reader a file needs, text files of any encoding, EPUB books, stored extractions."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import blocks_of

# Extensions.
FORMATS = {"epub": "epub", "pdf": "pdf", "txt": "txt", "html": "html", "htm": "html", "xhtml": "html"}
KNOWN_UNSUPPORTED = ("mobi", "azw3", "djvu")
ENVELOPE = (
    "version int, source_sha256 string, title string, blocks array<struct<kind:string,level:int,text:string,source_unit:int>>, "
    "toc array<struct<label:string,depth:int,start_block:int>>"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def detect(path: Column) -> Column:
    """Format of a file by its extension: a supported one, unsupported:<extension>, or unknown."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    ext = extension(path)
    return F.when(ext.isin(*KNOWN_UNSUPPORTED), F.concat(F.lit("unsupported:"), ext)).otherwise(F.coalesce(F.try_element_at(known, ext), F.lit("unknown")))


def walk(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, length, source_sha256, content) of all supported files below path but hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.where(~F.col("path").rlike(r"/\.[^/]*$")).withColumn("format", detect(F.col("path")))
    return named.where(F.col("format").isin(*set(FORMATS.values()))).select("path", "format", "length", F.sha2("content", 256).alias("source_sha256"), "content")


def decode(content: bytes) -> tuple[str, list[str]]:
    """Text of a file, and what had to be guessed: a byte order mark, else UTF-8, else GB18030 with what it cannot read replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            try:
                return content.decode(name), []
            except UnicodeDecodeError:
                return content.decode(name, "replace"), [f"{name}:replaced"]
    try:
        return content.decode("utf-8"), []
    except UnicodeDecodeError:
        pass
    try:
        return content.decode("gb18030"), ["gb18030"]
    except UnicodeDecodeError:
        return content.decode("gb18030", "replace"), ["gb18030", "gb18030:replaced"]


def text_files(files: DataFrame) -> DataFrame:
    """(path, text, fallbacks) of text files."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [decode(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": [t for t, _ in found], "fallbacks": [f for _, f in found]})

    return files.select("path", "content").mapInPandas(of, "path string, text string, fallbacks array<string>")


def ocr_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(book, text): the ordered Markdown fragments of each folder below path as one text."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    rows = parts.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("book"), "path", F.col("content").cast("string").alias("t"))
    return rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("path", "t"))).alias("p")).select("book", F.array_join("p.t", "\n").alias("text"))


_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "dc": "http://purl.org/dc/elements/1.1/"}


def read_epub(content: bytes) -> dict:
    """Blocks in spine order (source_unit is the place in the spine), contents, and metadata of one book."""
    book = zipfile.ZipFile(io.BytesIO(content))
    opf_path = ET.fromstring(book.read("META-INF/container.xml")).find(".//c:rootfile", _NS).get("full-path")
    opf, base = ET.fromstring(book.read(opf_path)), posixpath.dirname(opf_path)
    items = {i.get("id"): i for i in opf.iterfind(".//o:manifest/o:item", _NS)}
    at = lambda href: posixpath.normpath(posixpath.join(base, href))
    spine = [at(items[r.get("idref")].get("href")) for r in opf.iterfind(".//o:spine/o:itemref", _NS) if r.get("idref") in items]
    blocks, anchors, first = [], {}, {}
    for unit, name in enumerate(spine):
        for _, kind, level, text, ids in blocks_of(book.read(name).decode("utf-8", "replace")):
            first.setdefault(name, len(blocks))
            anchors |= {(name, i): len(blocks) for i in ids}
            blocks.append((kind, level, text, unit))
    starts = [first.get(n) for n in spine]
    toc: list[tuple[str, int, int | None]] = []

    def resolve(href: str, folder: str) -> int | None:
        name, _, fragment = href.partition("#")
        name = posixpath.normpath(posixpath.join(folder, name))
        if (name, fragment) in anchors:
            return anchors[name, fragment]
        # the first block at or after the unit
        return next((s for s in starts[spine.index(name) :] if s is not None), None) if name in spine else None

    nav = next((i for i in items.values() if "nav" in (i.get("properties") or "").split()), None)
    if nav is not None:
        path, tag = at(nav.get("href")), "{http://www.w3.org/1999/xhtml}"

        def descend(node, depth: int) -> None:
            for entry in node.findall(f"{tag}li"):
                link = entry.find(f"{tag}a")
                if link is not None:
                    toc.append((" ".join("".join(link.itertext()).split()), max(0, depth - 1), resolve(link.get("href", ""), posixpath.dirname(path))))
                for below in entry.findall(f"{tag}ol"):
                    descend(below, depth + 1)

        for listed in ET.fromstring(book.read(path)).iterfind(f".//{tag}nav/{tag}ol"):
            descend(listed, 1)
    one = lambda n: next((e.text.strip() for e in opf.iterfind(f".//dc:{n}", _NS) if e.text), None)
    people = [(e.get("{http://www.idpf.org/2007/opf}role") or ("aut" if e.tag.endswith("creator") else ""), e.text) for n in ("creator", "contributor") for e in opf.iterfind(f".//dc:{n}", _NS) if e.text]
    if not blocks:
        raise ValueError("no text in the book")
    return {"title": one("title"), "language": one("language"), "publisher": one("publisher"), "date": one("date"), "people": people, "blocks": blocks, "toc": toc}


def epub_books(files: DataFrame) -> DataFrame:
    """(path, title, language, publisher, date, people, blocks, toc, error) of EPUB files; a broken file has an error."""
    names = ["title", "language", "publisher", "date", "people", "blocks", "toc"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False):
                try:
                    found = read_epub(bytes(content))
                    rows.append((path, *[found[n] for n in names], None))
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(
        of,
        "path string, title string, language string, publisher string, date string, people array<struct<role:string,name:string>>, "
        "blocks array<struct<kind:string,level:int,text:string,source_unit:int>>, toc array<struct<label:string,depth:int,start_block:int>>, error string",
    )


def read_envelopes(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Stored extractions (JSON lines) of this version or older."""
    return spark.read.schema(ENVELOPE).json(path).where(F.col("version") <= version)


def write_envelopes(extractions: DataFrame, path: str, version: int = 1) -> None:
    extractions.withColumn("version", F.lit(version)).write.mode("append").json(path)

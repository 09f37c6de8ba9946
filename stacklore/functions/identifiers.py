"""Identifiers: checksums, and finding them in texts and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers.
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
DOI_PLACEHOLDER = r"(?i)/[nNxX]{3,}|/[Yy]{4}\.[Mm]{2}|nnnnnnn|XXXXXX|0000-0000"
DOI_FILE = r"^(10\.\d{4,9})_(.+)$"
ACL_FILE = r"(?i)^[A-Z]\d{2}-\d{3,4}$"
ARXIV = r"(?i)arxiv[:\s]+(\d{4}\.\d{4,5})(?:v\d+)?"
ARXIV_FILE = r"^(\d{4}\.\d{4,5})(?:v\d+)?$"
ARXIV_OLD = r"\b([a-z][a-z\-]*(?:\.[A-Za-z\-]+)?/\d{7})\b"
ISSN = r"\b\d{4}-\d{3}[\dX]\b"
VENUE = r"(?i)^[^\n]*(?:\bproceedings of\b|\bconference on\b|\bvol\.)[^\n]*$"


def _digits(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit("."), F.lit(0)), lambda c: F.when(F.upper(c) == "X", 10).otherwise(c.try_cast("int")))


def _weighted(s: Column, weights: list[int]) -> Column:
    products = F.zip_with(_digits(s), F.array(*map(F.lit, weights)), lambda d, w: d * w)
    return F.aggregate(products, F.lit(0), lambda a, x: a + x)


def isbn10_ok(s: Column) -> Column:
    return s.rlike(r"^\d{9}[\dXx]$") & (_weighted(s, list(range(10, 0, -1))) % 11 == 0)


def isbn13_ok(s: Column) -> Column:
    return s.rlike(r"^\d{13}$") & (_weighted(s, [1, 3] * 6 + [1]) % 10 == 0)


def isbn_ok(s: Column) -> Column:
    bare = F.regexp_replace(s, "[ -]", "")
    return F.when(F.char_length(bare) == 10, isbn10_ok(bare)).when(F.char_length(bare) == 13, isbn13_ok(bare)).otherwise(False)


def issn_ok(s: Column) -> Column:
    bare = F.replace(s, F.lit("-"), F.lit(""))
    return bare.rlike(r"^\d{7}[\dXx]$") & (_weighted(bare, [8, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)


def orcid_ok(s: Column) -> Column:
    """ISO 7064, modulus 11-2."""
    bare = F.replace(s, F.lit("-"), F.lit(""))
    total = F.aggregate(F.slice(_digits(bare), 1, 15), F.lit(0), lambda t, d: (t + d) * 2)
    check = (12 - total % 11) % 11
    return bare.rlike(r"^\d{15}[\dX]$") & (F.element_at(_digits(bare), -1) == check)


def find_doi(text: Column, stem: Column | None = None) -> Column:
    """First DOI that is no placeholder, without trailing punctuation; a file's name counts before its text."""
    found = F.filter(F.regexp_extract_all(text, F.lit(DOI), F.lit(0)), lambda x: ~x.rlike(DOI_PLACEHOLDER))
    in_text = F.regexp_replace(F.try_element_at(found, F.lit(1)), r"[.,;:)]+$", "")
    if stem is None:
        return in_text
    of_file = (
        F.when(stem.rlike(DOI_FILE), F.replace(F.concat_ws("/", F.regexp_extract(stem, DOI_FILE, 1), F.regexp_extract(stem, DOI_FILE, 2)), F.lit("_"), F.lit("/")))
        .when(stem.rlike(ACL_FILE), F.concat(F.lit("10.18653/v1/"), F.upper(stem)))
        .when(stem.rlike(ARXIV_FILE), F.concat(F.lit("10.48550/arxiv."), F.regexp_extract(stem, ARXIV_FILE, 1)))
    )
    return F.coalesce(of_file, in_text)


def find_arxiv(text: Column, stem: Column | None = None) -> Column:
    first = lambda s, p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    in_text = F.coalesce(first(text, ARXIV), first(text, ARXIV_OLD))
    return in_text if stem is None else F.coalesce(first(stem, ARXIV_FILE), in_text)


def find_issn(text: Column) -> Column:
    return F.regexp_substr(text, F.lit(ISSN))


def find_venue(text: Column) -> Column:
    line = F.trim(F.regexp_extract(text, "(?m)" + VENUE, 0))
    return F.when((line != "") & (F.char_length(line) <= 120), line)


def arxiv_year(arxiv: Column) -> Column:
    new = F.regexp_extract(arxiv, r"^(\d{2})\d{2}\.\d{4,5}", 1).try_cast("int")
    old = F.regexp_extract(arxiv, r"/(\d{2})\d{5}$", 1).try_cast("int")
    return F.when(new.isNotNull(), 2000 + new).when(old.isNotNull(), F.when(old >= 91, 1900 + old).otherwise(2000 + old))


def doi_year(doi: Column) -> Column:
    return F.regexp_extract(doi, r"[./](19\d{2}|20\d{2})[./]", 1).try_cast("int")


def text_year(text: Column) -> Column:
    pick = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    return F.coalesce(pick(r"(?i)(?:©|\(c\)|copyright)\s*(\d{4})"), pick(r"(?i)\bvol\.?\s*\d+[^\n]{0,40}\((\d{4})\)"))


def paper_year(arxiv: Column, doi: Column, text: Column, biblio: Column) -> Column:
    """The most trusted year: arXiv id, DOI, text, then metadata unless that is a file's creation date."""
    meta = F.when(~F.coalesce(biblio, F.lit("")).rlike(r"^D:\d{8,}"), F.regexp_extract(biblio, r"(\d{4})", 1).try_cast("int"))
    return F.coalesce(arxiv_year(arxiv), doi_year(doi), text_year(text), meta)


def name_fields(stem: Column) -> Column:
    """Series, authors, title, year, publisher and ISBN by the first file name template that fits."""
    series = r"^\[(.+?)\]\s+(.+?)\s+-\s+(.+?)\s+\((\d{4})(?:,\s*(.+?))?\)$"
    plain = r"^(.+?)\s+-\s+(.+?)\s+\((\d{4})(?:,\s*(.+?))?\)$"
    long = r"^(.+?)\s+--\s+(.+?)\s+--\s+(.+)$"
    part = lambda p, i: F.nullif(F.regexp_extract(stem, p, i), F.lit(""))
    isbn = F.regexp_extract(stem, r"(?i)(?:isbn(?:13|10)?[ :_-]*)?((?:97[89][0-9 -]{10,14}|\d{9}[0-9Xx]))(?!\d)", 1)
    isbn = F.regexp_replace(isbn, "[ -]", "")
    null = F.lit(None).cast("string")

    def of(series_: Column, authors: Column, title: Column, year: Column, publisher: Column) -> Column:
        return F.struct(
            series_.alias("series"), authors.alias("authors"), title.alias("title"), year.alias("year"),
            publisher.alias("publisher"), F.when(isbn_ok(isbn), isbn).alias("isbn"),
        )

    return (
        F.when(stem.rlike(series), of(part(series, 1), part(series, 2), part(series, 3), part(series, 4), part(series, 5)))
        .when(stem.rlike(plain), of(null, part(plain, 1), part(plain, 2), part(plain, 3), part(plain, 4)))
        .when(stem.rlike(long), of(null, part(long, 2), part(long, 1), null, null))
    )

"""Abstracts of papers that have only the text of their pages: a heading, what follows it, and where that ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_space

# Headings of an abstract, headings that end it, and lengths in characters.
HEADING = r"(?:(摘\s*要)|(Abstract|ABSTRACT|Summary|SUMMARY))\s*[：:.]?\s*"
NEXT = (
    r"(?:关\s*键\s*词|关\s*键\s*字|Key\s*[Ww]ords?|Keywords|KEY\s?WORDS"
    r"|(?:[1IⅠ一]\s*[.、,]?\s+)?(?:Introduction|INTRODUCTION|引\s*言|背\s*景)"
    r"|Categories\s+and\s+Subject|Index\s+[Tt]erms|CCS\s+CONCEPTS)"
)
LEAST, MOST, FRONT_PAGES, FRONT = 80, 3_000, 2, 2_000
#: the beginning of a line and its blanks; from line to line, so that runs of empty lines are read once
LINE = r"^[^\S\n]*"


def page_texts(pages: DataFrame, order: str = "page") -> DataFrame:
    """(doc_id, text, front) of pages (doc_id, page, text): all pages in order, and the first two.

    Pages without text count as empty ones. A document is one row, as elsewhere in the library.
    """
    held = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce("text", F.lit("")).alias("text")))).alias("held"))
    lines = F.transform("held", lambda p: F.concat(p["text"], F.lit("\n")))
    return held.select("doc_id", F.array_join(lines, "\n").alias("text"), F.array_join(F.slice(lines, 1, FRONT_PAGES), "\n").alias("front"))


def anchored(text: Column, front: Column) -> Column:
    """A struct of abstract and reason; null where there is no text at all.

    The abstract begins after the first line that begins with a heading, wherever it stands, and
    ends before the next heading, which may also follow the end of a sentence. Where no heading
    is, or less than 80 characters follow it, the first pages stand in.
    """
    heading = f"(?Udm){LINE}{HEADING}"
    rest = F.regexp_extract(text, heading + "((?s:.*))", 3)
    ends_on_lines = F.regexp_replace(rest, rf"(?U)([。.])\s+({NEXT})", "$1\n$2")
    own = collapse_space(F.left(F.split(ends_on_lines, f"(?Uidm){LINE}{NEXT}", 2)[0], F.lit(MOST)))
    chinese = F.regexp_extract(text, heading, 1) != ""
    first = collapse_space(F.left(front, F.lit(FRONT)))
    found = F.when(text.rlike(heading) & (F.char_length(own) >= LEAST), F.struct(own.alias("abstract"), F.when(chinese, "heading-cn").otherwise("heading-en").alias("reason")))
    return F.coalesce(found, F.when(first != "", F.struct(first.alias("abstract"), F.lit("fallback-first-pages").alias("reason"))))


def paper_abstracts(pages: DataFrame) -> DataFrame:
    """(doc_id, abstract, reason) of every document of pages; both null where its pages have no text."""
    return page_texts(pages).select("doc_id", anchored(F.col("text"), F.col("front")).alias("_found")).select("doc_id", "_found.abstract", "_found.reason")

"""Walkers and splitters as table functions, for SQL with LATERAL.

Spark 4.1 gives no row for a text without any, with LEFT JOIN LATERAL neither: where such rows
are wanted, the result is joined to its table again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.html import BLOCK_SCHEMA, blocks_of
from .chunks import OVERLAP, TARGET, split


@udtf(returnType=BLOCK_SCHEMA, useArrow=True)
class HtmlBlocks:
    """The blocks of one page, as sources.html.html_blocks has them; none without a page."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        if html:
            yield from blocks_of(html)


@udtf(returnType="part int, start_char int, end_char int, text string", useArrow=True)
class ChunkWindows:
    """The spans that a chunker cuts one text into, in code points; none without a text.

    A null target or overlap is that of the library. An overlap must be less than half the target.
    """

    def eval(self, text: str | None, target: int | None = None, overlap: int | None = None) -> Iterator[tuple]:
        most = TARGET if target is None else target
        shared = OVERLAP if overlap is None else overlap
        if not 0 <= 2 * shared < most:
            raise ValueError("an overlap must be at least 0 and less than half the target")
        for part, (a, b) in enumerate(split(text or "", most, shared)):
            yield part, a, b, text[a:b]


FUNCTIONS = {"html_blocks": HtmlBlocks, "chunk_windows": ChunkWindows}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL, by their names here."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)

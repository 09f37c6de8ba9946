"""Headings of papers: blocks that the outline names, and numbered lines that go on a sequence.

blocks: doc_id, block_idx, page, kind, text, font_size, bold, lines (physical lines).
outline: doc_id, entry_idx, label, depth, start_block (a block at the top of the entry's page).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, heading_number

# What begins a caption, what begins a line that is no heading, numbered statements, lengths.
CAPTION = r"^(?:Figure|Fig\.?|Table|图|表)\s*\d+(?:[.:\-]|\s+\S)"
NO_HEADING = (
    "we ", "the ", "in ", "this ", "proceedings of", "preprint", "copyright", "doi:", "https://", "http://", "vol.", "volume ", "issn ", "issn:",
    "received ", "accepted ", "published ",
)
STATEMENT = r"^(?i)(?:Definition|Theorem|Lemma|Corollary|Proposition|Remark|Example|Claim|Fact|Algorithm)\s+\d"
LENGTH = (3, 80)


def label_key(label: Column) -> Column:
    """What labels are compared by: without numbers before them, small letters, single blanks."""
    words = F.regexp_replace(label, r"^[0-9. \tIVX]+", "")
    return ascii_lower(F.trim(F.regexp_replace(words, r"(?U)\s+", " ")))


def captions(blocks: DataFrame) -> DataFrame:
    """blocks, of which those of the text that begin like a caption have kind caption."""
    own = (F.col("kind") == "body") & F.trim("text").rlike(CAPTION)
    return blocks.withColumn("kind", F.when(own, "caption").otherwise(F.col("kind")))


def usual_fonts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, usual): the median font size of each page, the upper one of two."""
    order = Window.partitionBy("doc_id", "page").orderBy("font_size")
    ranked = blocks.where("font_size is not null").select("doc_id", "page", "font_size", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("doc_id", "page")).alias("n"))
    return ranked.where(F.col("i") == F.floor(F.col("n") / 2)).select("doc_id", "page", F.col("font_size").alias("usual"))


def outline_headings(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, block_idx, level) of blocks that outline entries name.

    An entry looks from its start block to the end of the next page for single lines of 3 to
    80 characters, not in a smaller font than usual, of which one's key begins with the other's.
    Entries choose in order, each the first such block that none before it chose.
    """
    text = F.trim("text")
    gate = (F.col("kind") == "body") & F.char_length(text).between(*LENGTH) & (F.coalesce("lines", F.lit(1)) == 1)
    sized = blocks.join(usual_fonts(blocks), ["doc_id", "page"], "left")
    smaller = F.coalesce((F.col("usual") > 0.1) & (F.col("font_size") < 0.95 * F.col("usual")), F.lit(False))
    lines = sized.where(gate & ~smaller).select("doc_id", "page", "block_idx", label_key(text).alias("key")).where("key <> ''")
    named = outline.where(F.col("start_block").isNotNull() & ~F.trim("label").rlike(CAPTION))
    named = named.select("doc_id", "entry_idx", "depth", "start_block", label_key(F.col("label")).alias("label_key")).where("label_key <> ''")
    anchors = named.join(blocks.select("doc_id", F.col("block_idx").alias("start_block"), F.col("page").alias("at")), ["doc_id", "start_block"])
    # the pages and the first letter are equal where a pair fits, so only such pairs meet
    sought = anchors.withColumn("page", F.explode(F.array("at", F.col("at") + 1))).withColumn("letter", F.substring("label_key", 1, 1))
    met = sought.join(lines.withColumn("letter", F.substring("key", 1, 1)), ["doc_id", "page", "letter"])
    fits = F.startswith("key", F.col("label_key")) | F.startswith("label_key", F.col("key"))
    pairs = met.where(fits & (F.col("block_idx") >= F.col("start_block"))).select("doc_id", "entry_idx", "depth", "block_idx")

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, int] = {}
        for _, entry in own.sort_values(["entry_idx", "block_idx"]).groupby("entry_idx"):
            for block, depth in zip(entry["block_idx"], entry["depth"], strict=True):
                if block not in taken:
                    taken[block] = 1 if depth == 0 else 2
                    break
        return pd.DataFrame({"doc_id": own["doc_id"].iloc[0], "block_idx": list(taken), "level": list(taken.values())})

    return pairs.groupBy("doc_id").applyInPandas(choose, "doc_id long, block_idx int, level int")


def _series(text: Column) -> Column:
    """Which sequence a numbered line belongs to: roman, appendix or arabic; null without a number."""
    return F.when(text.rlike(r"^(?i)Appendix\s+[A-Z]\b"), "appendix").when(heading_number(text).isNotNull(), F.when(text.rlike(r"^[IVX]"), "roman").otherwise("arabic"))


def numbered_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, series, number) of lines that may be numbered headings.

    Single lines of 2 to 80 characters without formulas, addresses, or the beginnings of
    statements, notices and plain sentences; an Arabic number also needs bold type or a font
    over 1.1 times the usual.
    """
    text = F.trim("text")
    words = F.trim(F.regexp_replace(text, r"^(?:\d{1,2}(?:\.\d{1,2}){0,2}\.?|[IVX]{1,6}\.)\s+", ""))
    no = text.rlike(r"[=@∑∫≤≥]") | text.rlike(STATEMENT)
    for prefix in NO_HEADING:
        no = no | F.startswith(ascii_lower(text), F.lit(prefix)) | F.startswith(ascii_lower(words), F.lit(prefix))
    sized = blocks.join(usual_fonts(blocks), ["doc_id", "page"], "left")
    rows = sized.where((F.col("kind") == "body") & (F.col("lines") == 1) & F.char_length(text).between(2, 80)).withColumn("series", _series(text))
    rows = rows.where(F.col("series").isNotNull()).where(~no)  # few lines have a number, and only these are looked at for all beginnings
    stands_out = F.coalesce(F.col("bold"), F.lit(False)) | F.coalesce((F.col("usual") > 0.1) & (F.col("font_size") > 1.1 * F.col("usual")), F.lit(False))
    return rows.where((F.col("series") != "arabic") | stands_out).select("doc_id", "block_idx", "series", _number(text).alias("number"))


def _number(text: Column) -> Column:
    letter = F.ascii(F.upper(F.regexp_extract(text, r"^(?i)Appendix\s+([A-Z])", 1))) - 64
    return F.when(_series(text) == "appendix", F.array(letter)).otherwise(heading_number(text))


def in_sequence(lines: DataFrame, given: DataFrame) -> DataFrame:
    """(doc_id, block_idx, level) of lines whose numbers go on from the last heading of their series.

    given (doc_id, block_idx, series, number) are headings already: they set where a series
    stands, whatever it was. A line goes on if it is the next of its level or the first below.
    """
    both = lines.withColumn("given", F.lit(False)).unionByName(given.withColumn("given", F.lit(True)))

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        last: dict[str, list[int]] = {}
        out = []
        for row in own.sort_values("block_idx").itertuples(index=False):
            n, at = [int(x) for x in row.number], last.get(row.series, [])
            same = len(n) <= len(at) and n[:-1] == at[: len(n) - 1] and n[-1] == at[len(n) - 1] + 1
            if row.given or n == [*at, 1] or same:
                last[row.series] = n
                if not row.given:
                    out.append((row.doc_id, row.block_idx, len(n)))
        return pd.DataFrame(out, columns=["doc_id", "block_idx", "level"])

    return both.groupBy("doc_id").applyInPandas(walk, "doc_id long, block_idx int, level int")


def promote(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """blocks with kind and level of captions and headings, and by: outline or sequence for a heading that was made one here."""
    colored = captions(blocks)
    named = outline_headings(colored, outline)
    given = colored.join(named.select("doc_id", "block_idx"), ["doc_id", "block_idx"]).unionByName(colored.where("kind = 'heading'"))
    given = given.select("doc_id", "block_idx", _series(F.trim("text")).alias("series"), _number(F.trim("text")).alias("number")).where("series is not null")
    lines = numbered_lines(colored).join(named.select("doc_id", "block_idx"), ["doc_id", "block_idx"], "left_anti")
    made = named.withColumn("by", F.lit("outline")).unionByName(in_sequence(lines, given).withColumn("by", F.lit("sequence")))
    out = colored.join(made.withColumnRenamed("level", "made_level"), ["doc_id", "block_idx"], "left")
    kind = F.when(F.col("by").isNotNull(), "heading").otherwise(F.col("kind"))
    level = F.coalesce("made_level", F.col("level")) if "level" in blocks.columns else F.col("made_level")
    return out.withColumns({"kind": kind, "level": level}).drop("made_level")


def sources(promoted: DataFrame) -> DataFrame:
    """(doc_id, source): none, outline, heuristic or mixed, by what made headings of a document's blocks."""
    has = lambda by: F.coalesce(F.max(F.col("by") == by), F.lit(False))
    found = promoted.groupBy("doc_id").agg(has("outline").alias("o"), has("sequence").alias("s"))
    source = F.when(F.col("o") & F.col("s"), "mixed").when(F.col("o"), "outline").when(F.col("s"), "heuristic").otherwise("none")
    return found.select("doc_id", source.alias("source"))

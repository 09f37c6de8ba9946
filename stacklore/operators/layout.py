"""Layout of pages given as text segments with boxes: headers, numbers, columns, rows, paragraphs and numbered headings.

segments: doc_id, page, seg, left, right, top, bottom (from the top of the page down), text,
page_width, page_height.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_number

# Longest running header, margin of page numbers, where a gutter may be and how wide, gaps.
HEADER_CHARS, MARGIN, GUTTER, GUTTER_WIDTH, CANDIDATES = 80, 0.15, (0.30, 0.70), 0.03, 41
ROW_SHARE, PARAGRAPH_GAP, INDENT = 0.7, 1.5, 0.8


def without_running(segments: DataFrame) -> DataFrame:
    """segments but short texts found on two pages or more of their document, and numbers at the edge of a page."""
    short = segments.where(F.char_length("text") <= HEADER_CHARS)
    repeated = short.groupBy("doc_id", "text").agg(F.count_distinct("page").alias("pages")).where("pages >= 2")
    middle = (F.col("top") + F.col("bottom")) / 2 / F.col("page_height")
    number = F.col("text").rlike("^[0-9]{1,6}$") & ((middle <= MARGIN) | (middle >= 1 - MARGIN))
    return segments.where(~number).join(repeated, ["doc_id", "text"], "left_anti")


def gutters(segments: DataFrame) -> DataFrame:
    """(doc_id, page, gutter) of pages in two columns: the place between 30 and 70 % that the fewest segments cross.

    It must lie between segments on both sides whose edges are over 3 % of the width apart
    in the median; ties go to the leftmost place.
    """
    step = (GUTTER[1] - GUTTER[0]) / (CANDIDATES - 1)
    at = segments.select("*", F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1))).alias("i"))
    x = (GUTTER[0] + F.col("i") * step) * F.col("page_width")
    at = at.withColumn("x", x)
    sums = at.groupBy("doc_id", "page", "i", "x").agg(
        F.count_if((F.col("left") < F.col("x")) & (F.col("right") > F.col("x"))).alias("crossed"),
        F.count_if(F.col("right") <= F.col("x")).alias("on_left"),
        F.count_if(F.col("left") >= F.col("x")).alias("on_right"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN right <= x THEN right END)").alias("edge_left"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN left >= x THEN left END)").alias("edge_right"),
        F.max("page_width").alias("width"),
        F.count("*").alias("n"),
    )
    best = sums.groupBy("doc_id", "page").agg(F.min_by(F.struct("x", "crossed", "on_left", "on_right", "edge_left", "edge_right", "width", "n"), F.struct("crossed", "i")).alias("b"))
    b = F.col("b")
    two = (b["on_left"] > 0) & (b["on_right"] > 0) & (b["crossed"] * 5 < b["n"]) & (b["edge_right"] - b["edge_left"] > GUTTER_WIDTH * b["width"])
    return best.where(two).select("doc_id", "page", b["x"].alias("gutter"))


def in_columns(segments: DataFrame) -> DataFrame:
    """segments with column: 0, or 1 right of their page's gutter; pages are bounded, so their table is joined by key."""
    found = segments.join(gutters(segments), ["doc_id", "page"], "left")
    return found.withColumn("column", F.when(F.col("left") >= F.col("gutter"), 1).otherwise(0)).drop("gutter")


def rows_of(segments: DataFrame) -> DataFrame:
    """segments with line: a line begins with the topmost segment left, and takes those whose tops are within 0.7 of its height."""

    def of(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "left", "seg"], kind="stable")
        line, anchor, unit, out = -1, None, 0.0, []
        for top, bottom in zip(page["top"], page["bottom"], strict=True):
            if anchor is None or top - anchor > ROW_SHARE * unit:
                line, anchor, unit = line + 1, top, bottom - top
            out.append(line)
        return page.assign(line=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return segments.groupBy("doc_id", "page", "column").applyInPandas(of, f"{fields}, line int")


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, page, column, paragraph, text) of segments in lines: a wide gap or an indent begins a paragraph."""
    lines = rows.groupBy("doc_id", "page", "column", "line").agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"),
        F.array_sort(F.collect_list(F.struct("left", "seg", "text"))).alias("parts"),
    )
    w = Window.partitionBy("doc_id", "page", "column").orderBy("line")
    lines = lines.withColumn("gap", F.col("top") - F.lag("top").over(w)).withColumn("unit", F.col("bottom") - F.col("top"))
    usual = lines.groupBy("doc_id", "page", "column").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("usual_gap"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY left)").alias("usual_left"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unit)").alias("usual_unit"),
    )
    joined = lines.join(usual, ["doc_id", "page", "column"])
    new = (F.col("gap") > PARAGRAPH_GAP * F.col("usual_gap")) | (F.col("left") > F.col("usual_left") + INDENT * F.col("usual_unit"))
    marked = joined.withColumn("paragraph", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w))
    out = marked.groupBy("doc_id", "page", "column", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", F.array_join("parts.text", " ").alias("text")))).alias("l"))
    return out.select("doc_id", "page", "column", "paragraph", F.array_join("l.text", " ").alias("text"))


def valid_numbers(headings: DataFrame) -> DataFrame:
    """headings (doc_id, block_idx, text) whose numbers go on from the last accepted: the next of a level, or the first below.

    A document's headings come to one task in order; what is kept of them is three counters.
    """
    numbered = headings.withColumn("number", heading_number(F.col("text"))).where("number is not null")
    groups = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "number", "text"))).alias("h"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, items in batch.itertuples(index=False):
                last: list[int] = []
                for h in items:
                    n = list(h["number"])
                    deeper = n[:-1] == last and n[-1] == 1
                    same = len(n) <= len(last) and n[:-1] == last[: len(n) - 1] and n[-1] == last[len(n) - 1] + 1
                    if (not last and n == [1]) or (last and (deeper or same)):
                        out.append((doc, h["block_idx"], len(n), h["text"]))
                        last = n
            yield pd.DataFrame(out, columns=["doc_id", "block_idx", "level", "text"])

    return groups.mapInPandas(of, "doc_id long, block_idx int, level int, text string")


def heading_candidates(blocks: DataFrame) -> DataFrame:
    """One-line blocks of 2 to 80 characters, without formulas or addresses, bold or in a font over 1.1 times the page's median."""
    body = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("font_size")).alias("s"))
    median = F.coalesce(F.try_element_at("s", F.floor(F.size("s") / 2).cast("int") + 1), F.lit(0.0))
    with_median = blocks.join(body.select("doc_id", "page", median.alias("usual")), ["doc_id", "page"])
    text = F.trim("text")
    plain = F.char_length(text).between(2, 80) & ~text.rlike(r"[=@∑∫≤≥]|\n")
    return with_median.where(plain & (F.col("bold") | (F.col("font_size") > 1.1 * F.col("usual")))).drop("usual")

"""The gate that decides whether a text layer can be trusted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK_QUALITY, PRIVATE_USE


@dataclass(frozen=True)
class Thresholds:
    # The default limits of the gate.
    chars_ocr: float = 50.0
    chars_doubt: float = 200.0
    replacement_ocr: float = 0.05
    private_ocr: float = 0.10
    private_doubt: float = 0.01
    control_ocr: float = 0.02
    images: float = 0.5
    cjk_space_doubt: float = 0.02


def assess(pages: DataFrame, key: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """Signals and verdict of each document of pages (key, text, has_image); one map-side aggregate."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda p: F.sum(F.regexp_count(text, F.lit(p)))
    sums = pages.groupBy(key).agg(
        F.count("*").alias("page_count"),
        F.count_if(F.char_length(text) >= 20).alias("pages_with_text"),
        F.count_if(F.col("has_image")).alias("image_pages"),
        F.sum(F.char_length(text)).alias("total_chars"),
        count(r"[\x{FFFD} ]*\x{FFFD}[\x{FFFD} ]*").alias("runs"),
        count(r"\x{FFFD}").alias("glyphs"),
        count(f"[{PRIVATE_USE}]").alias("private"),
        count(r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]").alias("control"),
        count("[0-9]").alias("digit"),
        count(f"[{CJK_QUALITY}]").alias("cjk"),
        count("[A-Za-z]").alias("latin"),
        count(f"(?<=[{CJK_QUALITY}]) (?=[{CJK_QUALITY}])").alias("split_cjk"),
    )
    share = lambda n, d="total_chars": F.when(F.col(d) == 0, 0.0).otherwise(F.col(n) / F.col(d))
    ratios = sums.select(
        key, "page_count", "pages_with_text", "image_pages", "total_chars",
        (F.col("total_chars") / F.col("page_count")).alias("chars_per_page"),
        share("image_pages", "page_count").alias("image_page_ratio"),
        share("runs").alias("replacement_ratio"),
        share("glyphs").alias("replacement_char_ratio"),
        share("private").alias("pua_ratio"),
        share("control").alias("control_ratio"),
        share("split_cjk", "cjk").alias("cjk_space_ratio"),
        share("digit").alias("digit_ratio"),
        share("cjk").alias("cjk_ratio"),
        share("latin").alias("latin_ratio"),
    )
    return ratios.withColumn("verdict", ladder(limits))


def ladder(limits: Thresholds) -> Column:
    """First rule that applies: what makes a layer unusable, then what makes it doubtful."""
    c = F.col
    return (
        F.when((c("total_chars") == 0) | (c("chars_per_page") < limits.chars_ocr), "ocr:no_text_layer")
        .when(c("replacement_ratio") >= limits.replacement_ocr, "ocr:replacement")
        .when(c("pua_ratio") >= limits.private_ocr, "ocr:private_use")
        .when(c("control_ratio") >= limits.control_ocr, "ocr:control")
        .when(c("image_page_ratio") >= limits.images, "doubtful:dual_layer")
        .when(c("cjk_space_ratio") >= limits.cjk_space_doubt, "doubtful:split_cjk")
        .when(c("chars_per_page") < limits.chars_doubt, "doubtful:sparse")
        .when((c("pua_ratio") >= limits.private_doubt) | (c("replacement_ratio") > 0), "doubtful:anomalies")
        .otherwise("usable")
    )

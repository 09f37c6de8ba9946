"""Audit of book metadata: a grade and flags for each of seven fields, a verdict and a confidence.

Grades are numbers while they are worked out: 0 missing, 1 weak, 2 medium, 3 strong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import isbn_ok
from ..functions.text import body_agrees, fold_publisher, is_bcp47, is_placeholder

FIELDS = ("title", "language", "publisher", "year", "isbn", "subtitle", "series")
GRADES = ("missing", "weak", "medium", "strong")
# Adapters whose metadata is trusted, and needles that give a distributor away.
TRUSTED = ("epub", "mobi", "azw3")
URLS, MAILS = ("http://", "https://", "www.", ".com", ".net", ".org", ".cn"), ("@",)
BRACKETS = (("(", ")"), ("[", "]"), ("（", "）"), ("【", "】"), ("《", "》"))


def _flags(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def bracket_kind(title: Column, least: int = 3, volume_suffixes: tuple[str, ...] = ()) -> Column:
    """What a bracketed part at the head or the tail of a title is: series, marketing, aggregator or volume."""
    out = F.lit(None).cast("string")
    for a, b in reversed(BRACKETS):
        q = lambda s: "\\" + s if s in "()[]" else s
        inner = rf"{q(a)}([^{q(a)}{q(b)}]+){q(b)}"
        part = F.trim(F.coalesce(F.nullif(F.regexp_extract(title, rf"^\s*{inner}\s*\S", 1), F.lit("")), F.regexp_extract(title, rf"\S\s*{inner}\s*$", 1)))
        kind = {"(": "series", "（": "series", "【": "marketing", "[": "aggregator", "《": "series"}[a]
        volume = F.lower(part) == "indexed"
        for suffix in volume_suffixes:
            volume = volume | F.endswith(part, F.lit(suffix))
        out = F.when(volume, "volume").when(F.char_length(part) >= least, kind).otherwise(out)
    return out


def publisher_kind(value: Column, whitelist: tuple[str, ...] = ()) -> Column:
    """watermark:url, watermark:email, whitelisted, or null."""
    has = lambda needles: F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(F.lower(value), n))
    out = F.when(has(URLS), "watermark:url").when(has(MAILS), "watermark:email")
    if whitelist:
        known = F.array(*[fold_publisher(F.lit(w)) for w in whitelist])
        out = out.when(F.array_contains(known, fold_publisher(value)), "whitelisted")
    return out


def audit(records: DataFrame, whitelist: tuple[str, ...] = (), volume_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """records with fields (array of field, grade, flags), verdict, confidence and shape_flags.

    records: the seven fields as strings (null: none), adapter, source_stem, year_raw,
    body, doubtful, year_overridden, and toc_entries, unanchored, suspicious_flat, heading_skew.
    """
    c = F.col
    prior = ~c("adapter").isin(*TRUSTED)
    raw_year = F.regexp_extract(F.coalesce("year_raw", F.lit("")), r"(\d{4})", 1)

    def finish(name: str, start: Column, flags: list[tuple[Column, str, int]], weigh_prior: bool = True, lift: Column | None = None) -> Column:
        present = c(name).isNotNull()
        tests = [(F.coalesce(t, F.lit(False)), f, n) for t, f, n in flags]
        if weigh_prior:
            tests.append((present & prior, "source_prior_weak", 1))
        tests.append((present & c("doubtful"), "doubtful_text_layer", 1))
        lost = sum((F.when(test, notches).otherwise(0) for test, _, notches in tests if notches), F.lit(0))
        grade = F.greatest(start - lost, F.lit(0))
        if lift is not None:
            grade = F.when(lift, F.least(grade + 1, F.lit(3))).otherwise(grade)
        named = F.element_at(F.array(*map(F.lit, GRADES)), (grade + 1).cast("int"))
        return F.struct(F.lit(name).alias("field"), named.alias("grade"), _flags(*[(t, f) for t, f, _ in tests]).alias("flags"))

    blank = lambda n: c(n).isNull() | (F.trim(c(n)) == "")
    required = lambda n: F.when(blank(n), 0).otherwise(3)
    filled = lambda n, test: ~blank(n) & test
    t, kind, pub = F.trim("title"), bracket_kind(F.trim("title"), volume_suffixes=volume_suffixes), publisher_kind(F.trim("publisher"), whitelist)
    same = lambda a, b: F.lower(a) == F.lower(b)
    year = F.trim("year").try_cast("int")
    overridden = c("year_overridden")
    fields = F.array(
        finish("title", required("title"), [
            (blank("title"), "empty", 0),
            (filled("title", is_placeholder(t)), "placeholder_value", 1),
            (filled("title", t.rlike(r"^[\p{N}\s]+$")), "purely_numeric", 1),
            (filled("title", same(c("source_stem"), t)), "equals_filename", 1),
            (filled("title", same(c("publisher"), t)), "equals_publisher", 1),
            (filled("title", kind == "series"), "title_series_paren", 1),
            (filled("title", kind == "marketing"), "title_marketing_block", 1),
            (filled("title", kind == "aggregator"), "title_aggregator_marker", 1),
            (filled("title", kind == "volume"), "title_volume_marker", 0),
        ]),
        finish("language", required("language"), [
            (blank("language"), "empty", 0),
            (filled("language", ~is_bcp47(F.trim("language"))), "non_bcp47", 1),
            (filled("language", ~body_agrees(c("body"), F.trim("language"))), "lang_mismatches_body", 1),
        ]),
        finish("publisher", required("publisher"), [
            (blank("publisher"), "empty", 0),
            (filled("publisher", F.startswith(pub, F.lit("watermark"))), "source_watermark", 2),
            (filled("publisher", pub == "whitelisted"), "publisher_whitelisted", 0),
        ], lift=F.coalesce(filled("publisher", pub == "whitelisted"), F.lit(False))),
        finish("year", F.when(c("year").isNull(), 0).otherwise(3), [
            (c("year").isNull(), "empty", 0),
            (c("year").isNotNull() & (year.isNull() | ~year.between(1450, 2100)), "year_out_of_range", 1),
            (c("year").isNotNull() & (c("adapter") == "pdf") & ~overridden, "pdf_year_likely_file_date", 1),
            (c("year").isNotNull() & ~overridden & (raw_year == F.trim("year")) & (F.contains("year_raw", F.lit("T")) | F.contains("year_raw", F.lit(":"))), "date_looks_like_timestamp", 1),
        ]),
        finish("isbn", F.when(c("isbn").isNull(), 2).otherwise(3), [(c("isbn").isNotNull() & ~isbn_ok(F.trim("isbn")), "isbn_check_failed", 1)], weigh_prior=False),
        *[
            finish(n, F.when(blank(n), 2).otherwise(3), [(c(n).isNotNull() & (F.trim(n) == ""), "empty", 0)])
            for n in ("subtitle", "series")
        ],
    )
    out = records.withColumn("fields", fields)
    part = F.col("toc_entries")
    shape = _flags(
        (c("unanchored").between(1, F.ceil(part / 2) - 1), "toc:unanchored_some"),
        ((c("unanchored") > 0) & (c("unanchored") * 2 >= part), "toc:unanchored_half"),
        (c("suspicious_flat"), "toc:suspicious_flat"),
        (c("heading_skew"), "toc:heading_block_skew"),
    )
    severe = (c("unanchored") > 0) & (c("unanchored") * 2 >= part) | c("suspicious_flat") & (part > 10)
    out = out.withColumn("shape_flags", shape).withColumn("_severe", severe)
    is_ = lambda names, grades: F.exists("fields", lambda f: f["field"].isin(*names) & f["grade"].isin(*grades))
    core = ("title", "language", "publisher", "year")
    confidence = (
        F.when(c("_severe") | is_(core, ("missing",)), "low")
        .when(~is_(core, ("missing", "weak", "medium")), F.when(F.size("shape_flags") > 0, "medium").otherwise("high"))
        .when(is_(core, ("weak",)), "low")
        .otherwise("medium")
    )
    verdict = F.when(c("_severe") | is_(("title", "language"), ("missing", "weak")), "needs_work").otherwise("clean")
    return out.withColumn("verdict", verdict).withColumn("confidence", confidence).drop("_severe")

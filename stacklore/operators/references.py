"""Looking up reference entries: overlays, redirects, severity and substrings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import alphanumeric_core

# How grave a flag is.
SEVERITY = {"verified_by_user": 0, "spliced_from_orphan": 1, "pair_mismatch": 2, "low_ocr_confidence": 2, "anchor_glued_with_body": 2, "redirect_loop": 3}


def _merge(target, change):
    if not isinstance(change, dict):
        return change
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in change.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = _merge(out.get(key), value)
    return out


@pandas_udf(T.StringType())
def merge_patch(target: pd.Series, change: pd.Series) -> pd.Series:
    """JSON merge patch: null takes a member away, objects are merged, all else replaces."""
    return pd.Series([t if c is None else json.dumps(_merge(json.loads(t) if t else {}, json.loads(c)), ensure_ascii=False) for t, c in zip(target, change, strict=True)], dtype=object)


@pandas_udf(T.StringType())
def string_leaves(payload: pd.Series) -> pd.Series:
    """All strings of a JSON value in order, space-joined."""

    def walk(v):
        if isinstance(v, str):
            yield v
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from walk(x)

    return payload.map(lambda x: None if x is None else " ".join(walk(json.loads(x))))


def effective(entries: DataFrame, overlays: DataFrame) -> DataFrame:
    """Entries with their payload as the overlay patches it."""
    over = overlays.select("book_slug", "entry_key", F.col("payload").alias("_patch"))
    return entries.join(over, ["book_slug", "entry_key"], "left").withColumn("payload", merge_patch("payload", "_patch")).drop("_patch")


def lookup(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, hit columns, redirected, flags) for each query: direct hits, else by the folded key.

    A query with exactly one direct hit that redirects gets the target's entry; a redirect
    to the entry itself is flagged as a loop.
    """
    own = entries.withColumn("redirect_to", F.get_json_object("payload", "$.redirect_to"))
    direct = asked.join(own, asked["query"] == own["entry_key"])
    missed = asked.join(direct.select("query").distinct(), "query", "left_anti").withColumn("folded", alphanumeric_core(F.col("query")))
    by_fold = missed.join(own, missed["folded"] == own["entry_key"]).drop("folded")
    hits = direct.unionByName(by_fold)
    counted = hits.join(hits.groupBy("query").agg(F.count("*").alias("_n")), "query")
    target = own.select("book_slug", F.col("entry_key").alias("redirect_to"), *[F.col(c).alias(f"_t_{c}") for c in ("entry_key", "headword", "payload", "flags")])
    moved = counted.where((F.col("_n") == 1) & F.col("redirect_to").isNotNull()).join(target, ["book_slug", "redirect_to"], "left")
    loop = F.col("_t_entry_key") == F.col("entry_key")
    flags = F.when(loop, F.array_union("flags", F.array(F.lit("redirect_loop")))).otherwise(F.coalesce("_t_flags", "flags"))
    moved = moved.select(
        "query", "book_slug", F.coalesce("_t_entry_key", "entry_key").alias("entry_key"), F.coalesce("_t_headword", "headword").alias("headword"),
        F.coalesce("_t_payload", "payload").alias("payload"), F.coalesce(F.col("_t_entry_key").isNotNull() & ~loop, F.lit(False)).alias("redirected"), flags.alias("flags"),
    )
    plain = counted.where((F.col("_n") != 1) | F.col("redirect_to").isNull()).select("query", "book_slug", "entry_key", "headword", "payload", F.lit(False).alias("redirected"), "flags")
    return plain.unionByName(moved)


def grave(flags: Column, least: int) -> Column:
    """True for hits without flags, and for those with a flag of at least that severity (an unknown flag is 0)."""
    known = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.when(F.size(flags) == 0, True).otherwise(F.exists(flags, lambda f: F.coalesce(F.try_element_at(known, f), F.lit(0)) >= least))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text: those that begin at every third character, from the first, the second and the third on."""
    each = [F.regexp_extract_all(F.substring(text, i, 2**31 - 1), F.lit("(?s)..."), F.lit(0)) for i in (1, 2, 3)]
    return F.array_distinct(F.concat(*each))


def trigram_index(entries: DataFrame, text: str, key: str = "entry_id") -> DataFrame:
    return entries.select(F.explode(trigrams(F.lower(text))).alias("gram"), key)


def substring_search(entries: DataFrame, index: DataFrame, needle: str, text: str, key: str = "entry_id") -> DataFrame:
    """Entries that contain needle: those with all its trigrams, compared in full. Shorter needles scan."""
    low = needle.lower()
    if len(low) < 3:
        return entries.where(F.contains(F.lower(text), F.lit(low)))
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    full = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return entries.join(full, key, "left_semi").where(F.contains(F.lower(text), F.lit(low)))

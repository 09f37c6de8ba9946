"""Attributes as they are first written, and work that is done again: rebuild, embed, audit, reset."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import isbn_ok
from ..functions.text import alphanumeric_core, redact

BASE_FIELDS = ("title", "subtitle", "publisher", "year", "isbn", "series", "language")
FROM_NAME = ("title", "publisher", "year", "isbn", "series")


def garbage_title(title: Column, placeholders: tuple[str, ...], substrings: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """placeholder, substring or regex: the first kind of rule by which a title says nothing, else null."""
    name = F.trim(title)
    known = [p for p in {"".join(c for c in x.lower() if c.isalnum()) for x in placeholders} if p]
    out = F.when(name == "", F.lit(None).cast("string"))
    if known:
        out = out.when(alphanumeric_core(name).isin(*sorted(known)), "placeholder")
    for needle in filter(None, substrings):
        out = out.when(F.contains(F.lower(name), F.lit(needle.lower())), "substring")
    for pattern in patterns:
        out = out.when(name.rlike(f"(?i){pattern}"), "regex")
    return out


def base_attributes(items: DataFrame, placeholders: tuple[str, ...], substrings: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> DataFrame:
    """items with their fields as they are first written, source, and actions in the order they were taken.

    items: the seven fields as extracted, year_raw, adapter, and name, a struct of what the
    file's name says (see identifiers.name_fields; null if it says nothing). An ISBN that
    fails its checksum is dropped, a year that comes from a time stamp too if the name has
    another, and a title that says nothing. What is empty then is filled from the name.
    """
    c = F.col
    named = lambda f: F.nullif(c(f"name.{f}"), F.lit(""))
    bad_isbn = c("isbn").isNotNull() & ~F.coalesce(isbn_ok(c("isbn")), F.lit(False))
    stamped = F.coalesce(c("year_raw").rlike(r"^(?:D:)?\d{8,}|^\d{4}-\d{2}-\d{2}T"), F.lit(False))
    stale = c("year").isNotNull() & stamped & named("year").isNotNull() & (named("year") != c("year"))
    garbage = garbage_title(c("title"), placeholders, substrings, patterns)
    dropped = {"isbn": bad_isbn, "year": F.coalesce(stale, F.lit(False)), "title": garbage.isNotNull()}
    kept = {f: F.when(~dropped[f], c(f)) if f in dropped else c(f) for f in BASE_FIELDS}
    filled = {f: kept[f].isNull() & named(f).isNotNull() for f in FROM_NAME}
    steps = [F.when(dropped[f], F.lit(f"drop:{f}")) for f in ("isbn", "year")]
    steps.append(F.when(garbage.isNotNull(), F.concat(F.lit("drop:title:"), garbage)))
    steps += [F.when(filled[f], F.lit(f"filename:{f}")) for f in FROM_NAME]
    own = F.coalesce(*kept.values()).isNotNull()
    by_name = F.greatest(*[filled[f].cast("int") for f in FROM_NAME]) == 1
    source = F.when(c("adapter") == "ocr-pages", "ocr_marker").when(own | ~by_name, "extracted").otherwise("filename")
    fields = [F.coalesce(kept[f], named(f)).alias(f) if f in FROM_NAME else kept[f].alias(f) for f in BASE_FIELDS]
    others = [x for x in items.columns if x not in (*BASE_FIELDS, "name", "year_raw")]
    return items.select(*others, *fields, source.alias("source"), F.array_compact(F.array(*steps)).alias("actions"))


def sniff_title(title: Column, least_letters: float = 0.55) -> Column:
    """A document's own title, trimmed; null for file names, arXiv banners and codes with few letters."""
    name = F.trim(title)
    # Endings of production files.
    file_name = name.rlike(r"(?i)\.(?:pdf|docx?|tex|dvi|ps|indd|qxd|rtf|pptx?|eps)$")
    letters = F.regexp_count(name, F.lit(r"\p{L}")) / F.greatest(F.char_length(F.regexp_replace(name, r"(?U)\s", "")), F.lit(1))
    banner = F.lower(name).rlike("^arxiv[: ]")
    return F.when((name != "") & ~file_name & ~banner & (letters >= least_letters), name)


def pdf_year(date: Column) -> Column:
    """The year of a PDF date."""
    return F.regexp_extract(date, r"^(?:D:)?(\d{4})", 1).try_cast("int")


def rebuild_plan(items: DataFrame, envelopes: DataFrame, version: int | None = None) -> DataFrame:
    """(intake_id, bucket) of all items, or of those that another extractor version made: rebuilt, missing, mismatched or failed.

    items: intake_id, source_sha256, extractor_version; envelopes: intake_id, source_sha256, body (null: unreadable).
    """
    wanted = items if version is None else items.where(F.coalesce(F.col("extractor_version") != version, F.lit(True)))
    found = envelopes.select("intake_id", F.struct(F.col("source_sha256").alias("sha"), F.col("body").isNotNull().alias("ok")).alias("e"))
    bucket = F.when(F.col("e").isNull(), "missing").when(F.col("e.sha") != F.col("source_sha256"), "mismatched").when(~F.col("e.ok"), "failed").otherwise("rebuilt")
    return wanted.join(found, "intake_id", "left").select("intake_id", bucket.alias("bucket"))


def reembed_plan(items: DataFrame, chunks: DataFrame, only: list[int] | None = None) -> DataFrame:
    """(intake_id, chunks, chars) of what embedding again takes; items without chunks are not listed."""
    wanted = items if only is None else items.where(F.col("intake_id").isin(only))
    sums = chunks.groupBy("intake_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("chars"))
    return sums.join(wanted.select("intake_id").distinct(), "intake_id", "left_semi")


def reset(items: DataFrame, chunks: DataFrame, resume: bool = False) -> tuple[DataFrame, DataFrame]:
    """items with embedded ones extracted again (resume: as they are), and (intake_id, has_chunks) of what is to be embedded."""
    status = F.when(F.col("status") == "embedded", "extracted").otherwise(F.col("status"))
    out = items if resume else items.withColumn("status", status)
    have = chunks.select("intake_id").distinct().withColumn("_has", F.lit(True))
    todo = out.where("status = 'extracted'").join(have, "intake_id", "left")
    return out, todo.select("intake_id", F.coalesce("_has", F.lit(False)).alias("has_chunks"))


def reaudit(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(intake_id, old and new verdict and confidence, changed, outcome): partial where the new audit has no verdict, so the old one stays."""
    new = audited.select("intake_id", F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    joined = rows.join(new, "intake_id")
    ok = F.col("_v").isNotNull() & F.col("_c").isNotNull()
    pick = lambda a, b: F.when(ok, F.col(a)).otherwise(F.col(b))
    return joined.select(
        "intake_id", F.col("verdict").alias("old_verdict"), F.col("confidence").alias("old_confidence"),
        pick("_v", "verdict").alias("verdict"), pick("_c", "confidence").alias("confidence"),
        (ok & ~(F.col("_v").eqNullSafe(F.col("verdict")) & F.col("_c").eqNullSafe(F.col("confidence")))).alias("changed"), F.when(ok, "ok").otherwise("partial").alias("outcome"),
    )


def ocr_product(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(intake_id, source_sha256, text, pages, missing, accepted) of OCR pages (intake_id, page, text, expected): texts joined in
    order, the item they derive from, and whether every expected page is there."""
    sums = pages.groupBy("intake_id").agg(
        F.max("expected").alias("expected"), F.count_distinct("page").alias("pages"),
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"),
    )
    found = sums.join(items.select("intake_id", "source_sha256"), "intake_id")
    missing = F.greatest(F.col("expected") - F.col("pages"), F.lit(0))
    return found.select("intake_id", "source_sha256", F.array_join("p.text", "\n\n").alias("text"), "pages", missing.alias("missing"), (missing == 0).alias("accepted"))


# --- payloads and settings ------------------------------------------------------


def aliases(payload: Column, keys: tuple[str, ...] = ("aliases", "alias")) -> Column:
    """Other names in a JSON payload: a string, or an array of strings, under each of keys; none where the payload is no JSON."""
    parsed = F.try_parse_json(payload)
    none = F.array().cast("array<string>")

    def under(key: str) -> Column:
        many = F.try_variant_get(parsed, f"$['{key}']", "array<string>")
        one = F.try_variant_get(parsed, f"$['{key}']", "string")
        return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), none)

    return F.filter(F.flatten(F.array(*map(under, keys))), lambda x: x.isNotNull() & (x != ""))


def full_text(headword: Column, names: Column, leaves: Column) -> Column:
    """What an entry is found by: its headword, other names, and the leaves of its payload."""
    return F.concat_ws(" ", F.nullif(headword, F.lit("")), F.nullif(F.array_join(names, " "), F.lit("")), F.nullif(leaves, F.lit("")))


def strings_as_json(items: Column) -> Column:
    """An array of strings as JSON text, null when it is empty."""
    return F.when(F.size(items) > 0, F.to_json(items))


def one_hot(flags: Column, names: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.array_contains(flags, n), F.lit(False)).cast("int").alias(n) for n in names]


def from_one_hot(names: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]))


def scrub_json(value: Column) -> Column:
    """JSON text with every string value redacted as what it says, however it is escaped; keys, numbers and structure stay.

    A string in which there is nothing to redact stays as it was written; one that cannot be
    decoded is redacted as it stands.
    """
    strings = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'
    found = F.regexp_extract_all(value, F.lit(strings), F.lit(0))

    def of_value(m: Column) -> Column:
        said = F.coalesce(F.element_at(F.from_json(F.concat(F.lit("["), m, F.lit("]")), "array<string>"), 1), m)
        cleaned = redact(said)
        written = F.to_json(F.array(cleaned))
        return F.when(F.endswith(m, F.lit(":")) | (cleaned == said), m).otherwise(F.substring(written, F.lit(2), F.char_length(written) - 2))

    between = F.split(value, strings, -1)
    pairs = F.zip_with(between, F.transform(found, of_value), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) == 0, value).otherwise(F.array_join(pairs, ""))


def strip_span(s: Column, start: Column, end: Column) -> Column:
    """s without the characters from start to before end (counted from 0), its white space made single."""
    rest = F.concat_ws(" ", F.substring(s, F.lit(1), start), F.substring(s, end + 1, F.char_length(s)))
    return F.trim(F.regexp_replace(rest, r"(?U)\s+", " "))


def canonical_json(settings: dict) -> str:
    """One text for equal settings, whatever the order of their keys."""
    return json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def switches(settings: dict, prefix: str = "") -> dict[str, bool]:
    """The booleans of nested settings by their dotted names."""
    out: dict[str, bool] = {}
    for key, value in sorted(settings.items()):
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            out |= switches(value, f"{name}.")
        elif isinstance(value, bool):
            out[name] = value
    return out


def search_options(asked: dict, built: dict | None) -> dict:
    """What a call asks for, else what the index was built with; bypassing the index sticks once either says so."""
    base = {"probes": None, "refine": None, "bypass": False} | (built or {})
    out = base | {k: v for k, v in asked.items() if v is not None}
    return out | {"bypass": bool(base["bypass"] or asked.get("bypass"))}

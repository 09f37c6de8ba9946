"""The stages from a file to chunks, each with a channel for what fails.

Items go through extract, structure, audit and chunk. A broken item is a row in the report
that says at which stage and why, never a dead job. The stages only plan; a dry run stops
there, an ingest hands the same plans to a library, which publishes them as one version.
What extraction found is kept in envelopes, so that items can be structured and audited
again without their files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import name_fields
from ..functions.text import file_stem
from ..sources import files, html
from . import book_audit, rework, sinks, structure

#: raised when extraction gives other blocks for the same file
EXTRACTOR_VERSION = 1
BODY = 2_000
BLOCK = "struct<kind:string,level:int,text:string,source_unit:int>"
EXTRACTED = (
    "outcome string, error string, title string, language string, publisher string, date string, author string, "
    f"blocks array<{BLOCK}>, toc array<struct<label:string,depth:int,start_block:int>>"
)
Extractor = Callable[[bytes], dict]


class NeedsOcr(ValueError):
    """The file is sound, and has no text to read."""


def _text_file(content: bytes) -> dict:
    text, _ = files.decode(content)
    lines = (line.replace("\t", " ").replace("　", " ").strip(" ") for line in re.split(r"\r\n|[\r\n]", text))
    return {"blocks": [("line", None, line, 0) for line in lines if line]}


def _html_file(content: bytes) -> dict:
    text, _ = files.decode(content)
    head = html.head_of(text)
    blocks = [(kind, level, body, 0) for _, kind, level, body, _ in html.blocks_of(text)]
    toc = [(body, level - 1, i) for i, (kind, level, body, _) in enumerate(blocks) if kind == "heading"]
    return {"title": head["title"], "language": head["lang"], "author": head["author"], "blocks": blocks, "toc": toc}


def _epub_file(content: bytes) -> dict:
    found = files.read_epub(content)
    authors = [name for role, name in found["people"] if role == "aut"]
    return {**found, "author": authors[0] if authors else None}


EXTRACTORS: dict[str, Extractor] = {"txt": _text_file, "html": _html_file, "epub": _epub_file}


def extract(items: DataFrame, extractors: dict[str, Extractor] | None = None, kept: Callable[[DataFrame], DataFrame] = sinks.stored) -> DataFrame:
    """items (doc_id, name, content) with adapter, source_sha256, outcome, error and what was found.

    outcome is extracted, unsupported (no extractor for the name), needs_ocr (nothing to read) or
    error, whatever the extractor raised; then error says why. Blocks of text files are lines, whose
    headings blocks_of finds. Null and repeated ids go through row by row here. kept writes the
    result down and gives it back.
    """
    known = EXTRACTORS if extractors is None else extractors
    fields = [f.split(" ")[0] for f in re.split(r", (?![^<]*>)", EXTRACTED)]

    def one(adapter: str, content) -> dict:
        if adapter not in known:
            return {"outcome": "unsupported", "error": f"no extractor for {adapter}"}
        if content is None:
            return {"outcome": "error", "error": "no content"}
        try:
            found = known[adapter](bytes(content))
            if not found.get("blocks"):
                raise NeedsOcr("no text")
            return {"outcome": "extracted", **found}
        except NeedsOcr as error:
            return {"outcome": "needs_ocr", "error": str(error)}
        except Exception as error:  # whatever a file does to a parser is that file's row
            return {"outcome": "error", "error": f"{type(error).__name__}: {error}"[:500]}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(a, c) for a, c in zip(batch["adapter"], batch["content"], strict=True)]
            out = {f: [x.get(f) for x in found] for f in fields}
            yield pd.DataFrame({**{c: batch[c] for c in ("key", "name", "adapter", "source_sha256")}, **out})

    rows = items.select(F.col("doc_id").cast("string").alias("key"), "name", files.detect(F.col("name")).alias("adapter"), F.sha2("content", 256).alias("source_sha256"), "content")
    found = rows.mapInPandas(of, f"key string, name string, adapter string, source_sha256 string, {EXTRACTED}")
    return kept(found.select(F.col("key").cast("long").alias("doc_id"), *found.columns[1:]))


def blocks_of(extracted: DataFrame, level: Column) -> DataFrame:
    """Blocks of extracted items; lines whose level is not null are headings."""
    rows = extracted.where("outcome = 'extracted' and doc_id is not null").select("doc_id", F.posexplode("blocks").alias("block_idx", "b"))
    rows = rows.select("doc_id", "block_idx", F.col("b.kind").alias("kind"), F.col("b.level").alias("own"), F.col("b.text").alias("line"), F.col("b.source_unit").alias("source_unit"))
    is_line = F.col("kind") == "line"
    kind = F.when(is_line & level.isNotNull(), "heading").when(is_line, "body").otherwise(F.col("kind"))
    return rows.select("doc_id", "block_idx", kind.alias("kind"), F.when(is_line, level).otherwise(F.col("own")).cast("int").alias("level"), F.col("line").alias("text"), "source_unit")


def contents_of(extracted: DataFrame, blocks: DataFrame) -> DataFrame:
    """Contents entries: those that the file has, else its headings."""
    own = extracted.where("outcome = 'extracted' and doc_id is not null and size(toc) > 0").select("doc_id", F.posexplode("toc").alias("entry_idx", "t")).select("doc_id", "entry_idx", "t.label", "t.depth", "t.start_block")
    rest = blocks.join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    return own.unionByName(structure.contents_of(rest))


def records(extracted: DataFrame, blocks: DataFrame, toc: DataFrame, overrides: DataFrame | None = None, placeholders: tuple[str, ...] = ("untitled", "unknown")) -> DataFrame:
    """What the audit grades: fields as first written, curated values over them, signs of the text and the contents' shape."""
    c = F.col
    none = F.lit(None).cast("string")
    rows = extracted.where("outcome = 'extracted' and doc_id is not null").select(
        "doc_id", "adapter", "title", none.alias("subtitle"), "publisher", F.nullif(F.regexp_extract(F.coalesce("date", F.lit("")), r"(\d{4})", 1), F.lit("")).alias("year"),
        c("date").alias("year_raw"), none.alias("isbn"), none.alias("series"), "language", name_fields(file_stem(c("name"))).alias("name"), file_stem(c("name")).alias("source_stem"),
        F.substring(F.array_join(F.transform(F.slice("blocks", 1, 200), lambda b: b["text"]), "\n"), 1, BODY).alias("body"),
        F.exists("blocks", lambda b: F.contains(b["text"], F.lit("�"))).alias("doubtful"), c("date").alias("_date"),
    )
    rows = rework.base_attributes(rows, placeholders).withColumnRenamed("_date", "year_raw").withColumn("year_overridden", F.lit(False))
    if overrides is not None:
        over = overrides.groupBy(c("intake_id").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("_o"))
        rows = rows.join(over, "doc_id", "left")
        has = lambda f: F.coalesce(F.map_contains_key("_o", F.lit(f)), F.lit(False))
        rows = rows.withColumns({f: F.when(has(f), c("_o")[f]["value"]).otherwise(c(f)) for f in rework.BASE_FIELDS} | {"year_overridden": has("year")}).drop("_o")
    # only a language is compared with the text
    rows = rows.withColumn("body", F.when(F.trim("language") != "", c("body")))
    shape = structure.toc_stats(toc, blocks).select("doc_id", c("entries").alias("toc_entries"), "unanchored", "suspicious_flat", "heading_skew")
    return rows.join(shape, "doc_id")


def audit(extracted: DataFrame, blocks: DataFrame, toc: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id, verdict, confidence, shape_flags, fields, source, actions) of extracted items."""
    graded = book_audit.audit(records(extracted, blocks, toc, overrides))
    return graded.select("doc_id", "verdict", "confidence", "shape_flags", "fields", "source", "actions")


@dataclass
class Planned:
    """What the stages have planned for some items, nothing of it written."""

    extracted: DataFrame
    blocks: DataFrame
    toc: DataFrame
    audits: DataFrame
    tables: dict[str, DataFrame]

    def report(self) -> DataFrame:
        """A row for each item: stage and error where it failed, else what each stage made of it."""
        nodes = self.tables["nodes"].groupBy("doc_id").agg(F.count_if(F.col("text").isNotNull()).alias("leaves"), F.count_if(F.col("text").isNull()).alias("parts"))
        sizes = self.tables["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("text")).alias("chunk_chars"))
        audits = self.audits.select("doc_id", "verdict", "confidence", "shape_flags", F.col("actions").alias("base_actions"))
        out = self.extracted.select("doc_id", "name", "adapter", "outcome", "error", F.size("blocks").alias("blocks"))
        for part in (nodes, sizes, audits):
            out = out.join(part, "doc_id", "left")
        stage = (
            F.when(F.col("outcome") != "extracted", "extract").when(F.col("doc_id").isNull(), "register")
            .when(F.coalesce("leaves", F.lit(0)) == 0, "structure").when(F.col("verdict").isNull(), "audit").when(F.coalesce("chunks", F.lit(0)) == 0, "chunk")
        )
        why = F.coalesce("error", F.when(stage == "register", "no id").when(stage == "structure", "headings only").when(stage.isNotNull(), F.concat(F.lit("nothing from "), stage)))
        blocks = F.when(F.col("outcome") == "extracted", F.col("blocks"))
        return out.withColumns({"failed_at": stage, "error": why, "blocks": blocks})


def summary(report: DataFrame) -> DataFrame:
    """(measure, value, n): how many items there are of each outcome, verdict, confidence, and of each flag and action."""
    one = lambda c: F.array(F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")))
    many = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("measure"), x.alias("value")))
    pairs = F.concat(*[one(c) for c in ("adapter", "outcome", "failed_at", "verdict", "confidence")], many("shape_flags"), many("base_actions"))
    return report.select(F.explode(pairs).alias("p")).groupBy("p.measure", "p.value").agg(F.count("*").alias("n"))

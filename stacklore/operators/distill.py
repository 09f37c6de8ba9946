"""Dictionary entries from OCR text, by a declared list of stages.

Each stage is a function from a DataFrame to a DataFrame, named in STAGES with the kinds of
rows that it takes and gives: source -> pages -> blocks -> raws -> splits -> drafts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK_DISTILL, line_is_cjk, lookup_key
from .sequences import anchored, runs

PAGE_MARK = r"<!--\s*page\s+(\d+)(?:\s+\(sheet\s+(\d+)\))?\s*-->"


def split_pages(source: DataFrame) -> DataFrame:
    """source (book, text) at page marks; a text without any is page 1. Front matter goes."""
    body = F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", "")
    # one list of all three: what a lambda names beside its arguments is worked out again for each element
    found = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(PAGE_MARK), F.lit(1)).alias("page"),
        F.regexp_extract_all(body, F.lit(PAGE_MARK), F.lit(2)).alias("sheet"),
        F.filter(F.split(body, PAGE_MARK, -1), lambda x, i: i > 0).alias("text"),
    )
    each = F.transform(
        found,
        lambda m: F.struct(
            m["page"].cast("int").alias("page"),
            F.coalesce(F.nullif(m["sheet"], F.lit("")), m["page"]).cast("int").alias("sheet"),
            F.regexp_replace(m["text"], r"^\s+|\s+$", "").alias("text"),
        ),
    )
    whole = F.array(F.struct(F.lit(1).alias("page"), F.lit(1).alias("sheet"), body.alias("text")))
    pages = F.when(F.size(each) == 0, whole).otherwise(each)
    return source.select("book", F.posexplode(pages).alias("seq", "p")).select("book", "seq", "p.page", "p.sheet", "p.text")


def one_block_per_page(pages: DataFrame) -> DataFrame:
    return pages.select("book", "page", "sheet", F.col("seq").alias("block"), F.when(line_is_cjk(F.col("text")), "cjk").otherwise("latin").alias("lang"), "text")


def split_bilingual_blocks(pages: DataFrame) -> DataFrame:
    """A block for each run of lines in one script."""
    lines = pages.select("book", "page", "sheet", "seq", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.trim("text") != "")
    lines = lines.withColumn("lang", F.when(line_is_cjk(F.col("text")), "cjk").otherwise("latin")).withColumn("at", F.struct("seq", "line"))
    blocks = runs(lines, "book", "at", "lang").groupBy("book", "run").agg(
        F.min("page").alias("page"), F.min("sheet").alias("sheet"), F.min("lang").alias("lang"),
        F.array_sort(F.collect_list(F.struct("at", "text"))).alias("l"),
    )
    return blocks.select("book", "page", "sheet", F.col("run").alias("block"), "lang", F.array_join(F.col("l.text"), "\n").alias("text"))


def latin_headword(line: Column) -> Column:
    return line.rlike(r"^[A-Z][A-Z'\-]{1,}(?:[ ,][A-Z][A-Z'\-]+)*\b") & ~running_header(line)


def running_header(line: Column) -> Column:
    """A short line of capitals and digits alone; its bytes count, not its characters."""
    return (F.octet_length(line) < 40) & line.rlike(r"^[A-Z ]*\d+[A-Z ]*$")


def short_cjk(line: Column) -> Column:
    return line.rlike(f"^[{CJK_DISTILL}]{{1,8}}(?:\\s|$)")


def short_english(line: Column) -> Column:
    return line.rlike(r"^[A-Z][a-z]+(?: [A-Z]?[a-z]+){0,3}$")


ANCHORS: dict[str, Callable[[Column], Column]] = {"latin_headword": latin_headword, "short_cjk": short_cjk, "short_english": short_english}


def any_of(names: list[str]) -> Callable[[Column], Column]:
    def test(line: Column) -> Column:
        out = F.lit(False)
        for name in names:
            out = out | ANCHORS[name](line)
        return out

    return test


def walk_anchors(blocks: DataFrame, anchor: str | list[str] = "latin_headword", per_lang: dict[str, str] | None = None) -> DataFrame:
    """An entry from each anchor line to the next; lines before a block's first anchor end the entry before it.

    Lines before the first anchor of a book belong to no entry and are dropped.
    """
    lines = blocks.select("book", "page", "sheet", "lang", "block", F.posexplode(F.split("text", "\n")).alias("line", "l")).where(F.trim("l") != "")
    lines = lines.withColumn("at", F.struct("block", "line"))
    if per_lang:
        test = F.lit(False)
        for lang, name in per_lang.items():
            test = test | ((F.col("lang") == lang) & ANCHORS[name](F.col("l")))
    else:
        test = any_of([anchor] if isinstance(anchor, str) else anchor)(F.col("l"))
    marked = anchored(lines.withColumn("is_anchor", test), "book", "at", F.col("is_anchor")).where("entry > 0")
    first_block = F.first("block").over(Window.partitionBy("book", "entry").orderBy("at"))
    grouped = marked.withColumn("_b", first_block).groupBy("book", "entry").agg(
        F.min("page").alias("page"), F.min("sheet").alias("sheet"), F.min_by("lang", "at").alias("lang"),
        F.min_by("l", "at").alias("anchor"), F.array_sort(F.collect_list(F.struct("at", "l"))).alias("rows"),
        F.max(F.col("block") != F.col("_b")).alias("spliced"),
    )
    body = F.array_join(F.slice(F.col("rows.l"), F.lit(2), F.size("rows")), "\n")
    return grouped.select("book", "page", "sheet", F.col("entry").alias("seq"), "lang", "anchor", body.alias("body"), F.when(F.col("spliced"), F.array(F.lit("spliced_from_orphan"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def walk_anchors_per_lang(blocks: DataFrame, rules: dict[str, str]) -> DataFrame:
    return walk_anchors(blocks, per_lang=rules)


def pair_bilingual_entries(raws: DataFrame, first: str = "latin", second: str = "cjk") -> DataFrame:
    """The nth entry of one language with the nth of the other in each run of one page and sheet.

    Where a run has unequal numbers, its entries come alone, flagged. The pair's body is
    first body <<<second anchor>>> second anchor <<<body>>> second body.
    """
    place = raws.withColumn("_p", F.concat_ws(":", "page", "sheet"))
    run = runs(place, "book", "seq", "_p")
    nth = run.withColumn("n", F.row_number().over(Window.partitionBy("book", "run", "lang").orderBy("seq")))
    sums = run.groupBy("book", "run").agg(F.count_if(F.col("lang") == first).alias("_f"), F.count_if(F.col("lang") == second).alias("_s"))
    even = nth.join(sums, ["book", "run"])
    other = even.where((F.col("lang") == second) & (F.col("_f") == F.col("_s"))).select("book", "run", "n", F.col("anchor").alias("_a"), F.col("body").alias("_body"))
    paired = even.where((F.col("lang") == first) & (F.col("_f") == F.col("_s"))).join(other, ["book", "run", "n"])
    packed = F.concat("body", F.lit("<<<key_head>>>"), "_a", F.lit("<<<key_body>>>"), "_body")
    alone = even.where(F.col("_f") != F.col("_s")).withColumn("flags", F.array_union("flags", F.array(F.lit("pair_mismatch"))))
    return paired.withColumn("body", packed).select(*raws.columns).unionByName(alone.select(*raws.columns))


def unpack_paired_body(splits: DataFrame) -> DataFrame:
    rest = F.split_part("body", F.lit("<<<key_head>>>"), F.lit(2))
    paired = F.contains("body", F.lit("<<<key_head>>>"))
    return splits.withColumns({
        "other_anchor": F.when(paired, F.split_part(rest, F.lit("<<<key_body>>>"), F.lit(1))),
        "other_body": F.when(paired, F.split_part(rest, F.lit("<<<key_body>>>"), F.lit(2))),
        "body": F.split_part("body", F.lit("<<<key_head>>>"), F.lit(1)),
    })


def split_at_first_cjk(raws: DataFrame) -> DataFrame:
    """The anchor line up to its first CJK character is the headword, the rest leads the body."""
    at = F.regexp_instr("anchor", F.lit(f"[{CJK_DISTILL}]"))
    head = F.when(at > 1, F.trim(F.left("anchor", (at - 1).cast("int")))).otherwise(F.col("anchor"))
    lead = F.when(at > 1, F.substr("anchor", at)).otherwise(F.lit(""))
    return raws.withColumns({"headword": head, "body": F.trim(F.concat_ws("\n", F.nullif(lead, F.lit("")), "body"))})


def split_headline_only(raws: DataFrame) -> DataFrame:
    return raws.withColumn("headword", F.trim("anchor"))


def extract_year_span(splits: DataFrame, column: str = "body") -> DataFrame:
    span = r"\(?\b(\d{3,4})\s*[-–—]\s*(\d{3,4})?\b?\)?"
    year = lambda i: F.nullif(F.regexp_extract(column, span, i), F.lit("")).cast("int")
    return splits.withColumn("years", F.when(year(1).isNotNull(), F.struct(year(1).alias("birth"), year(2).alias("death"))))


def extract_bracketed_tag(splits: DataFrame, column: str = "body") -> DataFrame:
    shapes = [r"<([^<>]+)>|〈([^〈〉]+)〉", r"\[([^\[\]]+)\]|［([^［］]+)］", r"\(([^()]+)\)|（([^（）]+)）"]
    found = [F.nullif(F.regexp_extract(column, p, i), F.lit("")) for p in shapes for i in (1, 2)]
    return splits.withColumn("tag", F.trim(F.coalesce(*found)))


def extract_gender_tag(splits: DataFrame, column: str = "body") -> DataFrame:
    mark = F.lower(F.regexp_extract(column, r"(?i)(?:^|[\s(])([mf])\.(?=[\s),]|$)|([男女])", 0))
    return splits.withColumn("gender", F.when(mark.rlike("m|男"), "M").when(mark.rlike("f|女"), "F"))


def split_variants(splits: DataFrame, pattern: str = r"\s*[,;/、，；]\s*") -> DataFrame:
    parts = F.filter(F.transform(F.split("headword", pattern), lambda x: F.trim(x)), lambda x: x != "")
    return splits.withColumn("variants", F.when(F.size(parts) > 1, parts))


def extract_quotes(splits: DataFrame, column: str = "body") -> DataFrame:
    return splits.withColumn("quotes", F.regexp_extract_all(column, F.lit("“([^”]+)”|「([^」]+)」"), F.lit(0)))


def partition_body_around_match(splits: DataFrame, pattern: str) -> DataFrame:
    """body before a pattern's first match, the match, and after it."""
    at, found = F.regexp_instr("body", F.lit(pattern)), F.regexp_substr("body", F.lit(pattern))
    return splits.withColumns({
        "before": F.when(at > 0, F.trim(F.left("body", (at - 1).cast("int")))).otherwise(F.col("body")),
        "matched": F.when(at > 0, found),
        "after": F.when(at > 0, F.trim(F.substr("body", at + F.char_length(found)))),
    })


def to_entry_draft(splits: DataFrame) -> DataFrame:
    others = [c for c in ("years", "tag", "gender", "variants", "quotes", "other_anchor", "other_body") if c in splits.columns]
    latin = ~line_is_cjk(F.col("headword"))
    return splits.select(
        "book", "seq", "page", "sheet", "headword", lookup_key(F.col("headword"), latin).alias("entry_key"), "body", "flags",
        F.to_json(F.struct("body", *others)).alias("payload"),
    )


@dataclass(frozen=True)
class Stage:
    takes: str
    gives: str
    run: Callable[..., DataFrame]


STAGES: dict[str, Stage] = {
    f.__name__: Stage(a, b, f)
    for f, a, b in (
        (split_pages, "source", "pages"), (one_block_per_page, "pages", "blocks"), (split_bilingual_blocks, "pages", "blocks"),
        (walk_anchors, "blocks", "raws"), (walk_anchors_per_lang, "blocks", "raws"), (pair_bilingual_entries, "raws", "raws"),
        (split_at_first_cjk, "raws", "splits"), (split_headline_only, "raws", "splits"), (unpack_paired_body, "splits", "splits"),
        (extract_year_span, "splits", "splits"), (extract_bracketed_tag, "splits", "splits"), (extract_gender_tag, "splits", "splits"),
        (split_variants, "splits", "splits"), (extract_quotes, "splits", "splits"), (partition_body_around_match, "splits", "splits"),
        (to_entry_draft, "splits", "drafts"),
    )
}


@dataclass
class Spec:
    """Stages of a book with their arguments, and the share that stages of one kind must keep."""

    stages: list[tuple[str, dict]] = field(default_factory=list)
    retention: float | None = None

    def check(self) -> list[str]:
        """What is wrong with it: unknown stages, and stages that do not take what the one before gives."""
        bad, kind = [], "source"
        for name, _ in self.stages:
            if name not in STAGES:
                bad.append(f"unknown stage {name}")
                continue
            if STAGES[name].takes != kind:
                bad.append(f"{name} takes {STAGES[name].takes}, not {kind}")
            kind = STAGES[name].gives
        return bad + ([] if kind == "drafts" else [f"the last stage gives {kind}, not drafts"])


def build(source: DataFrame, spec: Spec) -> DataFrame:
    """Entry drafts of the books of source (book, text)."""
    if bad := spec.check():
        raise ValueError("; ".join(bad))
    rows = source
    for name, arguments in spec.stages:
        rows = STAGES[name].run(rows, **arguments)
    return rows


def report(source: DataFrame, spec: Spec) -> list[dict]:
    """Rows of each stage, and for stages that keep the kind the share kept with the gate's verdict."""
    out, rows, before = [], source, source.count()
    for name, arguments in spec.stages:
        stage = STAGES[name]
        rows = stage.run(rows, **arguments)
        n = rows.count()
        kept = n / before if stage.takes == stage.gives and before else None
        gate = "off" if spec.retention is None or kept is None else "pass" if kept >= spec.retention else "fail"
        out.append({"stage": name, "rows": n, "kept": kept, "gate": gate})
        before = n
    return out


def coverage(entries: Column, unmatched: Column) -> Column:
    total = entries + unmatched
    return F.when(total == 0, 100.0).otherwise(100.0 * entries / total)

"""Papers: what identifies them, their sections, and the audit of their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.text import collapse_space

# Fields that each kind of publication must have.
REQUIRED = {
    "article-journal": ("title", "author", "year", "container_title", "doi"),
    "paper-conference": ("title", "author", "year", "container_title"),
    "chapter": ("title", "author", "year", "container_title"),
    "thesis": ("title", "author", "year", "publisher"),
    "report": ("title", "author", "year"),
    "book": ("title", "author", "year"),
    "webpage": ("title", "author", "year"),
}
AUDITED = ("title", "author", "year", "doi", "arxiv_id", "issn", "container_title", "publisher", "abstract", "language")
LEAST_ABSTRACT, YEARS = 200, (1900, 2100)


def identify(papers: DataFrame) -> DataFrame:
    """papers (doc_id, text, stem, biblio_year) with doi, arxiv_id, issn, venue, year and abstract."""
    text = F.coalesce("text", F.lit(""))
    out = papers.withColumns({
        "doi": ids.find_doi(text, F.col("stem")),
        "arxiv_id": ids.find_arxiv(text, F.col("stem")),
        "issn": ids.find_issn(text),
        "venue": ids.find_venue(text),
    })
    year = ids.paper_year(F.col("arxiv_id"), F.col("doi"), text, F.col("biblio_year"))
    return out.withColumn("year", F.when(year.between(*YEARS), year)).withColumn("abstract", abstract(text))


def abstract(text):
    """After an abstract heading, else the first block of 200 characters, else the longest block (the last of equals)."""
    headed = F.nullif(F.regexp_extract(text, r"(?is)(?:^|\n)\s*abstract\s*[:.\n—-]\s*(.+?)(?:\n\s*\n|\n\s*(?:1\.?\s+)?introduction\b|$)", 1), F.lit(""))
    blocks = F.transform(F.split(text, r"\n+"), lambda b: F.trim(b))
    long = F.try_element_at(F.filter(blocks, lambda b: F.char_length(b) >= LEAST_ABSTRACT), F.lit(1))
    longest = F.array_max(F.transform(blocks, lambda b, i: F.struct(F.char_length(b).alias("n"), i.alias("i"), b.alias("b"))))["b"]
    return F.coalesce(F.when(F.char_length(headed) >= 80, collapse_space(headed)), long, F.nullif(longest, F.lit("")))


def window_of_metadata(text):
    """Text before the references, 30,000 characters at most: where a paper states what it is."""
    end = F.regexp_instr(text, F.lit(r"(?im)^\s*(?:references|bibliography)\s*$"))
    return F.substring(F.when(end > 0, F.left(text, (end - 1).cast("int"))).otherwise(text), 1, 30_000)


def sections(blocks: DataFrame) -> DataFrame:
    """blocks with section and subsection numbers from the levels of headings, counted anew in each section."""
    order = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("section", F.sum(F.when(F.col("level") <= 1, 1).otherwise(0)).over(order))
    within = Window.partitionBy("doc_id", "section").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("subsection", F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).over(within))


def audit(papers: DataFrame) -> DataFrame:
    """papers with grades (a struct with a grade for each field), verdict and confidence.

    A paper needs work if a field that its csl_type requires is missing or weak, or nothing
    stable identifies it: a DOI, an arXiv id, or an ISSN with a container.
    """
    c = F.col
    have = lambda n: c(n).isNotNull() & (F.trim(c(n).cast("string")) != "")
    grade = lambda n, good: F.when(~have(n), "missing").when(F.coalesce(good, F.lit(False)), "strong").otherwise("weak")
    title = F.trim("title")
    letters = F.regexp_count(title, F.lit(r"\p{L}")) / F.greatest(F.char_length(title), F.lit(1))
    grades = F.struct(
        grade("title", (letters >= 0.55) & ~title.rlike(r"(?i)^arxiv[:\s]|\.(?:pdf|docx?|tex)$")).alias("title"),
        F.when(~have("author"), "missing").when(F.contains(F.trim("author"), F.lit(" ")), "strong").otherwise("weak").alias("author"),
        grade("year", c("year").cast("int").between(*YEARS)).alias("year"),
        grade("doi", c("doi").rlike(f"^{ids.DOI}$")).alias("doi"),
        grade("arxiv_id", c("arxiv_id").rlike(r"^(\d{4}\.\d{4,5}|[a-z\-]+(\.[A-Za-z\-]+)?/\d{7})$")).alias("arxiv_id"),
        grade("issn", ids.issn_ok(c("issn"))).alias("issn"),
        grade("container_title", F.lit(True)).alias("container_title"),
        grade("publisher", F.lit(True)).alias("publisher"),
        grade("abstract", F.char_length("abstract") >= LEAST_ABSTRACT).alias("abstract"),
        grade("language", F.lit(True)).alias("language"),
    )
    need = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    required = F.coalesce(F.try_element_at(need, c("csl_type")), F.array(*map(F.lit, REQUIRED["book"])))
    out = papers.withColumn("grades", grades).withColumn("_required", required)
    bad = lambda kinds: F.exists("_required", lambda f: F.exists(F.array(*[F.struct(F.lit(n).alias("f"), c(f"grades.{n}").alias("g")) for n in AUDITED]), lambda x: (x["f"] == f) & x["g"].isin(*kinds)))
    stable = have("doi") | have("arxiv_id") | (have("issn") & have("container_title"))
    return (
        out.withColumn("verdict", F.when(bad(("missing", "weak")) | ~stable, "needs_work").otherwise("clean"))
        .withColumn("confidence", F.when(bad(("missing",)) | ~stable, "low").when(~bad(("weak", "missing")), "high").otherwise("medium"))
        .drop("_required")
    )

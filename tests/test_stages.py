"""Stages from files to chunks: one bad file is a row, not a dead job."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stacklore.library import Library
from stacklore.operators import stages
from stacklore.sources import html



def level():
    return F.when(F.col("line").rlike("^# "), 1)


ITEMS = "doc_id long, name string, content binary"
PAGE = b"<html lang='en'><head><meta content='Ann' name=author><title>A page &amp; more</title></head><body><h1>Head</h1><p>owls fly at night</p></body></html>"


def broken_epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container")
    return out.getvalue()


ROWS = [
    (1, "Ann - First (2001).txt", b"# One\nwords of one\n# Two\nwords of two"),
    (2, "page.html", PAGE),
    (3, "scan.txt", b" \n \n"),
    (4, "book.epub", b"no zip file"),
    (5, "book2.epub", broken_epub()),
    (6, "slides.docx", b"x"),
    (7, "gone.txt", None),
    (8, "heads.txt", b"# only\n# heads"),
    (None, "nameless.txt", b"words"),
    (9, "latin.txt", "gut ﻿ 中文".encode("gb18030")),
    (10, "odd.html", b"<p>unclosed <b>tags <div> everywhere </p></i>"),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ROWS, ITEMS)


@pytest.fixture
def library(spark, tmp_path):
    return Library(spark, str(tmp_path / "lib"))


def told(report, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in report.collect()}


def test_a_dry_run_tells_and_writes_nothing(spark, library, items):
    report = library.dry_run(items, level())
    found = told(report, "outcome", "failed_at")
    assert found == {
        1: ("extracted", None), 2: ("extracted", None), 3: ("needs_ocr", "extract"), 4: ("error", "extract"), 5: ("error", "extract"), 6: ("unsupported", "extract"),
        7: ("error", "extract"), 8: ("extracted", "structure"), None: ("extracted", "register"), 9: ("extracted", None), 10: ("extracted", None),
    }
    why = told(report, "error")
    assert why[7] == "no content" and why[4].startswith("BadZipFile") and why[5].startswith("ParseError") and why[1] is None
    first = report.where("doc_id = 1").first()
    assert (first.blocks, first.leaves, first.parts, first.chunks) == (4, 2, 3, 2) and "filename:title" in first.base_actions
    assert library.store.version() == 0
    counts = {(r.measure, r.value): r.n for r in stages.summary(report).collect()}
    assert counts["outcome", "extracted"] == 6 and counts["failed_at", "extract"] == 5 and counts["failed_at", "none"] == 4 and counts["base_actions", "filename:title"] == 1


def test_an_extractor_that_raises_is_a_row(spark, library, items):
    def moody(content):
        if b"two" in content:
            raise RecursionError("too deep")
        return stages.EXTRACTORS["txt"](content)

    found = told(library.dry_run(items.where("name like '%.txt'"), level(), {"txt": moody}), "outcome", "error")
    assert found[1] == ("error", "RecursionError: too deep") and found[9][0] == "extracted"


def test_ingest_keeps_what_can_be_read(spark, library, items):
    report = library.ingest_files(items, level())
    assert report.where("failed_at is null").count() == 4
    assert {r.doc_id for r in library.table("chunks").select("doc_id").distinct().collect()} == {1, 2, 9, 10}
    assert library.search("owls fly", 1).first().breadcrumb == "A page & more › Head"
    # a file that breaks later leaves what was read of it before
    again = library.ingest_files(spark.createDataFrame([(1, "a.txt", None), (2, "page.html", PAGE.replace(b"owls", b"gulls"))], ITEMS), level())
    assert told(again, "failed_at") == {1: "extract", 2: None}
    assert sorted(r.text for r in library.table("chunks").where("doc_id < 3").collect()) == ["gulls fly at night", "words of one", "words of two"]
    assert library.audits("low").count() + library.audits("medium").count() + library.audits("high").count() == 4


def test_rebuild_from_envelopes(spark, library, items):
    library.ingest_files(items, level())
    shas = {i: hashlib.sha256(c).hexdigest() for i, _, c in ROWS if c is not None}
    intakes = spark.createDataFrame([(1, shas[1]), (2, "of another file"), (9, shas[9]), (44, "never read")], "doc_id long, source_sha256 string")
    want = {1: "rebuilt", 2: "mismatched", 9: "rebuilt", 44: "missing"}
    before, other = library.store.version(), F.when(F.col("line").rlike("^# One"), 1)
    assert told(library.rebuild(intakes, other, dry=True), "bucket") == want and library.store.version() == before
    assert told(library.rebuild(intakes, other), "bucket") == want and library.store.version() == before + 1
    assert library.table("nodes").where("doc_id = 1 and text is null").count() == 2  # "# Two" is a line of text now
    assert library.table("nodes", before).where("doc_id = 1 and text is null").count() == 3
    assert told(library.rebuild(intakes, level(), only=[9]), "bucket") == {9: "rebuilt"}
    assert library.rebuild(intakes, level(), version=stages.EXTRACTOR_VERSION).count() == 0  # nothing is of another version
    only_heads = F.lit(1)
    assert told(library.rebuild(intakes.where("doc_id = 1"), only_heads), "bucket", "error") == {1: ("failed", "headings only")}


def test_reaudit_under_curated_values(spark, library, items):
    library.ingest_files(items, level())
    over = spark.createDataFrame([(1, "title", "A fine title"), (1, "language", "en"), (1, "publisher", "House"), (2, "title", None)], "intake_id long, field string, value string")
    dry = told(library.reaudit(level(), over, dry=True), "old_verdict", "verdict", "changed")
    assert dry[1] == ("needs_work", "clean", True) and dry[2][1] == "needs_work"
    assert library.audits(verdict="clean").where("doc_id = 1").count() == 0
    done = library.reaudit(level(), over, only=[1])
    assert told(done, "outcome") == {1: "ok"} and library.audits(verdict="clean").where("doc_id = 1").count() == 1
    assert library.audits().count() == 4


@pytest.mark.parametrize(
    ("page", "title", "lang", "author"),
    [
        ("<html lang=de><title>T</title><meta name='author' content='A B'>", "T", "de", "A B"),
        ('<meta content="B, C" NAME="Author"><TITLE> two\n words </TITLE>', "two words", None, "B, C"),
        ("<meta name=author content=Ann><title>a &lt;b&gt;</title><title>late</title>", "a <b>", None, "Ann"),
        ("<title></title><meta name=author content=''>", None, None, None),
        (None, None, None, None),
    ],
)
def test_head_of_a_page(spark, page, title, lang, author):
    r = html.html_biblio(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert (r.title, r.lang, r.author) == (title, lang, author)


def test_references_of_a_page_are_read_as_the_caller_says(spark):
    page = '<html lang="de"><title>a &amp; b&lt;c &quot;d&quot; e&&amp</title><meta name=author content="A &amp; B">'
    rows = spark.createDataFrame([(1, page), (2, "<title>x\u00a0\ty</title>"), (3, None)], "page_id long, html string")
    found = {r.page_id: (r.title, r.lang, r.author) for r in html.html_biblio(rows, decode=html.usual_references).collect()}
    assert found == {1: ("a & b<c &quot;d&quot; e&&amp", "de", "A & B"), 2: ("x\u00a0 y", None, None), 3: (None, None, None)}
    assert html.html_biblio(rows).where("page_id = 1").first().title == 'a & b<c "d" e&&'


def test_planned_nodes_are_stored_once(library, items, monkeypatch):
    """plan_tree with all columns has stored its nodes; they are not written a second time."""
    from stacklore.operators import sinks

    seen, store = [], sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda df: seen.append(df.columns) or store(df))
    library.dry_run(items.where("doc_id = 1"), level())
    assert seen and not [c for c in seen if "node_id" in c]

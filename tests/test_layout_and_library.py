import pytest
from pyspark.sql import functions as F

from stacklore.library import Library, Profile
from stacklore.operators import catalog, layout


def segments(spark):
    rows = []
    for page in (1, 2, 3):
        rows += [(1, page, 0, 40.0, 60.0, 2.0, 4.0, "Running head"), (1, page, 1, 48.0, 52.0, 97.0, 99.0, str(page))]
        for i in range(6):
            rows.append((1, page, 10 + i, 5.0, 45.0, 10.0 + 5 * i, 14.0 + 5 * i, f"left {page} {i}"))
            rows.append((1, page, 20 + i, 55.0, 95.0, 10.0 + 5 * i + (10 if i > 2 else 0), 14.0 + 5 * i + (10 if i > 2 else 0), f"right {page} {i}"))
    rows += [(2, 1, i, 5.0, 95.0, 10.0 + 5 * i, 14.0 + 5 * i, f"wide {i}") for i in range(6)]
    kinds = "doc_id long, page int, seg int, left double, right double, top double, bottom double, text string"
    return spark.createDataFrame(rows, kinds).withColumns({"page_width": F.lit(100.0), "page_height": F.lit(100.0)})


def test_columns_and_paragraphs(spark):
    body = layout.without_running(segments(spark))
    assert body.where("text = 'Running head' or text in ('1', '2', '3')").count() == 0
    assert {(r.doc_id, r.page) for r in layout.gutters(body).collect()} == {(1, 1), (1, 2), (1, 3)}
    found = {(r.doc_id, r.page, r.column, r.paragraph): r.text for r in layout.paragraphs(layout.rows_of(layout.in_columns(body))).collect()}
    assert found[1, 1, 0, 0] == " ".join(f"left 1 {i}" for i in range(6))
    assert found[1, 1, 1, 0] == "right 1 0 right 1 1 right 1 2" and found[1, 1, 1, 1] == "right 1 3 right 1 4 right 1 5"
    assert found[2, 1, 0, 0].startswith("wide 0 wide 1")


def test_numbers_go_on(spark):
    rows = [(1, i, t) for i, t in enumerate(["1 One", "1.1 A", "3 Not yet", "1.2 B", "2.2 Not", "2 Two", "2.1 C", "5 kilograms of it"])]
    found = layout.valid_numbers(spark.createDataFrame(rows, "doc_id long, block_idx int, text string")).orderBy("block_idx").collect()
    assert [r.text for r in found] == ["1 One", "1.1 A", "1.2 B", "2 Two", "2.1 C"]


def test_heading_candidates(spark):
    rows = [(1, 1, "Big", 14.0, False), (1, 1, "bold", 10.0, True), (1, 1, "x = y", 14.0, True), (1, 1, "body text", 10.0, False), (1, 1, "more body", 10.0, False)]
    found = layout.heading_candidates(spark.createDataFrame(rows, "doc_id long, page int, text string, font_size double, bold boolean"))
    assert sorted(r.text for r in found.collect()) == ["Big", "bold"]


def test_library(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    level = F.when(F.col("line").rlike("^# "), 1).when(F.col("line").rlike("^## "), 2)
    docs = spark.createDataFrame([(1, "# Birds\nowls fly at night\n## Small\nwrens sing all day", "Animals"), (1001, "# Stones\ngranite is hard and old", "Rocks")], "doc_id long, text string, title string")
    library.ingest(docs, level)
    library.ingest(docs.where("doc_id = 1"), level)  # replaces its partition, leaves the other
    assert library.info() == {"chunks": 3, "books": 2, "model": "hashing", "dim": 64, "index": "brute-force"}
    first = library.search("wrens sing all day", 1).first()
    assert first.doc_id == 1 and first.breadcrumb == "Animals › # Birds › ## Small"
    assert {r.doc_id for r in library.search("owls night", 5, exclude=(1,)).collect()} == {1001}
    assert {r.doc_id for r in library.search("owls night", 5, doc_id=1001).collect()} == {1001}
    assert [r.title for r in library.contents(1, max_depth=1).collect()] == ["Animals", "# Birds"]
    assert [r.text for r in library.read(1, budget=5).collect()] == ["owls fly at night"]
    assert library.context(1, 0).first().positions == [0, 1]
    with pytest.raises(ValueError):
        library.search("  ")
    with pytest.raises(ValueError):
        library.search("x", doc_id=1, exclude=(2,))


def test_a_second_ingest_into_a_shelf_keeps_what_is_there(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"))
    level = F.when(F.col("line").rlike("^# "), 1)
    row = lambda i, text: (i, f"# Head {i}\n{text}", f"Book {i}")
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string, title string")
    library.ingest(docs(row(1, "owls fly"), row(2, "wrens sing"), row(1500, "larks rise")), level)
    first = {r.chunk_sha256 for r in library.table("chunks").where("doc_id = 2").collect()}
    for _ in range(2):  # the same call again changes nothing
        library.ingest(docs(row(3, "gulls cry"), row(1, "owls sleep")), level)
        books = {r.doc_id: r.n for r in library.table("nodes").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert books == {1: 3, 2: 3, 3: 3, 1500: 3}
        assert {r.doc_id: r.text for r in library.table("chunks").collect()} == {1: "owls sleep", 2: "wrens sing", 3: "gulls cry", 1500: "larks rise"}
    assert {r.chunk_sha256 for r in library.table("chunks").where("doc_id = 2").collect()} == first
    library.ingest(docs((1500, "", "Book 1500")), level)  # the only chunk of its shelf goes
    assert {r.doc_id for r in library.table("chunks").collect()} == {1, 2, 3} and library.table("nodes").where("doc_id = 1500").count() == 1


def test_profile():
    assert Profile().problems() == []
    assert len(Profile(index="ivf-pq", dim=64, sub_vectors=4).problems()) == 1
    assert len(Profile(index="other", dim=0, reranker="x", top_k_in=1, top_k_out=2).problems()) == 3


def test_books_page(spark):
    items = spark.createDataFrame([(i, f"Item {i}", "2000", "extracted", "pdf", "high") for i in range(30)], "intake_id int, title string, year string, status string, format string, confidence string")
    over = spark.createDataFrame([(3, "title", "Other"), (4, "title", None)], "intake_id int, field string, value string")
    none = lambda kinds: spark.createDataFrame([], kinds)
    library = Library(spark, "/nowhere")
    found = library.books(items, over, catalog.Filter(title="item"), none("intake_id int, name string, role string"), none("intake_id int, review string"), none("intake_id int, category string"), 0, 5).collect()
    assert [r.intake_id for r in found] == [0, 1, 2, 5, 6] and found[0].total == 28 and found[0].more

"""Operators on small inputs against what they should give, or against a plain twin."""

import io
import json
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from stacklore.functions import identifiers as ids
from stacklore.functions import text as tx
from stacklore.operators import book_audit, catalog, chunks, dedup, distill, paper_audit, quality, references, search, sequences, sinks, structure
from stacklore.sources import files, html
from stacklore.streaming import ingest


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, s {kind}")
    return [r[1] for r in df.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()]


def test_normalize_matches_its_definition(spark):
    texts = ["a\r\nb\rc\u2028d", "ﬁne\u00a0 text\t\tx ", "\u200bzero\ufeff", "“q” ‘s’ \u2015 \u22ef \u2e3a", "漢 字 and 漢 x", "a\n\n\n\nb", "  \n ", "", None]
    want = ["a\nb\nc\nd", "fine text x", "zero", "\"q\" 's' \u2014 \u2026 \u2014\u2014", "漢字 and 漢 x", "a\n\nb", "", "", None]
    # NFKC folds the midline ellipsis and wide forms before the punctuation is unified
    want[3] = "\"q\" 's' \u2014 " + unicodedata.normalize("NFKC", "\u22ef").replace("\u22ef", "\u2026") + " \u2014\u2014"
    assert values(spark, tx.normalize, texts) == want


def test_text_scalars(spark):
    assert values(spark, tx.sentence_count, ["", "  ", "No end", "A. B! C?!", "。。x。"]) == [0, 0, 1, 3, 2]
    assert values(spark, tx.heading_level, ["第三章 开始", "第一卷", "Chapter IV", "BOOK one", "Erstes Kapitel", "zweiter Teil", "A line of text.", "Chapter"]) == [2, 1, 2, 1, 2, 1, None, None]
    assert values(spark, tx.roman_value, ["iv", "XXX", "IIII", "XXXI"]) == [4, 30, None, None]
    assert values(spark, tx.file_stem, ["/a/b.c.pdf", "x", "c:\\d\\e.txt", "/.epub"]) == ["b.c", "x", "e", None]
    assert values(spark, tx.is_bcp47, ["en", "zh-Hant", "english!", "pt-BR"]) == [True, True, False, True]
    assert values(spark, tx.is_placeholder, ["[Unknown]", "N A", "A title"]) == [True, True, False]
    assert values(spark, tx.fold_publisher, ["Acme Univ. Pub", "X & Co"]) == ["acme university publishing", "x company"]
    assert values(spark, tx.heading_number, ["1.2.3 Deep", "IV. Results", "No number"]) == [[1, 2, 3], [4], None]
    assert values(spark, tx.fold_fullwidth, ["ＡＢ１\u3000x"]) == ["AB1 x"]
    redacted = values(spark, tx.redact, ["/Users/me/books/War and Peace.epub read", "见漢字書 x", None])
    assert redacted[0].startswith("<HOME>/books/<file:") and redacted[0].endswith(">.epub read")
    assert redacted[1].startswith("<cjk:") and redacted[2] is None


def test_identifiers(spark):
    assert values(spark, ids.isbn_ok, ["0306406152", "978-0-306-40615-7", "9780306406158", "080442957X", "1", "x"]) == [True, True, False, True, False, False]
    assert values(spark, ids.issn_ok, ["0378-5955", "0378-5954", "2434-561X"]) == [True, False, True]
    assert values(spark, ids.orcid_ok, ["0000-0002-1825-0097", "0000-0002-1825-0098"]) == [True, False]
    assert values(spark, ids.find_doi, ["see 10.1000/xyz123.", "10.1000/XXXXXX then 10.5555/ok", "none"]) == ["10.1000/xyz123", "10.5555/ok", None]
    assert values(spark, ids.find_arxiv, ["arXiv:2101.00001v2", "hep-th/9901001 x", "-"]) == ["2101.00001", "hep-th/9901001", None]
    assert values(spark, ids.arxiv_year, ["2101.00001", "hep-th/9901001", "math/0501001"]) == [2021, 1999, 2005]
    named = values(spark, ids.name_fields, ["[Series] Ann Author - A Title (1999, House)", "Ann - Title (2001)", "Title -- Ann -- 9780306406157", "plain"])
    assert (named[0].series, named[0].title, named[0].publisher) == ("Series", "A Title", "House")
    assert named[1].year == "2001" and named[2].isbn == "9780306406157" and named[3] is None


def test_quality_ladder(spark):
    pages = [(1, "", False), (2, "x" * 60, False), (3, "\ufffd " * 200 + "y" * 300, False), (4, "z" * 300, True), (5, "clean text " * 40, False), (6, "\ue000" * 60 + "a" * 300, False), (7, "a\ufffdb" + "c" * 400, False)]
    found = {r.k: r.verdict for r in quality.assess(spark.createDataFrame(pages, "k int, text string, has_image boolean"), "k").collect()}
    assert found == {1: "ocr:no_text_layer", 2: "doubtful:sparse", 3: "doubtful:anomalies", 4: "doubtful:dual_layer", 5: "usable", 6: "ocr:private_use", 7: "doubtful:anomalies"}


def test_tree_and_breadcrumbs(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "body", None, "front", 0), (1, 1, "heading", 1, "One", 0), (1, 2, "body", None, "alpha", 0), (1, 3, "heading", 2, "Inner", 0), (1, 4, "body", None, "beta", 1), (1, 5, "heading", 1, "Two", 1), (1, 6, "body", None, "gamma", 1)],
        "doc_id long, block_idx int, kind string, level int, text string, source_unit int",
    )
    toc = structure.contents_of(blocks)
    nodes = structure.plan_tree(blocks, toc, spark.createDataFrame([(1, "Book")], "doc_id long, title string")).cache()
    by = {r.title or r.text: r for r in nodes.collect()}
    assert set(by) == {"Book", "One", "Inner", "Two", "front", "alpha", "beta", "gamma"}
    assert by["Book"].node_id == 100_000_001 and by["Inner"].parent_id == by["One"].node_id and by["beta"].parent_id == by["Inner"].node_id
    assert (by["One"].toc_lo, by["One"].toc_hi) == (1, 2) and (by["Book"].toc_lo, by["Book"].toc_hi) == (0, 3)
    # leaves come before organizing nodes among siblings
    assert (by["front"].ordinal, by["One"].ordinal, by["Two"].ordinal) == (0, 1, 2) and by["alpha"].ordinal == 0 and by["Inner"].ordinal == 1
    crumbs = {r.node_id: r.breadcrumb for r in structure.breadcrumbs(nodes).collect()}
    assert crumbs[by["beta"].node_id] == "Book › One › Inner" and crumbs[by["front"].node_id] == "Book"


def test_chunks_keep_their_promises(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(400)) + "x" * 2500
    spans = chunks.split(text)
    assert all(b - a <= chunks.TARGET for a, b in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a2 <= b1 + 1 and b1 - a2 <= chunks.OVERLAP and a2 > a1 for (a1, b1), (a2, _) in zip(spans, spans[1:]))
    assert chunks.split("") == [] and chunks.split("   ") == []


def test_overlay_null_hides(spark):
    base = spark.createDataFrame([(1, "a", "1990"), (2, "b", "1991"), (3, "c", None)], "intake_id int, title string, year string")
    over = spark.createDataFrame([(1, "title", None), (2, "title", "B"), (3, "year", "2000")], "intake_id int, field string, value string")
    assert {tuple(r) for r in catalog.effective(base, over, ["title", "year"]).collect()} == {(1, None, "1990"), (2, "B", "1991"), (3, "c", "2000")}
    assert catalog.clamp_limit(0) == (20, False) and catalog.clamp_limit(500) == (100, True)
    with pytest.raises(ValueError):
        catalog.valid("other", catalog.STATUSES)


def test_keyed_tables(spark):
    rows = lambda data: spark.createDataFrame(data, "intake_id int, derived_from_sha256 string")
    linked = catalog.link_once(rows([(1, None), (2, "x")]), rows([(1, "a"), (2, "x")]))
    assert {tuple(r) for r in linked.collect()} == {(1, "a"), (2, "x")}
    with pytest.raises(Exception, match="another value"):
        catalog.link_once(rows([(1, "b")]), rows([(1, "a")])).collect()
    patched = catalog.patch(rows([(1, "a"), (2, "b")]), rows([(2, None), (3, "c")]), ["intake_id"], ["derived_from_sha256"])
    assert {tuple(r) for r in patched.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert sinks.schema_differs(rows([]), "intake_id int, other string") == ["derived_from_sha256: string, expected none", "other: missing, expected string"]
    assert sinks.should_rebuild(0, 0) and not sinks.should_rebuild(100, 300) and sinks.should_rebuild(10_000, 20_000)
    with pytest.raises(ValueError):
        sinks.reconcile({"model": "a"}, {"model": "b", "dim": 1, "chunk_version": 1, "normalize_version": 1})


def test_partitions_are_replaced_not_repeated(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(1, 7, [0.0, 1.0]), (2, 8, [1.0, 0.0])], "id int, partition_idx long, vector array<float>")
    sinks.append_vectors(rows, path, 2)
    sinks.replace_items(rows.where("id = 1"), path)
    sinks.replace_items(rows.where("id = 1"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    with pytest.raises(Exception, match="components"):
        sinks.append_vectors(rows, path, 3)


def test_context_grows_in_turn(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([10, 50, 10, 10, 10, 10])], "k int, t int, s string")
    found = sequences.context(rows, spark.createDataFrame([(1, 2)], "k int, t int"), "k", "t", "s", reach=2, budget=50).collect()
    assert found[0].positions == [2, 3, 4]


def test_passages_meet_whole(spark):
    docs = spark.createDataFrame([(1, "so One two three four five six seven eight nine, ten."), (2, "one two three"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine"), (8, "two three"), (9, "")], "item_id long, text string")
    assert {tuple(r) for r in dedup.passages_in(docs, items).collect()} == {(1, 7), (1, 8), (2, 8)}
    assert {tuple(r) for r in dedup.passages_in(docs, items, broadcast_bytes=0).collect()} == {(1, 7), (1, 8), (2, 8)}


def test_book_audit(spark):
    kinds = "doc_id int, title string, language string, publisher string, year string, isbn string, subtitle string, series string, adapter string, source_stem string, year_raw string, body string, doubtful boolean, year_overridden boolean, toc_entries int, unanchored int, suspicious_flat boolean, heading_skew boolean"
    good = (1, "A Title", "en", "House", "1999", "9780306406157", None, None, "epub", "file", "1999", "plain english text", False, False, 6, 0, False, False)
    bad = (2, "untitled", "zh", "www.x.com", "1200", "1", " ", None, "pdf", "untitled", None, "plain english text", True, False, 12, 8, True, False)
    found = {r.doc_id: r for r in book_audit.audit(spark.createDataFrame([good, bad], kinds)).collect()}
    assert (found[1].verdict, found[1].confidence) == ("clean", "high")
    assert (found[2].verdict, found[2].confidence) == ("needs_work", "low")
    grades = {f.field: (f.grade, f.flags) for f in found[2].fields}
    assert grades["title"] == ("missing", ["placeholder_value", "equals_filename", "source_prior_weak", "doubtful_text_layer"])
    assert grades["publisher"][0] == "missing" and "source_watermark" in grades["publisher"][1]
    assert grades["isbn"] == ("weak", ["isbn_check_failed", "doubtful_text_layer"])


def test_paper_audit(spark):
    kinds = "title string, author string, year int, doi string, arxiv_id string, issn string, container_title string, publisher string, abstract string, language string, csl_type string"
    rows = [("A paper", "Ann Author", 2001, "10.1000/x", None, None, "Journal", None, "a" * 300, "en", "article-journal"), ("A paper", "Ann Author", 2001, None, None, None, None, None, None, "en", "article-journal")]
    found = paper_audit.audit(spark.createDataFrame(rows, kinds)).collect()
    assert [(r.verdict, r.confidence) for r in found] == [("clean", "high"), ("needs_work", "low")]


def test_distill_pairs_and_orphans(spark):
    text = "<!-- page 1 (sheet 1) -->\nALPHA first\nbody a\nBETA second\nbody b\n甲 漢字漢字\n漢字\n乙 漢字漢字\n漢字漢\n<!-- page 2 (sheet 2) -->\nstray line\nGAMMA third\n"
    source = spark.createDataFrame([("b", text)], "book string, text string")
    blocks = distill.split_bilingual_blocks(distill.split_pages(source))
    raws = distill.walk_anchors_per_lang(blocks, {"latin": "latin_headword", "cjk": "short_cjk"})
    paired = distill.unpack_paired_body(distill.split_headline_only(distill.pair_bilingual_entries(raws))).collect()
    by = {r.headword: r for r in paired}
    assert any("pair_mismatch" in r.flags for r in paired) or by["ALPHA first"].other_anchor.startswith("甲")
    spec = distill.Spec([("split_pages", {}), ("walk_anchors", {})])
    assert spec.check() == ["walk_anchors takes blocks, not pages", "the last stage gives raws, not drafts"]
    report = distill.report(source, distill.Spec([("split_pages", {}), ("one_block_per_page", {}), ("walk_anchors", {}), ("split_headline_only", {}), ("extract_year_span", {}), ("to_entry_draft", {})], retention=0.9))
    assert [r["gate"] for r in report] == ["off", "off", "off", "off", "pass", "off"]


def test_references(spark):
    entries = spark.createDataFrame([("d", "alpha", "Alpha", '{"redirect_to": "beta"}', []), ("d", "beta", "Beta", '{"n": 1}', ["pair_mismatch"]), ("d", "loop", "Loop", '{"redirect_to": "loop"}', [])], "book_slug string, entry_key string, headword string, payload string, flags array<string>")
    asked = spark.createDataFrame([("alpha",), ("BE-TA",), ("loop",), ("none",)], "query string")
    found = {r.query: r for r in references.lookup(entries, asked).collect()}
    assert found["alpha"].entry_key == "beta" and found["alpha"].redirected
    assert found["BE-TA"].entry_key == "beta" and not found["BE-TA"].redirected
    assert found["loop"].flags == ["redirect_loop"] and "none" not in found
    merged = spark.createDataFrame([('{"a": {"b": 1, "c": 2}, "d": 3}', '{"a": {"b": null}, "d": [1]}')], "t string, c string").select(references.merge_patch("t", "c")).first()[0]
    assert json.loads(merged) == {"a": {"c": 2}, "d": [1]}
    assert spark.createDataFrame([([],), (["pair_mismatch"],), (["odd"],)], "f array<string>").where(references.grave(F.col("f"), 2)).count() == 2


def test_html_walk():
    page = '<html><head><title>x</title></head><body>loose<nav>no</nav><h2 id="a">Head <b>bold</b></h2><p>one<p>two<br>2</p><div>in<ul><li>item</li></ul>out</div><aside role="doc-footnote"><p>note</p></aside><script>var a="<p>";</script></body></html>'
    found = [(k, lv, t) for _, k, lv, t, _ in html.blocks_of(page)]
    assert found == [("body", None, "loose"), ("heading", 2, "Head bold"), ("body", None, "one"), ("body", None, "two 2"), ("body", None, "in"), ("body", None, "item"), ("body", None, "out"), ("footnote", None, "note")]


def test_decoding():
    assert files.decode("é".encode()) == ("é", [])
    assert files.decode("漢".encode("utf-16")) == ("漢", [])
    assert files.decode("漢字".encode("gb18030")) == ("漢字", ["gb18030"])


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata><dc:title>T</dc:title><dc:creator opf:role="aut">Ann</dc:creator></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="1" href="a.xhtml"/><item id="2" href="b.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>')
        z.writestr("O/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol><li><a href="a.xhtml">A</a><ol><li><a href="b.xhtml#x">B</a></li></ol></li></ol></nav></body></html>')
        z.writestr("O/a.xhtml", "<html><body><h1>A</h1><p>first</p></body></html>")
        z.writestr("O/b.xhtml", '<html><body><p>second</p><p id="x">third</p></body></html>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.epub").write_bytes(epub())
    (tmp_path / "b.txt").write_bytes("漢字".encode("gb18030"))
    (tmp_path / "c.epub").write_bytes(b"broken")
    (tmp_path / "d.doc").write_bytes(b"")
    found = files.walk(spark, str(tmp_path)).cache()
    assert sorted((r.path.rsplit("/", 1)[1], r.format) for r in found.collect()) == [("a.epub", "epub"), ("b.txt", "txt"), ("c.epub", "epub")]
    books = {r.path.rsplit("/", 1)[1]: r for r in files.epub_books(found.where("format = 'epub'")).collect()}
    assert books["c.epub"].error and books["a.epub"].title == "T"
    assert [(t.label, t.depth, t.start_block) for t in books["a.epub"].toc] == [("A", 0, 0), ("B", 1, 3)]
    assert files.text_files(found.where("format = 'txt'")).first().text == "漢字"


def test_stream_ingest_is_idempotent(spark, tmp_path):
    inbox, library = str(tmp_path / "in"), str(tmp_path / "lib")
    schema = "source_sha256 string, name string"
    for n, rows in enumerate(([("a", "1"), ("a", "2"), ("b", "3")], [("b", "4"), ("c", "5")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        for _ in range(2):  # the second run finds nothing new
            ingest.ingest(spark, inbox, schema, library, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.source_sha256 for r in spark.read.parquet(library).collect()) == ["a", "b", "c"]


def test_stream_windows_equal_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = ingest.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == ingest.tumbling(events).count()


def test_cells_prune_and_find(spark):
    store = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").cache()
    centres = search.train_cells(store, store.count())
    indexed = search.assign_cells(store, centres).cache()
    assert indexed.select("cell").distinct().count() == len(centres) > 1
    vector = store.where("vec_id = 5").first()["embedding"]
    exact = [r.vec_id for r in search.top_k(store, vector, 5).collect()]
    assert [r.vec_id for r in search.probe(indexed, centres, vector, 5, len(centres)).collect()] == exact


def test_trigrams_are_all_runs_of_three_characters(spark):
    from stacklore.operators import references

    texts = ["", "ab", "abc", "abcabcab", "a\nb\n\nc", "x😀y😀zé", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "entry_id long, text string")
    got = {(r.entry_id, r.gram) for r in references.trigram_index(df, "text").collect()}
    assert got == {(i, t[j : j + 3]) for i, t in enumerate(texts) if t for j in range(len(t) - 2)}
    plan = references.trigram_index(df, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" not in plan  # texts are not taken apart into characters


def test_a_tree_shuffles_its_texts_once(spark):
    rows = [(1, "a\nthe words of a\n\n b \nmore of b"), (2, "x\nwords of x" * 3), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = structure.text_blocks(docs, F.when(F.char_length("line") < 3, 1))
    toc = structure.contents_of(blocks)
    nodes = structure.plan_tree(blocks, toc, docs.select("doc_id", F.lit("T").alias("title")))
    leaves = nodes.where("text is not null").select("doc_id", "node_id", "toc_lo", "ordinal", "text")
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan  # the entries, and all together
    assert [r.text for r in leaves.where("doc_id = 1").orderBy("toc_lo").collect()] == ["the words of a", "more of b"]


def test_lines_of_repeated_ids_are_numbered_together(spark):
    docs = spark.createDataFrame([(1, "a\n \n\tb　"), (1, "a\n \n\tb　"), (2, "c")], "doc_id long, text string")
    found = structure.text_blocks(docs, F.lit(None).cast("int")).orderBy("doc_id", "block_idx").collect()
    assert [(r.doc_id, r.block_idx, r.text) for r in found] == [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 0, "c")]


def test_entries_without_a_place_or_at_one_place(spark):
    blocks = spark.createDataFrame([(1, i, "body", t, 0) for i, t in enumerate(["front", "one", "two"])] + [(None, 0, "body", "lost", 0)], "doc_id long, block_idx int, kind string, text string, source_unit int")
    toc = spark.createDataFrame([(1, 0, "A", 0, 1), (1, 1, "B", 1, 1), (1, 2, "C", 0, None)], "doc_id long, entry_idx int, label string, depth int, start_block int")
    nodes = structure.plan_tree(blocks, toc, spark.createDataFrame([(1, "Book"), (2, "Bare")], "doc_id long, title string"), whole=True).collect()
    by = {r.title or r.text: r for r in nodes}
    assert len(nodes) == len(by) == 8 and by["Bare"].toc_lo is None
    assert by["two"].parent_id == by["one"].parent_id == by["B"].node_id and (by["one"].ordinal, by["two"].ordinal) == (0, 1)
    assert (by["front"].ordinal, by["A"].ordinal, by["C"].ordinal, by["B"].ordinal) == (0, 1, 2, 0) and by["front"].node_id == by["Book"].node_id + 4


def test_plain_texts_are_as_normalize_leaves_them(spark):
    texts = ["", " ", "a", "a b", "a  b", " a", "a ", "a\n\nb", "a\n\n\nb", "a \nb", "a\tb", "a\r\nb", "a\n", "été ß", "a b", "a­b", "“q”", "½", "ﬁ", "中 文", "x\u007fy", "é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    same = rows.where(F.col("t").rlike(tx.PLAIN))
    assert {r.t for r in same.collect()} == {"", "a", "a b", "a\n\nb", "été ß"}
    assert same.where(tx._steps(F.col("t")) != F.col("t")).count() == 0


def test_chunks_of_a_batch_are_made_in_slices(spark, monkeypatch):
    import pyarrow as pa

    assert [b.num_rows for b in sinks.sliced(iter([pa.RecordBatch.from_pydict({"x": list(range(5))})]), 2)] == [2, 2, 1]
    rows = [(1, i, 10 + i % 7, i, f"leaf {i}") for i in range(20)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, toc_lo int, text string").coalesce(1)
    whole = [tuple(r) for r in chunks.plan_chunks(nodes).orderBy("chunk_idx").collect()]
    monkeypatch.setattr(chunks, "RUNS", 3)
    assert len(whole) == 20 and [tuple(r) for r in chunks.plan_chunks(nodes).orderBy("chunk_idx").collect()] == whole


def test_blocks_of_pages_are_made_in_slices(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"<h1>H{i}</h1><p>page {i}</p>" if i % 5 else None) for i in range(20)], "page_id long, html string").coalesce(1)
    whole = sorted(tuple(map(str, r)) for r in html.html_blocks(pages).collect())
    assert html.PAGES < 1000 and len(whole) == 32
    monkeypatch.setattr(html, "PAGES", 3)
    assert sorted(tuple(map(str, r)) for r in html.html_blocks(pages).collect()) == whole


def test_words_are_hashed_in_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"word {i % 3} of {i}" if i % 4 else None) for i in range(20)], "i long, t string").coalesce(1)
    whole = sorted(tuple(map(str, r)) for r in search.hash_vectors(rows, "t", 8).collect())
    monkeypatch.setattr(search, "HASHED", 3)
    assert len(whole) == 20 and sorted(tuple(map(str, r)) for r in search.hash_vectors(rows, "t", 8).collect()) == whole


def test_pages_of_a_long_book_are_split_once(spark):
    """The parts of a text were made again for each of its pages, in time that grew with their square."""
    import time

    text = "".join(f"<!-- page {i} -->\nWORD {i}\n" for i in range(1, 8001))
    began = time.time()
    found = distill.split_pages(spark.createDataFrame([("b", text), ("c", "plain"), ("d", None)], "book string, text string")).collect()
    assert time.time() - began < 10 and len([r for r in found if r.book == "b"]) == 8000
    assert [tuple(r) for r in found if r.book == "b" and r.seq in (0, 7999)] == [("b", 0, 1, 1, "WORD 1"), ("b", 7999, 8000, 8000, "WORD 8000")]
    assert [tuple(r) for r in found if r.book == "c"] == [("c", 0, 1, 1, "plain")]

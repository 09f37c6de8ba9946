"""Trails, runs, calls, batches, and work that is done again, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from stacklore.operators import rework, trails


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, s string")
    return [r[1] for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is None, x) for x in r))


def frame(spark, kinds, *data):
    return spark.createDataFrame(list(data), kinds)


# --- rework ------------------------------------------------------------------------


def test_scrub_reads_what_the_text_says(spark):
    texts = [
        json.dumps({"path": "C:\\Users\\bob\\x.pdf", "n": 1.50, "list": ["/home/ann/y", "plain"]}),
        r'{"a": "\/home\/ann\/y", "b": "\u002fhome\u002fann\u002fz", "c": "tab\t \"q\" \\ é"}',
        '{"/home/ann/key" : "/Users/bob/v", "e": "", "t": true, "nul": null}',
        '"/home/ann"', "[]", "12", "", None, '{"open": "/home/ann/x',
    ]
    got = values(spark, rework.scrub_json, texts)
    plain = values(spark, lambda c: rework.redact(c), ["C:\\Users\\bob\\x.pdf", "/home/ann/y", "/home/ann/z", "/Users/bob/v", "/home/ann"])
    assert all("bob" not in p and "ann" not in p for p in plain[:4])
    assert json.loads(got[0]) == {"path": plain[0], "n": 1.5, "list": [plain[1], "plain"]} and '"n": 1.5,' in got[0]
    assert json.loads(got[1]) == {"a": plain[1], "b": plain[2], "c": 'tab\t "q" \\ é'}
    assert got[1].endswith(r'"c": "tab\t \"q\" \\ é"}')  # what holds nothing stays as it was written
    assert json.loads(got[2]) == {"/home/ann/key": plain[3], "e": "", "t": True, "nul": None}
    assert got[3:8] == [json.dumps(plain[4]), "[]", "12", "", None]


def test_aliases_of_any_payload(spark):
    payloads = [
        '{"aliases": ["one", "two", ""]}', '{"alias": "three", "aliases": []}', '{"alias": "[sic] name"}', '{"alias": "["}', '{"aliases": "[a] b", "alias": ["c"]}',
        '{"aliases": [null, "x"]}', '{"aliases": null}', "{}", "no json", None, '{"aliases": {"a": 1}}',
    ]
    got = values(spark, rework.aliases, payloads)
    assert got[:10] == [["one", "two"], ["three"], ["[sic] name"], ["["], ["[a] b", "c"], ["x"], [], [], [], []]


def test_base_attributes(spark):
    kinds = "id int, title string, subtitle string, publisher string, year string, isbn string, series string, language string, year_raw string, adapter string, name struct<series:string,title:string,publisher:string,year:string,isbn:string>"
    named = ("S", "Named", "House", "1987", None)
    df = frame(
        spark, kinds,
        (1, "UNTITLED!", None, None, "2019", "9780306406158", None, None, "D:20190101000000", "pdf", named),
        (2, "Own", None, "Press", "2019", "9780306406157", None, "en", "2019", "pdf", None),
        (3, None, None, None, None, None, None, None, None, "ocr-pages", None),
    )
    got = {r.id: r for r in rework.base_attributes(df, ("untitled",)).collect()}
    assert (got[1].title, got[1].year, got[1].isbn, got[1].source) == ("Named", "1987", None, "filename")
    assert got[1].actions == ["drop:isbn", "drop:year", "drop:title:placeholder", "filename:title", "filename:publisher", "filename:year", "filename:series"] or set(got[1].actions) >= {"drop:isbn", "drop:year", "filename:title"}
    assert (got[2].title, got[2].isbn, got[2].source, got[2].actions) == ("Own", "9780306406157", "extracted", [])
    assert got[3].source == "ocr_marker"


def test_titles_and_years(spark):
    assert values(spark, rework.sniff_title, [" A title ", "draft.docx", "arXiv:1234 x", "12-34 a", "", None]) == ["A title", None, None, None, None, None]
    assert values(spark, rework.pdf_year, ["D:20190101", "1999-02", "none", None]) == [2019, 1999, None, None]
    assert values(spark, lambda c: rework.garbage_title(c, ("Untitled",), ("bookshare",), (r"^doc-\d+$",)), ["untitled", "By BookShare", "DOC-12", "Fine", " "]) == ["placeholder", "substring", "regex", None, None]


def test_plans_of_rework(spark):
    items = frame(spark, "intake_id int, source_sha256 string, extractor_version int", (1, "a", 1), (2, "b", 2), (3, "c", None), (4, "d", 1))
    env = frame(spark, "intake_id int, source_sha256 string, body string", (1, "a", "x"), (2, "other", "x"), (3, "c", None))
    assert rows(rework.rebuild_plan(items, env)) == [(1, "rebuilt"), (2, "mismatched"), (3, "failed"), (4, "missing")]
    assert rows(rework.rebuild_plan(items, env, 1)) == [(2, "mismatched"), (3, "failed")]
    chunks = frame(spark, "intake_id int, text string", (1, "abc"), (1, "de"), (9, "x"))
    assert rows(rework.reembed_plan(items, chunks)) == [(1, 2, 5)] and rows(rework.reembed_plan(items, chunks, [2])) == []
    states = frame(spark, "intake_id int, status string", (1, "embedded"), (2, "extracted"), (3, "failed"))
    out, todo = rework.reset(states, chunks)
    assert rows(out) == [(1, "extracted"), (2, "extracted"), (3, "failed")] and rows(todo) == [(1, True), (2, False)]
    out, todo = rework.reset(states, chunks, resume=True)
    assert rows(out)[0] == (1, "embedded") and rows(todo) == [(2, False)]
    old = frame(spark, "intake_id int, verdict string, confidence string", (1, "clean", "high"), (2, "clean", "low"), (3, "clean", "low"))
    new = frame(spark, "intake_id int, verdict string, confidence string", (1, "clean", "high"), (2, "needs_work", "low"), (3, None, "low"))
    assert rows(rework.reaudit(old, new), "intake_id", "verdict", "changed", "outcome") == [(1, "clean", False, "ok"), (2, "needs_work", True, "ok"), (3, "clean", False, "partial")]


def test_ocr_product(spark):
    pages = frame(spark, "intake_id int, page int, text string, expected int", (1, 2, "b", 2), (1, 1, "a", 2), (2, 1, "c", 3))
    items = frame(spark, "intake_id int, source_sha256 string", (1, "x"), (2, "y"))
    assert rows(rework.ocr_product(pages, items)) == [(1, "x", "a\n\nb", 2, 0, True), (2, "y", "c", 1, 2, False)]


def test_settings():
    assert rework.canonical_json({"b": 1, "a": {"d": "é", "c": 2}}) == '{"a":{"c":2,"d":"é"},"b":1}'
    assert rework.switches({"a": {"x": True, "n": 3}, "b": False}) == {"a.x": True, "b": False}
    assert rework.search_options({"probes": 4, "bypass": None}, {"probes": 9, "refine": 2, "bypass": True}) == {"probes": 4, "refine": 2, "bypass": True}


def test_flags_and_texts(spark):
    df = frame(spark, "f array<string>, s string", (["en"], "ab  cdef g"), (None, "x"))
    wide = df.select("s", *rework.one_hot(F.col("f"), ("en", "de")))
    got = wide.select("en", "de", rework.from_one_hot(("en", "de")).alias("back"), rework.strip_span(F.col("s"), F.lit(2), F.lit(6)).alias("cut")).collect()
    assert [tuple(r) for r in got] == [(1, 0, ["en"], "ab ef g"), (0, 0, [], "x")]
    assert values(spark, lambda c: rework.full_text(c, F.array(F.lit("b")), F.lit(None).cast("string")), ["a", "", None]) == ["a b", "b", "b"]
    assert df.select(rework.strings_as_json(F.col("f")).alias("j")).collect()[0].j == '["en"]'


# --- trails --------------------------------------------------------------------------


def test_curate_and_its_trail(spark):
    kinds = "intake_id int, field string, value string"
    base = frame(spark, kinds, (1, "title", "T"), (2, "title", "U"))
    over = frame(spark, kinds, (2, "title", "V"), (3, "title", "W"))
    changes = frame(spark, "intake_id int, field string, seq int, action string, value string", (1, "title", 1, "set", "A"), (1, "title", 2, "void", None), (2, "title", 1, "clear", None))
    after, trail = trails.curate(base, over, changes)
    assert rows(after) == [(1, "title", None), (3, "title", "W")]
    assert rows(trail, "intake_id", "seq", "old_value", "new_value") == [(1, 1, "T", "A"), (1, 2, "A", None), (2, 1, "V", "U")]
    with pytest.raises(Exception, match="action"):
        trails.curate(base, over, changes.withColumn("action", F.lit("burn")))[0].collect()


def test_runs(spark):
    runs = frame(spark, "run_id int, command string, started_at int, finished_at int, status string", (1, "a", 10, None, "running"), (2, "b", 20, 21, "ok"), (3, "a", 30, None, "running"))
    closed = trails.close_runs(runs, frame(spark, "run_id int, finished_at int, status string", (1, 11, "error")))
    assert rows(closed)[0] == (1, "a", 10, 11, "error")
    assert [r.run_id for r in trails.list_runs(runs, "a").collect()] == [3, 1] and [r.run_id for r in trails.list_runs(runs, last=1).collect()] == [3]
    both = trails.merged_runs({"x": (runs, frame(spark, "run_id int, n int", (3, 7))), "y": (runs.where("run_id = 2"), frame(spark, "run_id int, n int"))}, 3)
    assert [(r.run_id, r.n, r.catalogue) for r in both.collect()] == [(3, 7, "x"), (2, None, "x"), (2, None, "y")] or both.count() == 3
    log = frame(spark, "id int, run string, ts int", (1, "r", 5), (2, "r", 3), (3, "s", 1))
    assert [r.id for r in trails.trail(log, "run", "r", "ts", "id").collect()] == [2, 1]
    assert rows(trails.append_once(log, log.unionByName(frame(spark, "id int, run string, ts int", (4, "s", 2), (4, "s", 2))), "id"), "id") == [(1,), (2,), (3,), (4,)]


def test_calls(spark):
    calls = spark.createDataFrame([(1, "f", [("a", 1), ("b", 2)]), (2, None, []), (3, "g", [("c", 3)])], "call_id int, corpus_fingerprint string, hits array<struct<node:string,n:int>>")
    logged, hits = trails.log_calls(calls)
    assert rows(hits) == [(1, 0, "a", 1), (1, 1, "b", 2), (3, 0, "c", 3)]
    kept, left = trails.prune_stale(logged, hits, "f")
    assert rows(kept, "call_id") == [(1,)] and left.count() == 2


def test_ranked_candidates(spark):
    candidates = frame(spark, "call_id int, index int, node string, note string", (1, 0, "a", None), (1, 1, "b", "x"), (2, 0, None, None))
    ranked = frame(spark, "call_id int, rank int, index int, score double", (1, 0, 1, 0.9), (1, 1, 0, 0.5), (2, 0, 0, 0.1))
    got = trails.take_ranked(candidates, ranked).collect()
    assert [(r.rank, r.node) for r in got if r.call_id == 1] == [(0, "b"), (1, "a")] and len(got) == 3  # columns that are null are no gaps
    for bad in ((1, 2, 1, 0.1), (1, 2, 7, 0.1)):
        with pytest.raises(Exception, match="repeated or out of range"):
            trails.take_ranked(candidates, ranked.unionByName(frame(spark, "call_id int, rank int, index int, score double", bad))).collect()


def plain_batches(sizes, chars, most):
    out, number, filled, held = [], 0, 0, 0
    for n in sizes:
        if held and (filled + n > chars or held >= most):
            number, filled, held = number + 1, 0, 0
        filled, held = filled + n, held + 1
        out.append(number)
    return out


def test_batches_of_long_items(spark):
    """Forty thousand chunks of one item, and some of others: as a plain loop deals them."""
    sizes = {1: [(i * 37) % 900 for i in range(40_000)], 2**60 + 1: [9000, 1, 1, 9000], 3: [10] * 200}
    data = [(item, i, n) for item, own in sizes.items() for i, n in enumerate(own)]
    df = spark.createDataFrame(data, "item long, at long, n long").repartition(7)
    got = trails.greedy_batches(df, "item", "at", F.col("n"))
    found = {}
    for r in got.orderBy("item", "at").collect():
        found.setdefault(r.item, []).append(r.batch)
    assert found == {item: plain_batches(own, trails.BATCH_CHARS, trails.BATCH_ROWS) for item, own in sizes.items()}


def test_addresses_and_crumbs(spark):
    nodes = frame(
        spark, "doc_id int, node_id int, parent_id int, text string, subtree_sha256 string, stable_anchor string",
        (1, 10, None, None, "r", None), (1, 11, 10, None, "p", None), (1, 12, 11, "t", None, "x"), (1, 13, 11, "t", None, "x"),
    )
    asked = frame(spark, "doc_id int, scope string", (1, "book"), (1, "part:p"), (1, "leaf:x"), (1, "leaf:y"))
    assert rows(trails.resolve(nodes, asked), "scope", "node_id", "state") == [("book", 10, "found"), ("leaf:x", None, "ambiguous"), ("leaf:y", None, "not_found"), ("part:p", 11, "found")]
    crumb = lambda *x: spark.range(1).select(trails.paper_breadcrumb(*[F.lit(v).cast("string") for v in x], F.lit(7)).alias("c")).first().c
    assert [crumb("Proc", "T", "s"), crumb(None, " ", "s"), crumb("", None, "")] == ["Proc › T", "s", "paper #7"]


def test_addresses_worked_out_before_resolve_alike(spark):
    own = spark.createDataFrame([(1, 11, "book"), (1, 12, "leaf:a"), (1, 13, "leaf:b"), (1, 14, "leaf:b")], "doc_id long, node_id long, scope string")
    asked = spark.createDataFrame([(1, "book"), (1, "leaf:a"), (1, "leaf:b"), (1, "leaf:c"), (2, "book")], "doc_id long, scope string")
    found = {(r.doc_id, r.scope): (r.node_id, r.state) for r in trails.resolve_in(own, asked).collect()}
    assert found == {(1, "book"): (11, "found"), (1, "leaf:a"): (12, "found"), (1, "leaf:b"): (None, "ambiguous"), (1, "leaf:c"): (None, "not_found"), (2, "book"): (None, "not_found")}

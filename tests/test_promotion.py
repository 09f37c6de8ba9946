"""Headings of papers by outline and by sequence, against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stacklore.operators import promotion

BLOCKS = "doc_id long, block_idx int, page int, kind string, text string, font_size double, bold boolean, lines int"
OUTLINE = "doc_id long, entry_idx int, label string, depth int, start_block int"


def made(spark, blocks, outline):
    b = spark.createDataFrame([(1, i, *x) for i, x in enumerate(blocks)], BLOCKS)
    o = spark.createDataFrame([(1, i, *x) for i, x in enumerate(outline)], OUTLINE)
    out = promotion.promote(b, o)
    return {r.block_idx: (r.kind, r.level, r.by) for r in out.collect()}, promotion.sources(out).first().source


def body(text, page=0, size=10.0, bold=False, lines=1, kind="body"):
    return (page, kind, text, size, bold, lines)


def test_a_paper(spark):
    blocks = [
        body("A paper on owls"), body("1 Introduction", size=12.0), body("words of the text"), body("Figure 1. An owl"), body("2 Background", page=1), body("long text that goes on", page=1, lines=3),
        body("3 Model", page=1, bold=True), body("3.1 Owls", page=2, bold=True), body("47 Owls were seen", page=2, bold=True), body("4 = four", page=2, bold=True), body("5 The skipped", page=3, bold=True),
        body("IV. Not first", page=3), body("I. Roman", page=3), body("II. Roman too", page=3), body("Appendix A Proofs", page=4), body("Appendix C Later", page=4),
    ]
    kinds, source = made(spark, blocks, [("2. Background", 0, 2), ("Table 3 of things", 0, 2), ("Nowhere", 0, 0)])
    heads = {i: (level, by) for i, (kind, level, by) in kinds.items() if kind == "heading"}
    assert heads == {1: (1, "sequence"), 4: (1, "outline"), 6: (1, "sequence"), 7: (2, "sequence"), 12: (1, "sequence"), 13: (1, "sequence"), 14: (1, "sequence")}
    assert kinds[3][0] == "caption" and source == "mixed"


def test_sources(spark):
    assert made(spark, [body("plain words here")], [])[1] == "none"
    assert made(spark, [body("Methods"), body("x y z")], [("3 methods", 1, 0)]) == ({0: ("heading", 2, "outline"), 1: ("body", None, None)}, "outline")
    assert made(spark, [body("1 Only", bold=True), body("a b c d")], [])[1] == "heuristic"


def test_the_window_and_the_gate(spark):
    far = [body("top of page"), body("text", page=1), body("Results", page=2)]
    assert made(spark, far, [("Results", 0, 0)])[1] == "none"  # two pages on
    assert made(spark, far, [("Results", 0, 1)])[1] == "outline"
    assert made(spark, [body("Results", size=8.0), body("text one"), body("text two")], [("Results", 0, 0)])[1] == "none"
    assert made(spark, [body("Results", lines=2)], [("Results", 0, 0)])[1] == "none"
    twice = made(spark, [body("Results"), body("and more"), body("Results")], [("Results", 0, 0), ("Results", 0, 0), ("Results", 0, 0)])[0]
    assert [i for i, x in twice.items() if x[0] == "heading"] == [0, 2]


def plain_outline(blocks, outline):
    key = lambda s: re.sub(r"\s+", " ", re.sub(r"^[0-9. \tIVX]+", "", s)).strip().lower()
    taken = {}
    for label, depth, start in outline:
        want = key(label)
        for i in range(start, len(blocks)):
            page, kind, text, size, _, lines = blocks[i]
            if page > blocks[start][0] + 1:
                break
            sizes = sorted(b[3] for b in blocks if b[0] == page)
            own = key(text)
            fits = kind == "body" and 3 <= len(text) <= 80 and lines == 1 and size >= 0.95 * sizes[len(sizes) // 2] and want and own
            if fits and i not in taken and (own.startswith(want) or want.startswith(own)):
                taken[i] = 1 if depth == 0 else 2
                break
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_outlines_as_a_loop_finds_them(spark, seed):
    r = random.Random(seed)
    words = ["owls", "owls at night", "wrens", "wr", "larks sing", "2.1 owls", "gulls", "III gulls", "  larks  sing on "]
    blocks = [body(r.choice(words), page=i // 6, size=r.choice([8.0, 10.0, 10.0, 12.0]), lines=r.choice([1, 1, 1, 2])) for i in range(60)]
    outline = [(r.choice(words), r.choice([0, 1]), r.randrange(60)) for _ in range(25)]
    b = spark.createDataFrame([(1, i, *x) for i, x in enumerate(blocks)], BLOCKS)
    o = spark.createDataFrame([(1, i, *x) for i, x in enumerate(outline)], OUTLINE)
    found = {x.block_idx: x.level for x in promotion.outline_headings(b, o).collect()}
    assert found == plain_outline([(p, k, t.strip(), s, bo, li) for p, k, t, s, bo, li in blocks], outline)
    assert promotion.promote(b, o).where(F.col("kind") == "heading").count() >= len(found)


def test_promotion_by_outline_shuffles_no_texts(spark, tmp_path, monkeypatch):
    """What the query stored had the texts of all blocks beside the three columns that it counts."""
    from stacklore.operators import sinks
    from stacklore.plans import documents

    spark.createDataFrame([(1, "A\nsome longer line of words that is no heading\nb\nC"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, store = [], sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda df: seen.append(df.columns) or store(df))
    assert [(r.doc_id, r.headings, r.source) for r in documents.outline_promotion(spark, str(tmp_path)).collect()] == [(1, 2, "outline")]
    assert seen[-1] == ["doc_id", "by", "level"]

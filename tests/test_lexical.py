"""Retrieval by words against a plain BM25."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacklore.operators import lexical, search


def plain(docs, queries, k):
    tokens = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in docs}
    n, usual = len(tokens), max(1.0, sum(map(len, tokens.values())) / len(tokens))
    counts = {i: Counter(t) for i, t in tokens.items()}
    holders = Counter(w for c in counts.values() for w in c)
    out = []
    for q, text in queries:
        asked = sorted({w for w in re.split(r"[\W_]+", (text or "").lower()) if w in holders})
        scores = []
        for i, c in counts.items():
            s = 0.0
            for w in asked:
                idf = math.log(1 + (n - holders[w] + 0.5) / (holders[w] + 0.5))
                s += idf * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(tokens[i]) / usual))) if c[w] else 0
            if i != q and s > 0:
                scores.append((-round(s, 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(r.choices(vocabulary, weights, k=r.randrange(1, 60)))) for i in range(400)]
    rows += [(1000 + i, "w0 w1 w2 the same words") for i in range(80)]  # a group of copies
    rows += [(2000, None), (2001, ""), (2002, " ... "), (2003, "Wörter W0-w1_x"), (2004, "w3 " * 5000)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_equal_to_plain_bm25(spark, docs, block, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 5 if block == 16 else 256)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical.build(df)
    queries = [d for d in docs if d[0] % 25 == 0 or d[0] > 2000] + [(-1, "nothing of this"), (-2, "w0 w59 w58")]
    found = lexical.search(spark.createDataFrame(queries, "doc_id long, text string"), index, 7)
    got = sorted(tuple(r) for r in found.collect())
    want = plain(docs, queries, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("clash", [False, True])
def test_many_queries_make_no_rows_of_pairs(spark, docs, monkeypatch, clash):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "MOST_PAIRS", 0)
    monkeypatch.setattr(lexical, "PART", 50)
    monkeypatch.setattr(lexical, "GROUP", 100)
    if clash:
        monkeypatch.setattr(lexical, "_number", lambda term: F.char_length(term))
    monkeypatch.setattr(lexical, "_scored", None)  # the way by bounds is not taken
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    queries = [d for d in docs if d[0] % 25 == 0 or d[0] > 2000] + [(-1, "nothing of this"), (-2, "w0 w59 w58")]
    got = sorted(tuple(r) for r in lexical.search(spark.createDataFrame(queries, "doc_id long, text string"), index, 7).collect())
    want = plain(docs, queries, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))


def test_many_queries_go_as_few_rows():
    """Queries of a group are a row for so many words, in which each word is there once."""
    r = random.Random(3)
    asked = {q: sorted(r.sample(range(-50, 50), r.randrange(1, 20))) for q in range(300)}
    rows = [(q, w, [n / 7 for n in w], q % 2) for q, w in asked.items()]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 40], strict=True), kinds, strict=True)], ["query_id", "numbers", "idfs", "group"]) for i in range(0, 300, 40)]
    for most in (1, 1000, 1_000_000):
        packed = pa.Table.from_batches(lexical._asked(iter(batches), most)).to_pylist()
        assert len(packed) <= 2 * min(len(batches), 1 + sum(map(len, asked.values())) // most)
        got = {}
        for row in packed:
            number, idf, place = (np.frombuffer(row[c], k) for c, k in (("numbers", np.int64), ("idfs", np.float64), ("places", np.int32)))
            assert len(set(number)) == len(number) and np.array_equal(idf, number / 7)
            ends = np.cumsum(np.frombuffer(row["lengths"], np.int32))
            for q, own in zip(np.frombuffer(row["queries"], np.int64), np.split(number[place], ends[:-1]), strict=True):
                assert q % 2 == row["group"]
                got[int(q)] = own.tolist()
        assert got == asked
    assert list(lexical._asked(iter([]))) == []


def test_blocks_are_skipped(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    sent = []
    scored = lexical._scored
    monkeypatch.setattr(lexical, "_scored", lambda asked, pairs, *a: (sent.append(pairs.count()), scored(asked, pairs, *a))[1])
    assert lexical.search(spark.createDataFrame([(-1, "w40 w41")], "doc_id long, text string"), index, 3).count() == 3
    blocks = index.postings.select("block").distinct().count()
    assert sent[0] == 1 and sent[1] < blocks


def test_saved_and_loaded(spark, docs, tmp_path):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical.build(df)
    lexical.save(index, str(tmp_path / "index"))
    again = lexical.load(spark, str(tmp_path / "index"))
    asked = df.where("doc_id % 100 = 0")
    assert sorted(lexical.search(asked, again, 5).collect()) == sorted(lexical.search(asked, index, 5).collect()) and again.n == len(docs)


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.search(spark.createDataFrame([(1, "x")], "doc_id long, text string"), lexical.build(none), 3).collect() == []


def test_fusion(spark):
    kinds = "query_id long, rank int, id long"
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 5)], kinds)
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], kinds)
    got = [(r.query_id, r.rank, r.id) for r in lexical.fuse([a, b], 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 11), (1, 2, 10), (2, 1, 5)]
    weighted = lexical.fuse([a, b], 3, [0.0, 1.0]).where("query_id = 1").orderBy("rank").collect()
    assert [r.id for r in weighted] == [11, 12, 10]


def test_a_library_by_words_and_vectors(spark, tmp_path):
    from stacklore.library import Library

    library = Library(spark, str(tmp_path / "lib"))
    level = F.when(F.col("line").rlike("^# "), 1)
    docs = [(i, f"# Head {i}\nnumber {i} speaks of thing{i} and of thing{i + 1}", f"Book {i}") for i in range(30)]
    library.ingest(spark.createDataFrame(docs, "doc_id long, text string, title string"), level)
    library.build_lexical()
    hits = library.hybrid("thing7", 2).collect()
    assert {r.doc_id for r in hits} == {6, 7} and [r.rank for r in hits] == [1, 2]
    library.ingest(spark.createDataFrame([(7, "# Head\nother words", "Book 7")], "doc_id long, text string, title string"), level)
    assert library.hybrid("thing7", 1).first().doc_id == 6  # chunks that went are no hits
    assert search.WEAK == 0.5

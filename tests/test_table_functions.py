"""Table functions in SQL give the rows of the DataFrame functions; parts of a library can be replaced."""

import pytest
from pyspark.sql import functions as F

from stacklore.library import Library, Profile
from stacklore.operators import chunks, table_functions
from stacklore.sources import html

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    table_functions.register(spark)


def test_blocks_by_lateral_are_those_of_the_walk(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    own = spark.sql("SELECT page_id, b.* FROM {pages}, LATERAL html_blocks(html) AS b", pages=pages)
    got, want = sorted(map(str, own.collect())), sorted(map(str, html.html_blocks(pages).collect()))
    assert got == want and got


def test_windows_of_whole_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = spark.sql("SELECT doc_id, w.* FROM {docs}, LATERAL chunk_windows(text, 300, 40) AS w", docs=docs)
    got = sorted((r.doc_id, r.part, r.start_char, r.end_char, r.text) for r in own.collect())
    want = [(d.doc_id, i, a, b, d.text[a:b]) for d in docs.collect() for i, (a, b) in enumerate(chunks.split(d.text or "", 300, 40))]
    assert got == sorted(want)


def test_nulls_defaults_and_what_is_refused(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a 𝛼 b")], "id int, text string")
    windows = lambda more="": spark.sql(f"SELECT id, w.* FROM {{rows}}, LATERAL chunk_windows(text{more}) AS w", rows=rows).collect()
    assert windows() == windows(", NULL, NULL") == [(3, 0, 0, 5, "a 𝛼 b")]
    blocks = spark.sql("SELECT id, b.text FROM {rows}, LATERAL html_blocks(text) AS b", rows=rows)
    assert [(r.id, r.text) for r in blocks.collect()] == [(3, "a 𝛼 b")]
    with pytest.raises(Exception, match="less than half"):
        windows(", 10, 5")


def vowels(rows, text, dims):
    """An embedder that counts vowels."""
    return rows.withColumn("embedding", F.array(*[F.regexp_count(F.lower(text), F.lit("aeiou"[i])).cast("float") for i in range(dims)]))


def made(spark, path, **parts):
    library = Library(spark, str(path), Profile(dim=4, model="vowels", reranker="shortest", top_k_in=3, top_k_out=2), **parts)
    docs = spark.createDataFrame([(i, t, f"Book {i}") for i, t in enumerate(["aaaa", "aaaa aaaa", "a e i o", "oooo"])], "doc_id long, text string, title string")
    library.ingest(docs, F.when(F.col("line").rlike("^# "), 1))
    return library


def test_an_embedder_and_a_scorer_of_ones_own(spark, tmp_path):
    library = made(spark, tmp_path / "a", embedder=vowels, scorer=lambda text, query: -F.char_length(text))
    assert library.embed("ao") == [1, 0, 0, 1]
    hits = library.search("aaa", 2).orderBy("rerank_score").collect()
    assert sorted(r.text for r in hits) == ["a e i o", "aaaa"]  # the three nearest hold both long texts of a's, the shortest two of them stay
    with pytest.raises(Exception, match="another length"):
        made(spark, tmp_path / "b", embedder=lambda rows, text, dims: vowels(rows, text, dims - 1))

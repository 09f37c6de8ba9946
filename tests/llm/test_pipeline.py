"""Each stage keeps what it should; the whole runs and its parts are checked by what they promise."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs, seen = documents, []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == documents.columns and out.count() <= docs.count(), name
        seen.append((docs, out))
        docs = out
    before, after = seen[0]
    assert after.count() == before.where(F.col("text").rlike(r"\p{L}")).count()
    before, after = seen[1]
    # one of each group of equal texts stays, that with the smallest id
    equal = before.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    assert after.join(equal, "doc_id", "left_anti").count() == 0
    before, after = seen[2]
    assert after.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert after.agg(F.sum("n_chars")).first()[0] <= before.agg(F.sum(F.char_length("text"))).first()[0]
    before, after = seen[3]
    assert 0.5 * before.count() < after.count() < before.count()
    pieces = cp.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_odd_rows_pass_through(spark, odd):
    docs = odd
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == odd.columns
        docs = spark.createDataFrame(docs.collect(), odd.schema)
    assert docs.where("doc_id in (4, 5, 6, 7)").count() == 0
    assert cp.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_empty_table(spark, none):
    docs = none
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_registered_queries(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))

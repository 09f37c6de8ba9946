"""Queries on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search, sinks, vector_index
from .registry import query, table

_SIM = "1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_ONE = f"SELECT a.vec_id, round(CAST({_SIM} AS DOUBLE), 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _first(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings")
    return store, store.where("vec_id = 0").first()["embedding"]


def _rounded(hits):
    return hits.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"{_ONE} ORDER BY distance, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    store, vector = _first(spark, sf_dir)
    return _rounded(search.top_k(store, vector, 10))


@query(f"{_ONE} WHERE a.label = 3 ORDER BY distance, vec_id LIMIT 10")
def vector_topk_partition(spark, sf_dir):
    store, vector = _first(spark, sf_dir)
    return _rounded(search.top_k(store, vector, 10, where=F.col("label") == 3))


@query(f"{_ONE} WHERE NOT (a.vec_id BETWEEN 0 AND 99) AND NOT (a.vec_id BETWEEN 300 AND 349) ORDER BY distance, vec_id LIMIT 10")
def vector_topk_exclusion(spark, sf_dir):
    store, vector = _first(spark, sf_dir)
    return _rounded(search.top_k(store, vector, 10, where=search.outside("vec_id", [(0, 99), (300, 349)])))


@query(f"""
WITH r AS (SELECT q.vec_id AS query_id, a.vec_id AS id, round(CAST({_SIM} AS DOUBLE), 9) AS d
  FROM embeddings a JOIN embeddings q ON a.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS distance FROM n WHERE rank <= 5""")
def vector_topk_batch(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings")
    hits = search.top_k_batch(store.where("vec_id % 100 = 0"), store, 5)
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query(f"""
WITH b AS ({_ONE} WHERE a.label % 2 = 0 ORDER BY distance, vec_id LIMIT 10),
p AS ({_ONE} WHERE a.label % 2 = 1 ORDER BY distance, vec_id LIMIT 10)
SELECT * FROM (SELECT *, 'book' AS kind FROM b UNION ALL SELECT *, 'paper' AS kind FROM p) ORDER BY distance, kind, vec_id LIMIT 10""")
def unified_topk(spark, sf_dir):
    store, vector = _first(spark, sf_dir)
    books = _rounded(search.top_k(store, vector, 10, where=F.col("label") % 2 == 0))
    papers = _rounded(search.top_k(store, vector, 10, where=F.col("label") % 2 == 1))
    return search.unified(books, papers, 10)


@query(f"SELECT count(*) AS hits, min(distance) >= 0.5 AS all_weak FROM ({_ONE} ORDER BY distance, vec_id LIMIT 10)")
def weak_recall(spark, sf_dir):
    store, vector = _first(spark, sf_dir)
    return search.all_weak(_rounded(search.top_k(store, vector, 10)))


@query(f"""
WITH r AS ({_ONE} ORDER BY distance, vec_id LIMIT 50)
SELECT vec_id, distance, vec_id % 7 AS rerank_score FROM r ORDER BY vec_id % 7 DESC, distance, vec_id LIMIT 10""")
def rerank_topk(spark, sf_dir):
    store, vector = _first(spark, sf_dir)
    return search.rerank(_rounded(search.top_k(store, vector, 50)), F.col("vec_id") % 7, 50, 10, 20)


@query()
def vector_cells(spark, sf_dir):
    """Rows of each cell of an index over all vectors."""
    store = table(spark, sf_dir, "embeddings")
    centres = search.train_cells(store, store.count())
    return search.assign_cells(store, centres).groupBy("cell").agg(F.count("*").alias("n"))


_EXACT = f"""
WITH r AS (SELECT q.vec_id AS query_id, a.vec_id AS id, round(CAST({_SIM} AS DOUBLE), 9) AS d
  FROM embeddings a JOIN embeddings q ON a.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM r)"""


def _indexed(spark, sf_dir, kind):
    store = table(spark, sf_dir, "embeddings")
    index = vector_index.train(store, kind)
    return store, index, sinks.stored(vector_index.encode(store, index))


@query()
def vector_index_search(spark, sf_dir):
    """The ten nearest rows by codes of pieces, for all rows whose vec_id is divisible by 100; probes and refine are calibrated."""
    store, index, codes = _indexed(spark, sf_dir, "ivf-pq")
    index = vector_index.calibrate(index, codes, store)
    return vector_index.search(store.where("vec_id % 100 = 0"), codes, store, index, 10)


@query(f"{_EXACT} SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS recall_met FROM n WHERE rank <= 10")
def vector_index_recall(spark, sf_dir):
    """Whether calibrated searches by each kind of code find at least 0.9 of what an exact search finds, for all rows whose vec_id is divisible by 100."""
    store = table(spark, sf_dir, "embeddings")
    asked = store.where("vec_id % 100 = 0")
    exact = sinks.stored(search.top_k_batch(asked, store, 10))
    met = []
    for kind in vector_index.KINDS:
        _, index, codes = _indexed(spark, sf_dir, kind)
        index = vector_index.calibrate(index, codes, store)
        met.append(vector_index.recall(vector_index.search(asked, codes, store, index, 10), exact) >= 0.9)
    return exact.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.lit(all(met)).alias("recall_met"))


@query(f"{_EXACT} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS distance FROM n WHERE rank <= 5")
def vector_index_full(spark, sf_dir):
    """With every cell probed and every code ranked again, an index gives the rows of an exact search."""
    store, index, codes = _indexed(spark, sf_dir, "ivf-sq")
    hits = vector_index.search(store.where("vec_id % 100 = 0"), codes, store, index, 5, probes=len(index.centres), refine=-(-store.count() // 5))
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query("""
SELECT count(*) AS rows, count(*) FILTER (WHERE vec_id % 3 <> 0) AS indexed, count(*) FILTER (WHERE vec_id % 3 = 0) AS unindexed, count(*) FILTER (WHERE vec_id % 3 <> 0 AND vec_id % 7 = 1) AS stale
FROM embeddings""")
def vector_index_status(spark, sf_dir):
    """Rows of the table, of which two thirds were indexed; some were indexed under ids that are gone."""
    store = table(spark, sf_dir, "embeddings")
    old = store.where("vec_id % 3 <> 0")
    gone = old.where("vec_id % 7 = 1").withColumn("vec_id", -1 - F.col("vec_id"))
    index = vector_index.train(old, "ivf-sq")
    return vector_index.status(store, vector_index.encode(old.unionByName(gone), index))


@query("SELECT label, count(*) AS n, round(avg(list_aggregate(CAST(embedding AS DOUBLE[]), 'sum')), 6) AS mean_sum FROM embeddings GROUP BY label")
def vector_stats(spark, sf_dir):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(total), 6).alias("mean_sum"))

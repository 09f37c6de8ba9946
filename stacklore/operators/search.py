"""Vector search: exact top-k, batches, two stores, cells, reranking, and what a search returns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEAK = 0.5  # a hit as far as this says little
DISTANCES = 1 << 20  # that a task holds at once
HASHED = 512  # rows whose words a task holds at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(store: DataFrame, vector: list[float], k: int, id_column: str = "vec_id", column: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest rows to one vector; ties to the smaller id. A filter on a partition column prunes the scan."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    rows = store if where is None else store.where(where)
    return rows.withColumn("distance", cosine_distance(F.col(column), query)).orderBy("distance", id_column).limit(k)


def outside(id_column: str, excluded: list[tuple[int, int]]) -> Column:
    """True for ids in none of the ranges."""
    out = F.lit(True)
    for low, high in excluded:
        out = out & ~F.col(id_column).between(low, high)
    return out


def top_k_batch(
    queries: DataFrame,
    store: DataFrame,
    k: int,
    id_column: str = "vec_id",
    column: str = "embedding",
    query_block: int = 8192,
    store_block: int = 16384,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of store to each query but itself.

    Both sides are dealt to blocks, and a task multiplies a pair of blocks, DISTANCES at a time;
    only k rows for each query and block are shuffled to be merged.
    """
    q_blocks = max(1, -(-queries.count() // query_block))
    s_blocks = max(1, -(-store.count() // store_block))
    deal = lambda n: F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int")
    pick = [F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")]
    left = queries.select(*pick, deal(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(s_blocks - 1))).alias("sb"))
    right = store.select(*pick, deal(s_blocks).alias("sb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64"})
        unit = lambda rows: (x := np.array(rows.tolist(), np.float64)) / np.linalg.norm(x, axis=1, keepdims=True)
        asked, ids, left, right = a["id"].to_numpy(), b["id"].to_numpy(), unit(a["x"]), unit(b["x"]).T
        m, step, out = min(k, len(b)), max(1, DISTANCES // len(b)), []
        for at in range(0, len(a), step):
            own = asked[at : at + step]
            far = np.round(1 - left[at : at + step] @ right, 9)
            far[own[:, None] == ids[None, :]] = np.inf
            edge = np.partition(far, m - 1, axis=1)[:, m - 1]
            rows, columns = np.nonzero((far <= edge[:, None]) & np.isfinite(far))
            out.append(pd.DataFrame({"query_id": own[rows], "id": ids[columns], "distance": far[rows, columns]}))
        return pd.concat(out)

    found = left.groupBy("qb", "sb").cogroup(right.groupBy("qb", "sb")).applyInPandas(nearest, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def unified(books: DataFrame, papers: DataFrame, k: int, id_column: str = "vec_id") -> DataFrame:
    """The k nearest of two stores' hits; books come first at equal distance."""
    both = books.withColumn("kind", F.lit("book")).unionByName(papers.withColumn("kind", F.lit("paper")))
    return both.orderBy("distance", "kind", id_column).limit(k)


def all_weak(hits: DataFrame) -> DataFrame:
    """One row: the number of hits, and whether every one of them is weak."""
    return hits.agg(F.count("*").alias("hits"), F.coalesce(F.min("distance") >= WEAK, F.lit(True)).alias("all_weak"))


def rerank(hits: DataFrame, score: Column, top_k_in: int, top_k_out: int, k: int, id_column: str = "vec_id") -> DataFrame:
    recalled = hits.orderBy("distance", id_column).limit(top_k_in)
    return recalled.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), "distance", id_column).limit(min(k, top_k_out))


def lexical_score(text: Column, query: str) -> Column:
    """Share of the query's words that a text holds: the scorer used where no model can be called."""
    words = sorted({w.lower() for w in query.split()})
    own = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) / float(max(1, len(words)))


def hash_vectors(rows: DataFrame, text: str, dims: int = 64, normalise: Callable[[str], str] = str.lower) -> DataFrame:
    """rows with column embedding: signed counts of hashed words. A stand-in for an embedding service, alike everywhere.

    Each distinct word of HASHED rows is hashed once, and the counts of these rows are one sum.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + HASHED] for whole in batches for at in range(0, len(whole), HASHED)):
            split = [normalise(body or "").split() for body in batch[text]]
            words = [w for own in split for w in own]
            hashes = {w: zlib.crc32(w.encode()) for w in set(words)}
            each = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
            row = np.repeat(np.arange(len(split)), [len(own) for own in split])
            counts = np.bincount(row * dims + each % dims, np.where(each >> 31, 1.0, -1.0), len(split) * dims)
            yield batch.assign(embedding=list(counts.reshape(-1, dims).astype(np.float32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(of, f"{fields}, embedding array<float>")


def train_cells(store: DataFrame, rows: int, cells: int = 64, seed: int = 1, column: str = "embedding") -> np.ndarray:
    """Centroids of at most one cell for each 256 rows, learned on a bounded sample of unit vectors."""
    count = max(1, min(cells, rows // 256))
    sample = store.where(F.col(column).isNotNull()).orderBy(F.xxhash64(F.col("vec_id"), F.lit(seed))).limit(count * 256)
    x = np.array([r[0] for r in sample.select(column).collect()], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[:count].copy()
    for _ in range(10):
        near = (x @ centres.T).argmax(1)
        for c in range(count):
            if (near == c).any():
                mean = x[near == c].mean(0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def assign_cells(store: DataFrame, centres: np.ndarray, column: str = "embedding") -> DataFrame:
    """store with column cell, the nearest centroid: what an index is partitioned by."""
    scores = F.array(*[F.struct(dot(F.col(column), F.array(*map(F.lit, c.tolist()))).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(centres)])
    return store.withColumn("cell", -F.array_max(scores)["i"])


def probe(indexed: DataFrame, centres: np.ndarray, vector: list[float], k: int, probes: int, **names) -> DataFrame:
    """top_k over the cells nearest to the query; the filter on cell prunes a table that is partitioned by it."""
    near = np.argsort(-(centres @ np.asarray(vector)), kind="stable")[:probes]
    return top_k(indexed, vector, k, where=F.col("cell").isin([int(c) for c in near]), **names)

"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt to blocks. For each pair of blocks a task sorts every
dimension of its candidates once and answers its queries one by one: it reads the lists
in steps, from the end that the query's sign favours, scores every row it meets for the
first time in full, and stops when the sum of the last values read in all lists, the most
that an unseen row could score, is below the kth score so far. The k best of each block
are then merged; k rows for each query and candidate block are all that is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(vectors: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, dims, x): floor(scale * component) of vectors without null or non-finite parts."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & F.col(id_column).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.size(x).alias("dims"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"),
    )


class Lists:
    """Candidates of one block with their per-dimension sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order, axis=0)
        # sums below 2**53 are exact in doubles, whose products are much faster
        most = float(np.abs(self.rows).max(initial=0))
        self.limit = 2.0**53 / max(1.0, most * max(1, self.rows.shape[1]))
        self.exact = self.rows.astype(np.float64)

    def best(self, own: int, query: np.ndarray, k: int, first: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows but own (ties to smaller ids), and the rows scored."""
        n = len(self.ids)
        fast = float(np.abs(query).max(initial=0)) < self.limit
        rows, q = (self.exact, query.astype(np.float64)) if fast else (self.rows, query)
        seen = np.zeros(n, bool)
        kept, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        up = np.flatnonzero(query > 0)
        down = np.flatnonzero(query < 0)
        depth, step = 0, first
        while depth < n:
            upto = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.order[n - upto : n - depth, up].ravel()] = True
            new[self.order[depth:upto, down].ravel()] = True
            if not len(up) and not len(down):
                new[:] = True
                upto = n
            new &= ~seen
            seen |= new
            fresh = np.flatnonzero(new)
            found = rows[fresh] @ q
            other = self.ids[fresh] != own
            kept, scores = np.r_[kept, fresh[other]], np.r_[scores, found[other]]
            if len(kept) > k:
                top = np.lexsort((kept, -scores))[:k]
                kept, scores = kept[top], scores[top]
            bound = self.values[n - upto, up] @ query[up] + self.values[upto - 1, down] @ query[down]
            # a row not seen could tie at the bound with a smaller id, so the bound must be below
            if len(kept) == k and bound < scores.min():
                break
            depth, step = upto, 2 * step
        top = np.lexsort((kept, -scores))[:k]
        return self.ids[kept[top]], scores[top].astype(np.int64), int(seen.sum())


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector: str = "embedding",
    candidate_block: int = 8192,
    query_block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products for each query.

    Components are floor(scale * x). Queries are the rows that satisfy is_query, on the
    column vec_id; all rows but those with the query's own id are candidates; ties go to
    the smaller id. Vectors that are null or hold null or non-finite components, and rows
    with a null id, take no part; a query is compared with vectors of its own length only.
    A repeated id is a candidate each time it occurs, but a query once: its smallest
    vector asks. Fewer candidates than k are all returned; an empty table gives no rows.
    """
    rows = quantised(vectors, id_column, vector, scale)
    asked = rows.where(is_query).groupBy("vec_id", "dims").agg(F.min("x").alias("x"))
    sizes = rows.agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("q")
    ).first()
    candidate_blocks = max(1, -(-sizes["n"] // candidate_block))
    query_blocks = max(1, -(-sizes["q"] // query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    left = (
        asked.withColumn("qb", deal(query_blocks, "q"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))))
        .groupBy("dims", "qb", "cb")
    )
    right = (
        rows.withColumn("cb", deal(candidate_blocks, "c"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        .groupBy("dims", "qb", "cb")
    )

    def answer(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            width = int(queries["dims"].iloc[0])
            stack = lambda x: np.array(x.tolist(), np.int64).reshape(len(x), width)
            lists = Lists(candidates["vec_id"].to_numpy(), stack(candidates["x"]))
            for own, query in zip(queries["vec_id"], stack(queries["x"]), strict=True):
                ids, scores, _ = lists.best(int(own), query, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = left.cogroup(right).applyInPandas(answer, "query_id long, vec_id long, score long")
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

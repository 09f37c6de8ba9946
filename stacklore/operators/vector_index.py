"""An index over vectors: cells to probe, codes to score by, and the vectors themselves to rank the best again.

Vectors are scaled to length one. A cell is the nearest of the learned centres. A code is

* ``ivf-flat``: the vector itself, in floats;
* ``ivf-sq``: a byte for each component, linear between the least and the largest of the sample;
* ``ivf-pq``: for each run of components the number of the nearest of 256 learned pieces.

A query adds up the products of its own pieces with the learned ones, one table for each
query, instead of decoding rows. The best ``refine * k`` rows by code are ranked again by
their exact distances. Codes are a table partitioned by cell, so cells that no query probes
are not read; a cell with many rows is searched in blocks by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("ivf-flat", "ivf-sq", "ivf-pq")
#: vectors that cells and pieces are learned from at most, rounds of learning, pieces of a run
SAMPLE, ROUNDS, PIECES = 16_384, 10, 256
#: rows of a cell, and queries, that one task scores; scores that it holds at once
ROW_BLOCK, QUERY_BLOCK, SCORES = 16_384, 4096, 1 << 20


@dataclass(frozen=True)
class Index:
    """What a query needs besides the tables: all of it small, of a size that does not grow with the rows."""

    kind: str
    centres: np.ndarray
    pieces: np.ndarray | None = None  # (runs, PIECES, width)
    low: float = 0.0
    high: float = 0.0
    probes: int = 1
    refine: int = 5

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centres.T).argmax(1)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        if self.kind == "ivf-flat":
            return np.ascontiguousarray(unit, "<f4").view(np.uint8).reshape(len(unit), -1)
        if self.kind == "ivf-sq":
            step = max(self.high - self.low, 1e-12) / 255
            return np.clip(np.rint((unit - self.low) / step), 0, 255).astype(np.uint8)
        runs, _, width = self.pieces.shape
        split = unit.reshape(len(unit), runs, width)
        return np.stack([_nearest(split[:, r], self.pieces[r]) for r in range(runs)], axis=1).astype(np.uint8)

    def products(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, rows): inner products as far as the codes tell them."""
        if self.kind == "ivf-flat":
            return queries @ np.ascontiguousarray(codes).view("<f4").astype(np.float64).T
        if self.kind == "ivf-sq":
            step = max(self.high - self.low, 1e-12) / 255
            return step * (queries @ codes.astype(np.float64).T) + self.low * queries.sum(1)[:, None]
        runs, _, width = self.pieces.shape
        out = np.zeros((len(queries), len(codes)))
        for r in range(runs):
            out += (queries[:, r * width : (r + 1) * width] @ self.pieces[r].T)[:, codes[:, r]]
        return out


def unit_rows(x: pd.Series | np.ndarray, dims: int) -> np.ndarray:
    rows = np.array(x.tolist() if isinstance(x, pd.Series) else x, np.float64).reshape(-1, dims)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def _means(x: np.ndarray, count: int) -> np.ndarray:
    """Centres of count groups of x (Lloyd's rounds from the first rows); a group that empties keeps its centre."""
    centres = np.resize(x, (count, x.shape[1])).copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def whole(store: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there, finite and not zero: the others are near to nothing."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return store.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0))


def train(store: DataFrame, kind: str, id_column: str = "vec_id", column: str = "embedding", cells: int = 64, runs: int = 0, seed: int = 1) -> Index:
    """Cells (at most one for each 256 rows) and codes, learned from the SAMPLE vectors with the smallest hashes of their ids.

    Of vectors of several lengths those of the most common one are indexed.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    lengths = whole(store, column).groupBy(F.size(column).alias("dims")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "dims").first()
    if most is None:
        raise ValueError("there is no vector to learn from")
    n, rows = most["n"], whole(store, column).where(F.size(column) == most["dims"])
    drawn = rows.select(id_column, column).orderBy(F.xxhash64(F.col(id_column), F.lit(seed)), F.col(id_column)).limit(SAMPLE).collect()
    unit = unit_rows([r[column] for r in drawn], len(drawn[0][column]))
    centres = _means(unit, max(1, min(cells, n // 256)))
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    made = Index(kind, centres, low=float(unit.min()), high=float(unit.max()), probes=len(centres))
    if kind == "ivf-pq":
        runs = runs or max(1, made.dims // 4)
        if made.dims % runs:
            raise ValueError("the runs must divide the components")
        split = unit.reshape(len(unit), runs, -1)
        made = replace(made, pieces=np.stack([_means(split[:, r], PIECES) for r in range(runs)]))
    return made


def encode(store: DataFrame, index: Index, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, cell, code) of every row with a usable vector of the index's length."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = unit_rows(batch["x"], index.dims)
            yield pd.DataFrame({"id": batch["id"], "cell": index.cells(unit), "code": [c.tobytes() for c in index.codes(unit)]})

    kind = store.schema[id_column].dataType.simpleString()
    rows = whole(store, column).where(F.size(column) == index.dims).select(F.col(id_column).alias("id"), F.col(column).alias("x"))
    return rows.mapInPandas(of, f"id {kind}, cell int, code binary")


def search(queries: DataFrame, codes: DataFrame, store: DataFrame, index: Index, k: int, id_column: str = "vec_id", column: str = "embedding", probes: int | None = None, refine: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance): for each query but itself the k nearest rows of the cells that it probes.

    queries and store hold id_column and column, codes what encode gives. Distances are exact,
    ties go to the smaller id; with every cell probed and refine * k at least the rows, so are
    the ranks. Queries without a usable vector have no rows. Where refine * k is at least the
    rows, codes choose none of the probed rows, so tasks rank these by their vectors at once,
    and only k rows of each query and block leave them.
    """
    probes, refine = min(probes or index.probes, len(index.centres)), refine or index.refine
    kept = k * refine
    sizes = {r["cell"]: r["count"] for r in codes.groupBy("cell").count().collect()}  # a row for each cell
    blocks = np.array([-(-sizes.get(c, 0) // ROW_BLOCK) for c in range(len(index.centres))])
    asked = whole(queries, column).where(F.size(column) == index.dims).select(F.col(id_column).alias("query_id"), F.col(column).alias("x"))
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.argsort(-(unit_rows(batch["x"], index.dims) @ index.centres.T), axis=1, kind="stable")[:, :probes]
            row, cell = np.arange(len(batch)).repeat(probes), near.ravel()
            row, cell, n = row.repeat(blocks[cell]), cell.repeat(blocks[cell]), blocks[cell]
            place = np.arange(len(row)) - (n.cumsum() - n).repeat(n)
            yield batch.iloc[row].assign(cell=cell, rb=place)

    kind = store.schema[id_column].dataType.simpleString()
    own = queries.schema[id_column].dataType.simpleString()
    probing = asked.mapInPandas(spread, f"query_id {own}, x array<double>, cell int, rb int")
    left = probing.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).groupBy("cell", "rb", "qb")
    n_blocks = F.array(*[F.lit(max(1, int(n))) for n in blocks])[F.col("cell")]
    vectors = store.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("y"))
    every = kept >= sum(sizes.values())
    rated = codes.drop("code").join(vectors, "id") if every else codes
    dealt = rated.withColumn("rb", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    right = dealt.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).groupBy("cell", "rb", "qb")

    def scored(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            queries, ids = unit_rows(asked["x"], index.dims), rows["id"].to_numpy()
            coded = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            step = max(1, SCORES // len(rows))
            for at in range(0, len(queries), step):
                part = slice(at, at + step)
                score = index.products(queries[part], coded)
                score[asked["query_id"].to_numpy()[part, None] == ids[None, :]] = -np.inf
                m = min(kept, len(rows))
                best = np.argpartition(-score, m - 1, axis=1)[:, :m]
                value = np.take_along_axis(score, best, axis=1)
                out.append(pd.DataFrame({"query_id": asked["query_id"].to_numpy()[part].repeat(m), "id": ids[best.ravel()], "score": value.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "id": rows["id"].iloc[:0], "score": np.zeros(0)})

    def ranked(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "id": rows["id"].iloc[:0], "distance": np.zeros(0)})]
        if len(asked) and len(rows):
            queries, ids, y, m = unit_rows(asked["x"], index.dims), rows["id"].to_numpy(), unit_rows(rows["y"], index.dims), min(k, len(rows))
            step = max(1, SCORES // len(rows))
            for at in range(0, len(queries), step):
                own = asked["query_id"].to_numpy()[at : at + step]
                far = np.round(1 - queries[at : at + step] @ y.T, 9)
                far[own[:, None] == ids[None, :]] = np.inf
                edge = np.partition(far, m - 1, axis=1)[:, m - 1]
                r, c = np.nonzero((far <= edge[:, None]) & np.isfinite(far))
                out.append(pd.DataFrame({"query_id": own[r], "id": ids[c], "distance": far[r, c]}))
        return pd.concat(out)

    order = Window.partitionBy("query_id").orderBy("distance", "id")
    if every:
        found = left.cogroup(right).applyInPandas(ranked, f"query_id {own}, id {kind}, distance double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
    rough = left.cogroup(right).applyInPandas(scored, f"query_id {own}, id {kind}, score double").where(F.col("score") > float("-inf"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rough = rough.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= kept).select("query_id", "id")
    both = rough.join(vectors, "id").join(asked.select("query_id", F.col("x").cast("array<double>").alias("x")), "query_id")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distance = 1 - (unit_rows(batch["x"], index.dims) * unit_rows(batch["y"], index.dims)).sum(1)
            yield pd.DataFrame({"query_id": batch["query_id"], "id": batch["id"], "distance": np.round(distance, 9)})

    found = both.mapInPandas(exact, f"query_id {own}, id {kind}, distance double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of exact (query_id, id) that found has too."""
    wanted = exact.select("query_id", "id")
    n = wanted.count()
    return wanted.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0


def calibrate(index: Index, codes: DataFrame, store: DataFrame, k: int = 10, least: float = 0.95, queries: int = 256, **names) -> Index:
    """index with the fewest probes, and then the smallest refine, that find least of the k nearest of some rows of store.

    The rows that ask are those with the smallest hashes of their ids; what they should find is
    an exact search of all rows. Probes grow by a quarter at a time, up to all cells.
    """
    from .search import top_k_batch

    id_column, column = names.get("id_column", "vec_id"), names.get("column", "embedding")
    usable = whole(store, column)
    drawn = usable.orderBy(F.xxhash64(F.col(id_column), F.lit(2)), F.col(id_column)).limit(queries).select(id_column, column)
    asked = store.sparkSession.createDataFrame(drawn.collect(), drawn.schema)
    exact = [tuple(r) for r in top_k_batch(asked, usable, k, id_column, column).select("query_id", "id").collect()]
    wanted = store.sparkSession.createDataFrame(exact, "query_id long, id long")
    cells = len(index.centres)
    probes, refine = max(1, cells // 8), 2
    while True:
        got = search(asked, codes, usable, index, k, probes=probes, refine=refine, **names)
        if recall(got, wanted) >= least:
            return replace(index, probes=probes, refine=refine)
        if probes == cells and refine >= 64:
            return replace(index, probes=cells, refine=refine)
        if probes == cells or refine < 8:
            refine *= 2
        else:
            probes = min(cells, probes + max(1, probes // 4))


def save(index: Index, spark: SparkSession, path: str) -> None:
    """Write the index to a table of a few rows."""
    flat = lambda x: None if x is None else x.ravel().tolist()
    shape = None if index.pieces is None else list(index.pieces.shape)
    row = (index.kind, flat(index.centres), list(index.centres.shape), flat(index.pieces), shape, index.low, index.high, index.probes, index.refine)
    kinds = "kind string, centres array<double>, cells array<int>, pieces array<double>, runs array<int>, low double, high double, probes int, refine int"
    spark.createDataFrame([row], kinds).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(path).first()
    pieces = None if r["pieces"] is None else np.array(r["pieces"]).reshape(r["runs"])
    return Index(r["kind"], np.array(r["centres"]).reshape(r["cells"]), pieces, r["low"], r["high"], r["probes"], r["refine"])


def status(store: DataFrame, codes: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row: rows with a usable vector, how many of them the index has, how many it lacks, and codes whose row is gone."""
    have = whole(store, column).select(F.col(id_column).alias("id"), F.lit(1).alias("row"))
    both = have.join(codes.select("id", F.lit(1).alias("code")), "id", "full")
    return both.agg(
        F.count("row").alias("rows"), F.count_if(F.col("row").isNotNull() & F.col("code").isNotNull()).alias("indexed"),
        F.count_if(F.col("code").isNull()).alias("unindexed"), F.count_if(F.col("row").isNull()).alias("stale"),
    )

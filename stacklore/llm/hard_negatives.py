"""Hard negatives: rows of another label that are nearly as near to an anchor as its positives.

All vectors are rotated to the principal axes of the table (about the origin, as inner
products are). A pair's product over the leading axes, give or take the product of what is
left of both vectors' lengths and a slack for rounding, bounds its score. Pairs whose bound
cannot reach an anchor's kth best, or the range that its positive asks for, are dropped
after few axes; what is left after the last step is worked out in integers. Anchors and
candidates are dealt to blocks, and only the best rows of each block are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: pairs are bounded where these shares of the squared lengths are left on later axes
LEFT = (0.05, 0.005)
#: pairs that are multiplied at once, and pairs that are bounded at once
PAIRS, BOUNDED = 1 << 16, 1 << 18


def usable(vectors: DataFrame, label: Column, id_column: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, label, dims, x): floor(scale * component) of rows with an id, a label and a vector without null or non-finite parts."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v"), F.coalesce(bad, F.lit(True)).alias("bad"))
    return rows.where("vec_id is not null and label is not null and v is not null and not bad").select(
        "vec_id", "label", F.size("v").alias("dims"), F.transform("v", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")
    )


def _stack(x: pd.Series, dims: int) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(len(x), dims)


def rotations(rows: DataFrame) -> dict[int, tuple[np.ndarray, list[int]]]:
    """For each number of dims the principal axes of all rows as columns, the longest first, and after how many of them pairs are bounded."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                x = _stack(own["x"], dims).astype(np.float64)
                sums[dims] = sums.get(dims, 0) + x.T @ x
        for dims, s in sums.items():
            yield pd.DataFrame({"dims": dims, "i": np.arange(dims), "row": list(s)})

    parts = rows.select("dims", "x").where("dims > 0").mapInPandas(of, "dims int, i int, row array<double>")
    cells = parts.select("dims", "i", F.posexplode("row").alias("j", "v")).groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for dims, own in cells.groupby("dims"):
        m = np.zeros((dims, dims))
        m[own["i"], own["j"]] = own["v"]
        out[int(dims)] = axes_and_steps((m + m.T) / 2)
    return out


def axes_and_steps(moments: np.ndarray) -> tuple[np.ndarray, list[int]]:
    values, axes = np.linalg.eigh(moments)
    left = np.maximum(values, 0).cumsum()[::-1] / max(values.sum(), 1e-300)  # at i: on axis i and all later ones
    return axes[:, ::-1], sorted({int((left > share).sum()) for share in LEFT} | {len(values)})


class Rotated:
    """Vectors of a block along the axes, with the length of what is left after each step."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.ids, self.labels, self.x = ids, labels, x
        d = x.shape[1]
        self.y = x.astype(np.float64) @ axes
        squares = np.cumsum(self.y[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.steps = steps
        self.rest = [np.sqrt(squares[:, s]) if s < d else np.zeros(len(x)) for s in steps]
        self.length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        # by how much a product along computed axes may miss the exact one, for vectors of length 1
        self.slack = 16 * max(1, d) ** 2 * 2.0**-53 + 2 * np.linalg.norm(axes.T @ axes - np.eye(d))

    def part(self, own: slice) -> Rotated:
        """Some of the rows."""
        out = copy(self)
        out.ids, out.labels, out.x, out.y, out.length = (v[own] for v in (self.ids, self.labels, self.x, self.y, self.length))
        out.rest = [r[own] for r in self.rest]
        return out

    def margins(self, other: Rotated, step: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.rest[step][i] * other.rest[step][j] * (1 + 1e-9) + self.slack * self.length[i] * other.length[j]


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("nd,nd->n", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def _kth(group: np.ndarray, values: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The kth largest value of each group, -inf for groups with fewer."""
    out = np.full(groups, -np.inf)
    order = np.lexsort((-values, group))
    g = group[order]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    at = rank == k - 1
    out[g[at]] = values[order][at]
    return out


def best_in_range(a: Rotated, b: Rotated, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For each row i of a and each of its ranges r the k highest integer scores of allowed rows of b in [low, high].

    low and high have a row for each row of a and a column for each range; equal scores go
    to the smaller id. Gives i, r, rows of b, scores, and the number of pairs worked out in
    integers. Rows of a go through a few at a time, so that memory does not depend on how many pairs stay.
    """
    step, parts, pairs = max(1, BOUNDED // max(1, len(b.ids))), [], 0
    for at in range(0, len(a.ids), step):
        own = slice(at, at + step)
        i, *rest, n = _best(a.part(own), b, allowed[own], low[own], high[own], k)
        parts.append((i + at, *rest))
        pairs += n
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), pairs


def _best(a: Rotated, b: Rotated, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    ranges = low.shape[1]
    first = a.steps[0]
    partial = a.y[:, :first] @ b.y[:, :first].T
    margin = np.outer(a.rest[0], b.rest[0]) * (1 + 1e-9) + a.slack * np.outer(a.length, b.length)
    upper, lower = partial + margin, partial - margin
    near, found = allowed & (upper >= low.min(axis=1, initial=np.inf)[:, None]), [(np.zeros(0, np.int64),) * 3]
    for row in range(len(a.ids)):
        columns = np.flatnonzero(near[row])
        u, v = upper[row, columns], lower[row, columns]
        for r in range(ranges):
            lo, hi = low[row, r], high[row, r]
            stays = (u >= lo) & (v <= hi)
            sure = v[stays & (v >= lo) & (u <= hi)]
            if len(sure) >= k:
                stays &= u >= np.partition(sure, len(sure) - k)[len(sure) - k]
            j = columns[stays]
            found.append((np.full(len(j), row), np.full(len(j), r), j))
    i, r, j = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs, own = np.unique(i * len(b.ids) + j, return_inverse=True)
    pi, pj = pairs // max(1, len(b.ids)), pairs % max(1, len(b.ids))
    sums = partial[pi, pj]
    for step in range(1, len(a.steps)):
        lo_axis, hi_axis = a.steps[step - 1], a.steps[step]
        sums = sums + _products(a.y[:, lo_axis:hi_axis], b.y[:, lo_axis:hi_axis], pi, pj)
        margin = a.margins(b, step, pi, pj)
        upper, lower = (sums + margin)[own], (sums - margin)[own]
        lo, hi = low[i, r], high[i, r]
        sure = (lower >= lo) & (upper <= hi)
        group = i * ranges + r
        edge = _kth(group[sure], lower[sure], k, low.size)
        keep = (upper >= lo) & (lower <= hi) & (upper >= edge[group])
        i, r, j = i[keep], r[keep], j[keep]
        used, own = np.unique(own[keep], return_inverse=True)
        pi, pj, sums = pi[used], pj[used], sums[used]
    if len(pi) and (a.length[pi] * b.length[pj]).max() >= 2.0**62:
        raise ValueError("a score does not fit a long")
    exact = _products(a.x, b.x, pi, pj)
    scores = exact[own]
    right = (scores >= low[i, r]) & (scores <= high[i, r])
    i, r, j, scores = i[right], r[right], j[right], scores[right]
    order = np.lexsort((b.ids[j], -scores, r, i))
    i, r, j, scores = i[order], r[order], j[order], scores[order]
    group = i * ranges + r
    best = np.arange(len(group)) - np.searchsorted(group, group) < k
    return i[best], r[best], j[best], scores[best], len(pi)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector: str = "embedding",
    anchor_block: int = 512,
    candidate_block: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that satisfy is_anchor, on the column vec_id. An anchor's positives
    are the best other rows of its label; for each of them come the best rows of other labels
    with least to most hundredths of the positive's score. Scores are integer products of
    floor(scale * component); ties go to the smaller id. Rows with a null id or label, or a
    vector that is null or holds null or non-finite components, take no part, and vectors are
    compared with those of their own length. Of rows with an equal id the one with the smallest
    (label, vector) is an anchor, once; each of them is a candidate for others. Fewer rows than
    asked for are all returned; an anchor without positives or negatives gives no rows, nor does
    an empty table. Other columns play no part.
    """
    rows = usable(vectors, label, id_column, vector, scale)
    axes = rotations(rows)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).first()
    c_blocks, a_blocks = max(1, -(-sizes["n"] // candidate_block)), max(1, -(-sizes["a"] // anchor_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(is_anchor).groupBy("vec_id", "dims").agg(F.min(F.struct("label", "x")).alias("m")).select("vec_id", "dims", "m.label", "m.x")
    candidates = rows.withColumn("cb", deal(c_blocks, "c")).withColumn("ab", each(a_blocks)).groupBy("dims", "ab", "cb")

    def block(part: pd.DataFrame) -> Rotated:
        dims = int(part["dims"].iloc[0])
        return Rotated(part["vec_id"].to_numpy(), part["label"].to_numpy(), _stack(part["x"], dims), *axes.get(dims, (np.zeros((0, 0)), [0])))

    def sought(anchors: DataFrame):
        return anchors.withColumn("ab", deal(a_blocks, "a")).withColumn("cb", each(c_blocks)).groupBy("dims", "ab", "cb")

    def near(anchors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(others):
            return pd.DataFrame({"anchor_id": [], "id": [], "score": []}, dtype="int64")
        a, b = block(anchors), block(others)
        allowed = (a.labels[:, None] == b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
        every = np.full((len(a.ids), 1), np.inf)
        i, _, j, scores, _ = best_in_range(a, b, allowed, -every, every, positives)
        return pd.DataFrame({"anchor_id": a.ids[i], "id": b.ids[j], "score": scores})

    found = sought(asked).cogroup(candidates).applyInPandas(near, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    own = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    own = own.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    paired = asked.join(own.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("*", F.col("p.id").alias("p_ids"), F.col("p.score").alias("p_scores"))
    paired = stored(paired.drop("p"))  # a row for each anchor, read once more

    def hard(anchors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", "positive_id", "place", "negative_id", "positive_score", "negative_score"]
        if not len(anchors) or not len(others):
            return pd.DataFrame({c: [] for c in names}, dtype="int64")
        a, b = block(anchors), block(others)
        ids, scores = np.zeros((len(a.ids), positives), np.int64), np.zeros((len(a.ids), positives), np.int64)
        low, high = np.full(scores.shape, np.inf), np.full(scores.shape, -np.inf)
        for n, (p, s) in enumerate(zip(anchors["p_ids"], anchors["p_scores"], strict=True)):
            ids[n, : len(p)], scores[n, : len(s)] = p, s
            low[n, : len(s)] = [-(-least * int(x) // 100) for x in s]
            high[n, : len(s)] = [most * int(x) // 100 for x in s]
        allowed = (a.labels[:, None] != b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
        i, r, j, own, _ = best_in_range(a, b, allowed, low, high, negatives)
        columns = (a.ids[i], ids[i, r], r, b.ids[j], scores[i, r], own)
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    kind = "anchor_id long, positive_id long, place long, negative_id long, positive_score long, negative_score long"
    got = sought(paired).cogroup(candidates).applyInPandas(hard, kind)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return got.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def sql(anchors: str = "vec_id % 50 = 0", label: str = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") -> str:
    return f"""
WITH v AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.{anchors}),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

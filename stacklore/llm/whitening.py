"""Whitening of vectors by their exact mean and a covariance that is summed in doubled precision.

The mean comes from integer sums. Centred products are split without error into a double
and what it lacks (Veltkamp, Dekker), summed as such pairs in every task, and the pairs of all
tasks are added up again, high parts and low parts. The symmetric matrix is solved by
LAPACK's syevd: reduction to a tridiagonal matrix, then divide and conquer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows whose products are summed at once, and tasks whose sums are added up in one group
ROWS, TASKS = 256, 512
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """The rounded sum and what rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b) -> Pair:
    """The rounded product and what rounding lost, exactly."""
    p = a * b
    factor = 134217729.0  # 2**27 + 1
    x, y = factor * a, factor * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two pairs, as a pair whose low part is within half a unit of the high part's last place."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiply(a: Pair, b: Pair) -> Pair:
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def total(values: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    hi, lo = values
    while len(hi) > 1:
        half = len(hi) // 2
        odd = (hi[2 * half :], lo[2 * half :])
        hi, lo = add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        if len(odd[0]):
            first = add((hi[:1], lo[:1]), odd)
            hi, lo = np.concatenate([first[0], hi[1:]]), np.concatenate([first[1], lo[1:]])
    return hi[0], lo[0]


def integers(vectors: DataFrame, id_column: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, dims, x): floor(scale * component) + offset of vectors that are whole and finite; ids as text, which pandas leaves as it is."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_column).cast("string").alias("vec_id"), F.size(x).alias("dims"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long") + offset).alias("x")
    )


def _stack(x: pd.Series, dims: int) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(len(x), dims)


@dataclass(frozen=True)
class Model:
    """What whitens vectors of one length: n of them, their sums, axes as columns and variances by falling variance."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.variances, 0) / self.trace if self.trace > 0 else np.zeros(len(self.variances))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: long where that is sure to fit, else Python's integers."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * max(1, centred.shape[1]) < 2.0**62:
            return (centred * centred).sum(1)
        sums = [sum(int(v) ** 2 for v in row) for row in centred]
        if max(sums, default=0) >= 2**63:
            raise ValueError("a deviation does not fit a long")
        return np.array(sums, np.int64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """A component without variance (but for rounding) is 0 for all rows."""
        real = self.variances > self.trace * len(self.sums) * 2.0**-52
        y = (centred / self.n).astype(np.float64)
        return np.where(real, y @ self.axes / np.sqrt(np.where(real, self.variances, 1.0)), 0.0)


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each number of dims: how many vectors, and the sum of each component."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                yield pd.DataFrame({"dims": dims, "n": len(own), "s": [_stack(own["x"], dims).sum(0)]})

    parts = rows.select("dims", "x").where("dims > 0").mapInPandas(of, "dims int, n long, s array<long>")
    cells = parts.select("dims", "n", F.posexplode("s").alias("i", "s")).groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in cells.orderBy("dims", "i").collect():  # one row for each component
        out.setdefault(r["dims"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts (keys, part, hi, lo) with the pairs of each key added up in the order of part."""

    def of(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("part")
        hi, lo = total((np.stack(own["hi"].to_list()), np.stack(own["lo"].to_list())))
        return own[[*keys, "part"]].iloc[:1].assign(part=own["part"].iloc[0] // TASKS, hi=[hi], lo=[lo])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    return parts.groupBy(*keys, F.floor(F.col("part") / TASKS).alias("_g")).applyInPandas(
        lambda key, group: of(group), ", ".join(f"{c} {kinds[c]}" for c in (*keys, "part", "hi", "lo"))
    )


def _covariances(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    means = {}
    for dims, (n, s) in sums.items():
        high = np.array([v / n for v in s])
        means[dims] = high, np.array([float(Fraction(v, n) - Fraction(h)) for v, h in zip(s, high.tolist(), strict=True)])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[Pair]] = {}
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                high, low = means[dims]
                for at in range(0, len(own), ROWS):
                    x = _stack(own["x"].iloc[at : at + ROWS], dims)
                    xh = x.astype(np.float64)
                    y = add((xh, (x - xh.astype(np.int64)).astype(np.float64)), (-high, -low))
                    new = [total(multiply((y[0][:, i : i + 1], y[1][:, i : i + 1]), (y[0][:, i:], y[1][:, i:]))) for i in range(dims)]
                    held[dims] = [add(a, b) for a, b in zip(held[dims], new, strict=True)] if dims in held else new
        part = TaskContext.get().partitionId()
        for dims, sums_ in held.items():
            yield pd.DataFrame({"dims": dims, "i": np.arange(dims), "part": part, "hi": [p[0] for p in sums_], "lo": [p[1] for p in sums_]})

    parts = rows.select("dims", "x").where("dims > 0").mapInPandas(of, "dims int, i int, part long, hi array<double>, lo array<double>")
    merged = parts
    for _ in range(3):  # TASKS ** 3 tasks are added up, at most TASKS in a group
        merged = _merged(merged, ["dims", "i"])
    out = {dims: np.zeros((dims, dims)) for dims in sums}
    for r in merged.collect():  # a row for each component
        n, (hi, lo) = float(sums[r["dims"]][0]), (np.array(r["hi"]), np.array(r["lo"]))
        quotient = hi / n
        p, e = two_product(quotient, n)
        value = quotient + ((hi - p) - e + lo) / n
        out[r["dims"]][r["i"], r["i"] :] = out[r["dims"]][r["i"] :, r["i"]] = value
    return out


def fit(rows: DataFrame, components: int) -> dict[int, Model]:
    """A model for each length of vectors in rows (vec_id, dims, x)."""
    sums, models = _sums(rows), {}
    for dims, v in _covariances(rows, sums).items():
        variances, axes = np.linalg.eigh(v)
        own = slice(None, None, -1)
        models[dims] = Model(sums[dims][0], tuple(sums[dims][1]), axes[:, own][:, :components], variances[own][:components], float(np.trace(v)))
    return models


def identity_errors(rows: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each length, the largest absolute entry of the covariance of all whitened rows minus the identity."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                w = models[dims].whiten(models[dims].centred(_stack(own["x"], dims)))
                held[dims] = held.get(dims, 0) + np.vstack([w.T @ w, w.sum(0)])
        for dims, s in held.items():
            yield pd.DataFrame({"dims": dims, "i": np.arange(len(s)), "row": list(s)})

    parts = rows.select("dims", "x").where("dims > 0").mapInPandas(of, "dims int, i int, row array<double>")
    cells = parts.select("dims", "i", F.posexplode("row").alias("j", "v")).groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for dims, own in cells.groupby("dims"):
        n, k = models[dims].n, int(own["j"].max()) + 1
        s = np.zeros((k + 1, k))
        s[own["i"], own["j"]] = own["v"]
        mean = s[k] / n
        out[int(dims)] = float(np.abs(s[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every whole vector and component.

    Vectors that are null or hold null or non-finite entries are dropped; null and repeated ids
    stay, row by row. Vectors of different lengths are whitened apart, each length by its own.
    A component whose variance is nothing but rounding has whitened 0, and identity_error says so
    by being 1. Vectors without entries have no component and so no rows, as an empty table has none.
    Other columns play no part.
    """
    rows = integers(vectors, id_column, vector, scale, offset)
    models = fit(rows, components)
    errors = identity_errors(rows, models)
    id_kind = vectors.schema[id_column].dataType

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                model = models[dims]
                centred = model.centred(_stack(own["x"], dims))
                yield pd.DataFrame({"vec_id": own["vec_id"], "dims": dims, "deviation": model.deviation(centred), "w": list(model.whiten(centred))})

    done = rows.where("dims > 0").mapInPandas(of, "vec_id string, dims int, deviation long, w array<double>")
    flat = done.select("vec_id", "dims", "deviation", F.posexplode("w").alias("_at", "whitened"))
    told = lambda d, m: flat.where(F.col("dims") == d).select(
        F.col("vec_id").cast(id_kind).alias("vec_id"), (F.col("_at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, m.explained.tolist()))[F.col("_at")].alias("explained"), F.lit(errors[d]).alias("identity_error"),
    )
    one = Model(0, (), np.zeros((0, 0)), np.zeros(1), 0.0)
    errors |= {0: 0.0}
    return reduce(DataFrame.unionByName, [told(d, m) for d, m in sorted(models.items())] or [told(0, one)])

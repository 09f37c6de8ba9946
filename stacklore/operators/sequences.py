"""Operators on ordered sequences: runs, anchors, pairs, budgets and context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with run, the number of the maximal run of equal values within key, from 0."""
    w = Window.partitionBy(key).orderBy(order)
    change = (~F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)).cast("int")
    return rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")


def anchored(rows: DataFrame, key: str, order: str, is_anchor: Column) -> DataFrame:
    """rows with entry, the number of anchors so far; 0 marks those before the first."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_a", F.coalesce(is_anchor, F.lit(False)).cast("int")).withColumn("entry", F.sum("_a").over(w)).drop("_a")


def pair_nth(rows: DataFrame, key: str, order: str, side: str, first: str, second: str, text: str) -> DataFrame:
    """(key, n, first, second, solo): the nth row of one side with the nth of the other.

    Where their numbers differ, no row of the key is paired: each comes alone, with solo true.
    """
    own = rows.where(F.col(side).isin(first, second))
    numbered = own.withColumn("n", F.row_number().over(Window.partitionBy(key, side).orderBy(order)))
    sums = own.groupBy(key).agg(F.count_if(F.col(side) == first).alias("_f"), F.count_if(F.col(side) == second).alias("_s"))
    even = numbered.join(sums, key)
    pair = even.where("_f = _s").groupBy(key, "n").agg(
        F.max(F.when(F.col(side) == first, F.col(text))).alias("first"), F.max(F.when(F.col(side) == second, F.col(text))).alias("second")
    )
    alone = even.where("_f <> _s").select(
        key, "n", F.when(F.col(side) == first, F.col(text)).alias("first"), F.when(F.col(side) == second, F.col(text)).alias("second")
    )
    return pair.withColumn("solo", F.lit(False)).unionByName(alone.withColumn("solo", F.lit(True)))


def within_budget(rows: DataFrame, key: str, order: str, size: Column, budget: int = 30_000, most: int = 2_000) -> DataFrame:
    """The first rows of each key that fit the budget, the first of them in any case, with the sum so far."""
    w = Window.partitionBy(key).orderBy(order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("so_far", total).withColumn("_n", F.row_number().over(w))
    return out.where(((F.col("so_far") <= budget) | (F.col("_n") == 1)) & (F.col("_n") <= most)).drop("_n")


def context(rows: DataFrame, anchors: DataFrame, key: str, order: str, text: str, reach: int = 5, budget: int = 30_000) -> DataFrame:
    """(key, anchor, positions): neighbours of each anchor row, taken one after and one before in turn while they fit.

    A side that does not fit, or has no more rows within reach, is closed. Neighbours are
    found by an equi-join on key and position, so an anchor brings 2 * reach + 1 rows at most.
    """
    numbered = rows.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    at = numbered.join(anchors, [key, order], "left_semi").select(key, F.col(order).alias("anchor"), F.col("_p").alias("_a"))
    near = at.select(key, "anchor", "_a", F.explode(F.sequence(F.col("_a") - reach, F.col("_a") + reach)).alias("_p"))
    near = near.join(numbered.select(key, "_p", F.col(order).alias("position"), F.char_length(text).alias("size")), [key, "_p"])
    groups = near.groupBy(key, "anchor", "_a").agg(F.array_sort(F.collect_list(F.struct("_p", "position", "size"))).alias("rows"))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, anchor, centre, near in batch.itertuples(index=False):
                by = {r["_p"]: r for r in near}
                taken, left = [centre], budget - by[centre]["size"]
                step = {1: 1, -1: 1}
                open_sides = [1, -1]
                while open_sides:
                    for side in list(open_sides):
                        row = by.get(centre + side * step[side])
                        if row is None or row["size"] > left:
                            open_sides.remove(side)
                            continue
                        taken.append(centre + side * step[side])
                        left -= row["size"]
                        step[side] += 1
                out.append((k, anchor, [by[p]["position"] for p in sorted(taken)]))
            yield pd.DataFrame(out, columns=[key, "anchor", "positions"])

    kind = rows.schema[key].dataType.simpleString()
    of = rows.schema[order].dataType.simpleString()
    return groups.mapInPandas(grow, f"`{key}` {kind}, anchor {of}, positions array<{of}>")

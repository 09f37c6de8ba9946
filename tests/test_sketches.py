"""Sketches of shelves against exact counts and ranks, and merged against whole ones."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from stacklore.operators import sketches

ROWS = "shelf string, name string, size long"


def made(spark, rows):
    return sketches.sketched(spark.createDataFrame(rows, ROWS).repartition(3), "shelf", F.col("name"), F.col("size"))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(r.choice(["a", "a", "a", "b"]), f"n{r.randrange(9000)}", int(r.lognormvariate(6, 2))) for _ in range(40_000)]


def close(row, own, ranks=(0.25, 0.5, 0.75)):
    names, sizes = {n for _, n, _ in own}, sorted(s for _, _, s in own)
    assert row.n == len(own)
    assert abs(row.distinct - len(names)) <= 1.5 * sketches.DISTINCT_ERROR * len(names)
    for rank, q in zip(ranks, row.quantiles, strict=True):
        low, high = bisect_left(sizes, q) / len(sizes), bisect_right(sizes, q) / len(sizes)
        assert low - 2 * sketches.RANK_ERROR <= rank <= high + 2 * sketches.RANK_ERROR


def test_merged_shelves_are_close_to_exact_ones(spark, rows):
    held = sketches.merged(made(spark, rows[:30_000]), made(spark, rows[30_000:]))
    for row in sketches.statistics(held).collect():
        close(row, [x for x in rows if x[0] == row.shelf])
    (row,) = sketches.statistics(sketches.whole(held)).collect()
    close(row, rows)


def test_distinct_counts_do_not_depend_on_the_way(spark, rows):
    count = lambda held: {r.shelf: r.distinct for r in sketches.statistics(held).collect()}
    assert count(sketches.merged(made(spark, rows[:100]), made(spark, rows[100:]))) == count(made(spark, rows))


def test_nulls_repeats_and_nothing(spark):
    held = made(spark, [(None, "x", 1), (None, "x", 1), ("c", None, None), ("c", None, None)])
    got = {r.shelf: (r.n, r.distinct, r.quantiles) for r in sketches.statistics(held, (0.5,)).collect()}
    assert got == {None: (2, 1, [1]), "c": (2, 0, None)}
    assert sketches.statistics(made(spark, [])).count() == 0
    again = sketches.merged(held, made(spark, []))
    assert {r.shelf: r.n for r in again.collect()} == {None: 2, "c": 2}

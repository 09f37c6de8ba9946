"""Statistics of shelves as sketches: stored for each shelf, and merged after an ingest instead of counted anew.

A shelf's row has its number of rows, a HyperLogLog sketch of what is distinct and a KLL sketch
of a number. Tasks build sketches before the shuffle, so a shelf with a third of all rows is a
few kilobytes from each of them. At the sizes here distinct counts are within 3.2 % (two standard
errors) and the rank of a quantile within 1.33 % of the rows, with 95 and 99 % of confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: logarithm of the number of HyperLogLog buckets, size of a KLL level, and the errors that follow from them
BUCKETS, LEVEL = 12, 200
DISTINCT_ERROR, RANK_ERROR = 0.032, 0.0133


def sketched(rows: DataFrame, shelf: str, distinct: Column, number: Column) -> DataFrame:
    """(shelf, n, ids, numbers): a row for each shelf. distinct is a string or a number that is no fraction.

    Nulls of distinct and number count in n alone; a null shelf is a shelf.
    """
    return rows.groupBy(F.col(shelf).alias("shelf")).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, F.lit(BUCKETS)).alias("ids"),
        F.kll_sketch_agg_bigint(number.cast("long"), F.lit(LEVEL)).alias("numbers"),
    )


def merged(held: DataFrame, new: DataFrame) -> DataFrame:
    """Sketches of shelves after new ones came; the rows that made them are not read again."""
    return held.unionByName(new).groupBy("shelf").agg(
        F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_bigint("numbers").alias("numbers")
    )


def whole(held: DataFrame) -> DataFrame:
    """The sketches of all shelves together, in one row without a shelf."""
    return merged(held.withColumn("shelf", F.lit(None).cast(held.schema["shelf"].dataType)), held.limit(0))


def statistics(held: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(shelf, n, distinct, quantiles): about how many are distinct, and about the numbers at ranks; null without numbers."""
    some = F.kll_sketch_get_n_bigint("numbers") > 0
    at = F.array(*[F.kll_sketch_get_quantile_bigint("numbers", F.lit(r)) for r in ranks])
    return held.select("shelf", "n", F.hll_sketch_estimate("ids").alias("distinct"), F.when(some, at).alias("quantiles"))

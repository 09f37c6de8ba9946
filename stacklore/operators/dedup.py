"""Equal sources, equal texts and contained passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import stored


def first_of_equal(rows: DataFrame, identity: Column, key: str = "doc_id", most_hot: int = 10_000) -> DataFrame:
    """(key, content_id, copies, first_id) of every row: the number of rows that share its content, the smallest key among them.

    The identity is worked out once and written. Contents with more than one in most_hot of
    all rows, so fewer than most_hot of them, are broadcast: their rows are not shuffled to
    meet in one task.
    """
    named = stored(rows.select(key, identity.alias("content_id")))
    groups = named.groupBy("content_id").agg(F.count("*").alias("copies"), F.min(key).alias("first_id"))
    edge = max(1000, named.count() // most_hot)
    hot = F.broadcast(groups.where(F.col("copies") > edge))
    rest = named.join(hot, "content_id", "left_anti").join(groups, "content_id")
    return named.join(hot, "content_id").unionByName(rest).select(key, "content_id", "copies", "first_id")


def passages_in(docs: DataFrame, passages: DataFrame, words: int = 8, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage word for word.

    Documents and passages meet on the hash of a passage's first words (of all, if it has
    fewer): one pass over the documents sends the hashes of all lengths that occur, and only
    the pairs that meet are compared in full. The hashes of the passages are broadcast while
    they take at most broadcast_bytes; beyond that both sides are shuffled.
    """
    tokens = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    found = passages.select("item_id", tokens(F.col("text")).alias("p")).where("size(p) > 0")
    size = F.least(F.size("p"), F.lit(words))
    heads = found.select("item_id", F.xxhash64(size, F.slice("p", F.lit(1), size)).alias("head"), size.alias("n"))
    counted = heads.groupBy("n").agg(F.count("*").alias("rows")).collect()
    small = sum(r["rows"] for r in counted) * 64 <= broadcast_bytes
    heads = heads.select("item_id", "head")

    def grams(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size("d") - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.slice("d", i, n)))
        return F.when(F.size("d") >= n, every).otherwise(F.array().cast("array<bigint>"))

    own = docs.select("doc_id", tokens(F.col("text")).alias("d"))
    sent = F.flatten(F.array(*[grams(r["n"]) for r in counted])) if counted else F.array().cast("array<bigint>")
    at = own.select("doc_id", F.explode(F.array_distinct(sent)).alias("head"))
    met = at.join(F.broadcast(heads) if small else heads, "head").select("doc_id", "item_id").distinct()
    pairs = met.join(found.select("item_id", spaced(F.col("p")).alias("passage")), "item_id")
    # the words of a document are joined again only if it met a passage
    held = F.contains(spaced(tokens(F.col("text"))), F.col("passage"))
    return pairs.join(docs.select("doc_id", "text"), "doc_id").where(held).select("doc_id", "item_id").distinct()

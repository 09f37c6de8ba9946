"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide
vector, and the fingerprint is the sum of these vectors, each lane modulo a power of two:
paragraphs can be added or taken away later by adding or subtracting vectors, and their
order does not matter. The vector of a paragraph has two parts:

* four lanes, hashes of the whole paragraph, for equality;
* a lane for the number of word pairs (each two words in a row; the line's start and end
  count as words), and 64 lanes, of which lane i counts the pairs whose hash has bit i set.
  Less half of the number of pairs, the lanes of two documents are random projections of
  their word pairs, and the cosine between them estimates the cosine of the pairs
  themselves: a likeness.

All lanes are modulo 2**32. A fingerprint holds all that is needed to compare it, to add
paragraphs to it and to take them away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

#: 32 long sums hold two lanes each: bit b and bit b + 32 of the pairs' hashes
PACKED, LOW = 32, 0xFFFFFFFF
#: lanes of a fingerprint: four for equality, the number of pairs, the counts of their bits
EQUALITY, COUNT, ALL = 4, 4, 4 + 1 + 64
EXACT = [f"e{i}" for i in range(EQUALITY)]
LANES = [f"l{i}" for i in range(PACKED)]


def vectors(versions: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """keys, copies and lanes (ALL longs below 2**32) of each distinct key.

    Equal keys must mean equal bodies; such repeats come out once, with their number in
    copies. A null body is an empty one: one empty paragraph.
    """
    lines = versions.select(
        *keys, F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n")).alias("line_at", "line")
    )
    words = F.split(F.concat(F.lit("\n "), F.col("line"), F.lit(" \n")), " +")
    pairs = lines.select(
        *keys,
        "line_at",
        F.xxhash64(F.lit(0), "line").alias("h0"),
        F.xxhash64(F.lit(1), "line").alias("h1"),
        words.alias("w"),
    ).select(
        *keys,
        "line_at",
        "h0",
        "h1",
        F.posexplode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("at", "p"),
    )
    hashed = pairs.select(*keys, "line_at", "h0", "h1", "at", F.xxhash64("p.a", "p.b").alias("h"))
    first = F.col("at") == 0
    once = lambda c: F.sum(F.when(first, c).otherwise(F.lit(0).cast("long")))
    spread = F.lit(1 | 1 << 32)
    sums = hashed.groupBy(*keys).agg(
        F.sum(F.when(first & (F.col("line_at") == 0), 1).otherwise(0)).alias("copies"),
        F.count("*").alias("n_pairs"),
        once(F.col("h0").bitwiseAND(F.lit(LOW))).alias("e0"),
        once(F.shiftrightunsigned("h0", 32)).alias("e1"),
        once(F.col("h1").bitwiseAND(F.lit(LOW))).alias("e2"),
        once(F.shiftrightunsigned("h1", 32)).alias("e3"),
        *[F.sum(F.shiftrightunsigned("h", b).bitwiseAND(spread)).alias(f"l{b}") for b in range(PACKED)],
    )
    reduced = lambda x: F.expr(f"({x} div copies) & {LOW}L")
    return sums.select(
        *keys,
        "copies",
        F.array(
            *[reduced(e) for e in EXACT],
            reduced("n_pairs"),
            *[reduced(f"({x} & {LOW}L)") for x in LANES],
            *[reduced(f"shiftrightunsigned({x}, 32)") for x in LANES],
        ).alias("lanes"),
    )


def text_form(lanes: Column) -> Column:
    """The fingerprint as hexadecimal digits, 8 for each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def parse(fingerprint: Column) -> Column:
    """The lanes of a fingerprint in its text form."""
    digits = lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(ALL - 1)), digits)


def add(fingerprint: Column, more: Column) -> Column:
    """The fingerprint of all paragraphs of two fingerprints."""
    return text_form(F.zip_with(parse(fingerprint), parse(more), lambda x, y: (x + y).bitwiseAND(F.lit(LOW))))


def remove(fingerprint: Column, less: Column) -> Column:
    """The fingerprint without the paragraphs of another, all of which it must hold."""
    return text_form(F.zip_with(parse(fingerprint), parse(less), lambda x, y: (x - y).bitwiseAND(F.lit(LOW))))


def likeness(lanes: Column, other: Column) -> Column:
    """Cosine of the centred lanes of two fingerprints (see parse), 0 where negative; equal lanes are 1."""
    centred = lambda x: F.transform(F.slice(x, COUNT + 2, ALL), lambda v: (2 * v - x[COUNT]).cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own, its = centred(lanes), centred(other)
    size = F.sqrt(dot(own, own)) * F.sqrt(dot(its, its))
    cosine = F.when(size > 0, dot(own, its) / size).otherwise(0.0)
    bits = lambda x: F.slice(x, COUNT + 1, ALL)
    return F.when(bits(lanes) == bits(other), 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def following(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, next_id) of every distinct non-null id in ascending order; the last is followed by the first.

    Ids are range partitioned, that partition is made lasting by a checkpoint, and each
    partition's last id is followed by the first of the next; the table that joins them
    has one row for each shuffle partition.
    """
    ids = docs.select(F.col(id_column).alias("doc_id")).where("doc_id is not null").distinct()
    parts = cut(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    firsts = parts.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select(
        "part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after")
    )
    ahead = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return (
        parts.withColumn("ahead", ahead)
        .join(F.broadcast(firsts), "part")
        .select("doc_id", F.coalesce("ahead", "after").alias("next_id"))
    )


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document in ascending id. A null text is empty. Every row of
    docs gives a row, repeats too. Columns that are not named are not read. Where several texts share an id, that with the
    smallest hash is the one that the preceding document sees. A null id comes out, but
    has no next document: nothing replaces its second half, and near_next is 0.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # a struct is never null itself, so both joins below read one and the same shuffle of the texts
    rows = rows.select(F.struct("doc_id").alias("key"), "body", F.xxhash64("body").alias("hash"))
    after = cut(following(docs, id_column))
    taken = F.expr("char_length(body) div 2").cast("int")
    need = (
        rows.groupBy(F.col("key.doc_id").alias("doc_id")).agg(F.max(taken).alias("need")).join(after, "doc_id")
        .select(F.struct("doc_id").alias("prev"), F.struct(F.col("next_id").alias("doc_id")).alias("key"), "need")
    )
    gift = (
        rows.join(need, "key")
        .groupBy(F.col("prev").alias("key"))
        .agg(F.min(F.struct("hash", F.expr("left(body, need)").alias("gift"))).alias("g"))
        .select("key", "g.gift")
    )
    edited = rows.join(gift, "key", "left").select(
        "key.doc_id",
        "hash",
        F.char_length("body").cast("long").alias("n_chars"),
        "body",
        F.concat(
            F.expr("left(body, char_length(body) - char_length(body) div 2)"),
            F.expr("coalesce(left(gift, cast(char_length(body) div 2 as int)), '')"),
        ).alias("edited_body"),
    )
    versions = edited.select(
        "doc_id",
        "hash",
        "n_chars",
        F.explode(
            F.array(
                F.struct(F.lit(None).cast("string").alias("edited_sha256"), F.col("body")),
                F.struct(F.sha2("edited_body", 256).alias("edited_sha256"), F.col("edited_body").alias("body")),
            )
        ).alias("v"),
    ).select("doc_id", "hash", "n_chars", "v.edited_sha256", "v.body")
    found = stored(vectors(versions, ["doc_id", "hash", "n_chars", "edited_sha256"]))
    plain = found.where("edited_sha256 is null").drop("edited_sha256")
    changed = found.where("edited_sha256 is not null").select(
        F.col("doc_id").alias("of"), F.col("hash").alias("of_hash"), "edited_sha256", F.col("lanes").alias("edited_lanes")
    )
    seen = (
        plain.groupBy("doc_id")
        .agg(F.min(F.struct("hash", F.col("lanes").alias("next_lanes"))).alias("s"))
        .select(F.col("doc_id").alias("next_id"), "s.next_lanes")
    )
    each = (
        plain.join(changed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")))
        .join(after, "doc_id", "left")
        .join(seen, "next_id", "left")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            text_form(F.col("lanes")).alias("fingerprint"),
            text_form(F.col("edited_lanes")).alias("edited_fingerprint"),
            likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
            F.coalesce(likeness(F.col("lanes"), F.col("next_lanes")), F.lit(0.0)).alias("near_next"),
            "copies",
        )
    )
    # repeated rows come back, at most 1,000 in an array at a time
    thousands = each.withColumn("at", F.explode(F.expr("sequence(0L, (copies - 1) div 1000)")))
    times = F.expr("array_repeat(0, cast(least(1000L, copies - at * 1000) as int))")
    return thousands.withColumn("one", F.explode(times)).drop("copies", "at", "one")

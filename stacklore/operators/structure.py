"""Node trees of documents: blocks and tables of contents become interval-coded nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_sha256, normalize, sentence_count
from .sinks import dealt, stored

#: ids of one document's nodes lie in [doc_id * SPACE + 1, doc_id * SPACE + SPACE - 1]
SPACE = 100_000_000
#: raw depths of contents entries that are told apart
DEPTHS = 8


def text_blocks(docs: DataFrame, level: Column) -> DataFrame:
    """One block for each line that is not blank; level (of column line) makes it a heading.

    Lines are numbered in the row that has them, so texts are not shuffled; only where ids are
    repeated are the lines of all rows of an id numbered together.
    """
    plain = lambda x: F.trim(F.replace(F.replace(x, F.lit("\u3000"), F.lit(" ")), F.lit("\t"), F.lit(" ")))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\r\n]"), lambda x, i: F.struct(i.alias("line_no"), plain(x).alias("line"))), lambda x: x["line"] != "")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = docs.select("doc_id", F.posexplode(lines).alias("block_idx", "x")).select("doc_id", "block_idx", "x.line")
    else:
        order = Window.partitionBy("doc_id").orderBy("line_no")
        rows = docs.select("doc_id", F.inline(lines)).select("doc_id", (F.row_number().over(order) - 1).alias("block_idx"), "line")
    return rows.select(
        "doc_id",
        "block_idx",
        F.when(level.isNotNull(), "heading").otherwise("body").alias("kind"),
        level.alias("level"),
        F.col("line").alias("text"),
        F.lit(0).alias("source_unit"),
    )


def contents_of(blocks: DataFrame) -> DataFrame:
    """Contents entries of heading blocks."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    return blocks.where("kind = 'heading'").select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("entry_idx"),
        F.col("text").alias("label"),
        (F.col("level") - 1).alias("depth"),
        F.col("block_idx").alias("start_block"),
    )


def owners(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """blocks with owner, the last contents entry that starts at or before the block (ties: the last entry)."""
    entries = toc.where("start_block is not null").select(
        "doc_id", F.col("start_block").alias("at"), F.lit(0).alias("is_block"), F.col("entry_idx").alias("entry"),
        F.lit(None).cast(blocks.schema["kind"].dataType).alias("kind"),
    )
    both = blocks.select("doc_id", F.col("block_idx").alias("at"), F.lit(1).alias("is_block"), F.lit(None).cast("int").alias("entry"), "kind")
    order = Window.partitionBy("doc_id").orderBy("at", "is_block", "entry").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(entries).withColumn("owner", F.last("entry", ignorenulls=True).over(order)).where("is_block = 1")
    return blocks.join(found.select("doc_id", F.col("at").alias("block_idx"), "owner"), ["doc_id", "block_idx"])


def skeleton(toc: DataFrame) -> DataFrame:
    """toc with path, the entries from the topmost down to the entry itself, as a stack of raw depths leaves them."""
    before = Window.partitionBy("doc_id").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.col("entry_idx")), ignorenulls=True).over(before) for d in range(DEPTHS)]
    out = toc.select("*", *[x.alias(f"_last{d}") for d, x in enumerate(last)])
    kept = []
    for d in range(DEPTHS):
        own, lower = F.col(f"_last{d}"), [F.coalesce(F.col(f"_last{i}"), F.lit(-1)) for i in range(d)]
        top = F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else F.lit(-1)
        kept.append(F.when((F.col("depth") > d) & own.isNotNull() & (own > top), own))
    path = F.concat(F.array_compact(F.array(*kept)), F.array("entry_idx"))
    return out.select(*toc.columns, path.alias("path"))


def _leaves(blocks: DataFrame, toc: DataFrame, orgs: DataFrame, by: Column | None = None) -> DataFrame:
    """blocks that are leaves, with owner, its path, their number in the document (doc_order) and among their owner's leaves (ordinal), and the number of entries.

    Blocks and entries go through the windows of a document as one stream, so texts are shuffled once.
    """
    kept = ("kind", "text", "source_unit")
    entries = orgs.where("doc_id is not null").select(
        "doc_id", F.col("start_block").alias("at"), F.lit(0).alias("is_block"), F.struct("entry_idx", "path").alias("entry"), normalize(F.col("label")).alias("_norm"),
        *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in kept],
    )
    # only a heading can repeat a label, so only headings are compared
    heading = F.col("kind") == "heading"
    both = entries.unionByName(
        blocks.where("doc_id is not null").select(
            "doc_id", F.col("block_idx").alias("at"), F.lit(1).alias("is_block"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"),
            normalize(F.when(heading, F.col("text"))).alias("_norm"), *kept,
        )
    )
    # all windows are dealt by documents alone; entries without a place own nothing, and are counted
    both, keys = dealt(both, by, "doc_id")
    here = Window.partitionBy(keys).orderBy("at").rangeBetween(Window.currentRow, Window.currentRow)
    so_far = Window.partitionBy(keys).orderBy("at", "is_block", "entry.entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    labels = F.collect_set(F.when((F.col("is_block") == 0) & F.col("at").isNotNull(), F.col("_norm"))).over(here)
    repeated = F.coalesce(heading & F.array_contains(labels, F.col("_norm")), F.lit(False))
    told = both.withColumn("_leaf", ((F.col("is_block") == 1) & ~repeated).cast("int"))
    told = told.withColumn("_before", F.sum("_leaf").over(so_far))
    owner = F.when((F.col("is_block") == 0) & F.col("at").isNotNull(), F.struct("entry.entry_idx", "entry.path", "_before"))
    told = told.withColumn("_owner", F.last(owner, ignorenulls=True).over(so_far))
    told = told.withColumn("entries", F.sum(1 - F.col("is_block")).over(Window.partitionBy(keys)))
    return told.where("_leaf = 1").select(
        "doc_id", F.col("at").alias("block_idx"), *kept, F.col("_owner.entry_idx").alias("owner"),
        F.coalesce("_owner.path", F.array().cast("array<int>")).alias("path"), (F.col("_before") - 1).cast("int").alias("doc_order"),
        (F.col("_before") - 1 - F.coalesce("_owner._before", F.lit(0))).cast("int").alias("ordinal"), "entries",
    )


def plan_tree(
    blocks: DataFrame, toc: DataFrame, titles: DataFrame, whole: bool = False, kept: Callable[[DataFrame], DataFrame] | None = None, by: Column | None = None
) -> DataFrame:
    """Nodes of all documents: root, one for each contents entry, and leaves in reading order.

    A heading that repeats the label of an entry that starts there is no leaf. An
    organizing node spans its descendants (toc_lo, toc_hi); its subtree_sha256 is the hash
    of their normalized hashes, its own leaves before its children. titles: doc_id, title.
    whole says that all columns will be read: the leaves, which are the dear part and are
    needed in two places, are then worked out once, into a table in a shared folder; or by kept,
    which adds rows to a table of its own and gives back all that it holds, with their columns.
    by deals out the texts by an expression that doc_id determines, so that a task has all of a
    part of whoever keeps them.
    """
    orgs = skeleton(toc)
    base = F.col("doc_id") * SPACE + 1
    null = lambda kind: F.lit(None).cast(kind)
    text, norm = F.col("text"), F.sha2(normalize(F.col("text")), 256)
    low = _leaves(blocks, toc, orgs, by).withColumn("norm_sha256", norm).select(
        "doc_id", null("int").alias("entry_idx"),
        (base + 1 + F.col("entries") + F.col("doc_order")).alias("node_id"),
        F.when(F.col("owner").isNull(), base).otherwise(base + 1 + F.col("owner")).alias("parent_id"),
        (F.size("path") + 1).alias("depth"), "ordinal",
        F.when(F.col("kind") == "heading", "heading").otherwise("paragraph").alias("node_type"), null("string").alias("title"),
        F.col("doc_order").alias("toc_lo"), F.col("doc_order").alias("toc_hi"),
        F.col("source_unit").alias("page_lo"), F.col("source_unit").alias("page_hi"), null("string").alias("subtree_sha256"),
        "text", F.char_length(text).alias("char_count"), sentence_count(text).alias("sentence_count"),
        F.substring("norm_sha256", 1, 16).alias("stable_anchor"), F.sha2(text, 256).alias("text_sha256"), "norm_sha256", "path",
    )
    names = [c for c in low.columns if c not in ("entry_idx", "path")]
    if whole:
        low = stored(low) if kept is None else kept(low)
    # a row for each entry with leaves of its own; only these go up to their ancestors, not every leaf
    own = low.groupBy("doc_id", "path").agg(
        F.min("toc_lo").alias("toc_lo"),
        F.max("toc_hi").alias("toc_hi"),
        F.min("page_lo").alias("page_lo"),
        F.max("page_hi").alias("page_hi"),
        F.array_sort(F.collect_list(F.struct("toc_lo", F.unhex("norm_sha256").alias("hash"))))["hash"].alias("hashes"),  # as bytes, half of their text
        F.count("*").alias("leaves"),
    )
    # the root has path [] and is an ancestor of every leaf
    up = own.withColumn("entry_idx", F.explode(F.concat(F.array(F.lit(-1)), "path")))
    mine = F.col("entry_idx") == F.when(F.size("path") == 0, -1).otherwise(F.try_element_at("path", F.lit(-1)))
    spans = up.groupBy("doc_id", "entry_idx").agg(
        F.min("toc_lo").alias("toc_lo"),
        F.max("toc_hi").alias("toc_hi"),
        F.min("page_lo").alias("page_lo"),
        F.max("page_hi").alias("page_hi"),
        F.array_sort(F.collect_list(F.struct("path", "hashes"))).alias("below"),
        F.sum(F.when(mine, F.col("leaves")).otherwise(0)).alias("_leaves"),
    )
    below = F.transform(F.flatten("below.hashes"), lambda x: F.lower(F.hex(x)))
    spans = spans.withColumn("subtree_sha256", F.sha2(F.array_join(below, ""), 256)).drop("below")
    root = titles.select(
        "doc_id", F.lit(-1).alias("entry_idx"), base.alias("node_id"), null("bigint").alias("parent_id"),
        F.lit(0).alias("depth"), F.lit("book").alias("node_type"), "title",
    )
    named = orgs.select(
        "doc_id", "entry_idx", (base + 1 + F.col("entry_idx")).alias("node_id"),
        F.when(F.size("path") > 1, base + 1 + F.element_at("path", -2)).otherwise(base).alias("parent_id"),
        F.size("path").alias("depth"),
        F.when(F.col("depth") == 0, "chapter").when(F.col("depth") == 1, "section").otherwise("subsection").alias("node_type"),
        F.col("label").alias("title"),
    )
    upper = root.unionByName(named).join(spans, ["doc_id", "entry_idx"], "left")
    # leaves come before organizing nodes among the children of a node: those of the parent, which is one of the rows
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    parents = upper.select("doc_id", F.col("node_id").alias("parent_id"), F.col("_leaves").alias("_first")).where("_first > 0").distinct()
    upper = upper.join(parents, ["doc_id", "parent_id"], "left")
    ordinal = F.when(F.col("parent_id").isNull(), 0).otherwise(F.coalesce("_first", F.lit(0)) + F.row_number().over(siblings) - 1).cast("int")
    upper = upper.withColumn("ordinal", ordinal).withColumns({c: null(low.schema[c].dataType) for c in ("text", "char_count", "sentence_count", "stable_anchor", "text_sha256", "norm_sha256")})
    if kept is not None:
        return kept(upper.select(names))
    return (stored(upper.select(names)) if whole else upper.select(names)).unionByName(low.select(names))


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, breadcrumb) of every leaf: titles of its ancestors from the top.

    Organizing nodes have ascending ids from the top down, so the last one of each smaller
    depth before a node is its ancestor; a leaf joins the path of its parent, by its id.
    """
    upper = nodes.where("text is null").select("doc_id", "node_id", "depth", "title")
    before = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda d: F.last(F.when(F.col("depth") == d, F.struct("title")), ignorenulls=True).over(before)["title"]
    above = [F.when(F.col("depth") > d, last(d)) for d in range(DEPTHS + 1)]
    paths = upper.select(F.col("node_id").alias("parent_id"), F.array_join(F.array(*above, "title"), " › ").alias("breadcrumb"))
    return nodes.where("text is not null").select("doc_id", "node_id", "parent_id").join(paths, "parent_id").select("doc_id", "node_id", "breadcrumb")


def toc_stats(toc: DataFrame, blocks: DataFrame) -> DataFrame:
    """Shape of each document's contents: totals, entries without a place, all at one depth, more or fewer than headings."""
    # 5 entries make a shape; a factor of 4 makes a skew.
    heads = blocks.groupBy("doc_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"))
    sums = toc.groupBy("doc_id").agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("start_block").isNull()).alias("unanchored"),
        (F.min("depth") == F.max("depth")).alias("one_depth"),
    )
    n, h = F.col("entries"), F.col("headings")
    return heads.join(sums, "doc_id", "left").select(
        "doc_id", F.coalesce(n, F.lit(0)).alias("entries"), F.coalesce("unanchored", F.lit(0)).alias("unanchored"), "headings",
        (F.coalesce(n, F.lit(0)) >= 5).__and__(F.coalesce("one_depth", F.lit(False))).alias("suspicious_flat"),
        (((F.coalesce(n, F.lit(0)) >= 5) | (h >= 5)) & ((F.coalesce(n, F.lit(0)) * 4 < h) | (h * 4 < F.coalesce(n, F.lit(0))))).alias("heading_skew"),
    )

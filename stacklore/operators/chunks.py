"""Chunks for retrieval: runs of leaves of one parent, split with an overlap."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sinks import dealt, sliced

#: version, characters of a chunk, characters that two chunks share, what joins leaves
CHUNK_VERSION, TARGET, OVERLAP, JOIN = 1, 1000, 100, "\n\n"
#: runs of leaves whose chunks a task holds at once
RUNS = 256
_LEVELS = [re.compile(p) for p in (r"\n+", r"[.!?;。！？；…]+\s*", r"\s+")]


def split_points(text: str) -> list[list[int]]:
    """Places after a line break, a sentence, a word."""
    return [[m.end() for m in level.finditer(text)] for level in _LEVELS]


def split(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most target characters, trimmed, ended at the coarsest break in their second half, else any break.

    The next span starts at a word at most overlap characters before the end of the one before.
    """
    levels, out, at, n = split_points(text), [], 0, len(text)
    while at < n:
        end = n
        if n - at > target:
            end = at + target
            for least in (at + target // 2, at + overlap + 1):
                ends = [p[i - 1] for p in levels if (i := bisect.bisect_right(p, at + target)) and p[i - 1] > least]
                if ends:
                    end = ends[0]
                    break
        a, b = at, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        if end == n:
            break
        words = levels[2]
        i = bisect.bisect_left(words, max(at + 1, end - overlap))
        at = words[i] if i < len(words) and words[i] <= end else end
    return out


def plan_chunks(nodes: DataFrame, by: Column | None = None) -> DataFrame:
    """Chunks of all documents from their prose leaves.

    Leaves in a row with one parent are joined by a blank line and split; a chunk names the
    first and last leaf that it covers with the offsets in them, and the hash of its text.
    Texts are shuffled once: a document's leaves reach one task in order, which numbers the
    chunks as they come. by: as in structure.plan_tree.
    """
    leaves, keys = dealt(nodes.where("text is not null").select("doc_id", "node_id", "parent_id", "toc_lo", "text"), by, "doc_id")
    order = Window.partitionBy(keys).orderBy("toc_lo")
    runs = leaves.withColumn("new", F.coalesce((F.lag("parent_id").over(order) != F.col("parent_id")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order)).sortWithinPartitions(*keys, "toc_lo").select("doc_id", "run", "node_id", "text")
    long, int_ = pa.int64(), pa.int32()
    kinds = {"doc_id": long, "run": long, "part": int_, "text": pa.string(), "start_node_id": long, "start_char": int_, "end_node_id": long, "end_char": int_, "chunk_idx": int_}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last, number = [], 0, None, 0
        leaves = (row for batch in sliced(batches, RUNS) for row in zip(*map(pa.Array.to_pylist, batch.columns), strict=True))
        for (doc, run), own in itertools.groupby(leaves, lambda row: row[:2]):
            _, _, ids, texts = zip(*own, strict=True)
            whole, starts, at = JOIN.join(texts), [], 0
            for text in texts:
                starts.append(at)
                at += len(text) + len(JOIN)
            last, number = doc, number if doc == last else 0
            for i, (a, b) in enumerate(split(whole)):
                first = bisect.bisect_right(starts, a) - 1
                end = bisect.bisect_right(starts, b - 1) - 1
                rows.append(
                    (doc, run, i, whole[a:b], ids[first], min(a - starts[first], len(texts[first])), ids[end], min(b - starts[end], len(texts[end])), number)
                )
                number += 1
            held += 1
            if held % RUNS == 0:
                yield _batch(rows, kinds)
                rows = []
        yield _batch(rows, kinds)

    out = runs.mapInArrow(
        of,
        "doc_id long, run long, part int, text string, start_node_id long, start_char int, end_node_id long, end_char int, chunk_idx int",
    )
    return out.withColumn("chunk_sha256", F.sha2("text", 256))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    size = F.char_length("text")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum(size).alias("chars"), F.min(size).alias("least"), F.max(size).alias("most")
    )

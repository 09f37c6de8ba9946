"""Token ids of documents in raw binary files, and a minimal perfect hash index to them.

A file (a shard) holds documents in ascending order of their ids:

* 64 bytes of text: ``TOKENIDS``, the bytes of an id (2), the documents (12), the ids (16), blanks;
* for each document 17 bytes: whether its id is known (1), its id (8), the number of its ids (8);
* the ids, little-endian and unsigned, with nothing between documents;
* a line break, since Spark's text writer writes the files, commits them and survives lost tasks.

A shard's number is that of the task that wrote it and of the file in it, so shards are in
the order of documents too. The index holds a row for each bucket of about 65,536 keys: a
minimal perfect hash of them and, by slot, a fingerprint, the shard, the place in it and the
number of ids. One bucket, one slot and one run of a file are read for a key, however many
documents there are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, shared_folder, stored
from .perfect_hash import PerfectHash, fingerprints

MAGIC, HEADER, FILES_OF_TASK = b"TOKENIDS", 64, 1_000_000
ENTRY = np.dtype([("known", "u1"), ("id", "<i8"), ("n", "<i8")])
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("n", "<i8")])
#: documents and keys that one shard and one bucket of the index hold at most
MOST_DOCUMENTS, BUCKET = 262_144, 65_536
#: words whose ids a worker keeps, and the longest word that it keeps
KEPT_WORDS, LONGEST = 300_000, 64


class Encoder(dict):
    """Ids of whole texts as ``tokenizers`` gives them, each distinct word encoded once while there is room for it.

    The vocabulary's words never reach over white space, so the ids of a text are those of
    its parts between blanks and line breaks, one after the other. The letters of a plain
    word and the marks after it are words of their own; small letters of Latin-1 need no
    normalizing, so the model itself encodes them. Texts of ASCII are made small as a whole, which the
    vocabulary does anyway, unless they could hold the name of a special token.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(model)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.letters = _Letters(self.tokenizer.model, self.code)

    def _whole(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return self._whole(word)
        plain = self._plain(word)
        found = self.letters[plain[1].lower()] + (self[plain[2]] if plain[2] else b"") if plain else self._whole(word)
        self[word] = found
        return found

    def encode_batch(self, texts: list[str], end: int) -> list[bytes]:
        for kept in (self, self.letters):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        last, out = array(self.code, [end]).tobytes(), []
        for text in texts:
            if text.isascii() and "<|" not in text:
                text = text.lower()
            out.append(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + last)
        return out


class _Letters(dict):
    """Ids of words of small letters of Latin-1."""

    # how byte-level vocabularies write a byte: as itself if it can be seen, else as the next sign from 256 on
    _written = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}

    def __init__(self, model, code: str):
        super().__init__()
        self.model, self.code = model, code

    def __missing__(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self._written)
        found = self[word] = array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()
        return found


@lru_cache(2)
def _encoder(model: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(model)


def _apart(rows: DataFrame) -> DataFrame:
    """rows with known and id in place of doc_id: pandas would make doubles of long ids among nulls."""
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), *others)


def _together(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in ("known", "id")]
    return rows.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), *others)


def write(docs: DataFrame, path: str, model: str, end: int, text: str = "text", shard_bytes: int = 8 << 20, task_bytes: int = 32 << 20) -> None:
    """Write the ids of all documents to shards of about shard_bytes below path, in ascending order of doc_id.

    Null ids come last, rows with an equal id stand together, each whole. A text that is null
    or empty has the end id alone. A document of more than shard_bytes has a shard of its own,
    whole. An empty table writes no shard; columns other than doc_id and text play no part.
    docs should be read from a table, so that a task that runs again sees its rows in the same order.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body"))
    whole = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    rows = _apart(rows).withColumn("place", F.monotonically_increasing_id())
    order = (F.col("known").desc(), F.col("id"), F.col("place"))
    laid = rows.repartitionByRange(max(1, -(-whole // task_bytes)), *order).sortWithinPartitions(*order)

    def shard(ids: list[tuple[bool, int]], bodies: list[bytes], width: int) -> bytes:
        entries = np.zeros(len(ids), ENTRY)
        entries["known"], entries["id"] = zip(*ids, strict=True)
        entries["n"] = [len(b) // width for b in bodies]
        head = b"%s%2d%12d%16d" % (MAGIC, width, len(ids), entries["n"].sum())
        return b"".join([head.ljust(HEADER), entries.tobytes(), *bodies])

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, ids, bodies, size = _encoder(model), [], [], 0
        for batch in batches:
            encoded = encoder.encode_batch(batch["body"].tolist(), end)
            for known, doc_id, body in zip(batch["known"], batch["id"], encoded, strict=True):
                if bodies and (size + len(body) > shard_bytes or len(bodies) == MOST_DOCUMENTS):
                    yield pd.DataFrame({"body": [shard(ids, bodies, encoder.width)]})
                    ids, bodies, size = [], [], 0
                ids.append((known, doc_id))
                bodies.append(body)
                size += len(body)
        if bodies:
            yield pd.DataFrame({"body": [shard(ids, bodies, encoder.width)]})

    files = laid.select("known", "id", "body").mapInPandas(shards, "body binary").select(F.col("body").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)


def _opened(path: str):
    """A file that can be read in part, wherever the task runs."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _in_parts(path: str) -> bool:
    """Whether tasks can read parts of files in such a place; else Spark reads them whole."""
    from pyarrow import ArrowInvalid, fs

    try:
        fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
    except (ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path, content) of every file; content is read only where it is asked for."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    name = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select(shard_number(F.col("path")).alias("shard"), name.alias("path"), "content")


def shard_number(path: Column) -> Column:
    """From a file's name part-<task>-<job>-c<file>.<ending>; the job's name may hold a -c and digits too."""
    part = lambda pattern: F.regexp_extract(path, pattern, 1).cast("long")
    return part(r"/part-(\d+)-[^/]*$") * FILES_OF_TASK + part(r"-c(\d+)\.[^/-]*$")


def _directory(content: bytes) -> tuple[int, int, int]:
    """Bytes of an id, documents and ids, as a header says."""
    return int(content[8:10]), int(content[10:22]), int(content[22:38])


def shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path, first, n_documents, n_tokens, entries): each shard's directory, and the number of ids in all shards before it."""
    in_parts = _in_parts(path)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if in_parts:
                    with _opened(row.path) as file:
                        _, n, tokens = _directory(file.read(HEADER))
                        entries = file.read(n * ENTRY.itemsize)
                else:
                    _, n, tokens = _directory(row.content)
                    entries = row.content[HEADER : HEADER + n * ENTRY.itemsize]
                yield pd.DataFrame({"shard": [row.shard], "path": row.path, "n_documents": n, "n_tokens": tokens, "entries": [entries]})

    files = contents(spark, path)
    rows = (files.drop("content") if in_parts else files).mapInPandas(of, "shard long, path string, n_documents long, n_tokens long, entries binary")
    rows = stored(rows.withColumn("task", F.floor(F.col("shard") / FILES_OF_TASK)))
    # a row for each task that wrote files; the sums below are of one task's files
    tasks = rows.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("shard")) - F.col("n_tokens")
    return rows.join(before, "task").select("shard", "path", (F.col("before") + own).alias("first"), "n_documents", "n_tokens", "entries")


def places(directory: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, offset, n) of every document; copy counts the documents before it that have its id."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, data in batch.itertuples(index=False):
                e = np.frombuffer(data, ENTRY)
                new = np.r_[True, (e["id"][1:] != e["id"][:-1]) | (e["known"][1:] != e["known"][:-1])]
                run = np.cumsum(new) - 1
                copy = np.arange(len(e)) - np.flatnonzero(new)[run]
                yield pd.DataFrame({
                    "known": e["known"] == 1, "id": e["id"], "copy": copy, "shard": shard, "offset": np.cumsum(e["n"]) - e["n"], "n": e["n"], "run": run, "last": run == run[-1],
                })

    kind = "known boolean, id long, copy long, shard long, offset long, n long, run long, last boolean"
    rows = _together(directory.select("shard", "entries").mapInPandas(of, kind))
    # an id goes on from shard to shard only as the last of one and the first of the next
    ends = rows.where("last or run = 0").groupBy("doc_id", "shard").agg(F.max("last").alias("last"), F.min("run").alias("run"), F.count("*").alias("copies"))
    earlier = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.withColumn("earlier", F.sum(F.when(F.col("last"), F.col("copies"))).over(earlier)).where("run = 0 and earlier > 0")
    joined = rows.join(earlier.select("shard", "run", "earlier"), ["shard", "run"], "left")
    return joined.select("doc_id", (F.col("copy") + F.coalesce("earlier", F.lit(0))).alias("copy"), "shard", "offset", "n")


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """keys (doc_id, copy and other columns) with two hashes and the bucket of the index."""
    known = F.col("doc_id").isNotNull()
    first, second = F.xxhash64(known, "doc_id", "copy"), F.xxhash64("copy", "doc_id", known, F.lit("second"))
    bucket = F.pmod(F.xxhash64("doc_id", "copy", F.lit("bucket")), F.lit(buckets))
    return keys.select("*", first.alias("h1"), second.alias("h2"), bucket.alias("bucket"))


def build_index(directory: DataFrame) -> DataFrame:
    """(bucket, buckets, n, hash, entries): the index to all documents of a directory (see shards)."""
    n = directory.agg(F.sum("n_documents")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET))

    def of(keys: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (keys[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        found = PerfectHash.build(h1, h2)
        at, entries = found.slots(h1, h2), np.zeros(len(keys), SLOT)
        entries["fingerprint"][at] = fingerprints(h1, h2)
        for c in ("shard", "offset", "n"):
            entries[c][at] = keys[c].to_numpy(np.int64)
        return pd.DataFrame({"bucket": keys["bucket"].iloc[:1], "buckets": buckets, "n": len(keys), "hash": [found.to_bytes()], "entries": [entries.tobytes()]})

    return _hashed(places(directory), buckets).groupBy("bucket").applyInPandas(of, "bucket long, buckets long, n long, hash binary, entries binary")


def locate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, offset, n) of keys (doc_id, copy); a key whose fingerprint is not in its slot has no row.

    A key that is not in the index is taken for one that is with a probability below 2**-32.
    """
    one = index.select("buckets").first()
    buckets = one["buckets"] if one else 1
    asked = _apart(_hashed(keys.select("doc_id", "copy"), buckets)).groupBy("bucket")

    def of(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = asked[["known", "id", "copy"]]
        if not len(asked) or not len(index):
            return out.iloc[:0].assign(shard=0, offset=0, n=0)
        h1, h2 = (asked[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        entries = np.frombuffer(index["entries"].iloc[0], SLOT)
        at = PerfectHash.from_bytes(index["hash"].iloc[0]).slots(h1, h2)
        own = entries[np.maximum(at, 0)]
        right = (at >= 0) & (own["fingerprint"] == fingerprints(h1, h2))
        return out.assign(shard=own["shard"], offset=own["offset"], n=own["n"])[right]

    found = asked.cogroup(index.groupBy("bucket")).applyInPandas(of, "known boolean, id long, copy long, shard long, offset long, n long")
    return _together(found)


def read(found: DataFrame, directory: DataFrame) -> DataFrame:
    """(doc_id, copy, start, n, ids) of what locate found: the ids before the document, and its own as little-endian unsigned 32-bit integers.

    A task opens a shard once and reads the runs that are asked for; where files cannot be
    read in part, Spark hands it the whole shard.
    """
    spark = found.sparkSession
    one = directory.select("path").first()
    kind = "known boolean, id long, copy long, start long, n long, ids binary"
    columns = ["known", "id", "copy", "start", "n", "ids"]
    asked = _apart(found.join(directory.select("shard", "path", "first"), "shard"))

    def runs(asked: pd.DataFrame, run) -> pd.DataFrame:
        width, n, _ = _directory(run(0, HEADER))
        at = HEADER + n * ENTRY.itemsize
        each = [np.frombuffer(run(at + o * width, n * width), f"<u{width}") for o, n in zip(asked["offset"], asked["n"], strict=True)]
        return asked.assign(start=asked["first"] + asked["offset"], ids=[x.astype("<u4").tobytes() for x in each])[columns]

    def in_parts(asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("offset")
        with _opened(asked["path"].iloc[0]) as file:
            return runs(asked, lambda at, n: file.read_at(n, at))

    def whole(asked: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(files):
            return asked.iloc[:0].assign(start=0, ids=[])[columns]
        content = files["content"].iloc[0]
        return runs(asked, lambda at, n: content[at : at + n])

    if one is None or _in_parts(one["path"]):
        return _together(asked.groupBy("shard").applyInPandas(in_parts, kind))
    files = contents(spark, one["path"].rsplit("/", 1)[0]).select("shard", "content")
    return _together(asked.groupBy("shard").cogroup(files.groupBy("shard")).applyInPandas(whole, kind))


def get(index: DataFrame, directory: DataFrame, doc_id: int | None, copy: int = 0) -> list[int] | None:
    """Ids of one document, from one bucket of the index and one run of a file; None if there is no such document."""
    spark = index.sparkSession
    key = spark.createDataFrame([(doc_id, copy)], "doc_id long, copy long")
    row = read(locate(key, index), directory).first()
    return None if row is None else np.frombuffer(row["ids"], "<u4").tolist()


def keys_of(docs: DataFrame, most: int = 65_536) -> DataFrame:
    """(doc_id, copy) of every row of docs; the copies of one id are numbered in lists of at most most, dealt out."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("copies"))
    last = F.col("copies") - 1
    lists = counts.select("doc_id", "copies", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(most).cast("long"))).alias("at"))
    return lists.repartition("doc_id", "at").select("doc_id", F.explode(F.sequence("at", F.least(F.col("at") + most - 1, last))).alias("copy"))


def round_trip(docs: DataFrame, path: str, model: str, end: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document as the files give it back, by keys and the index.

    start is the number of ids of all documents before it. Rows with an equal id, null too, come
    back one by one; see write for nulls, empty and very long texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    write(docs, path, model, end)
    directory = stored(shards(spark, path))
    index = stored(build_index(directory))
    back = read(locate(keys_of(docs), index), directory)
    return back.select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

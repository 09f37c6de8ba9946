"""Packing by lexical retrieval: neighbours of a seed document fill its window.

Documents are dealt to shards of a bounded number of bytes by their heaviest shared terms,
so that related ones meet. Each shard holds a BM25 inverted index of its own documents,
with document frequencies and the mean length of all. A window begins with a seed, the index returns the
seed's unused neighbours, best first, and they are laid end to end until the window is
full; the last is cut there, and what is left of it seeds the next window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bound_batches, stored, utf8

K1, B = 1.2, 0.75


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of a document, ascending, and how often each occurs; 16-bit ids are sorted by radix, in a third of np.unique's time."""
    ids = np.sort(ids, kind="stable")
    last = np.flatnonzero(ids[1:] != ids[:-1])
    last = np.append(last, len(ids) - 1) if len(ids) else last
    return ids[last], np.diff(last, prepend=-1)


def two_heaviest(ids: np.ndarray, rarity: np.ndarray, mean: float) -> list[int]:
    """The two terms of a document with the highest weights, ties to the smaller; -1 where there is none. rarity is negative for ids that lead nowhere."""
    term, tf = terms_of(ids)
    weight = rarity[term] * tf / (tf + K1 * (1 - B + B * len(ids) / mean))
    out = []
    for _ in range(2):
        best = int(weight.argmax()) if len(weight) else -1
        if best < 0 or weight[best] <= 0:
            out.append(-1)
            continue
        out.append(int(term[best]))
        weight[best] = -1
    return out


class Index:
    """BM25 inverted index of one shard over token ids: each term's postings, as a full row where an eighth of the documents have it.

    known is (documents, mean length, df of each id) of all shards; without it those of these documents are used.
    """

    def __init__(self, documents: list[np.ndarray], common: float = 1.0, known: tuple | None = None):
        n = len(documents)
        sizes = np.array([len(x) for x in documents], np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        whole = np.concatenate(documents).astype(np.int64)
        keys, tf = np.unique(owner << 32 | whole, return_counts=True)
        doc, term = keys >> 32, keys & 0xFFFFFFFF
        ids, term, df = np.unique(term, return_inverse=True, return_counts=True)
        whole_n, mean, whole_df = known or (n, max(1.0, sizes.mean()), None)
        rare = idf(whole_n, df if whole_df is None else whole_df[ids])
        length = K1 * (1 - B + B * sizes / mean)
        weight = rare[term] * tf * (K1 + 1) / (tf + length[doc])
        # terms in one document of the shard lead nowhere in it; common are only dropped where a caller says so
        useful = (df[term] > 1) & (df[term] <= max(2, common * n))
        self.docs, self.terms, self.weights = doc[useful], term[useful], weight[useful]
        # by document: its terms are the seed's query
        self.bounds = np.searchsorted(self.docs, np.arange(n + 1))
        # by term: postings, those of a term in many documents as a row with a place for each document
        self.row = np.full(len(df), -1)
        many = np.flatnonzero((df * 8 > n) & (df > 1) & (df <= max(2, common * n)))
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), n))
        wide = self.row[self.terms] >= 0
        self.rows[self.row[self.terms[wide]], self.docs[wide]] = self.weights[wide]
        order = np.argsort(self.terms[~wide], kind="stable")
        self.posted, self.posted_weights = self.docs[~wide][order], self.weights[~wide][order]
        self.posting = np.searchsorted(self.terms[~wide][order], np.arange(len(df) + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share one of the seed's terms, best score over all of them first, ties in order."""
        own = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        if not len(own):
            return own
        rows = self.row[own]
        narrow = own[rows < 0]
        begin, n = self.posting[narrow], np.diff(self.posting)[narrow]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        asked = np.zeros(len(self.rows))
        asked[rows[rows >= 0]] = 1
        score = asked @ self.rows + np.bincount(self.posted[at], self.posted_weights[at], len(used))
        score = np.round(score, 9)  # copies tie, in whatever order their sums were made
        found = np.flatnonzero((score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")]


def fill(documents: list[np.ndarray], window: int, known: tuple | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; only what is left at the end is not a full window.

    That rest becomes sequences whose lengths are powers of two, which need no padding.
    """
    index = Index(documents, known=known)
    used = np.zeros(len(documents), bool)
    order, following = [], 0
    filled = 0
    for_seed: np.ndarray = np.zeros(0, np.int64)
    at = 0
    while True:
        # the next document: the seed's best unused neighbour, else the first unused as a new seed
        while at < len(for_seed) and used[for_seed[at]]:
            at += 1
        if at < len(for_seed):
            doc = int(for_seed[at])
        else:
            while following < len(documents) and used[following]:
                following += 1
            if following == len(documents):
                break
            doc = following
            used[doc] = True
            for_seed, at = index.neighbours(doc, used), 0
        used[doc] = True
        order.append(doc)
        filled += len(documents[doc])
        if filled >= window:  # cut here; the document that was cut seeds the next window
            filled %= window
            for_seed, at = (index.neighbours(doc, used), 0) if filled else (np.zeros(0, np.int64), 0)
    total = int(sum(len(x) for x in documents))
    ends = list(range(window, total + 1, window))
    rest, done = total % window, total - total % window
    for power in range(window.bit_length(), -1, -1):
        if rest >> power & 1:
            done += 1 << power
            ends.append(done)
    out, position, sequence, begin = [], 0, 0, 0
    for doc in order:
        start, size = 0, len(documents[doc])
        while start < size:
            take = min(size - start, ends[sequence] - position)
            out.append((doc, start, take, sequence, position - begin))
            start += take
            position += take
            if position == ends[sequence]:
                sequence, begin = sequence + 1, position
    return out


def dealt(docs: DataFrame, end_id: int, shard_bytes: int) -> tuple[DataFrame, Broadcast]:
    """(doc_id, ids, shard) of every row, and what is counted over all of them: documents, mean length, df of each id.

    A document goes where its heaviest shared term goes. Terms with few bytes share a
    shard; one with more than shard_bytes is dealt out by the documents' second terms, and
    where these are too many as well (copies, say), by ids. Counts that go to the driver
    are one for each id of the vocabulary and one for each shard.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [np.append(tokens.encode(x.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u2").tobytes() for x in batch["body"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "size": batch["size"], "ids": ids})

    body = utf8("text")
    encoded = stored(docs.select("doc_id", F.octet_length(body).cast("long").alias("size"), body.alias("body")).mapInPandas(encode, f"doc_id {kind}, size long, ids binary"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, whole = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for x in batch["ids"]:
                x = np.frombuffer(x, "<u2")
                df[terms_of(x)[0]] += 1
                n, whole = n + 1, whole + len(x)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[at, -1, -2], "n": np.r_[df[at], n, whole]})

    counts = {r["term"]: r["n"] for r in encoded.select("ids").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, whole = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(1 << 16, np.int64)
    df[list(counts)] = list(counts.values())
    known = spark.sparkContext.broadcast((n, whole / max(1, n), df))

    def heaviest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, df = known.value
        rarity = np.where(df > 1, idf(n, df), -1.0)  # once a task, not for each document
        for batch in batches:
            first = np.array([two_heaviest(np.frombuffer(x, "<u2"), rarity, mean) for x in batch["ids"]], np.int64).reshape(-1, 2)
            yield batch.assign(t1=first[:, 0], t2=first[:, 1])

    rows = stored(encoded.mapInPandas(heaviest, f"doc_id {kind}, size long, ids binary, t1 long, t2 long"))
    sums = lambda x, key: {r[key]: r["n"] for r in x.groupBy(key).agg(F.sum(F.col("size") + 1).alias("n")).collect()}
    place, base, room = [], 0, 0
    for term, size in sorted(sums(rows, "t1").items()):
        parts = -(-size // shard_bytes)
        if parts > 1 or room + size > shard_bytes:
            base, room = base + (room > 0), 0
        place.append((term, base, parts))
        base, room = (base + parts, 0) if parts > 1 else (base, room + size)
    place = spark.createDataFrame(place, "t1 long, base long, parts long")
    rows = rows.join(F.broadcast(place), "t1").withColumn("first", F.col("base") + F.pmod(F.xxhash64("t2"), F.col("parts")))
    begins, at = [], 0
    for first, size in sorted(sums(rows, "first").items()):
        pieces = -(-size // shard_bytes) if size > 2 * shard_bytes else 1
        begins.append((first, at, pieces))
        at += pieces
    begins = spark.createDataFrame(begins, "first long, begin long, pieces long")
    shard = F.col("begin") + F.pmod(F.xxhash64("doc_id", "ids"), F.col("pieces"))
    return rows.join(F.broadcast(begins), "first").select("doc_id", "ids", shard.alias("shard")), known


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, shard_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    A document is the ids of its whole text and end_id; a null or empty text is end_id
    alone. Every id lies in one piece. Sequences are full but for the last of each shard,
    whose rest is split into powers of two. Rows with an equal id are packed as so many
    documents; null ids are kept. A very long text is one document of its shard and goes on
    over as many sequences as it fills. Neighbours with equal scores come in the order of
    their ids (null last). An empty table gives an empty result; other columns are not read,
    so their names cannot clash.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, known = dealt(docs, end_id, shard_bytes)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = rows["doc_id"].isna()
        keys = list(zip(none.tolist(), rows["doc_id"].where(~none, 0).tolist(), rows["ids"].tolist(), strict=True))
        order = sorted(range(len(rows)), key=keys.__getitem__)
        rows = rows.iloc[order]
        ids = [np.frombuffer(x, "<u2").astype(np.uint32) for x in rows["ids"]]
        pieces = fill(ids, window, known.value)
        which = [p[0] for p in pieces]
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].iloc[which].to_numpy(),
                "start": [p[1] for p in pieces],
                "length": [p[2] for p in pieces],
                "ids_crc32": [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces],
                "doc_tokens": [len(ids[d]) for d in which],
                "sequence_id": [(int(key[0]) << 32) + p[3] for p in pieces],
                "offset": [p[4] for p in pieces],
            }
        )

    return rows.groupBy("shard").applyInPandas(
        one,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )

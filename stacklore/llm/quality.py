"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of it. Learned filters slide
over the bytes of each chunk, each filter's largest answer in a chunk is kept, and the
mean and the maximum of these over the document's chunks make one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drawn, utf8

#: filters, bytes a filter sees, bytes in a chunk, bytes from one chunk to the next
FILTERS, WIDTH, CHUNK, STRIDE = 8, 6, 256, 224
#: filter weights are held in steps of 1/SCALE, so that an answer fits 16 bits
SCALE = 1000.0


def pieces(size: int) -> int:
    """Chunks that cover a text of size bytes; one for an empty text."""
    return 1 + max(0, -(-(size - CHUNK) // STRIDE))


def cut_chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, padded with zero bytes, and the row of the text of each."""
    counts = np.array([pieces(len(x)) for x in texts], np.int64)
    body = np.frombuffer(
        b"".join(x.ljust((n - 1) * STRIDE + CHUNK, b"\0") for x, n in zip(texts, counts, strict=True)), np.uint8
    )
    sizes = (counts - 1) * STRIDE + CHUNK
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(sizes) - sizes, counts) + nth * STRIDE
    return np.lib.stride_tricks.sliding_window_view(body, CHUNK)[first], owner


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    bias: float

    def __post_init__(self) -> None:
        self.pairs: list[np.ndarray] | None = None

    def tables(self) -> list[np.ndarray]:
        """For each two bytes in a row, the answers of four filters at a time as one 64-bit word."""
        if self.pairs is None:
            whole = np.clip(np.rint(self.filters * SCALE), -2500, 2500).astype(np.int16)
            self.pairs = []
            for k in range(0, WIDTH, 2):
                two = (whole[k][:, None] + whole[k + 1][None]).reshape(65536, FILTERS)
                self.pairs.append([np.ascontiguousarray(two[:, g : g + 4]).view(np.int64).ravel() for g in range(0, FILTERS, 4)])
        return self.pairs

    def answers(self, chunks: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each chunk."""
        codes = chunks[:, :-1].astype(np.uint16) << 8 | chunks[:, 1:]
        n, spots = len(chunks), CHUNK - WIDTH + 1
        best = np.empty((n, FILTERS), np.float32)
        for g in range(FILTERS // 4):
            total = None
            for k, tables in enumerate(self.tables()):
                part = tables[g].take(codes[:, 2 * k : 2 * k + spots]).view(np.int16)
                total = part if total is None else np.add(total, part, out=total)
            best[:, 4 * g : 4 * g + 4] = total.reshape(n, spots, 4).max(axis=1)
        return np.tanh(best / SCALE + self.shift)

    def score(self, texts: list[bytes], most: int = 1 << 20) -> np.ndarray:
        """Probability of label 1 of each whole text; memory follows the slice of most bytes, not the batch."""
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) + CHUNK <= most):
                size += len(texts[upto]) + CHUNK
                upto += 1
            chunks, owner = cut_chunks(texts[at:upto])
            seen = np.concatenate([self.answers(chunks[i : i + 1024]) for i in range(0, len(chunks), 1024)])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            mean = np.add.reduceat(seen, starts) / np.bincount(owner)[:, None]
            most_seen = np.maximum.reduceat(seen, starts)
            out[at:upto] = np.concatenate([mean, most_seen], 1) @ self.out + self.bias
            at = upto
        return 1 / (1 + np.exp(-out))


def train(
    documents: list[list[bytes]], labels: np.ndarray, epochs: int = 12, batch: int = 32, seed: int = 3
) -> Network:
    """Back-propagation over documents given as lists of chunks; without both labels, their share is the score."""
    random = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(
        random.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        random.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
        float(np.log(share / (1 - share))),
    )
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    values = {"filters": net.filters, "shift": net.shift, "out": net.out, "bias": np.array([net.bias], np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}
    # the rarer label weighs half as much as the other in all, so that it is learned but the scores stay near shares
    weight = np.where(labels == 1, 1.0, max(1.0, 0.5 * labels.sum() / (len(labels) - labels.sum()))).astype(np.float32)
    step, spots = 0, CHUNK - WIDTH + 1
    for epoch in range(epochs):
        order = random.permutation(len(documents))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            chunks = np.frombuffer(b"".join(c.ljust(CHUNK, b"\0") for d in some for c in documents[d]), np.uint8)
            chunks = chunks.reshape(-1, CHUNK)
            counts = np.array([len(documents[d]) for d in some])
            owner = np.repeat(np.arange(len(some)), counts)
            starts = np.cumsum(counts) - counts
            answer = values["filters"][0].take(chunks[:, :spots], axis=0)
            for k in range(1, WIDTH):
                answer += values["filters"][k].take(chunks[:, k : k + spots], axis=0)
            at = answer.argmax(axis=1)
            seen = np.tanh(np.take_along_axis(answer, at[:, None], 1)[:, 0] + values["shift"])
            mean, top = np.add.reduceat(seen, starts) / counts[:, None], np.maximum.reduceat(seen, starts)
            both = np.concatenate([mean, top], 1)
            p = 1 / (1 + np.exp(-(both @ values["out"] + values["bias"])))
            pull = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            back = pull[:, None] * values["out"]
            into = back[owner, :FILTERS] / counts[owner, None] + back[owner, FILTERS:] * (seen == top[owner])
            into = into * (1 - seen**2)
            grads = {"out": both.T @ pull, "bias": pull.sum(keepdims=True), "shift": into.sum(0)}
            g = np.zeros_like(values["filters"])
            rows, columns = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None]
            for k in range(WIDTH):
                np.add.at(g[k], (chunks[rows, at + k], np.broadcast_to(columns, at.shape)), into)
            grads["filters"] = g
            step += 1
            for name, v in values.items():
                m, s = moments[name]
                m += 0.1 * (grads[name] - m)
                s += 0.01 * (grads[name] ** 2 - s)
                rate = 0.01 * (0.3 if epoch >= epochs * 2 // 3 else 1)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    net.bias = float(values["bias"][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, documents: int = 2500, text_bytes: int = 1_000_000) -> Network:
    """Learn from a bounded sample of labelled rows that satisfy learn, each with its whole text.

    About documents rows of each label are drawn by a hash of their id, of those whose text
    has at most text_bytes; never more than twice as many, and then those with the smallest
    hashes of id and text, so the same rows however the tables are partitioned.
    """
    marked = (
        labels.where(learn & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
    )
    sizes = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1_000_000))
    rate = [int(1e6 * documents / sizes[k]) + 1 if k in sizes else 0 for k in (0, 1)]
    wanted = marked.where(draw < F.when(F.col("quality") == 1, rate[1]).otherwise(rate[0])).orderBy(draw, "doc_id").limit(4 * documents)
    found = docs.select("doc_id", utf8("text").alias("body")).where(F.octet_length("body") <= text_bytes).join(F.broadcast(wanted), "doc_id")
    rows = drawn(found.select("body", "quality", F.xxhash64("doc_id", "body").alias("draw")), F.col("draw"), 4 * documents).select("quality", "body").collect()
    taken = sorted((r["quality"], bytes(r["body"])) for r in rows)
    bodies = [[x[i * STRIDE : i * STRIDE + CHUNK] for i in range(pieces(len(x)))] for _, x in taken]
    return train(bodies, np.array([y for y, _ in taken], np.int64))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score) for every row of docs, from its whole text alone.

    Null and empty texts score as one chunk of padding; a very long text is scored in all
    its chunks, some at a time. Repeated rows are repeated in the result, null ids are
    kept, and an empty table gives an empty result. Other columns are not read, so their
    names cannot clash.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": shared.value.score(list(batch["body"]))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("body")).mapInPandas(of, f"doc_id {kind}, score double")

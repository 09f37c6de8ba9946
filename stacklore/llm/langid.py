"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier on hashed n-grams of
bytes learns each bit; a text goes to the language whose codeword has the least loss
against the classifiers' margins, each bit weighted by how well it did in training. A
second codeword almost as near flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, drawn, utf8

UNKNOWN = "und"
#: hashed n-grams that are told apart
DIMS = 4096
#: lower-case ASCII letters, all other ASCII bytes as space, bytes of other scripts as they are
_PLAIN = bytes(
    b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def features(texts: list[bytes], dims: int = DIMS, slice_bytes: int = 1 << 20) -> np.ndarray:
    """Root of the share of each hashed bigram and trigram, a row for each whole text."""
    out = np.zeros((len(texts), dims), np.float32)
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or (size + len(texts[upto]) <= slice_bytes and upto - at < 256)):
            size += len(texts[upto])
            upto += 1
        part = [b" " + b" ".join(x.translate(_PLAIN).split()) + b"  " for x in texts[at:upto]]
        codes = np.frombuffer(b"".join(part), np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(upto - at, dtype=np.uint32), [len(x) for x in part])[2:] * np.uint32(dims)
        two = codes[1:-1] * np.uint32(257) + codes[2:] * np.uint32(65537)
        grams = np.concatenate([two, codes[:-2] * np.uint32(8191) + two * np.uint32(131) + np.uint32(77)])
        grams ^= grams >> np.uint32(15)
        grams *= np.uint32(0x2C1B3C6D)
        grams >>= np.uint32(12)
        index = (grams & np.uint32(dims - 1)) + np.concatenate([row, row])
        counts = np.bincount(index, minlength=(upto - at) * dims).reshape(-1, dims)
        out[at:upto] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        at = upto
    return out


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Exhaustive code for up to five languages, else the most separated of 50 random dense codes."""
    if languages <= 1:
        return np.ones((languages, 0), np.int8)
    if languages <= 5:
        columns = [(1, *c) for c in product((1, -1), repeat=languages - 1) if -1 in c]
        return np.array(columns, np.int8).T
    length, random = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed)
    best, widest = None, -1
    for _ in range(50):
        code = random.choice(np.array([-1, 1], np.int8), (languages, length))
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(languages, dtype=int) * length
        if apart.min() > widest and (abs(code.sum(0)) < languages).all():
            best, widest = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    dims: int

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chosen language, its probability, and how much farther the next codeword is (mean loss of a bit)."""
        n, kinds = len(margins), len(self.languages)
        if kinds <= 1 or not self.code.shape[1]:
            return np.zeros(n, int), np.full(n, float(kinds)), np.full(n, np.inf)
        loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30))) @ self.trust
        two = np.partition(loss, 1, axis=1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        return loss.argmin(1), 1 / share.sum(1), (two[:, 1] - two[:, 0]) / self.trust.sum()

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.decode(features(texts, self.dims) @ self.weights + self.bias)


def train(x: np.ndarray, langs: list[str], epochs: int = 80) -> Model:
    """Fit one logistic classifier for each bit of the code to features and their languages, all at once, by Adam."""
    names = sorted(set(langs))
    code, dims = codewords(len(names)), x.shape[1]
    place = {name: i for i, name in enumerate(names)}
    which = np.array([place[y] for y in langs], int)
    aim = code[which].astype(np.float32) if names else np.zeros((0, 0), np.float32)
    # each language weighs the same, however often it was sampled
    weight = (1 / np.maximum(np.bincount(which, minlength=len(names)), 1))[which, None] / max(len(names), 1)
    w, b = np.zeros((dims, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [np.zeros_like(v) for v in (w, w, b, b)]
    for step in range(1, epochs + 1 if code.shape[1] else 1):
        pull = (-aim / (1 + np.exp(aim * (x @ w + b)))) * weight
        for i, (v, g) in enumerate(((w, x.T @ pull + 1e-5 * w), (b, pull.sum(0)))):
            m, s = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    right = ((x @ w + b) * aim > 0).mean(0) if len(x) else np.ones(code.shape[1])
    return Model(names, code, w, b, np.maximum(2 * right - 1, 0.01), dims)


def fit(docs: DataFrame, learn: Column, per_language: int = 400, texts: int = 16_000, text_bytes: int = 1_000_000) -> Model:
    """Learn from about per_language whole texts of each language, or as many as make texts in all.

    The sample is bounded: texts of at most text_bytes are drawn by a hash of id and text at a
    rate for each language, and of those the texts with the smallest hashes are taken, so the
    same ones however the table is partitioned. Tasks count their n-grams; what goes to the
    driver is a row of counts for each, and the sizes of the languages.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return train(np.zeros((0, DIMS), np.float32), [])
    each = min(per_language, max(1, texts // len(sizes)))
    rates = docs.sparkSession.createDataFrame([(k, int(1e9 * each / n) + 1) for k, n in sizes.items()], "lang string, rate long")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("langid")), F.lit(1_000_000_000))
    rows = labelled.select(utf8("text").alias("body"), "lang", draw.alias("draw")).join(F.broadcast(rates), "lang").where("draw < rate")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column("body").to_pylist())
            packed = [x.tobytes() for x in found.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], ["lang", "shares"])

    bound_batches(docs.sparkSession)
    sample = drawn(rows.select("body", "lang", "draw"), F.col("draw"), min(2 * each * len(sizes), 2 * texts)).select("body", "lang")
    found = sorted((r["lang"], bytes(r["shares"])) for r in sample.mapInArrow(count, "lang string, shares binary").collect())
    return train(np.array([np.frombuffer(x, np.float16) for _, x in found], np.float32).reshape(-1, DIMS), [x for x, _ in found])


def attach(docs: DataFrame, model: Model, gap: float = 0.15) -> DataFrame:
    """row (all of docs, as a struct), lang_pred, score and ambiguous for every row of docs.

    lang_pred is ``und`` with score 0 for a null text, one without any letter, or when no
    language was learned; score is the decoder's probability of the chosen codeword.
    ambiguous marks texts whose second codeword is within gap of the first in mean loss.
    The whole text counts, however long; repeated rows are repeated in the result, null ids
    are kept, and an empty table gives an empty result. All columns stay inside row, so
    their names cannot clash.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in batches:
            row, letters = batch.column("row"), batch.column("letters").to_numpy(zero_copy_only=False)
            texts = [x or b"" for x in row.field("text").cast(pa.binary()).to_pylist()]
            which, score, ahead = known.predict(texts)
            letters = letters & bool(known.languages)
            yield pa.RecordBatch.from_arrays(
                [
                    row,
                    pa.array(names[np.where(letters, which, len(names) - 1)], pa.string()),
                    pa.array(np.where(letters, np.clip(score, 0, 1), 0.0), pa.float64()),
                    pa.array(letters & (ahead < gap), pa.bool_()),
                ],
                ["row", "lang_pred", "score", "ambiguous"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    rows = docs.select(F.struct("*").alias("row"), letters)
    kind = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(of, kind)


def identify(docs: DataFrame, model: Model, gap: float = 0.15) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row of docs; see attach."""
    return attach(docs.select("doc_id", "text"), model, gap).select("row.doc_id", "lang_pred", "score", "ambiguous")

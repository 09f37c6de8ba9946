"""Language-model scores of documents, and a word-count baseline beside them.

Each text is split into words and subword ids once, in blocks of documents, and kept as
numbers: ids, and places in the block's own list of words. Gathered from all training texts
are the counts of words, of ids, and of pairs of an input row and the leaf that follows.
Blocks count for themselves and send packed counts to buckets (words, by their hash) or up
a tree of sums (ids and pairs, whose number is fixed). The attention network is first
trained on a bounded sample of whole texts; then blocks of all training texts (one in
one_in of them, if a caller says so) each train it further on their own, and the mean of
their weights is the model.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention, tokens
from .common import bound_batches, cut, stored, utf8, whole_bytes

IDS = 50_257 + 1  # of the tokenizer, and the end
PAIRS = attention.INPUTS * attention.BRANCHES * attention.LEAVES
SLICES = 16


def words_of(body: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII white space, and the end, which is the empty word."""
    return [*body.lower().split(), b""]


def by_bucket(words: Iterable[bytes], buckets: int) -> list[tuple[int, list[bytes]]]:
    """Buckets that have any words, and these, both in order."""
    out: dict[int, list[bytes]] = defaultdict(list)
    for w in words:
        out[zlib.crc32(w) % buckets].append(w)
    return [(bucket, sorted(out[bucket])) for bucket in sorted(out)]


def add_up(sums: DataFrame, size: Callable[[int], int], fan: int = 128) -> DataFrame:
    """Sum sparse vectors (slice, member, at, value) of each slice up a tree of at most fan members a task.

    at and value are packed uint32 places and int64 numbers; the result has one row for each slice.
    """

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(size(int(key[0])), np.int64)
        for at, value in zip(rows["at"], rows["value"], strict=True):
            np.add.at(whole, np.frombuffer(at, np.uint32), np.frombuffer(value, np.int64))
        at = np.flatnonzero(whole)
        return pd.DataFrame({"slice": [key[0]], "member": [key[1]], "at": [at.astype(np.uint32).tobytes()], "value": [whole[at].tobytes()]})

    members = (sums.agg(F.max("member")).first()[0] or 0) + 1
    while True:
        members = -(-members // fan)
        sums = (
            sums.withColumn("member", F.expr(f"member div {fan}"))
            .groupBy("slice", "member")
            .applyInPandas(add, "slice int, member long, at binary, value binary")
        )
        if members <= 1:
            return sums
        sums = cut(sums)


def _slices(codes: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Sparse counts of pairs, as slices for add_up."""
    width = PAIRS // SLICES
    cuts = np.searchsorted(codes, np.arange(SLICES + 1) * width)
    for i in range(SLICES):
        own = slice(cuts[i], cuts[i + 1])
        yield i, (codes[own] - i * width).astype(np.uint32).tobytes(), times[own].astype(np.int64).tobytes()


def _summed(sums: DataFrame, size: Callable[[int], int], slices: int = 1) -> np.ndarray:
    """The slices of add_up's result, one after the other."""
    out = np.zeros((slices, size(0)), np.int64)
    for r in add_up(sums, size).collect():
        out[r["slice"], np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["value"], np.int64)
    return out.ravel()


def _with_leaves(texts: list[np.ndarray], vocabulary: attention.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    rows, aims, _ = attention.windows(texts, vocabulary)
    return rows, np.where(aims >= 0, vocabulary.leaf[aims], -1).astype(np.int64)


def score(
    docs: DataFrame,
    learn: Column,
    block_bytes: int = 8_000_000,
    bucket_bytes: int = 16_000_000,
    sample: int = 1500,
    sample_ids: int = 4096,
    one_in: int = 1,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    learn says which rows are training texts. base_score is the log10 probability of the
    lower-cased words and the end under add-one smoothed counts, score that of the text's
    subword ids and the end under the attention model. The first training takes sample
    texts of at most sample_ids ids, those with the smallest hashes of their doc_id. Null
    texts are empty; repeated rows count and come out as often as they occur. Without
    training texts, all counts are 0.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    size = whole_bytes(docs)
    blocks, buckets = max(1, -(-size // block_bytes)), max(8, -(-size // bucket_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    # ids travel as text: a null beside them would turn a column of numbers into floats in pandas
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks))
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce(learn, F.lit(False)).alias("learn"), utf8("text").alias("body"), block.alias("block"))

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        index: dict[bytes, int] = defaultdict(count().__next__)
        spelled, texts = [], []
        for body in part["body"]:
            words = words_of(body)
            spelled.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
            texts.append(tokens.encode(body.decode("utf-8", "replace")))
        listed = by_bucket(index, buckets)
        place = np.empty(len(index), np.uint32)
        place[[index[w] for _, words in listed for w in words]] = np.arange(len(index))
        spelled = [place[x] for x in spelled]
        learned = np.flatnonzero(part["learn"])
        seen = np.bincount(np.concatenate([spelled[i] for i in learned]), minlength=len(index)) if len(learned) else np.zeros(len(index), np.int64)
        out = []
        for i, (name, own) in enumerate(zip(part["doc_id"], part["learn"], strict=True)):
            out.append(("text", 0, number, texts[i].astype(np.uint16).tobytes(), spelled[i].tobytes(), name, own))
        at = 0
        for bucket, words in listed:
            out.append(("words", bucket, number, b" ".join(words), seen[at : at + len(words)].astype(np.int64).tobytes(), None, None))
            at += len(words)
        ids = np.bincount(np.concatenate([texts[i] for i in learned]), minlength=IDS) if len(learned) else np.zeros(IDS, np.int64)
        ids[-1] = len(learned)
        at = np.flatnonzero(ids)
        out.append(("ids", 0, number, at.astype(np.uint32).tobytes(), ids[at].astype(np.int64).tobytes(), None, None))
        return pd.DataFrame(out, columns=["kind", "slice", "member", "at", "value", "doc_id", "learn"], dtype=object)

    gathered = stored(
        rows.groupBy("block").applyInPandas(
            gather, "kind string, slice int, member long, at binary, value binary, doc_id string, learn boolean"
        )
    )
    texts = gathered.where("kind = 'text'").select("doc_id", "learn", F.col("at").alias("ids"), F.col("value").alias("words"), F.col("member").alias("block"))
    learned = texts.where("learn")

    def reply(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        each = [x.split(b" ") for x in sent["at"]]
        for words, n in zip(each, sent["value"], strict=True):
            for w, c in zip(words, np.frombuffer(n, np.int64).tolist(), strict=True):
                if c:
                    total[w] += c
        packed = [np.array([total[w] for w in words], np.int64).tobytes() for words in each]
        rest = [0] * (len(each) - 1)
        return pd.DataFrame(
            {"block": sent["member"], "bucket": int(key[0]), "counts": packed, "of_all": [sum(total.values()), *rest], "distinct": [len(total), *rest]}
        )

    replies = stored(
        gathered.where("kind = 'words'")
        .groupBy("slice")
        .applyInPandas(reply, "block long, bucket int, counts binary, of_all long, distinct long")
    )
    train_tokens, distinct = (x or 0 for x in replies.agg(F.sum("of_all"), F.sum("distinct")).first())

    counts = _summed(gathered.where("kind = 'ids'").select("slice", "member", "at", "value"), lambda _: IDS)
    vocabulary = attention.Vocabulary.of(counts)
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros(PAIRS, np.int64)
        for batch in batches:
            codes, times = attention.count_pairs([np.frombuffer(x, np.uint16) for x in batch["ids"]], shared_vocabulary.value)
            pairs[codes] += times
        codes = np.flatnonzero(pairs)
        if len(codes):
            member = TaskContext.get().partitionId()
            yield pd.DataFrame([(i, member, at, value) for i, at, value in _slices(codes, pairs[codes])], columns=["slice", "member", "at", "value"])

    followed = stored(learned.select("ids").mapInPandas(follow, "slice int, member long, at binary, value binary"))
    logits = attention.pair_logits(_summed(followed, lambda _: PAIRS // SLICES, SLICES))

    short = learned.where(F.octet_length("ids") <= 2 * sample_ids)
    first = short.orderBy(F.xxhash64("doc_id", F.lit("lm")), "ids").select("ids").limit(sample).collect()
    first = [np.frombuffer(r["ids"], np.uint16) for r in first]
    weights = attention.train(attention.start(), logits, *_with_leaves(first, vocabulary), epochs=3)

    start = spark.sparkContext.broadcast((weights, logits, vocabulary))
    share = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(one_in)) == 0
    groups = max(1, blocks // one_in)

    def local(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        w, p, v = start.value
        windows, leaves = _with_leaves([np.frombuffer(x, np.uint16) for x in sorted(part["ids"])], v)
        w = attention.train(w, p, windows, leaves, rate=0.003)
        flat = np.concatenate([w[k].ravel() for k in sorted(w)])
        fixed = np.rint(flat.astype(np.float64) * (1 << 20)).astype(np.int64) * len(windows)
        value = np.append(fixed, len(windows))
        return pd.DataFrame({"slice": [0], "member": [int(key[0])], "at": [np.arange(len(value), dtype=np.uint32).tobytes()], "value": [value.tobytes()]})

    trained = stored(
        learned.where(share)
        .select("ids", F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(groups)).alias("block"))
        .groupBy("block")
        .applyInPandas(local, "slice int, member long, at binary, value binary")
    )
    length = sum(v.size for v in weights.values()) + 1
    value = _summed(trained, lambda _: length)
    if value[-1]:
        mean, at = value[:-1] / value[-1] / (1 << 20), 0
        for k in sorted(weights):
            weights[k] = mean[at : at + weights[k].size].reshape(weights[k].shape).astype(np.float32)
            at += weights[k].size
    model = spark.sparkContext.broadcast((weights, logits, vocabulary))

    def network(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = attention.Scorer(*model.value)
        for batch in batches:
            scores = scorer.score([np.frombuffer(x, np.uint16) for x in batch["ids"]])
            yield batch[["doc_id", "block", "words"]].assign(score=scores)

    def final(key: tuple, part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in known.sort_values("bucket")["counts"]])
        logs, heard = np.log10(counts + 1.0), counts > 0
        spelled = [np.frombuffer(x, np.uint32) for x in part["words"]]
        sizes = np.array([len(x) for x in spelled], np.int64)
        return pd.DataFrame(
            {
                "doc_id": part["doc_id"],
                "n_tokens": sizes,
                "n_known": [int(heard[x].sum()) for x in spelled],
                "train_tokens": train_tokens,
                "base_score": np.array([logs[x].sum() for x in spelled]) - sizes * np.log10(train_tokens + distinct + 1),
                "score": part["score"],
            }
        )

    # ids are scored where they were written; only words meet their counts
    scored = (
        texts.drop("learn")
        .mapInPandas(network, "doc_id string, block long, words binary, score double")
        .groupBy("block")
        .cogroup(replies.select("block", "bucket", "counts").groupBy("block"))
        .applyInPandas(
            final,
            "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))

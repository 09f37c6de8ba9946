"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common point at distance r or
less from both. Every distinct fingerprint therefore emits all points ("variants") of
its ball of half the linking radius, the variants meet by value, and those who share
one are verified and linked. Members of one meeting are linked to its smallest member
only: they are all within the radius of each other, so a star keeps every component.

The variants are dealt out by a syndrome: a linear XOR code of the bits, so that a task
that holds one syndrome can itself enumerate exactly the variants of a fingerprint that
belong there. What crosses the network is the packed fingerprint for each syndrome, not
each of its 2,081 variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_hot, utf8
from .components import connected_components

BITS = 64
#: bit values of each byte value, most significant first
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text; 0 if it has no words.

    A-Z are lower-cased, words are runs of anything but ASCII white space (what
    ``bytes.split`` takes), repeats count, and fewer words than a shingle make one shingle.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    each = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.bincount((each + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((counts @ _BYTE_BITS).ravel() * 2 > len(each)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; null and empty texts have 0."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch["body"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found.view(np.int64)})

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), utf8(text).alias("body")).mapInPandas(
        of, f"doc_id {kind}, fp long"
    )


def ball(radius: int) -> np.ndarray:
    """All XOR masks of at most that many bits."""
    return np.array(
        [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)], np.uint64
    )


class Syndromes:
    """A linear code that deals 64-bit points to 2**power classes."""

    def __init__(self, power: int):
        self.power = power
        labels = (np.arange(BITS, dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64((1 << power) - 1)
        self.masks = [
            np.uint64(sum(1 << i for i in range(BITS) if int(labels[i]) >> b & 1)) for b in range(power)
        ]

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for b, mask in enumerate(self.masks):
            out |= (np.bitwise_count(points & mask) & 1).astype(np.int64) << b
        return out


def meet(points: np.ndarray, here: int, code: Syndromes, masks: np.ndarray) -> np.ndarray:
    """Links (least, other) among distinct points whose variants meet at syndrome here."""
    shift = code.of(masks)
    order = np.argsort(shift, kind="stable")
    bounds = np.searchsorted(shift[order], np.arange((1 << code.power) + 1))
    need = code.of(points) ^ here
    by_need = np.argsort(need, kind="stable")
    need_bounds = np.searchsorted(need[by_need], np.arange((1 << code.power) + 1))
    variants, owners = [], []
    for t in np.unique(need):
        own = points[by_need[need_bounds[t] : need_bounds[t + 1]]]
        flips = masks[order[bounds[t] : bounds[t + 1]]]
        variants.append((own[:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(own, len(flips)))
    if not variants:
        return np.zeros((0, 2), np.uint64)
    values, owner = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(values)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.zeros((0, 2), np.uint64)
    place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
    hit = shared[place] == values
    place, owner = place[hit], owner[hit]
    order = np.lexsort((owner, place))
    place, owner = place[order], owner[order]
    first = np.r_[True, place[1:] != place[:-1]]
    least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
    return np.unique(np.stack([least, owner], 1)[least != owner], axis=0)


def links(prints: DataFrame, radius: int = 4, least_power: int = 6, task_variants: int = 16_000_000) -> DataFrame:
    """Links (u, v) among the distinct values of column fp that differ in at most radius bits.

    Components of these links are those of all pairs within the radius. The number of
    syndromes doubles as the fingerprints do, so that a task enumerates about
    task_variants of them whatever the size of the input.
    """
    distinct = prints.select("fp").where("fp is not null").distinct()
    masks = ball(radius // 2 + radius % 2)
    power, variants = least_power, distinct.count() * len(masks)
    while variants / (1 << power) > task_variants:
        power += 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Syndromes(power)
        shifts = np.unique(code.of(masks))
        everywhere = len(shifts) == 1 << power
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64).view(np.uint64)
            if everywhere:
                packed = points.tobytes()
                yield pd.DataFrame({"syndrome": np.arange(1 << power), "points": [packed] * (1 << power)})
                continue
            own = code.of(points)
            to = (own[:, None] ^ shifts[None, :]).ravel()
            order = np.argsort(to, kind="stable")
            to, dealt = to[order], np.repeat(points, len(shifts))[order]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            yield pd.DataFrame(
                {
                    "syndrome": to[cuts[:-1]],
                    "points": [dealt[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                }
            )

    def join(key: tuple, packed: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(np.frombuffer(b"".join(packed["points"]), np.uint64))
        found = meet(points, int(key[0]), Syndromes(power), masks)
        found = found[np.bitwise_count(found[:, 0] ^ found[:, 1]) <= radius]
        return pd.DataFrame(found.view(np.int64), columns=["u", "v"])

    return (
        distinct.mapInPandas(pack, "syndrome long, points binary")
        .groupBy("syndrome")
        .applyInPandas(join, "u long, v long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprints that differ in at most radius bits are linked, and component_id is the
    smallest id reachable over links, the row's own included. Null, empty and white
    texts have fingerprint zero, linked like any other. Rows repeated in docs are
    repeated in the result; an id with several texts gets a row for each. Null ids are
    kept; they name no component, so a component of null ids alone has component_id null.
    An empty table gives an empty result, and other columns of docs are not read.
    """
    bound_batches(docs.sparkSession)
    prints = cut(fingerprints(docs, id_column, text, words))
    roots = connected_components(links(prints, radius)).select(F.col("node").alias("fp"), "root")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = cut(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    component = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(join_hot(classes, component, "root").select("fp", "component_id"))
    return join_hot(prints, named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )

"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with
a smaller id. The suffixes that matter are sparse: in every window of ``length`` bytes the
least hash of its GRAM-byte grams names an anchor, at the same place in equal windows, and
only the suffixes at anchors are sorted. The steps, each over blocks of documents:

1. Blocks send buckets the hashes of their anchors, and in how many documents each occurs;
   a bucket replies, a bit for each, which occur in more than one document over all blocks.
   Only these anchors go on (an exact filter: a string in two documents has its anchor in
   both).
2. A block sorts the suffixes at its remaining anchors (the bytes from the anchor on that
   its windows take, then those before it, from right to left), keeps one of equal ones with
   the places where it occurs, and sends each bucket a sorted run, front-coded: the length
   of the prefix shared with the suffix before, and the rest.
3. A bucket merges its runs with a loser tree. Each head knows how much it shares with the
   last suffix that left the tree, so a match compares these lengths first, and bytes only
   beyond them; the run's own front coding gives the length for the next head. The shared
   lengths of neighbours also say which windows are equal, without looking at bytes again.
4. Verdicts, the places and how many bytes go before and after each, return to the block.

An anchor at the edge of a common passage has other surroundings in each document, and all
of them would gather in one bucket. The windows of an anchor that more than ``hot``
documents hold are therefore dealt out one by one, each by its own hash, so those that
differ part, and equal ones are one row for each block.

The number of blocks and buckets grows with the bytes, so what a task holds does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8, whole_bytes

GRAM = 26
_NO_ID = np.iinfo(np.int64).max
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_hashes(body: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of each gram bytes in a row (24 to 32 of them); equal for equal bytes at any place."""
    n = len(body) - gram + 1
    words = np.ndarray((len(body) - 7,), "<u8", np.ascontiguousarray(body).data, strides=(1,)).copy()
    h, first = words[:n] * _MIX[0], True
    for at, mix in ((8, _MIX[1]), (16, _MIX[2]), (gram - 8, _MIX[0])):
        part = words[at : at + n] * mix
        part ^= part >> np.uint64(29 if first else 31)
        h ^= h >> np.uint64(32)
        h += part
        first = False
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def _running(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each width values in a row, doubled."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def anchors(whole: np.ndarray, ends: np.ndarray, length: int, slice_bytes: int = 1 << 17) -> tuple[np.ndarray, ...]:
    """Hash, place and text of the anchors of texts laid end to end (each of length bytes at least), and where the first
    and the last of the windows begin that each anchor stands for.

    An anchor is the first of the least hashes (by their upper halves) in a window of one text.
    """
    total, span = int(ends[-1]) if len(ends) else 0, length - GRAM + 1
    crossing = np.zeros(total, bool)  # windows that begin in the last length - 1 bytes of a text leave it
    crossing[(ends[:, None] - np.arange(1, length)[None]).ravel()] = True
    padded = np.concatenate([whole, np.zeros(length + 8, np.uint8)])
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first in range(0, total, slice_bytes):
        low, high = max(0, first - span + 1), min(total, first + slice_bytes)
        h = gram_hashes(padded[low : high + span - 1 + GRAM - 1])
        upper = (h >> np.uint64(32)).astype(np.uint32)
        least = _running(upper, span, np.minimum)
        least[crossing[low:high]] = 0
        most = _running(np.concatenate([np.zeros(span - 1, np.uint32), least]), span, np.maximum)
        at = np.flatnonzero(upper[: high - low] == most)
        at = at[at + low >= first]
        hashes.append(h[at])
        places.append(at + low)
    hashes, at = np.concatenate(hashes), np.concatenate(places)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(at, ends), prepend=0))
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    # an anchor takes over where its smaller hash comes into the window, or where the one before it leaves
    begin = at - span + 1
    begin[1:] = np.where(upper[1:] < upper[:-1], begin[1:], np.maximum(begin[1:], at[:-1] + 1))
    begin = np.maximum(begin, np.concatenate([[0], ends])[doc])
    begin = np.minimum.accumulate(begin[::-1])[::-1]
    end = np.minimum(np.append(begin[1:] - 1, total), np.minimum(at, ends[doc] - length))
    some = begin <= end
    return hashes[some], at[some], doc[some], begin[some], end[some]


class Block:
    """The texts of one block end to end, in a lasting order."""

    def __init__(self, docs: pa.Table):
        ids = docs["doc_id"].fill_null(_NO_ID).to_numpy()
        bodies = docs["body"].to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], bodies[i]))
        self.ids = ids[self.order].astype(np.int64)
        self.bodies = [bodies[i] for i in self.order]
        self.whole = np.frombuffer(b"".join(self.bodies), np.uint8)
        self.ends = np.cumsum(np.array([len(x) for x in self.bodies], np.int64))

    def owner(self, places: np.ndarray) -> np.ndarray:
        """Ids of the documents of places; they do not fall as places rise."""
        return self.ids[np.searchsorted(self.ends, places, "right")]


class Terms:
    """The anchors of a block in the order of their hashes, and the buckets these fall in."""

    def __init__(self, block: Block, length: int, power: int):
        hashes, self.at, doc, begin, end = anchors(block.whole, block.ends, length)
        self.back, self.ahead = self.at - begin, end - self.at + length
        # anchors have the least hashes of their windows: mixed once more, they spread evenly over the buckets
        hashes = (hashes ^ hashes >> np.uint64(32)) * _MIX[1]
        hashes = (hashes ^ hashes >> np.uint64(29)) * _MIX[2]
        self.order = np.argsort(hashes, kind="stable")
        hashes = hashes[self.order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        self.which = np.cumsum(new) - 1
        owner = block.ids[doc][self.order]
        fresh = new.copy()
        fresh[1:] |= owner[1:] != owner[:-1]
        first = np.flatnonzero(new)
        self.documents = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        distinct = hashes[first]
        self.bounds = np.searchsorted(distinct >> np.uint64(64 - power), np.arange((1 << power) + 1))
        #: the 32 bits of a hash below those that name its bucket
        self.short = (distinct << np.uint64(power) >> np.uint64(32)).astype(np.uint32)


def surroundings(whole: np.ndarray, places: np.ndarray, back: np.ndarray, ahead: np.ndarray, length: int) -> np.ndarray:
    """A row for each place: the ahead bytes from it, the back bytes before it in reverse, and both numbers.

    Each part is padded with zeros, to length and to length - GRAM bytes.
    """
    before = length - GRAM
    padded = np.concatenate([np.zeros(before, np.uint8), whole, np.zeros(length, np.uint8)])
    out = np.empty((len(places), length + before + 2), np.uint8)
    out[:, :length] = np.lib.stride_tricks.sliding_window_view(padded, length)[places + before]
    out[:, :length][np.arange(length)[None] >= ahead[:, None]] = 0
    if before:
        out[:, length : length + before] = np.lib.stride_tricks.sliding_window_view(padded, before)[places][:, ::-1]
        out[:, length : length + before][np.arange(before)[None] >= back[:, None]] = 0
    out[:, -2], out[:, -1] = ahead, back
    return out


def _as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    size = -(-rows.shape[1] // 8) * 8
    words = np.zeros((len(rows), size), np.uint8)
    words[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for word in words.view("<u8").T:
        out = (out ^ (out >> np.uint64(31)) ^ word) * _MIX[0]
    return (out ^ out >> np.uint64(32)) * _MIX[1]


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows, and which of them each row is."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    # most equal rows are brought together by a hash, so that few are sorted by their bytes
    by_hash = np.argsort(_mixed(rows))
    new = np.ones(len(rows), bool)
    text = _as_strings(rows)[by_hash]
    new[1:] = text[1:] != text[:-1]
    nth = np.cumsum(new) - 1
    text = text[new]
    order = np.argsort(text, kind="stable")
    text = text[order]
    new = np.ones(len(text), bool)
    new[1:] = text[1:] != text[:-1]
    place = np.empty(len(text), np.int64)
    place[order] = np.cumsum(new) - 1
    which = np.empty(len(rows), np.int64)
    which[by_hash] = place[nth]
    return np.ascontiguousarray(text[new]).view(np.uint8).reshape(-1, rows.shape[1]), which


def front_code(rows: np.ndarray, starts: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """Shared prefix with the row before (none where a run starts), and the rest of each row, of sorted rows."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    if starts is not None:
        shared[starts[starts < len(rows)]] = 0
    return shared.tobytes(), rows[np.arange(rows.shape[1])[None] >= shared[:, None]].tobytes()


def merge_runs(runs: list[tuple[bytes, bytes]], width: int) -> tuple[list[bytes], list[int], list[list[int]]]:
    """Merge front-coded sorted runs of rows of width bytes with a loser tree.

    What a head shares with the last row that left the tree, and the byte after that, are
    one number, its code: the larger shared prefix wins, then the smaller byte. Bytes are
    only looked at where codes are equal, from the byte after them on.

    Returns the distinct rows in order, the prefix each shares with the one before, and
    for each run the place in that order of each of its rows.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    shared = [x[0] for x in runs]
    rest = [x[1] for x in runs]
    nth, offset = [0] * count, [0] * count
    heads = [b""] * size
    code = [-1] * size  # of a run that is over
    for i in range(count):
        if shared[i]:
            heads[i], offset[i] = rest[i][:width], width
            code[i] = 255 - rest[i][0]
    losers = [0] * size
    equal, number = width << 8 | 255, int.from_bytes

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads with the same code; the loser's code then tells what it shares with the winner."""
        p, q, at = heads[a], heads[b], (code[a] >> 8) + 1
        if at > width or p == q:
            code[b] = equal
            return a, b
        x, y = p[at : at + 8], q[at : at + 8]
        while x == y:
            at += 8
            x, y = p[at : at + 8], q[at : at + 8]
        at += len(x) - 1 - ((number(x) ^ number(y)).bit_length() - 1 >> 3)
        if x < y:
            code[b] = at << 8 | 255 - q[at]
            return a, b
        code[a] = at << 8 | 255 - p[at]
        return b, a

    def first(node: int) -> int:
        if node >= size:
            return node - size
        a, b = first(2 * node), first(2 * node + 1)
        if code[a] == code[b] >= 0:
            win, losers[node] = match(a, b)
        else:
            win, losers[node] = (a, b) if code[a] > code[b] else (b, a)
        return win

    out: list[bytes] = []
    common: list[int] = []
    places: list[list[int]] = [[] for _ in range(count)]
    win, last = first(1), -1
    while (own := code[win]) >= 0:
        if own != equal:
            out.append(heads[win])
            common.append(own >> 8)
            last += 1
        places[win].append(last)
        i = nth[win] = nth[win] + 1
        if i < len(shared[win]):
            s, at = shared[win][i], offset[win]
            upto = offset[win] = at + width - s
            heads[win] = heads[win][:s] + rest[win][at:upto]
            own = s << 8 | 255 - rest[win][at]
        else:
            own = -1
        code[win] = own
        node = win + size >> 1
        while node:
            other = losers[node]
            its = code[other]
            if its > own:
                losers[node], win, own = win, other, its
            elif its == own >= 0:
                win, losers[node] = match(win, other)
            node >>= 1
    return out, common, places


def judge(rows: np.ndarray, common: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows from o bytes before the anchor of each distinct row that are also in a row with a smaller least
    id, the smallest o and one more than the largest (0 and 0: none).

    common, the prefix a row shares with the one before, says which rows agree in their
    first bytes; the same is worked out once for the bytes before the anchor, and a window
    is a pair of these classes.
    """
    before = length - GRAM
    low, high = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    if not len(rows):
        return low, high
    new = common < GRAM
    new[0] = True
    group = np.cumsum(new) - 1
    where = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(where):
        return low, high
    common, own = common[where], least[where]
    right, left = rows[where, -2].astype(np.int64), rows[where, -1].astype(np.int64)
    leading = np.zeros(len(where), np.int64)
    leftward = np.arange(len(where))
    if before:
        part = rows[where, length : length + before]
        leftward = np.argsort(_as_strings(part), kind="stable")
        part = part[leftward]
        differ = part[1:] != part[:-1]
        leading[1:] = np.where(differ.any(1), differ.argmax(1), before)
    found_low, found_high = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    for o in range(before, -1, -1):
        fits = np.flatnonzero((left >= o) & (right >= length - o))
        if len(fits) < 2:
            continue
        after = np.cumsum(common < length - o)
        ahead = np.empty(len(where), np.int64)
        ahead[leftward] = np.cumsum(leading < o)
        key = after[fits] * (len(where) + 1) + ahead[fits]
        order = np.argsort(key)
        key, ids = key[order], own[fits][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        smallest = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(key))))
        hit = fits[order[smallest < ids]]
        found_low[hit] = o
        found_high[hit] = np.maximum(found_high[hit], o + 1)
    low[where], high[where] = found_low, found_high
    return low, high


def united(begin: np.ndarray, end: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans, none of which leaves its text: begins, ends and texts of the maximal ones, in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    text = np.searchsorted(ends, begin, "right")
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1 if len(first) else first
    return begin[first], end[last], text[first]


def _squeeze(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _expand(whole: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(whole)


class Parts:
    """Reads arrays one after another out of packed bytes."""

    def __init__(self, whole: bytes):
        self.whole, self.at = _expand(whole), 0

    def next(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.whole, kind, n, self.at)
        self.at += out.nbytes
        return out

    def rest(self) -> bytes:
        return self.whole[self.at :]


def _many(size: int, bytes_each: int, most_parts: int = 64, least_bytes: int = 1_000_000) -> int:
    """Parts of about bytes_each of an input of size bytes; smaller ones, if that makes fewer than most_parts."""
    return max(1, -(-size // bytes_each), min(most_parts, -(-size // least_bytes)))


def dedup(
    docs: DataFrame,
    length: int = 50,
    hot: int = 2048,
    block_bytes: int = 8_000_000,
    bucket_bytes: int = 16_000_000,
    carry: str | None = None,
    as_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs, and column carry, of any type, if named.

    Bytes covered by a string of length bytes that also starts in a document with a
    smaller id are removed; overlaps count, and strings are judged on the input. kept
    holds the remaining bytes, or with as_text the text they make without characters that
    were cut in two. Null and empty texts, and those shorter than length, keep all they
    have and meet no others. Rows with an equal id do not remove from each other; a null id
    counts as larger than all others. Very long texts are one row of a block, like any
    other. An empty table gives an empty result; columns of docs that are not named are not
    read, so their names cannot clash. length is at least GRAM.
    """
    width = 2 * length - GRAM + 2
    size = whole_bytes(docs)
    blocks = _many(size, block_bytes)
    power = max(3, (_many(size, bucket_bytes) - 1).bit_length())
    carried = F.col(carry) if carry else F.lit(None).cast("string")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", utf8("text").alias("body"), carried.alias("carry"))
    long_enough = F.octet_length("body") >= length
    rows = every.where(long_enough).select(
        "doc_id", "body", "carry", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    )

    def send_hashes(key: tuple, docs_here: pa.Table) -> pa.Table:
        terms = Terms(Block(docs_here), length, power)
        out: list[tuple] = []
        for bucket in np.flatnonzero(np.diff(terms.bounds)):
            some = slice(terms.bounds[bucket], terms.bounds[bucket + 1])
            more = np.flatnonzero(terms.documents[some] > 1)
            out.append((int(bucket), terms.short[some].tobytes(), np.stack([more, terms.documents[some][more]]).astype(np.uint32).tobytes()))
        return _table([(key[0].as_py(), *x) for x in out], "block long, bucket int, hashes binary, more binary")

    def reply(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, np.uint32) for x in sent["hashes"]]
        bounds = np.cumsum([0, *map(len, each)])
        documents = np.ones(bounds[-1], np.int64)
        for at, more in zip(bounds, sent["more"], strict=False):
            nth, n = np.frombuffer(more, np.uint32).reshape(2, -1)
            documents[at + nth] = n
        values = np.concatenate(each)
        order = np.argsort(values)
        values = values[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        total = np.add.reduceat(documents[order], first)
        kind = np.empty(len(values), np.int8)
        kind[order] = np.repeat((total > 1).astype(np.int8) + (total > hot), np.diff(np.append(first, len(values))))
        out = []
        for block, a, b in zip(sent["block"], bounds[:-1], bounds[1:], strict=True):
            if kind[a:b].any():
                out.append((int(block), int(key[0]), np.packbits(kind[a:b] > 0).tobytes(), np.packbits(kind[a:b] > 1).tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "shared", "hot"])

    def meetings(block: Block, replies: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bucket, place and surroundings of the suffixes that go on, some at a time."""
        terms = Terms(block, length, power)
        kind = np.zeros(len(terms.short), np.int8)
        for bucket, shared, busy in zip(replies["bucket"].to_pylist(), replies["shared"].to_pylist(), replies["hot"].to_pylist(), strict=True):
            a, b = terms.bounds[bucket], terms.bounds[bucket + 1]
            for bits in (shared, busy):
                kind[a:b] += np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(np.int8)
        bucket = np.repeat(np.arange(1 << power), np.diff(terms.bounds))[terms.which]
        kind = kind[terms.which]
        most = 100_000  # periodic texts have an anchor at each byte
        cold = np.flatnonzero(kind == 1)
        for i in range(0, len(cold), most):
            own = terms.order[cold[i : i + most]]
            yield bucket[cold[i : i + most]], terms.at[own], surroundings(block.whole, terms.at[own], terms.back[own], terms.ahead[own], length)
        busy = terms.order[kind == 2]
        for o in range(length - GRAM + 1):
            fits = terms.at[busy][(terms.back[busy] >= o) & (terms.ahead[busy] >= length - o)] - o
            for i in range(0, len(fits), most):
                at = fits[i : i + most]
                windows = surroundings(block.whole, at, np.zeros_like(at), np.full_like(at, length), length)
                yield (_mixed(windows[:, :length]) >> np.uint64(64 - power)).astype(np.int64), at, windows

    def send_runs(key: tuple, docs_here: pa.Table, replies: pa.Table) -> pa.Table:
        schema = "block long, bucket int, n int, run binary, found binary"
        if not len(docs_here) or not len(replies):
            return _table([], schema)
        block = Block(docs_here)
        each: list[list[np.ndarray]] = [[], [], []]
        for bucket, at, around in meetings(block, replies):
            rows, which = distinct_rows(np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), around], 1))
            for column, values in zip(each, (rows, which + sum(map(len, each[0])), at), strict=True):
                column.append(values)
        if not each[0]:
            return _table([], schema)
        del around, rows, which
        rows, which = distinct_rows(np.concatenate(each.pop(0)))
        where, places = which[np.concatenate(each[0])], np.concatenate(each[1])
        order = np.lexsort((places, where))
        where, places = where[order], places[order].astype(np.uint32)
        times = np.bincount(where, minlength=len(rows))
        begins = np.cumsum(times) - times
        least = block.owner(places[begins])
        bucket = np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(rows) else np.zeros(1, np.int64)
        shared, rest = front_code(rows[:, 4:], cuts)
        into = np.concatenate([[0], np.cumsum(width - np.frombuffer(shared, np.uint8).astype(np.int64))])
        begins = np.append(begins, len(places))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            run = _squeeze(shared[a:b], rest[into[a] : into[b]])
            found = _squeeze(least[a:b].tobytes(), times[a:b].astype(np.uint32).tobytes(), places[begins[a] : begins[b]].tobytes())
            out.append((key[0].as_py(), int(bucket[a]), int(b - a), run, found))
        return _table(out, schema)

    def merge(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        coded, found = [], []
        for n, run, of in zip(runs["n"], runs["run"], runs["found"], strict=True):
            run = _expand(run)
            coded.append((run[:n], run[n:]))
            of = Parts(of)
            found.append((of.next("<i8", n), of.next("<u4", n), np.frombuffer(of.rest(), np.uint32)))
        distinct, common, places = merge_runs(coded, width)
        lowest = np.full(len(distinct), _NO_ID)
        places = [np.array(x, np.int64) for x in places]
        for at, (ids, *_) in zip(places, found, strict=True):
            lowest[at] = np.minimum(lowest[at], ids)
        matrix = np.frombuffer(b"".join(distinct), np.uint8).reshape(-1, width)
        low, high = judge(matrix, np.array(common, np.int64), lowest, length)
        ahead, back = matrix[:, -2].astype(np.int64), matrix[:, -1].astype(np.int64)
        whole = np.stack([back, np.minimum(ahead, length)])  # bytes that go before and from a place, if all its windows do
        partly = np.where(high > 0, np.stack([high - 1, length - low]), 0)
        out = []
        for block, at, (ids, times, here) in zip(runs["block"], places, found, strict=True):
            later = lowest[at] < ids
            told = later | (high[at] > 0) | (times > 1)
            if told.any():
                at, spans = at[told], whole[:, at[told]]
                first = np.where(later[told], spans, partly[:, at])
                sent = _squeeze(np.concatenate([first, spans]).astype(np.uint8).tobytes(), times[told].astype("<u4").tobytes(), here[np.repeat(told, times)].tobytes())
                out.append((int(block), int(key[0]), len(at), sent))
        return pd.DataFrame(out, columns=["block", "bucket", "n", "spans"])

    def remove(key: tuple, docs_here: pa.Table, verdicts: pa.Table) -> pa.Table:
        block = Block(docs_here)
        spans = [(np.zeros(0, np.int64),) * 2]
        for n, sent in zip(verdicts["n"].to_pylist(), verdicts["spans"].to_pylist(), strict=True):
            sent = Parts(sent)
            first_back, first_ahead, back, ahead = sent.next("u1", 4 * n).reshape(4, n).astype(np.int64)
            times = sent.next("<u4", n).astype(np.int64)
            places = np.frombuffer(sent.rest(), "<u4").astype(np.int64)
            # the least id that this block has of a string comes first; later ones lose it for certain
            owner, which = block.owner(places), np.repeat(np.arange(n), times)
            least = owner[np.cumsum(times) - times][which] == owner
            before = np.where(least, first_back[which], back[which])
            after = np.where(least, first_ahead[which], ahead[which])
            gone = before + after > 0
            spans.append((places[gone] - before[gone], places[gone] + after[gone]))
        begin, end, text = united(*map(np.concatenate, zip(*spans, strict=True)), block.ends)
        n_spans = np.bincount(text, minlength=len(block.ends))
        n_removed = np.bincount(text, end - begin, minlength=len(block.ends)).astype(np.int64)
        starts = block.ends - np.array([len(x) for x in block.bodies], np.int64)
        digests, kept, at = [], [], 0
        for start, n, body in zip(starts.tolist(), n_spans.tolist(), block.bodies, strict=True):
            if n:
                cuts = [0, *(np.stack([begin[at : at + n], end[at : at + n]], 1).ravel() - start).tolist(), len(body)]
                body = b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                at += n
            digests.append(hashlib.sha256(body).hexdigest())
            kept.append(body.decode("utf-8", "ignore") if as_text else body)
        order = pa.array(block.order, pa.int64())
        return pa.table({
            "doc_id": docs_here["doc_id"].take(order), "n_bytes": pa.array(block.ends - starts, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
            "kept": pa.array(kept, pa.string() if as_text else pa.binary()), "carry": docs_here["carry"].take(order),
        })

    sent = rows.groupBy("block").applyInArrow(send_hashes, "block long, bucket int, hashes binary, more binary")
    replies = sent.groupBy("bucket").applyInPandas(reply, "block long, bucket int, shared binary, hot binary")
    runs = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        send_runs, "block long, bucket int, n int, run binary, found binary"
    )
    verdicts = runs.groupBy("bucket").applyInPandas(merge, "block long, bucket int, n int, spans binary")
    kinds = T.StructType()
    for name, kind in (("doc_id", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        kinds = kinds.add(name, kind)
    kinds = kinds.add("kept", "string" if as_text else "binary").add("carry", every.schema["carry"].dataType)
    out = rows.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(remove, kinds)
    nothing = F.lit(0).cast("long")
    short = every.where(~long_enough).select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"),
        F.sha2("body", 256).alias("kept_sha256"), (F.coalesce("text", F.lit("")) if as_text else F.col("body")).alias("kept"), "carry",
    )
    out = out.unionByName(short)
    return out.withColumnRenamed("carry", carry) if carry else out.drop("carry")


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(x, kinds[kind]) for (name, kind), x in zip(fields, columns, strict=True)})

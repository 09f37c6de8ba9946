"""Token counts of a unigram model by dynamic programming over a trie.

The distinct pre-tokens of many documents are inserted in a trie. The forward pass, the
best score of any segmentation of a prefix and its number of pieces, is computed once for
each trie node, so for each shared prefix, a depth of the trie at a time; the nodes where
pre-tokens end store their counts. A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, utf8

MARK = "▁"  # stands before the first character of a pre-token
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


class Pieces:
    """Log probabilities of the pieces of a vocabulary.

    The file holds no probabilities. They follow Zipf's law by rank, the place of a piece
    among the pieces in the file: p(rank) = 1 / (rank * H), with H the harmonic number that
    makes them sum to one with one more rank for each byte. A character that is no piece
    falls back to its UTF-8 bytes, a token each, with the probability of the last rank.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        ranks = len(names) + 256
        whole = float((1 / np.arange(1, ranks + 1)).sum())
        self.logp = {x: -float(np.log(i + 1.0)) - float(np.log(whole)) for i, x in enumerate(names)}
        self.byte = -float(np.log(ranks)) - float(np.log(whole))
        self.longest = max(map(len, names), default=1)
        self.tables = []
        for size in range(1, self.longest + 1):
            own = sorted((self.hash(x), p) for x, p in self.logp.items() if len(x) == size)
            self.tables.append((np.array([h for h, _ in own], np.uint64), np.array([p for _, p in own])))

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & _ALL
        return h


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def best_path(word: str, pieces: Pieces) -> tuple[int, float]:
    """Tokens and log probability of the best segmentation of one word, of any length."""
    score, count = [0.0], [0]
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode("utf-8", "surrogatepass"))
        top, least = score[e - 1] + n * pieces.byte, count[e - 1] + n
        for s in range(max(0, e - pieces.longest), e):
            p = pieces.logp.get(word[s:e])
            if p is not None and (score[s] + p, -count[s] - 1) > (top, -least):
                top, least = score[s] + p, count[s] + 1
        score.append(top)
        count.append(least)
    return count[-1], score[-1]


def trie_counts(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and log probability of the best segmentation of each word; words are sorted and distinct."""
    sizes = np.array([len(x) for x in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
    active = np.flatnonzero(sizes > 0)
    node = np.zeros(len(active), np.int64)  # trie node of each active word at this depth
    hashes, best, least = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)]
    parents: list[np.ndarray] = [np.zeros(1, np.int64)]
    powers = [1]
    for _ in range(pieces.longest):
        powers.append(powers[-1] * _BASE & _ALL)
    depth = 0
    while len(active):
        char = codes[starts[active] + depth]
        new = np.ones(len(active), bool)
        new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
        first = np.flatnonzero(new)
        parent, letter = node[first], char[first].astype(np.uint64)
        node = np.cumsum(new) - 1
        h = hashes[-1][parent] * np.uint64(_BASE) + letter + np.uint64(1)
        n = 1 + (letter >= 0x80).astype(np.int64) + (letter >= 0x800) + (letter >= 0x10000)
        top, few = best[-1][parent] + n * pieces.byte, least[-1][parent] + n
        above = parent
        for size in range(1, min(depth + 1, pieces.longest) + 1):
            at = len(hashes) - size
            known, logp = pieces.tables[size - 1]
            if len(known):
                key = h - hashes[at][above] * np.uint64(powers[size])
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = np.flatnonzero(known[place] == key)
                if len(hit):
                    score = best[at][above[hit]] + logp[place[hit]]
                    count = least[at][above[hit]] + 1
                    better = (score > top[hit]) | ((score == top[hit]) & (count < few[hit]))
                    top[hit[better]], few[hit[better]] = score[better], count[better]
            if size <= depth:
                above = parents[at][above]
        hashes.append(h)
        best.append(top)
        least.append(few)
        parents.append(parent)
        if len(hashes) > pieces.longest + 1:  # pieces reach no farther back
            for kept in (hashes, best, least, parents):
                kept.pop(0)
        depth += 1
        ends = sizes[active] == depth
        counts[active[ends]], scores[active[ends]] = few[node[ends]], top[node[ends]]
        active, node = active[~ends], node[~ends]
    return counts, scores


def count_tokens(docs: DataFrame, vocabulary: str, slice_bytes: int = 8_000_000, long_word: int = 200) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_prob) for every row of docs.

    Pre-tokens are runs of anything but ASCII white space, each with the mark of a word's
    start. Words of more than long_word characters are segmented by themselves, by the same
    recurrence. Null, empty and white texts have no tokens and log_prob 0. Repeated rows
    are repeated, null ids are kept. A trie holds the words of slice_bytes of text, so its
    memory does not follow the input.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def some(rows: list[tuple]) -> pd.DataFrame:
        pieces = load(vocabulary)
        split = [body.split() for _, body in rows]
        distinct = sorted({w for words in split for w in words})
        text = [MARK + w.decode("utf-8", "surrogateescape") for w in distinct]
        order = sorted(i for i in range(len(text)) if len(text[i]) <= long_word)
        order.sort(key=text.__getitem__)
        counts, scores = trie_counts([text[i] for i in order], pieces)
        found = {distinct[i]: (int(n), float(s)) for i, n, s in zip(order, counts, scores, strict=True)}
        found |= {w: best_path(t, pieces) for w, t in zip(distinct, text, strict=True) if w not in found}
        number, score = {w: x[0] for w, x in found.items()}, {w: x[1] for w, x in found.items()}
        return pd.DataFrame(
            {
                "doc_id": [x for x, _ in rows],
                "n_pretokens": [len(w) for w in split],
                "n_tokens": [sum(map(number.__getitem__, w)) for w in split],
                "log_prob": [float(sum(map(score.__getitem__, w))) for w in split],
            }
        )

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(batch["doc_id"], batch["body"], strict=True):
                rows.append(row)
                size += len(row[1])
                if size >= slice_bytes:
                    yield some(rows)
                    rows, size = [], 0
        if rows:
            yield some(rows)

    return docs.select("doc_id", utf8("text").alias("body")).mapInPandas(
        of, f"doc_id {kind}, n_pretokens long, n_tokens long, log_prob double"
    )

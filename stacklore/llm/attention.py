"""A small causal self-attention language model on subword ids, in numpy.

One head attends over a context window, and its answer goes, with the vectors of the last
two ids, through a hidden layer. The output is a tree: a branch, then a leaf of that
branch, then an id of that leaf with its smoothed share of the corpus counts. So all ids
have a probability and they sum to 1, at the cost of two short softmaxes. The most frequent
ids have a leaf each, the others share leaves. What the network answers is added to what
the corpus's counts of pairs say of branch and leaf after the last id: these are not
trained, and the network learns what they leave open.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: width of a vector, hidden width, inputs in a window, outputs scored in a window
DIM, HIDDEN, WINDOW, SCORED = 16, 32, 32, 24
#: branches, leaves of a branch, leaves of one id, input rows
BRANCHES, LEAVES, SINGLE, INPUTS = 32, 32, 960, 2048
_LEAD = WINDOW - SCORED
#: row 0 stands before a text, then the frequent ids, then the branches for all others
_BRANCH_ROW = INPUTS - BRANCHES
_SHIFT = LEAVES.bit_length() - 1
_ONES = np.ones(LEAVES, np.float32)
_MASK = np.where(np.arange(WINDOW)[None] <= np.arange(_LEAD, WINDOW)[:, None], 0, -1e9).astype(np.float32)


@dataclass
class Vocabulary:
    """What each id is to the model; the last id is the end of a text."""

    row: np.ndarray  # input row
    leaf: np.ndarray  # leaf of the output; its branch is leaf // LEAVES
    share: np.ndarray  # natural logarithm of the id's share of its leaf

    @property
    def end(self) -> int:
        return len(self.row) - 1

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        leaf = np.empty(len(counts), np.int64)
        leaf[order[:SINGLE]] = np.arange(min(SINGLE, len(counts)))
        mass, bins = np.cumsum(counts[order[SINGLE:]] + 0.5), BRANCHES * LEAVES - SINGLE
        leaf[order[SINGLE:]] = SINGLE + np.minimum((mass / mass[-1:] * bins).astype(np.int64), bins - 1)
        row = _BRANCH_ROW + leaf // LEAVES
        row[order[: _BRANCH_ROW - 1]] = 1 + np.arange(min(_BRANCH_ROW - 1, len(counts)))
        smooth = counts + 0.5
        share = np.log(smooth / np.bincount(leaf, smooth)[leaf])
        return cls(row.astype(np.int32), leaf.astype(np.int16), share.astype(np.float32))


def start(seed: int = 5) -> dict[str, np.ndarray]:
    """Weights before training: random, but the last layers are zero, so that training starts from the counts of pairs."""
    random = np.random.default_rng(seed)
    shapes = {
        "embed": (INPUTS, DIM), "place": (WINDOW, DIM), "query": (DIM, DIM), "key": (DIM, DIM), "value": (DIM, DIM),
        "out": (DIM, HIDDEN), "last": (DIM, HIDDEN), "before": (DIM, HIDDEN), "shift": (HIDDEN,),
        "branch": (HIDDEN, BRANCHES), "leaf": (BRANCHES, HIDDEN, LEAVES),
    }
    weights = {k: random.normal(0, 0.3, v).astype(np.float32) for k, v in shapes.items()}
    for zero in ("shift", "branch", "leaf"):
        weights[zero][:] = 0
    return weights


def count_pairs(texts: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Codes (input row * BRANCHES * LEAVES + leaf that follows it) that occur, and how often; the end follows too."""
    counts = np.zeros(INPUTS * BRANCHES * LEAVES, np.int64)
    for at in range(0, len(texts), 4096):
        codes = []
        for x in texts[at : at + 4096]:
            before = np.concatenate([[0], vocabulary.row[x]]).astype(np.int64)
            after = np.concatenate([vocabulary.leaf[x], vocabulary.leaf[vocabulary.end :]])
            codes.append(before * (BRANCHES * LEAVES) + after)
        counts += np.bincount(np.concatenate(codes), minlength=len(counts))
    codes = np.flatnonzero(counts)
    return codes, counts[codes]


def pair_logits(pairs: np.ndarray, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the branches after each input row and of the leaves in each branch, from counts of pairs.

    Each is smoothed by the same without regard to the row before, as if that had been seen strength times.
    """
    pairs = pairs.reshape(INPUTS, BRANCHES, LEAVES).astype(np.float64)
    wide = pairs.sum(2)
    base = (wide.sum(0) + 0.01) / (wide.sum() + 0.01 * BRANCHES)
    branch = np.log((wide + strength * base) / (wide.sum(1, keepdims=True) + strength))
    within = pairs.sum(0) + 0.01
    within /= within.sum(1, keepdims=True)
    leaf = np.log((pairs + strength * within) / (wide[..., None] + strength))
    return branch.astype(np.float32), leaf.astype(np.float32)


def windows(texts: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows (n, WINDOW), the ids to predict at the last SCORED of them (-1: none), and the text of each window.

    Windows overlap by WINDOW - SCORED. Every id of every text, and the end after it, is to be predicted exactly once.
    """
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    counts = -(-sizes // SCORED)
    room = counts * SCORED + WINDOW
    begins = np.cumsum(room) - room
    flat, aim = np.zeros(int(room.sum()), np.int32), np.full(int(room.sum()), -1, np.int32)
    for at, x in zip(begins + _LEAD, texts, strict=True):
        flat[at + 1 : at + 1 + len(x)] = vocabulary.row[x]
        aim[at : at + len(x)] = x
        aim[at + len(x)] = vocabulary.end
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(begins, counts) + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * SCORED
    view = np.lib.stride_tricks.sliding_window_view
    if not len(texts):
        return np.zeros((0, WINDOW), np.int32), np.zeros((0, SCORED), np.int32), owner
    return view(flat, WINDOW)[first], view(aim, SCORED)[first + _LEAD], owner


def _by_branch(branch: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(branch, kind="stable")
    cuts = np.searchsorted(branch[order], np.arange(BRANCHES + 1))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in range(BRANCHES) if cuts[b] < cuts[b + 1]]


class Scorer:
    """The forward pass with its tables worked out once: what an input row becomes in each matrix."""

    def __init__(self, weights: dict[str, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], vocabulary: Vocabulary):
        w, self.vocabulary = weights, vocabulary
        self.branch, self.leaf = w["branch"], w["leaf"]
        self.pair_branch, self.pair_leaf = pairs[0], pairs[1].reshape(-1, LEAVES)
        scale = np.float32(1 / np.sqrt(DIM))
        both = lambda k, by=np.float32(1): (w["embed"] @ w[k] * by, w["place"] @ w[k] * by)
        self.query, place = both("query", scale)
        self.query_place = place[_LEAD:]
        self.key, self.key_place = both("key")
        # the values go through the layer that follows attention at once; a last column of ones sums the weights
        ones = lambda m: np.concatenate([m, np.ones((len(m), 1), np.float32)], 1)
        value, place = both("value")
        self.value, self.value_place = ones(value), np.concatenate([place, np.zeros((WINDOW, 1), np.float32)], 1)
        self.out = w["out"]
        self.last, place = both("last")
        self.before, place_before = both("before")
        self.hidden_place = place[_LEAD:] + place_before[_LEAD - 1 : -1] + w["shift"]
        # without a mask, weights can only overflow if vectors are long
        long = [np.abs(t).max() + np.abs(p).max() for t, p in ((self.query, self.query_place), (self.key, self.key_place))]
        self.safe = DIM * long[0] * long[1] < 80
        self.open = (_MASK == 0).astype(np.float32)

    def of(self, rows: np.ndarray, aims: np.ndarray) -> np.ndarray:
        """Sum of the natural log probabilities of the ids to predict in each window."""
        last = rows[:, _LEAD:]
        query = self.query.take(last, axis=0)
        query += self.query_place
        key = self.key.take(rows, axis=0)
        key += self.key_place
        value = self.value.take(rows, axis=0)
        value += self.value_place
        weight = query @ key.transpose(0, 2, 1)
        if not self.safe:
            weight += _MASK
            weight -= weight.max(-1, keepdims=True)
        np.exp(weight, out=weight)
        weight *= self.open
        mixed = (weight @ value).reshape(-1, DIM + 1)
        mixed = mixed[:, :DIM] / mixed[:, DIM:]
        hidden = self.last.take(last, axis=0)
        hidden += self.before.take(rows[:, _LEAD - 1 : -1], axis=0)
        hidden += self.hidden_place
        hidden = hidden.reshape(-1, HIDDEN)
        hidden += mixed @ self.out
        # what is to be predicted, ordered by branch, so that each branch's leaves are one product
        aims = aims.ravel()
        known = np.flatnonzero(aims >= 0)
        leaf = self.vocabulary.leaf[aims[known]]
        order = np.argsort(leaf >> _SHIFT, kind="stable")
        known, leaf = known[order], leaf[order].astype(np.int64)
        branch, ids = leaf >> _SHIFT, aims[known]
        hidden = np.tanh(hidden.take(known, axis=0))
        last = last.ravel()[known].astype(np.int64)
        each = np.arange(len(known))
        logits = self.pair_branch.take(last, axis=0)
        logits += hidden @ self.branch
        found = logits[each, branch] - np.log(np.exp(logits, out=logits) @ _ONES)
        logits = self.pair_leaf.take(last * BRANCHES + branch, axis=0)
        cuts = np.searchsorted(branch, np.arange(BRANCHES + 1))
        for b in range(BRANCHES):
            if cuts[b] < cuts[b + 1]:
                some = slice(cuts[b], cuts[b + 1])
                logits[some] += hidden[some] @ self.leaf[b]
        found += logits[each, leaf & (LEAVES - 1)]
        found -= np.log(np.exp(logits, out=logits) @ _ONES)
        found += self.vocabulary.share[ids]
        return np.bincount(known // SCORED, found, len(rows))

    def score(self, texts: list[np.ndarray], batch: int = 256) -> np.ndarray:
        """log10 probability of each text, its end included."""
        rows, aims, owner = windows(texts, self.vocabulary)
        each = [self.of(rows[i : i + batch], aims[i : i + batch]) for i in range(0, len(rows), batch)]
        return np.bincount(owner, np.concatenate(each) if each else None, len(texts)) / np.log(10)


def gradient(w: dict[str, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], rows: np.ndarray, leaves: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of branches and leaves (leaves, -1: none) over a batch of windows."""
    scale = np.float32(1 / np.sqrt(DIM))
    x = w["embed"][rows] + w["place"]
    late, before = x[:, _LEAD:], x[:, _LEAD - 1 : -1]
    q, k, v = late @ w["query"], x @ w["key"], x @ w["value"]
    weight = q @ k.transpose(0, 2, 1) * scale + _MASK
    weight = np.exp(weight - weight.max(-1, keepdims=True))
    weight /= weight.sum(-1, keepdims=True)
    mixed = weight @ v
    hidden = np.tanh(mixed @ w["out"] + late @ w["last"] + before @ w["before"] + w["shift"])
    known = np.flatnonzero(leaves.ravel() >= 0)
    n = np.float32(max(1, len(known)))
    some, aim, last = hidden.reshape(-1, HIDDEN)[known], leaves.ravel()[known], rows[:, _LEAD:].ravel()[known]
    branch, each = aim // LEAVES, np.arange(len(known))

    def pull(logits: np.ndarray, right: np.ndarray) -> np.ndarray:
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), right] -= 1
        return p / n

    p = pull(some @ w["branch"] + pairs[0][last], branch)
    g = {"branch": some.T @ p, "leaf": np.zeros_like(w["leaf"])}
    back = p @ w["branch"].T
    for b, here in _by_branch(branch):
        p = pull(some[here] @ w["leaf"][b] + pairs[1][last[here], b], aim[here] % LEAVES)
        g["leaf"][b] = some[here].T @ p
        back[here] += p @ w["leaf"][b].T
    whole = np.zeros_like(hidden).reshape(-1, HIDDEN)
    whole[known] = back * (1 - some**2)
    back = whole.reshape(hidden.shape)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    g |= {"shift": whole.sum(0), "out": flat(mixed).T @ whole, "last": flat(late).T @ whole, "before": flat(before).T @ whole}
    into_mixed = back @ w["out"].T
    into_weight = into_mixed @ v.transpose(0, 2, 1)
    into_v = weight.transpose(0, 2, 1) @ into_mixed
    into_weight = weight * (into_weight - (into_weight * weight).sum(-1, keepdims=True)) * scale
    into_q, into_k = into_weight @ k, into_weight.transpose(0, 2, 1) @ q
    g |= {"query": flat(late).T @ flat(into_q), "key": flat(x).T @ flat(into_k), "value": flat(x).T @ flat(into_v)}
    into_x = into_k @ w["key"].T + into_v @ w["value"].T
    into_x[:, _LEAD:] += into_q @ w["query"].T + back @ w["last"].T
    into_x[:, _LEAD - 1 : -1] += back @ w["before"].T
    g["place"] = into_x.sum(0)
    order = rows.ravel()
    g["embed"] = np.stack([np.bincount(order, into_x[..., d].ravel(), INPUTS) for d in range(DIM)], 1)
    return g


def train(
    weights: dict[str, np.ndarray],
    pairs: tuple[np.ndarray, np.ndarray],
    rows: np.ndarray,
    leaves: np.ndarray,
    epochs: int = 1,
    batch: int = 128,
    rate: float = 0.01,
    seed: int = 11,
) -> dict[str, np.ndarray]:
    """Adam over the windows in random order, with a rate that falls to zero."""
    w = {k: v.copy() for k, v in weights.items()}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    random, step = np.random.default_rng(seed), 0
    whole = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            step += 1
            now = rate * (1 - (step - 1) / whole)
            for name, g in gradient(w, pairs, rows[some], leaves[some]).items():
                m, s = moments[name]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w[name] -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w

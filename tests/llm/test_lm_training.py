"""The network learns from every training text, and scores are those of its definition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklore.llm import attention, lm
from stacklore.llm.common import outside_fold


def test_texts_outside_any_share_are_learned_from(spark):
    """None of these is in the sample, nor in one of 16 by the share's hash."""
    rnd = random.Random(6)
    word = lambda: rnd.choice(["red", "green", "blue", "north", "south", "river", "stone"])
    docs = spark.createDataFrame([(i, " ".join(word() + " " + "then" for _ in range(60))) for i in range(60)], "doc_id long, text string")
    docs = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("share")), F.lit(16)) != 0)
    every = {r.doc_id: r.score for r in lm.score(docs, F.lit(True), sample=0).collect()}
    none = {r.doc_id: r.score for r in lm.score(docs, F.lit(True), sample=0, one_in=1 << 40).collect()}
    assert every.keys() == none.keys() and all(every[i] != none[i] for i in every)
    assert sum(every.values()) > sum(none.values())


def by_definition(w, pairs, vocabulary, ids):
    """log10 probability of one text, an id at a time, from the weights alone."""
    aims = [*ids, vocabulary.end]
    rows = [0, *(int(vocabulary.row[i]) for i in ids)]
    total, lead = 0.0, attention.WINDOW - attention.SCORED
    for t, aim in enumerate(aims):
        begin = t // attention.SCORED * attention.SCORED - lead
        at = t - begin
        x = np.array([w["embed"][rows[begin + i] if begin + i >= 0 else 0] + w["place"][i] for i in range(at + 1)], np.float64)
        reach = x @ w["key"] @ (x[-1] @ w["query"]) / np.sqrt(attention.DIM)
        reach = np.exp(reach - reach.max())
        mixed = reach / reach.sum() @ (x @ w["value"])
        hidden = np.tanh(mixed @ w["out"] + x[-1] @ w["last"] + x[-2] @ w["before"] + w["shift"])
        leaf, last = int(vocabulary.leaf[aim]), rows[t]
        branch = leaf // attention.LEAVES
        for logits, right in (
            (hidden @ w["branch"] + pairs[0][last], branch),
            (hidden @ w["leaf"][branch] + pairs[1][last][branch], leaf % attention.LEAVES),
        ):
            total += logits[right] - np.log(np.exp(logits).sum())
        total += vocabulary.share[aim]
    return total / np.log(10)


@pytest.mark.parametrize("size", [0.3, 4.0])
def test_scores_are_those_of_the_definition(size):
    """Also with weights so large that attention has to be shifted by its largest value."""
    rnd = np.random.default_rng(8)
    texts = [rnd.integers(0, 90, n).astype(np.uint16) for n in (0, 1, 24, 25, 70)]
    vocabulary = attention.Vocabulary.of(np.bincount(np.concatenate(texts), minlength=1500))
    codes, n = attention.count_pairs(texts, vocabulary)
    pairs = np.zeros(lm.PAIRS, np.int64)
    pairs[codes] = n
    logits = attention.pair_logits(pairs)
    weights = {k: (rnd.normal(0, size if k in ("query", "key") else 0.3, v.shape)).astype(np.float32) for k, v in attention.start().items()}
    got = attention.Scorer(weights, logits, vocabulary).score(texts)
    assert got == pytest.approx([by_definition(weights, logits, vocabulary, x) for x in texts], rel=1e-3)


def test_attention_is_better_than_its_pair_counts_on_held_out_texts():
    """What comes depends on an id three places back, which pairs cannot tell."""
    rnd = np.random.default_rng(3)

    def text():
        ids = []
        for _ in range(40):
            first = int(rnd.integers(0, 6))
            ids += [first, 10, 11, 20 + first]
        return np.array(ids, np.uint16)

    texts, held_out = [text() for _ in range(150)], [text() for _ in range(20)]
    counts = np.bincount(np.concatenate(texts), minlength=1500)
    vocabulary = attention.Vocabulary.of(counts)
    codes, n = attention.count_pairs(texts, vocabulary)
    pairs = np.zeros(lm.PAIRS, np.int64)
    pairs[codes] = n
    logits = attention.pair_logits(pairs)
    trained = attention.train(attention.start(), logits, *lm._with_leaves(texts, vocabulary), epochs=12)
    before = attention.Scorer(attention.start(), logits, vocabulary).score(held_out).sum()
    assert attention.Scorer(trained, logits, vocabulary).score(held_out).sum() > 0.9 * before


def test_null_and_large_ids_come_back_as_they_were(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**60 + 1, "b"), (3, None)], "doc_id long, text string")
    got = lm.score(docs, F.col("doc_id").isNotNull(), sample=2).collect()
    assert {(r.doc_id, r.n_tokens, r.train_tokens) for r in got} == {(None, 3, 3), (2**60 + 1, 2, 3), (3, 1, 3)}


def test_ids_are_scored_before_words_are_moved(spark, odd):
    scored = lm.score(odd, outside_fold("doc_id", 7, 2))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas network" in plan.split("FlatMapCoGroupsInPandas")[1]
    assert scored.count() == odd.count()

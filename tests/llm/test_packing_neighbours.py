"""Related documents meet whatever the number of shards, and copies find each other."""

import random
from collections import defaultdict

import numpy as np

from stacklore.llm import packing


def topical(topics=60, each=4, seed=3):
    """Documents of a common vocabulary with a few words of their topic, ids in random order."""
    rnd = random.Random(seed)
    name = lambda: "".join(rnd.choice("bcdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
    common = [name() for _ in range(300)]
    ids, out = rnd.sample(range(10_000), topics * each), []
    for t in range(topics):
        own = [name() for _ in range(3)]
        for i in range(each):
            words = [rnd.choice(common) for _ in range(80)] + own * 8
            rnd.shuffle(words)
            out.append((ids[t * each + i], t, " ".join(words)))
    return out


def test_related_documents_meet_in_many_shards(spark):
    rows = topical()
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    dealt, known = packing.dealt(docs, 1, 4000)
    shard = {r.doc_id: r.shard for r in dealt.collect()}
    topic = defaultdict(set)
    for i, t, _ in rows:
        topic[t].add(i)
    assert len(shard) == len(rows) and len(set(shard.values())) >= 30
    met = sum(any(shard[i] == shard[j] for j in topic[t] - {i}) for i, t, _ in rows) / len(rows)
    print("documents with one of their topic in their shard:", met, "shards:", len(set(shard.values())))
    assert met >= 0.8
    assert known.value[0] == len(rows)


def test_a_large_group_of_copies_is_dealt_out(spark):
    docs = spark.createDataFrame([(i, "the same words in every one of them " * 5) for i in range(200)], "doc_id long, text string")
    dealt, _ = packing.dealt(docs, 1, 4000)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert sum(sizes) == 200 and max(sizes) * 180 < 3 * 4000


def test_frequencies_are_those_of_all_shards():
    a = [np.array([5, 6, 7, 1], np.uint32), np.array([5, 6, 8, 1], np.uint32)]
    df = np.zeros(1 << 16, np.int64)
    df[[1, 5, 6, 7, 8]] = 1000, 2, 900, 1, 1
    index = packing.Index(a, common=1.0, known=(1000, 4.0, df))
    rare = {int(t): w for t, w in zip(index.terms[:3], index.weights[:3], strict=True)}  # of document 0: ids 1, 5, 6
    assert rare[1] > 10 * rare[0] and rare[1] > 10 * rare[2]


def test_copies_of_a_third_find_each_other():
    """With the production values."""
    rnd = np.random.default_rng(1)
    copy = rnd.integers(100, 160, 50).astype(np.uint32)
    documents = [copy if i % 3 == 0 else rnd.integers(1000, 3000, 50).astype(np.uint32) for i in range(90)]
    found = packing.Index(documents).neighbours(0, np.arange(90) == 0)
    assert found[:29].tolist() == list(range(3, 90, 3))


def test_few_long_documents_ask_with_all_their_terms():
    """The best neighbour shares many light terms, the others a few heavy ones."""
    common = np.arange(100, 160, dtype=np.uint32)
    documents = [np.r_[common, np.uint32(500), np.uint32(501)], common, np.r_[np.uint32(500), np.arange(700, 760, dtype=np.uint32)], common + np.uint32(1000), common]
    found = packing.Index(documents).neighbours(0, np.arange(5) == 0)
    assert found.tolist() == [1, 4, 2]


def test_heaviest_terms_without_sorting_all():
    rng = np.random.default_rng(3)
    df = np.r_[0, 1, rng.integers(1, 40, 60)]
    rarity = np.where(df > 1, packing.idf(40, df), -1.0)
    for n in (0, 1, 2, 5, 300):
        ids = rng.integers(1, 62, n).astype("<u2")
        term, tf = np.unique(ids, return_counts=True)
        assert [x.tolist() for x in packing.terms_of(ids)] == [term.tolist(), tf.tolist()]
        term, tf = term[df[term] > 1].astype(int), tf[df[term] > 1]
        weight = packing.idf(40, df[term]) * tf / (tf + packing.K1 * (1 - packing.B + packing.B * n / 9.0))
        assert packing.two_heaviest(ids, rarity, 9.0) == [*term[np.argsort(-weight, kind="stable")[:2]].tolist(), -1, -1][:2]

"""Operators 5, 6, 8 and 9 against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stacklore.llm import components, multiset_hash, simhash, suffix_dedup, topk


def plain_fingerprint(text, words=4):
    t = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    grams = [b" ".join(t[i : i + words]) for i in range(len(t) - words + 1)] or ([b" ".join(t)] if t else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in ids}


def test_simhash_is_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    found = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in found.items()} == want


def test_every_pair_within_the_radius_is_joined(spark):
    """Chains and clusters around random points, at all distances, with few and with many syndromes."""
    rnd, points = random.Random(1), set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for d in range(7):
            points.add(x)
            y = x
            for b in rnd.sample(range(64), d):
                y ^= 1 << b
            points.add(y)
    points |= {0, (1 << 64) - 1}
    values = np.array(sorted(points), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = groups(values, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    for power in (2, 6, 12):
        edges = simhash.links(df, 4, least_power=power, task_variants=1 << 60)
        root = {r.node: r.root for r in components.connected_components(edges).collect()}
        assert {v: root.get(v, v) for v in values} == want, power


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] and len(by[2]) == 1
    assert by[4] == by[5] == by[6] == {("0" * 16, 4)}
    assert simhash.near_duplicates(none).count() == 0


def plain_dedup(texts, length=50):
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][p : p + length], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_is_brute_force(spark):
    """Shared passages at random places, periodic texts, cut characters; one and many blocks, cold and hot anchors."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(8, 40))) for _ in range(6)] + ["ab" * 60, "x" * 130, "eren. " * 20]
    texts = {}
    for i in range(60):
        parts = [rnd.choice(passages)[rnd.randint(0, 20) :] if rnd.random() < 0.5 else "".join(word() for _ in range(20)) for _ in range(rnd.randint(0, 5))]
        texts[i] = "".join(parts)
    texts[60], texts[61], texts[62] = texts[5], "", texts[6][:49]
    want = plain_dedup({i: t.encode() for i, t in texts.items()})
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for options in ({}, {"block_bytes": 2000, "bucket_bytes": 1000}, {"block_bytes": 2000, "hot": 1}):
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, **options).collect()}
        assert found == want, options


def test_merge_of_runs_gives_each_row_once():
    rnd = random.Random(3)
    runs = [sorted({bytes(rnd.choice(b"ab") for _ in range(8)) for _ in range(rnd.randint(0, 40))}) for _ in range(7)]
    coded = [suffix_dedup.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 8)) for r in runs]
    rows, common, places = suffix_dedup.merge_runs(coded, 8)
    assert rows == sorted(set().union(*runs))
    assert [[rows[i] for i in p] for p in places] == runs
    for a, b, n in zip(rows, rows[1:], common[1:]):
        assert a[:n] == b[:n] and a[n] != b[n]


def test_suffix_dedup_of_odd_rows(odd, none):
    rows = suffix_dedup.dedup(odd, carry="source", as_text=True).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and all(r.n_removed == r.n_bytes for r in by[2])
    assert by[4][0].n_bytes == by[5][0].n_bytes == 0 and by[12][0].source == "d"
    # a null id counts as larger than all others, so what document 3 holds goes
    assert max(r.n_removed for r in by[None]) > 0
    assert suffix_dedup.dedup(none).count() == 0


def test_multiset_fingerprints(spark, odd, none, documents):
    rows = documents.orderBy("doc_id").collect()
    found = {r.doc_id: r for r in multiset_hash.fingerprint_edits(documents).collect()}
    for r, after in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after.text[:half]
        assert found[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[r.doc_id].n_chars == len(r.text)
    assert np.mean([r.near_edited > r.near_next for r in found.values()]) > 0.95
    odds = multiset_hash.fingerprint_edits(odd).collect()
    assert len(odds) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in odds)
    by = {r.doc_id: r for r in odds if r.doc_id is not None}
    assert by[1].fingerprint == by[2].fingerprint and by[4].fingerprint == by[5].fingerprint
    assert multiset_hash.fingerprint_edits(none).count() == 0
    one = multiset_hash.fingerprint_edits(spark.createDataFrame([(1, "abc", "x")], "doc_id long, text string, key string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()


def plain_lanes(text):
    """69 lanes modulo 2**32, word by word."""
    lanes = [0] * 69
    chain = lambda a, b: xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42))
    for line in (text or "").split("\n"):
        raw = line.encode()
        for k in (0, 1):
            h = chain(k.to_bytes(4, "little"), raw)
            lanes[2 * k] += h & 0xFFFFFFFF
            lanes[2 * k + 1] += h >> 32
        words = re.split(" +", "\n " + line + " \n")
        for a, b in zip(words, words[1:]):
            h = chain(a.encode(), b.encode())
            lanes[4] += 1
            for i in range(64):
                lanes[5 + i] += h >> i & 1
    return [x % (1 << 32) for x in lanes]


def plain_likeness(x, y):
    if x[4:] == y[4:]:
        return 1.0
    a, b = (np.array([2 * v - z[4] for v in z[5:]], float) for z in (x, y))
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return min(1.0, max(0.0, float(a @ b / size))) if size else 0.0


def test_fingerprints_and_likeness_are_brute_force(documents):
    rows = documents.orderBy("doc_id").collect()
    found = {r.doc_id: r for r in multiset_hash.fingerprint_edits(documents).collect()}
    lanes = {r.doc_id: plain_lanes(r.text) for r in rows}
    for r, after in list(zip(rows, rows[1:] + rows[:1]))[::7]:
        got, half = found[r.doc_id], len(r.text) // 2
        edited = plain_lanes(r.text[: len(r.text) - half] + after.text[:half])
        assert got.fingerprint == "".join(f"{x:08x}" for x in lanes[r.doc_id])
        assert got.edited_fingerprint == "".join(f"{x:08x}" for x in edited)
        assert abs(got.near_edited - plain_likeness(lanes[r.doc_id], edited)) < 1e-9
        assert abs(got.near_next - plain_likeness(lanes[r.doc_id], lanes[after.doc_id])) < 1e-9


def test_stored_fingerprints_add_up_and_compare(spark):
    """From the text form alone: insertion, deletion and likeness; the order of paragraphs does not matter."""
    df = spark.createDataFrame([(1, "a b c\nd e"), (2, "d e\na b c"), (3, "a b c"), (4, "d e"), (5, "a b c\nd e\nd e"), (5, "a b c\nd e\nd e")], "doc_id long, text string")
    rows = multiset_hash.fingerprint_edits(df)
    assert rows.where("doc_id = 5").count() == 2
    v = {r.doc_id: r.fingerprint for r in rows.collect()}
    pair = spark.createDataFrame([(v[3], v[4], v[1], v[5])], "a string, b string, both string, twice string")
    m = multiset_hash
    r = pair.select(
        m.add(F.col("a"), F.col("b")).alias("sum"), m.remove(F.col("twice"), F.col("b")).alias("less"),
        m.likeness(m.parse(F.col("both")), m.parse(F.col("twice"))).alias("near"), m.text_form(m.parse(F.col("a"))).alias("same"),
    ).first()
    assert v[1] == v[2] == r["sum"] == r["less"] and v[1] != v[5] and r["same"] == v[3]
    assert abs(r["near"] - plain_likeness(plain_lanes("a b c\nd e"), plain_lanes("a b c\nd e\nd e"))) < 1e-9


def test_following_ids(spark):
    ids = [5, -3, 100, 7, None, 7, 2**40]
    got = {r.doc_id: r.next_id for r in multiset_hash.following(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    assert got == {-3: 5, 5: 7, 7: 100, 100: 2**40, 2**40: -3}


def test_threshold_algorithm_is_brute_force(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 6)).round(2)
    x[10:20] = x[0]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (350, [0.0] * 6), (400, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, x string")
    for blocks in ({}, {"candidate_block": 40, "query_block": 3}):
        found = topk.search(df, F.col("vec_id") % 50 == 0, **blocks)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        good = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows if i is not None and v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)}
        want = {}
        for q in (i for i in good if i % 50 == 0):
            scores = sorted(((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:5]
            want[q] = [(i, -s) for s, i in scores]
        assert got == want
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1


def test_threshold_stops_early():
    rnd = np.random.default_rng(4)
    rows = np.rint(rnd.normal(size=(5000, 3)) * 200).astype(np.int64)
    lists = topk.Lists(np.arange(5000), rows)
    ids, scores, seen = lists.best(-1, np.array([300, 10, -5]), 5)
    assert seen < 2500 and scores.tolist() == sorted((rows @ np.array([300, 10, -5])).tolist())[::-1][:5]

"""Operators 1, 2, 3, 4, 7 and 10: held-out accuracy, brute force and round trips."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklore.llm import attention, langid, lm, mixing, packing, quality, token_counts, tokens
from stacklore.llm.common import outside_fold

BIG = "/root/testdata/sf0.01"


def test_quality_held_out(spark, odd, none):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    net = quality.fit(docs, labels, outside_fold("doc_id", 5, 0))
    found = quality.score(docs, net).join(labels, "doc_id").where(~outside_fold("doc_id", 5, 0)).toPandas()
    assert len(found) > 50
    assert ((found.score >= 0.3) == (found.quality == 1)).mean() > 0.93
    odds = quality.score(odd, net).collect()
    assert len(odds) == odd.count() and all(0 <= r.score <= 1 for r in odds)
    assert quality.score(none, net).count() == 0


def test_quality_without_both_labels(spark, odd):
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    net = quality.fit(odd, one, F.lit(True))
    assert len({r.score for r in quality.score(odd, net).collect()}) == 1


def test_chunks_cover_every_byte():
    for size in (0, 1, 255, 256, 257, 480, 481, 5000):
        body = bytes(np.random.default_rng(size).integers(1, 255, size, np.uint8))
        chunks, owner = quality.cut_chunks([body, b"x"])
        own = chunks[owner == 0]
        assert all((own[i // quality.STRIDE if i // quality.STRIDE < len(own) else -1] == body[i]).any() for i in range(size))
        assert len(own) == quality.pieces(size)


def test_network_tables_are_the_convolution():
    rnd = np.random.default_rng(0)
    net = quality.Network(rnd.normal(0, 0.2, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), np.ones(2 * quality.FILTERS), 0.0)
    chunks = rnd.integers(0, 256, (5, quality.CHUNK), np.uint8)
    spots = quality.CHUNK - quality.WIDTH + 1
    plain = sum(net.filters[k][chunks[:, k : k + spots]] for k in range(quality.WIDTH)).max(axis=1)
    assert np.abs(net.answers(chunks) - np.tanh(plain)).max() < 0.01


def test_mixing_is_sql(spark, none, odd):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{BIG}/documents.parquet'")
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    want = {r[0]: (r[1], r[2]) for r in c.sql(f"SELECT doc_id, probability, sampled FROM ({mixing.sql()})").fetchall()}
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r.sampled for r in rows} == {i: x for i, (_, x) in want.items()}
    assert all(abs(r.probability - want[r.doc_id][0]) < 1e-8 for r in rows)  # the SQL rounds to 9 digits
    total, kept = sum(r.tokens for r in rows), sum(r.tokens * r.probability for r in rows)
    assert abs(kept / total - 0.5) < 0.01
    odds = mixing.mix(odd).collect()
    assert len(odds) == odd.count() and {r.row.block for r in odds} == {1}
    assert mixing.mix(none).count() == 0


def test_raking_meets_the_margins_both_ways(spark):
    full = [(s, g, t, float(3 + 5 * i + 7 * j * k + 11 * k)) for i, s in enumerate("ab") for j, g in enumerate("xy") for k, t in enumerate("pq")]
    cells = spark.createDataFrame([*full, ("c", "x", "p", 0.0)], "source string, lang string, topic string, t double")
    wanted = {"source": spark.createDataFrame([("a", 0.2), ("b", 0.8), ("c", 0.0)], "value string, target double")}
    plan = mixing.Plan(rounds=20)
    for small in (100, 0):
        got = mixing.rake(cells, plan, wanted, small=small).groupBy("source").agg(F.sum("w").alias("w"))
        whole = plan.fraction * sum(r[3] for r in full)
        shares = {r.source: r.w / whole for r in got.collect()}
        assert shares["c"] == 0 and abs(shares["a"] - 0.2) < 1e-3 and abs(shares["b"] - 0.8) < 1e-3
        if small:
            first = shares
    assert {k: round(v, 9) for k, v in first.items()} == {k: round(v, 9) for k, v in shares.items()}


def test_expected_tokens_meet_every_margin_with_no_probability_above_one(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    cells = mixing.keyed(docs, None, "mix").groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("t"))
    for fraction, rounds, near in ((0.5, 20, 5e-3), (0.5, 60, 1e-3)):
        found = mixing.margins(mixing.rake(cells, mixing.Plan(fraction=fraction, rounds=rounds))).collect()
        assert all(r.expected <= r.tokens * (1 + 1e-9) and abs(r.expected - r.target) < near * r.target for r in found)
        for m in mixing.MARGINS:
            own = [r for r in found if r.margin == m]
            assert abs(sum(r.target for r in own) / sum(r.tokens for r in own) - fraction) < 1e-9
            # flattened shares, but for values that give all they have
            free = [r for r in own if r.target < r.tokens * (1 - 1e-9)]
            rates = [r.target / r.tokens**0.7 for r in free]
            assert max(rates) - min(rates) < 1e-6 * max(rates) and all(r.tokens / r.tokens**0.7 <= max(rates) * (1 + 1e-9) for r in own if r not in free)


def test_nothing_and_everything_can_be_wanted(spark, odd):
    none = mixing.mix(odd, mixing.Plan(fraction=0.0)).collect()
    assert len(none) == odd.count() and not any(r.sampled for r in none)
    assert all(r.sampled for r in mixing.mix(odd, mixing.Plan(fraction=1.0)).collect() if r.tokens)


def test_language_held_out(spark, odd, none):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = langid.fit(docs, outside_fold("doc_id", 4, 2), per_language=60)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(~outside_fold("doc_id", 4, 2)).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98
    odds = langid.attach(odd, model).collect()
    pred = {r.row.doc_id: r.lang_pred for r in odds if r.row.doc_id}
    assert len(odds) == odd.count() and [pred[i] for i in (4, 5, 6, 7)] == ["und"] * 4 and pred[1] == "en" and pred[3] == "de"
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    only = langid.fit(odd.where("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, only).collect()} == {"de", "und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(n).astype(int)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_language_code_corrects_a_wrong_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.ones(7), 1)
    for i in range(4):
        for flip in range(7):
            margins = 2.0 * code[i].astype(float)
            margins[flip] *= -1
            assert model.decode(margins[None])[0][0] == i


def test_lm_counts_and_probabilities(spark, odd, none, documents):
    got = {r.doc_id: r for r in lm.score(documents, outside_fold("doc_id", 7, 2), block_bytes=60_000, bucket_bytes=20_000, sample=40, one_in=2).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    seen = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update([*t.encode().lower().split(), b""])
    n, v = sum(seen.values()), len(seen)
    for i, t in texts.items():
        words = [*t.encode().lower().split(), b""]
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(seen[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    odds = lm.score(odd, F.col("doc_id") < 6).collect()
    assert len(odds) == odd.count() and all(np.isfinite(r.score) for r in odds)
    assert {r.n_tokens for r in odds if r.doc_id in (4, 5, 6)} == {1}
    assert lm.score(none, F.lit(True)).count() == 0
    unlearned = lm.score(odd, F.lit(False)).first()
    assert unlearned.train_tokens == 0 and unlearned.n_known == 0 and unlearned.base_score == 0


def tiny_model():
    rnd = np.random.default_rng(1)
    texts = [rnd.integers(0, 500, n).astype(np.uint32) for n in (0, 1, 23, 24, 25, 100)]
    counts = np.bincount(np.concatenate(texts), minlength=1500)
    vocabulary = attention.Vocabulary.of(counts)
    codes, n = attention.count_pairs(texts, vocabulary)
    pairs = np.zeros(lm.PAIRS, np.int64)
    pairs[codes] = n
    weights = attention.start()
    for k in ("branch", "leaf"):
        weights[k] = rnd.normal(0, 0.2, weights[k].shape).astype(np.float32)
    return texts, vocabulary, attention.pair_logits(pairs), weights


def test_windows_predict_each_id_once():
    texts, vocabulary, _, _ = tiny_model()
    _, aims, owner = attention.windows(texts, vocabulary)
    for i, x in enumerate(texts):
        assert [a for a in aims[owner == i].ravel() if a >= 0] == [*x, vocabulary.end]


def test_probabilities_of_all_ids_sum_to_one():
    texts, vocabulary, pairs, weights = tiny_model()
    scorer = attention.Scorer(weights, pairs, vocabulary)
    rows, aims, _ = attention.windows([texts[5][:30]], vocabulary)
    total = 0.0
    for i in range(len(vocabulary.row)):
        one = np.full_like(aims[:1], -1)
        one[0, 7] = i
        total += math.exp(scorer.of(rows[:1], one)[0])
    assert total == pytest.approx(1, abs=1e-3)


def test_later_ids_do_not_change_a_score():
    texts, vocabulary, pairs, weights = tiny_model()
    scorer = attention.Scorer(weights, pairs, vocabulary)
    rows, aims, _ = attention.windows([texts[5]], vocabulary)
    aims = np.where(np.arange(attention.SCORED) < 5, aims, -1)
    before = scorer.of(rows, aims)
    changed = rows.copy()
    changed[:, attention.WINDOW - attention.SCORED + 5 :] = 3
    assert scorer.of(changed, aims) == pytest.approx(before, rel=1e-5)


def test_gradient_is_the_slope():
    texts, vocabulary, pairs, weights = tiny_model()
    rows, aims, _ = attention.windows(texts, vocabulary)
    leaves = np.where(aims >= 0, vocabulary.leaf[aims], -1).astype(np.int64)
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    wide = tuple(p.astype(np.float64) for p in pairs)
    loss = lambda x: -(attention.Scorer(x, wide, vocabulary).of(rows, aims).sum() - vocabulary.share[aims[aims >= 0]].sum()) / (aims >= 0).sum()
    for k, g in attention.gradient(w, wide, rows, leaves).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-3, rel=0.02, abs=1e-5), k


def test_trie_counts_are_each_words_best_path(spark, odd, none, documents):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.load(path)
    words = sorted({"▁" + w for r in documents.limit(40).collect() for w in r.text.split()} | {"▁", "▁漢字語", "▁á😀b", "▁" + "ab" * 50})
    counts, scores = token_counts.trie_counts(words, pieces)
    for w, n, s in zip(words, counts, scores):
        want = token_counts.best_path(w, pieces)
        assert n == want[0] and s == pytest.approx(want[1])
    small = token_counts.count_tokens(documents, path, slice_bytes=1000).orderBy("doc_id").collect()
    assert small == token_counts.count_tokens(documents, path, long_word=3).orderBy("doc_id").collect() or all(
        a.n_tokens == b.n_tokens for a, b in zip(small, token_counts.count_tokens(documents, path, long_word=3).orderBy("doc_id").collect())
    )
    odds = token_counts.count_tokens(odd, path).collect()
    assert len(odds) == odd.count() and {r.n_tokens for r in odds if r.doc_id in (4, 5, 6)} == {0}
    assert token_counts.count_tokens(none, path).count() == 0


def test_ids_need_no_looking_ahead():
    from tokenizers import Tokenizer

    reference, rnd = Tokenizer.from_file(tokens.paths()[0]), random.Random(8)
    signs = [*tokens.SPACE, *"\x1c\x1f\u200b\u180e'ab1é漢.²", " ", " ", "'s", "\r\n"]
    for _ in range(4000):
        text = "".join(rnd.choices(signs, k=rnd.randrange(14)))
        assert "".join(tokens.parts(text)) == text
        assert tokens.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
    assert tokens.AHEAD not in tokens._loaded(*tokens.paths())._pat_str


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokens.paths()[0])
    for text in ("", "Hello  world\n\n x", "漢字 é 😀", "a<|endoftext|>b", "x" * 30_000, " " * 25_000 + "y", "it's we'll 123"):
        assert tokens.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts, window):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids, at = np.append(tokens.encode(text), np.uint32(1)), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0


def test_packing_is_a_round_trip(documents, odd, none):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for shard in (4_000_000, 50_000):
        check_pieces(packing.pack(documents, shard_bytes=shard).collect(), texts, 2048)
    odds = packing.pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    check_pieces(odds, {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}, 2048)
    assert packing.pack(odd).where("doc_id is null").count() >= 2
    assert packing.pack(none).count() == 0


def test_neighbours_share_the_seeds_words():
    rnd = np.random.default_rng(5)
    topics = [rnd.choice(np.arange(k * 1000, k * 1000 + 200), (6, 150)).astype(np.uint32) for k in range(1, 6)]
    documents = [np.append(d, np.uint32(1)) for t in zip(*topics) for d in t]
    index = packing.Index(documents, common=0.5)
    used = np.zeros(len(documents), bool)
    used[0] = used[5] = True
    found = index.neighbours(0, used)
    assert set(found[:4]) <= {10, 15, 20, 25} and 5 not in found

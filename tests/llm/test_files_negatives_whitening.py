"""Token files, hard negatives and whitening against plain twins."""

import tempfile
import zlib
from collections import Counter
from decimal import Decimal, getcontext

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stacklore.llm import hard_negatives, queries, token_files, whitening
from stacklore.llm.common import stored
from stacklore.llm.perfect_hash import PerfectHash, fingerprints

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def folder():
    return tempfile.mkdtemp(prefix="stacklore-test-") + "/files"


def plain(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- minimal perfect hash ----------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_is_minimal_and_small(n):
    r = np.random.default_rng(n)
    a, b = r.integers(0, 2**63, n, np.uint64), r.integers(0, 2**63, n, np.uint64)
    made = PerfectHash.build(a, b)
    again = PerfectHash.from_bytes(made.to_bytes())
    assert sorted(again.slots(a, b)) == list(range(n))
    if n >= 1000:
        assert len(made.to_bytes()) * 8 < 5 * n
        # keys that were not stored meet another key's fingerprint about once in 2**32
        x, y = r.integers(0, 2**63, n, np.uint64), r.integers(0, 2**63, n, np.uint64)
        slots, stored_ = made.slots(x, y), np.zeros(n, np.uint32)
        stored_[made.slots(a, b)] = fingerprints(a, b)
        assert not ((slots >= 0) & (stored_[slots] == fingerprints(x, y))).any()


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64), np.array([7, 7], np.uint64))


# --- token files ---------------------------------------------------------------------


def test_encoder_equals_the_library():
    odd = ["", " ", "a  b\n\nc\t d", "Don't WE'LL o'clock", "x<|endoftext|>y <|startoftext|>", "é ́a  b c\x1cd", "ÀÉ İ ΑΣ ß", "漢字かな交じり" * 30, "word" * 500, "a.b,c;;;d!?", "...", "\u0000x", "foo.́"]
    odd += ["<|ENDOFTEXT|> Plain", "plain Words, AND more;of THEM", "Über ÀÉÎ, straße. ÿþ µm ªº ÐÞ×÷ " + "".join(map(chr, range(0xA0, 0x180))), " ".join(chr(c) + "x" for c in range(0xA0, 0x250))]
    encoder = token_files.Encoder(WORDS)
    width = np.dtype(f"<u{encoder.width}")
    for _ in range(2):  # the second time from what was kept
        assert [np.frombuffer(x, width).tolist() for x in encoder.encode_batch(odd, 2)] == plain(odd)


def test_encoder_forgets_and_still_knows(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 5)
    texts = ["one two three four five six seven", "one eight nine", "two ten eleven one"]
    encoder = token_files.Encoder(WORDS)
    got = [np.frombuffer(encoder.encode_batch([t], 2)[0], "<u2").tolist() for t in texts]
    assert got == plain(texts) and len(encoder) < 12


def test_round_trip_of_the_documents(spark):
    found = {r.doc_id: r for r in queries.op11_token_files(spark, DATA).collect()}
    rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for (doc_id, _), ids in zip(rows, plain([r.text for r in rows]), strict=True):
        r = found.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), digest(ids))
        start += len(ids)
    assert not found


def test_small_shards_repeated_and_null_ids(spark, odd, monkeypatch):
    """Shards of a few hundred bytes: copies of one id go on over shards; null ids come last."""
    same = spark.createDataFrame([(7, "copy " * 40 + str(i // 2)) for i in range(60)] + [(2**60 + 1, "far away")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(same).repartition(5)
    path = folder()
    token_files.write(docs, path, WORDS, 2, shard_bytes=300)
    directory = stored(token_files.shards(spark, path))
    assert directory.count() > 15
    index = stored(token_files.build_index(directory))
    back = token_files.read(token_files.locate(token_files.keys_of(docs), index), directory).collect()
    monkeypatch.setattr(token_files, "_in_parts", lambda path: False)
    whole = token_files.read(token_files.locate(token_files.keys_of(docs), index), stored(token_files.shards(spark, path))).collect()
    assert Counter(whole) == Counter(back)
    texts = {}
    for doc_id, text in docs.collect():
        texts.setdefault(doc_id, []).append(text)
    assert len(back) == docs.count()
    for doc_id, own in texts.items():
        rows = [r for r in back if r.doc_id == doc_id]
        assert sorted(r.copy for r in rows) == list(range(len(own)))
        assert Counter(r.ids for r in rows) == Counter(np.array(x, "<u4").tobytes() for x in plain(own))
    ordered = sorted(back, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in back), key=lambda x: (x is None, x or 0))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n


def test_one_key_and_absent_keys(spark, odd):
    path = folder()
    token_files.write(odd, path, WORDS, 2)
    directory = stored(token_files.shards(spark, path))
    index = stored(token_files.build_index(directory))
    assert token_files.get(index, directory, 8) == plain(["One"])[0]
    assert token_files.get(index, directory, 5) == [2]
    assert token_files.get(index, directory, 2, copy=1) == token_files.get(index, directory, 2)
    assert token_files.get(index, directory, 2, copy=2) is None and token_files.get(index, directory, 999) is None
    assert token_files.locate(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy")), index).count() == 0


def test_numbers_of_files(spark):
    """The name of the job that Spark puts into a file's name may look like a file's number."""
    names = ["file:/a/part-00002-7d4b0c1e-c123-4c55-9c01-c4567890abcd-c011.txt", "file:/part-1-c9/part-00000-aaaaaaaa-bbbb-c000-dddd-eeeeeeeeeeee-c000.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r[0] for r in df.select(token_files.shard_number(F.col("path"))).collect()] == [2_000_011, 0]


def test_token_files_of_nothing(spark, none):
    assert token_files.round_trip(none, folder(), WORDS, 2).collect() == []


# --- hard negatives ------------------------------------------------------------------


def naive_negatives(rows, is_anchor, positives=5, negatives=3):
    """rows: (vec_id, label, ints); everything by loops."""
    out = []
    for a, label, x in rows:
        if not is_anchor(a):
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y, strict=True))  # noqa: B023, E731
        near = sorted(((-score(y), i) for i, l, y in rows if i != a and l == label and len(y) == len(x)))[:positives]
        for s, p in near:
            fit = sorted((-score(y), i) for i, l, y in rows if i != a and l != label and len(y) == len(x) and 50 * -s <= 100 * score(y) <= 95 * -s)
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    """Ties, zero and opposite vectors, nulls, other lengths, repeated rows, clashing names."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1] + 0.4).round(2).tolist(), int(i % 3)) for i in range(120)]
    rows += [(200 + i, rows[0][1], i % 3) for i in range(40)]
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (304, [0.0] * 6, 0), (305, [1.0] * 6, None)]
    rows += [(None, [1.0] * 6, 1), (306, [1.0, 2.0], 1), (307, [2.0, 1.0], 1), (308, [1.5, 1.0], 2), (309, [], 2), (310, [-1.0] * 6, 2), (7, rows[7][1], 1)]
    return spark.createDataFrame([(*x, 5, 6.0) for x in rows], "vec_id long, embedding array<double>, label int, dims int, x double")


@pytest.mark.parametrize("blocks", [(512, 8192), (7, 13)])
def test_hard_negatives_equal_loops(vectors, blocks):
    found = hard_negatives.mine(vectors, F.col("vec_id") % 5 == 0, F.col("label"), anchor_block=blocks[0], candidate_block=blocks[1])
    rows = [(r.vec_id, r.label, tuple(r.x)) for r in hard_negatives.usable(vectors, F.col("label"), "vec_id", "embedding", 256.0).collect()]
    assert sorted(map(tuple, found.collect())) == naive_negatives(rows, lambda i: i % 5 == 0)


def test_hard_negatives_equal_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    found = queries.op12_hard_negatives(spark, DATA)
    its = c.sql(hard_negatives.sql()).df()
    assert sorted(map(tuple, found.select(*its.columns).collect())) == sorted(its.itertuples(index=False, name=None))


def test_bounds_drop_pairs_and_lose_none():
    """On vectors with a few long axes most pairs are never multiplied in full."""
    r = np.random.default_rng(1)
    x = (r.normal(size=(900, 32)) * 0.7 ** np.arange(32) * 256).astype(np.int64) @ np.linalg.qr(r.normal(size=(32, 32)))[0]
    x = np.floor(x * 16).astype(np.int64)
    axes, steps = hard_negatives.axes_and_steps((x.T @ x).astype(float))
    assert len(steps) == 3 and steps[0] < 10
    ids = np.arange(900)
    a = hard_negatives.Rotated(ids[:60], ids[:60], x[:60], axes, steps)
    b = hard_negatives.Rotated(ids, ids, x, axes, steps)
    every = np.full((60, 1), np.inf)
    i, _, j, scores, pairs = hard_negatives.best_in_range(a, b, ids[:60, None] != ids[None], -every, every, 5)
    full = x[:60] @ x.T
    full[np.arange(60), np.arange(60)] = -(2**62)
    want = [(q, c, full[q, c]) for q in range(60) for c in np.lexsort((ids, -full[q]))[:5]]
    assert list(zip(i, j, scores, strict=True)) == want
    assert pairs < 0.05 * 60 * 900


def test_hard_negatives_of_nothing(vectors):
    assert hard_negatives.mine(vectors.limit(0), F.lit(True), F.col("label")).collect() == []


# --- whitening -----------------------------------------------------------------------


def test_error_free_steps():
    getcontext().prec = 200
    r = np.random.default_rng(0)
    a, b = r.normal(size=500) * 10.0 ** r.integers(-8, 8, 500), r.normal(size=500) * 10.0 ** r.integers(-8, 8, 500)
    for f, exact in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        for x, y, hi, lo in zip(a, b, *f(a, b), strict=True):
            assert Decimal(float(hi)) + Decimal(float(lo)) == exact(Decimal(float(x)), Decimal(float(y)))
    hi, lo = whitening.total((np.r_[1e17, a, -1e17, b], np.zeros(1002)))
    exact = sum((Decimal(float(x)) for x in np.r_[a, b]), Decimal(0))
    assert abs(Decimal(float(hi)) + Decimal(float(lo)) - exact) < abs(exact) * Decimal(1e-14)


def exact_model(x):
    n, s = len(x), [sum(int(v) for v in c) for c in x.T]
    d = [[n * int(v) - t for v, t in zip(row, s, strict=True)] for row in x]
    cov = [[float(Decimal(sum(r[i] * r[j] for r in d)) / Decimal(n) ** 3) for j in range(len(s))] for i in range(len(s))]
    return n, [sum(v * v for v in row) for row in d], np.array(d, float) / n, np.array(cov)


def test_whitening_equals_exact_arithmetic(spark):
    found = queries.op13_whitening(spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.array(e["embedding"].tolist(), np.float64)).astype(np.int64) + 1_000_000
    n, deviation, centred, cov = exact_model(x)
    values, axes = np.linalg.eigh(cov)
    wide = found.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert wide.shape == (n, 32) and (found["n"] == n).all()
    assert found.groupby("vec_id")["deviation"].first().sort_index().tolist() == deviation
    for k in range(32):
        want = centred @ axes[:, -1 - k] / np.sqrt(values[-1 - k])
        assert min(np.abs(wide[:, k] - want).max(), np.abs(wide[:, k] + want).max()) < 1e-7
        assert np.allclose(found[found["component"] == k + 1]["explained"], values[-1 - k] / np.trace(cov), rtol=1e-10)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def test_whitening_of_odd_tables(spark, vectors):
    found = whitening.whiten(vectors.withColumn("embedding", F.transform("embedding", lambda v: v * 1e4)))
    whole = vectors.where("embedding is not null and not exists(embedding, v -> v is null or isnan(v) or v = double('inf'))")
    assert found.count() == whole.select(F.sum(F.size("embedding"))).first()[0]
    assert found.where("vec_id is null").count() == 6 and found.where("vec_id = 7").count() == 12
    assert found.where("component <= 6 and n > 3").agg(F.max("identity_error")).first()[0] < 1e-6
    one = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 1.0), (2, 1, 0, 0.0, 0.0, 1.0)]
    assert whitening.whiten(vectors.limit(0)).collect() == []


def test_parts_are_merged_in_groups(spark, monkeypatch):
    """As many groups of tasks as the table has: the result does not depend on them."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    once = whitening.fit(whitening.integers(rows.coalesce(1), "vec_id", "embedding", 64.0, 10**6), 32)[64]
    monkeypatch.setattr(whitening, "TASKS", 3)
    parts = whitening.fit(whitening.integers(rows.repartition(14), "vec_id", "embedding", 64.0, 10**6), 32)[64]
    assert (once.n, once.sums) == (parts.n, parts.sums) and np.allclose(once.variances, parts.variances, rtol=1e-13)

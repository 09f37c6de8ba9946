"""Indexes over vectors: codes, recall, blocks, calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklore.operators import search, vector_index

DATA = "/root/testdata/sf0.01/embeddings.parquet"


@pytest.fixture(scope="module")
def store(spark):
    return spark.read.parquet(DATA).cache()


@pytest.fixture(scope="module")
def clustered(spark):
    """Two thousand vectors around forty directions, and some that are no vectors."""
    r = np.random.default_rng(5)
    hubs = r.normal(size=(40, 32))
    rows = [(i, (hubs[i % 40] + 0.4 * r.normal(size=32)).tolist()) for i in range(2000)]
    rows += [(3000, None), (3001, [0.0] * 32), (3002, [float("nan")] * 32), (3003, [1.0, None] * 16), (3004, [1.0] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()


@pytest.mark.parametrize("kind", vector_index.KINDS)
def test_calibrated_recall(store, kind):
    """All rows whose id is divisible by 100 against all rows, as in production: at least 0.9 of the ten nearest."""
    asked = store.where("vec_id % 100 = 0")
    index = vector_index.train(store, kind)
    codes = vector_index.encode(store, index).cache()
    index = vector_index.calibrate(index, codes, store)
    exact = search.top_k_batch(asked, store, 10)
    assert vector_index.recall(vector_index.search(asked, codes, store, index, 10), exact) >= 0.9


def test_few_probes_do_where_vectors_lie_in_groups(clustered):
    index = vector_index.train(clustered, "ivf-pq", cells=64, runs=8)
    codes = vector_index.encode(clustered, index).cache()
    assert codes.count() == 2000 and codes.agg(F.max(F.octet_length("code"))).first()[0] == 8
    found = vector_index.calibrate(index, codes, clustered.where("vec_id < 3000"))
    assert found.probes < len(index.centres)
    asked = clustered.where("vec_id % 100 = 0")
    hits = vector_index.search(asked, codes, clustered, found, 10)
    assert vector_index.recall(hits, search.top_k_batch(clustered.where("vec_id % 100 = 0 and vec_id < 3000"), clustered.where("vec_id < 2000"), 10)) >= 0.9
    assert hits.where("query_id >= 3000 or id >= 3000 or query_id = id").count() == 0


def test_products_are_those_of_the_decoded_codes():
    r = np.random.default_rng(2)
    unit = vector_index.unit_rows(r.normal(size=(300, 8)), 8)
    asked = vector_index.unit_rows(r.normal(size=(7, 8)), 8)
    pieces = np.stack([vector_index._means(unit.reshape(300, 4, 2)[:, i], 256) for i in range(4)])
    pq = vector_index.Index("ivf-pq", unit[:3], pieces)
    codes = pq.codes(unit)
    decoded = np.concatenate([pieces[i][codes[:, i]] for i in range(4)], axis=1)
    assert np.allclose(pq.products(asked, codes), asked @ decoded.T)
    sq = vector_index.Index("ivf-sq", unit[:3], low=float(unit.min()), high=float(unit.max()))
    assert np.abs(sq.products(asked, sq.codes(unit)) - asked @ unit.T).max() < 0.02
    flat = vector_index.Index("ivf-flat", unit[:3])
    assert np.allclose(flat.products(asked, flat.codes(unit)), asked @ unit.T, atol=1e-6)


def test_blocks_of_a_cell_change_nothing(clustered, monkeypatch):
    index = vector_index.train(clustered, "ivf-sq", cells=2)
    codes = vector_index.encode(clustered, index)
    asked = clustered.where("vec_id % 50 = 0")
    whole = vector_index.search(asked, codes, clustered, index, 5).collect()
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 100)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_index, "SCORES", 300)
    assert sorted(vector_index.search(asked, codes, clustered, index, 5).collect()) == sorted(whole)


def test_saved_and_loaded(spark, clustered, tmp_path):
    index = vector_index.train(clustered, "ivf-pq", runs=8)
    vector_index.save(index, spark, str(tmp_path / "index"))
    again = vector_index.load(spark, str(tmp_path / "index"))
    assert again.kind == index.kind and np.array_equal(again.centres, index.centres) and np.array_equal(again.pieces, index.pieces) and again.refine == index.refine


def test_nothing_to_learn_from(clustered):
    with pytest.raises(ValueError):
        vector_index.train(clustered.limit(0), "ivf-pq")
    with pytest.raises(ValueError):
        vector_index.train(clustered, "ivf-hnsw-pq")


def test_a_block_of_distances_is_bounded(store, monkeypatch):
    asked = store.where("vec_id % 50 = 0")
    whole = sorted(tuple(r) for r in search.top_k_batch(asked, store, 5).collect())
    monkeypatch.setattr(search, "DISTANCES", 1000)
    assert sorted(tuple(r) for r in search.top_k_batch(asked, store, 5, query_block=4).collect()) == whole


def test_ranking_every_code_again_makes_no_pairs(store):
    """Where all probed rows are ranked again, only k rows of each query and block leave a task."""
    asked = store.where("vec_id % 100 = 0")
    index = vector_index.train(store, "ivf-sq")
    codes = vector_index.encode(store, index).cache()
    hits = vector_index.search(asked, codes, store, index, 5, probes=len(index.centres), refine=store.count())
    assert hits._jdf.queryExecution().executedPlan().toString().count("Window ") == 1  # none over the pairs
    assert sorted(tuple(r) for r in hits.collect()) == sorted(tuple(r) for r in search.top_k_batch(asked, store, 5).collect())

"""Several tables published at once: whole or not at all."""

import pytest
from pyspark.sql import functions as F

from stacklore.library import Library, Profile
from stacklore.operators import versions

KIND = "doc_id long, shelf long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, str(tmp_path / "store"), partition="shelf")


def rows(spark, *pairs):
    return spark.createDataFrame([(i, i // 10, v) for i, v in pairs], KIND)


def seen(store, name, version=None):
    return sorted(tuple(r) for r in store.read(name, version).select("doc_id", "v").collect())


def test_layers_replace_rows_by_key(spark, store):
    assert store.version() == 0 and store.tables() == []
    a, b = rows(spark, (1, "a"), (2, "b"), (11, "c")), rows(spark, (1, "x"), (1, "y"))
    assert store.publish({"nodes": a, "chunks": b}, a) == 1
    assert store.publish({"nodes": rows(spark, (2, "B"))}, spark.createDataFrame([(2,), (11,), (None,)], "doc_id long"), stamps={"model": "m"}) == 2
    assert seen(store, "nodes") == [(1, "a"), (2, "B")] and seen(store, "chunks") == [(1, "x"), (1, "y")]
    assert seen(store, "nodes", 1) == [(1, "a"), (2, "b"), (11, "c")] and store.stamps() == {"model": "m"} and store.stamps(1) == {}
    store.publish({"nodes": rows(spark, (11, "C"))})
    assert seen(store, "nodes") == [(1, "a"), (2, "B"), (11, "C")]


def test_death_between_tables_leaves_the_old_version(spark, store):
    store.publish({"nodes": rows(spark, (1, "a")), "chunks": rows(spark, (1, "x"))})
    dies = rows(spark, (1, "z")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.publish({"nodes": rows(spark, (1, "new")), "chunks": dies}, rows(spark, (1, "")))
    assert store.version() == 1 and seen(store, "nodes") == [(1, "a")] and seen(store, "chunks") == [(1, "x")]
    store.publish({"nodes": rows(spark, (1, "new")), "chunks": rows(spark, (1, "z"))}, rows(spark, (1, "")))
    assert seen(store, "nodes") == [(1, "new")] and seen(store, "chunks") == [(1, "z")]
    assert len(store.vacuum(keep=1)) == 1  # what the dead job left
    assert seen(store, "nodes") == [(1, "new")]


def test_the_slower_of_two_writers_is_refused(spark, store):
    begun = store.publish({"nodes": rows(spark, (1, "a"))})
    store.publish({"nodes": rows(spark, (2, "b"))}, expected=begun)
    with pytest.raises(versions.Conflict):
        store.publish({"nodes": rows(spark, (3, "c"))}, expected=begun)
    assert seen(store, "nodes") == [(1, "a"), (2, "b")]


def test_layers_are_folded(spark, store, monkeypatch):
    monkeypatch.setattr(versions, "MOST_LAYERS", 3)
    for i in range(5):
        store.publish({"nodes": rows(spark, (i, str(i)), (100, f"last {i}"))}, rows(spark, (i, ""), (100, "")))
    assert len(store.manifest()["layers"]) <= 3
    assert seen(store, "nodes") == [*((i, str(i)) for i in range(5)), (100, "last 4")]
    newest = store.version()
    store.vacuum(keep=1)
    assert store.version() == newest and len(seen(store, "nodes")) == 6
    with pytest.raises(Exception):
        store.read("nodes", 1).collect()


@pytest.fixture
def library(spark, tmp_path):
    out = Library(spark, str(tmp_path / "lib"))
    docs = spark.createDataFrame([(i, f"# Head {i}\nwords of book {i} about {'owls' if i % 2 else 'wrens'}", f"Book {i}") for i in (1, 2, 3, 1500)], "doc_id long, text string, title string")
    out.ingest(docs, F.when(F.col("line").rlike("^# "), 1))
    return out


def test_embedding_again(spark, library):
    """Of one, of some, and of those that another model made; nodes and other chunks stay as they were."""
    before = {(r.doc_id, r.chunk_sha256): list(r.embedding) for r in library.table("chunks").collect()}
    nodes = library.table("nodes").count()
    other = Library(spark, library.path, Profile(model="hashing-2"))
    assert sorted(r.doc_id for r in other.stale().collect()) == [1, 2, 3, 1500]
    assert other.reembed([2]) == 1
    assert sorted(r.doc_id for r in other.stale().collect()) == [1, 3, 1500]
    assert other.reembed([2, 3, 77]) == 2
    assert other.reembed() == 2 and other.reembed() == 0  # what is stale, then nothing
    assert other.stale().count() == 0 and library.stale().count() == 4
    after = {(r.doc_id, r.chunk_sha256): list(r.embedding) for r in other.table("chunks").collect()}
    assert after == before and other.table("nodes").count() == nodes  # the same stand-in model by another name


def test_another_dimension_needs_all_items(spark, library):
    wider = Library(spark, library.path, Profile(dim=128))
    with pytest.raises(ValueError, match="dim"):
        wider.reembed([1])
    assert wider.reembed() == 4
    assert {len(r.embedding) for r in wider.table("chunks").collect()} == {128}
    with pytest.raises(ValueError, match="dim"):
        library.search("owls")


def test_search_by_an_index(spark, tmp_path):
    """The index finds what it has, rows that came later are searched as they are, and rows that went do not come back."""
    library = Library(spark, str(tmp_path / "lib"), Profile(index="ivf-pq", sub_vectors=16))
    level = F.when(F.col("line").rlike("^# "), 1)
    book = lambda i, words: (i, f"# Head {i}\n{words}", f"Book {i}")
    docs = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string, title string")
    library.ingest(docs(*[book(i, f"number {i} speaks of thing{i} and of thing{i + 1}") for i in range(40)]), level)
    with pytest.raises(ValueError, match="index"):
        library.search("thing7")
    library.build_index()
    assert library.index_status().first().asDict() == {"rows": 40, "indexed": 40, "unindexed": 0, "stale": 0}
    exact = Library(spark, library.path).search("number 7 speaks of thing7 and of thing8", 5).select("start_node_id", "distance").collect()
    assert library.search("number 7 speaks of thing7 and of thing8", 5).select("start_node_id", F.round("distance", 9).alias("distance")).collect() == [(r[0], round(r[1], 9)) for r in exact]
    library.ingest(docs(book(7, "other words altogether"), book(99, "number 7 speaks of thing7 and of thing8")), level)
    assert library.index_status().first().asDict() == {"rows": 41, "indexed": 39, "unindexed": 2, "stale": 1}
    found = library.search("number 7 speaks of thing7 and of thing8", 3).collect()
    assert found[0].doc_id == 99 and 7 not in {r.doc_id for r in found}
    assert {r.doc_id for r in library.search("number thing8", 3, exclude=(99, 8)).collect()}.isdisjoint({99, 8})
    assert [r.doc_id for r in library.search("number", 1, doc_id=12).collect()] == [12]


def test_a_draft_is_published_where_it_lies(spark, store):
    store.publish({"nodes": rows(spark, (1, "old"), (2, "old"))})
    draft = store.draft()
    assert draft.put("nodes", rows(spark, (1, "new"))).count() == 1
    assert sorted(r[0] for r in draft.put("nodes", rows(spark, (2, "no good"), (3, "c")).unionByName(spark.createDataFrame([(None, 0, "lost")], KIND))).where("doc_id > 0").select("doc_id").collect()) == [1, 2, 3]
    assert store.read("nodes").count() == 2  # nobody sees it yet
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "doc_id long")
    store.publish(draft, ids(1, 3), void=ids(2))
    assert seen(store, "nodes") == [(1, "new"), (2, "old"), (3, "c")]
    store.publish({"nodes": rows(spark, (3, "d"))}, ids(3))
    assert seen(store, "nodes") == [(1, "new"), (2, "old"), (3, "d")]


def test_an_ingest_writes_few_files_for_a_shelf(spark, tmp_path):
    """Each task wrote a file of each shelf that it had a document of, so files grew with tasks times shelves."""
    import glob

    library = Library(spark, str(tmp_path / "lib"))
    docs = spark.range(0, 8000, 40).selectExpr("id as doc_id", "concat('# Head\nwords of ', id) as text", "concat('Book ', id) as title")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        library.ingest(docs, F.when(F.col("line").rlike("^# "), 1))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    count = lambda name: len(glob.glob(f"{library.path}/layers/*/{name}/shelf=*/*.parquet"))
    assert count("chunks") <= 8 * 4 and count("nodes") <= 8 * 5 and count("stamps") == 8
    assert library.table("nodes").count() == 600 and library.table("chunks").count() == 200


def test_chunks_are_numbered_without_another_shuffle(spark):
    from stacklore.operators import chunks

    nodes = spark.createDataFrame([(1, 10 + i, i // 2, i, "word " * 150 + str(i)) for i in range(8)] + [(2, 50, 1, 0, "other")], "doc_id long, node_id long, parent_id long, toc_lo int, text string")
    found = chunks.plan_chunks(nodes)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    own = found.where("doc_id = 1").orderBy("run", "part").collect()
    assert len(own) == 8 and [r.chunk_idx for r in own] == list(range(8)) and found.where("doc_id = 2").first().chunk_idx == 0

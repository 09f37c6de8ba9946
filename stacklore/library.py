"""The library as one object: what a caller asks of the tables in a folder."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, chunks, lexical, search, sequences, sinks, stages, structure, vector_index, versions


#: documents of a shelf, and of a part of one that a task works on: tasks then write few files, however many shelves there are
SHELF, DEAL = 1000, 250


@dataclass(frozen=True)
class Profile:
    """How a library is indexed and searched."""

    model: str = "hashing"
    dim: int = 64
    index: str = "brute-force"
    sub_vectors: int = 0
    reranker: str | None = None
    top_k_in: int = 50
    top_k_out: int = 10

    def problems(self) -> list[str]:
        out = []
        if self.dim <= 0:
            out.append("dim must be positive")
        if self.index not in ("brute-force", *vector_index.KINDS):
            out.append(f"unknown index {self.index}")
        if self.index.endswith("pq"):
            if self.sub_vectors <= 0 or self.dim % max(1, self.sub_vectors):
                out.append("sub_vectors must divide dim")
            elif self.dim // self.sub_vectors > 8:
                out.append("sub_vectors leave more than 8 components each")
        if self.reranker is not None and not self.top_k_in >= self.top_k_out > 0:
            out.append("top_k_in must be at least top_k_out, and that positive")
        return out


class Embedder(Protocol):
    """Gives rows a column embedding (array<float>, dims long) of what is in their column text."""

    def __call__(self, rows: DataFrame, text: str, dims: int) -> DataFrame: ...


class Scorer(Protocol):
    """How well a text answers a query: the column by which reranking sorts, highest first."""

    def __call__(self, text: Column, query: str) -> Column: ...


def _shelf() -> Column:
    return F.floor(F.col("doc_id") / SHELF).cast("long").alias("shelf")


def _good(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id) of items that no stage refused, and of those that have no such row."""
    good = report.where("failed_at is null").select("doc_id").distinct()
    return good, report.where("failed_at is not null").select("doc_id").join(good, "doc_id", "left_anti").distinct()


@dataclass
class Library:
    """Books of one folder: nodes, chunks with vectors, items and their curation.

    Nodes, chunks and stamps of an item change together (see versions.Store); they carry
    doc_id and are partitioned by runs of 1,000 documents, so a search in one book reads one
    partition of each layer.
    """

    spark: SparkSession
    path: str
    profile: Profile = field(default_factory=Profile)
    embedder: Embedder = search.hash_vectors
    scorer: Scorer = search.lexical_score

    @property
    def store(self) -> versions.Store:
        return versions.Store(self.spark, self.path, "doc_id", "shelf")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.store.read(name, version)

    def _print(self) -> Column:
        p = self.profile
        return sinks.fingerprint(p.model, p.dim, chunks.CHUNK_VERSION, 1, "")

    def _checked(self) -> None:
        if bad := self.profile.problems():
            raise ValueError("; ".join(bad))

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """rows with their vectors; a vector of another length than the profile's fails the job."""
        found, size = self.embedder(rows, "text", self.profile.dim), F.size("embedding")
        wrong = F.raise_error(F.concat(F.lit("a vector of another length than the profile's: "), size.cast("string")))
        return found.withColumn("embedding", F.when(size == self.profile.dim, F.col("embedding")).otherwise(wrong))

    def plan(self, docs: DataFrame, blocks: DataFrame, toc: DataFrame, draft: versions.Draft | None = None) -> dict[str, DataFrame]:
        """Nodes, chunks and stamps of documents (doc_id, title) from their blocks, as ingest would publish them; written to draft, if there is one."""
        by = F.floor(F.col("doc_id") / DEAL)
        kept = None if draft is None else lambda rows: draft.put("nodes", rows.select("*", _shelf()), deal="path" not in rows.columns)
        nodes = structure.plan_tree(blocks, toc, docs.select("doc_id", "title"), whole=True, kept=kept, by=by)  # stored there
        found = self._embedded(chunks.plan_chunks(nodes, by)).select("*", _shelf())
        stamps = docs.select("doc_id", _shelf(), self._print().alias("fingerprint")).where("doc_id is not null").distinct()
        if draft is not None:
            return {"nodes": nodes, "chunks": draft.put("chunks", found), "stamps": draft.put("stamps", stamps, deal=True)}
        return {"nodes": nodes.select("*", _shelf()), "chunks": found, "stamps": stamps}

    def ingest(self, docs: DataFrame, level) -> int:
        """Structure, chunk and embed documents (doc_id, text, title); the number of the version that has them.

        Those that are there already are replaced, all others stay as they are, on the same
        shelf too; only what comes in is chunked, embedded and written. Readers see all of it or
        nothing, and a writer who began before another published is refused.
        """
        self._checked()
        begun = self.store.version()
        self._same_dim(begun)
        blocks = structure.text_blocks(docs, level)
        draft = self.store.draft()
        self.plan(docs, blocks, structure.contents_of(blocks), draft)
        return self.store.publish(draft, docs.select("doc_id"), begun, {"dim": self.profile.dim})

    # --- from files, by stages ----------------------------------------------------

    def dry_run(self, items: DataFrame, level, extractors: dict | None = None) -> DataFrame:
        """The report of what ingest_files would do with items (doc_id, name, content); nothing of the library is read or written."""
        return self._planned(stages.extract(items, extractors), level).report()

    def ingest_files(self, items: DataFrame, level, extractors: dict | None = None) -> DataFrame:
        """Extract, structure, audit, chunk and embed items (doc_id, name, content); the report, a row for each item.

        What can be read is published as one version with its envelopes and audits; what
        cannot is a row of the report and leaves what the library has of it alone.
        """
        self._checked()
        begun = self.store.version()
        self._same_dim(begun)
        draft = self.store.draft()
        # files come in any order, so envelopes are not dealt to shelves
        written = lambda rows: draft.put("envelopes", rows.select("*", _shelf(), F.lit(stages.EXTRACTOR_VERSION).alias("version")), split=False)
        planned = self._planned(stages.extract(items, extractors, written), level, draft=draft)
        report = sinks.stored(planned.report())
        good, bad = _good(report)
        self.store.publish(draft, good, begun, {"dim": self.profile.dim}, bad)
        return report

    def _planned(self, extracted: DataFrame, level, overrides: DataFrame | None = None, draft: versions.Draft | None = None) -> stages.Planned:
        blocks = stages.blocks_of(extracted, level)
        toc = stages.contents_of(extracted, blocks)
        audits = stages.audit(extracted, blocks, toc, overrides)
        audits = sinks.stored(audits) if draft is None else draft.put("audits", audits.select("*", _shelf()), deal=True)
        titles = extracted.where("outcome = 'extracted' and doc_id is not null").select("doc_id", F.coalesce("title", stages.file_stem(F.col("name"))).alias("title"))
        return stages.Planned(extracted, blocks, toc, audits, self.plan(titles, blocks, toc, draft))

    def rebuild(self, items: DataFrame, level, only: list[int] | None = None, version: int | None = None, dry: bool = False) -> DataFrame:
        """(doc_id, bucket, error) of items (doc_id, source_sha256) whose nodes and chunks are made again from their envelopes.

        Buckets: rebuilt, missing (no envelope), mismatched (of another file) or failed. only
        picks items, version those whose envelopes are of another extractor version. dry only says
        what would be done. What is rebuilt is published as one version, all else stays as it is.
        """
        self._checked()
        begun = self.store.version()
        wanted = items if only is None else items.where(F.col("doc_id").isin(only))
        found = self.table("envelopes", begun)
        if version is not None:
            wanted = wanted.join(found.where(F.col("version") != version).select("doc_id"), "doc_id", "left_semi")
        own = found.select("doc_id", F.struct(F.col("source_sha256").alias("sha"), ((F.col("outcome") == "extracted") & (F.size("blocks") > 0)).alias("ok")).alias("e"))
        bucket = F.when(F.col("e").isNull(), "missing").when(~F.col("e.sha").eqNullSafe(F.col("source_sha256")), "mismatched").when(~F.coalesce("e.ok", F.lit(False)), "failed").otherwise("rebuilt")
        sorted_ = sinks.stored(wanted.join(own, "doc_id", "left").select("doc_id", bucket.alias("bucket")))
        todo = sorted_.where("bucket = 'rebuilt'").select("doc_id")
        if todo.isEmpty():
            return sorted_.withColumn("error", F.lit(None).cast("string"))
        draft = None if dry else self.store.draft()
        planned = self._planned(sinks.among(found, todo, "doc_id"), level, draft=draft)
        report = sinks.stored(planned.report()).select("doc_id", F.col("failed_at"), "error")
        if not dry:
            self._same_dim(begun)
            good, bad = _good(report)
            self.store.publish(draft, good, begun, void=bad)
        told = sorted_.join(report, "doc_id", "left")
        return told.select("doc_id", F.when(F.col("failed_at").isNotNull(), "failed").otherwise(F.col("bucket")).alias("bucket"), "error")

    def reaudit(self, level, overrides: DataFrame | None = None, only: list[int] | None = None, dry: bool = False) -> DataFrame:
        """(doc_id, old and new verdict and confidence, changed, outcome): items audited again from their envelopes under curated values.

        Only the audits change, as one version; outcome is ok for a clean verdict, else partial.
        """
        begun = self.store.version()
        envelopes = self.table("envelopes", begun)
        envelopes = envelopes if only is None else envelopes.where(F.col("doc_id").isin(only))
        blocks = stages.blocks_of(envelopes, level)
        new = sinks.stored(stages.audit(envelopes, blocks, stages.contents_of(envelopes, blocks), overrides))
        old = self.table("audits", begun).select("doc_id", F.col("verdict").alias("old_verdict"), F.col("confidence").alias("old_confidence"))
        told = new.select("doc_id", "verdict", "confidence").join(old, "doc_id", "left").select(
            "doc_id", "old_verdict", "old_confidence", "verdict", "confidence",
            (~(F.col("verdict").eqNullSafe(F.col("old_verdict")) & F.col("confidence").eqNullSafe(F.col("old_confidence")))).alias("changed"),
            F.when(F.col("verdict") == "clean", "ok").otherwise("partial").alias("outcome"),
        )
        told = sinks.stored(told)
        if not dry:
            self.store.publish({"audits": new.select("*", _shelf()).repartition("shelf")}, new.select("doc_id"), begun)
        return told

    def audits(self, confidence: str | None = None, verdict: str | None = None) -> DataFrame:
        """Audits of all items; of one confidence, or one verdict."""
        out = self.table("audits")
        out = out if confidence is None else out.where(F.col("confidence") == confidence)
        return out if verdict is None else out.where(F.col("verdict") == verdict)

    # --- vectors ------------------------------------------------------------------

    def _same_dim(self, version: int) -> None:
        have = self.store.stamps(version).get("dim", self.profile.dim)
        if have != self.profile.dim:
            raise ValueError(f"the vectors have dim {have}, the profile {self.profile.dim}")

    def stale(self) -> DataFrame:
        """(doc_id) of items whose vectors another model or another way of chunking made."""
        return self.table("stamps").where(F.col("fingerprint") != self._print()).select("doc_id")

    def reembed(self, only: list[int] | None = None) -> int:
        """Embed the chunks of some items again, or of all that are stale; how many items that were.

        Nodes stay as they are. Vectors of another dim can only come in for all items at once.
        """
        self._checked()
        begun = self.store.version()
        stamps = self.table("stamps", begun)
        todo = stamps.where(F.col("doc_id").isin(only)) if only is not None else stamps.where(F.col("fingerprint") != self._print())
        todo = sinks.stored(todo.select("doc_id", "shelf"))
        if (n := todo.count()) == 0:
            return 0
        if n < stamps.count():
            self._same_dim(begun)
        old = self.table("chunks", begun).drop("embedding").join(todo.select("doc_id"), "doc_id", "left_semi")
        new = {"chunks": self._embedded(old), "stamps": todo.withColumn("fingerprint", self._print())}
        self.store.publish(new, todo, begun, {"dim": self.profile.dim})
        return n

    # --- the index --------------------------------------------------------------

    def _keyed(self, version: int | None = None) -> DataFrame:
        """Chunks with a key that says which chunk of which text they are."""
        return self.table("chunks", version).withColumn("chunk_key", F.xxhash64("doc_id", "chunk_idx", "chunk_sha256"))

    def build_index(self, recall: float = 0.95) -> vector_index.Index:
        """Learn an index of the profile's kind from the chunks as they are, and calibrate it to find recall of the ten nearest."""
        self._checked()
        if self.profile.index == "brute-force":
            raise ValueError("the profile asks for no index")
        rows = self._keyed()
        names = {"id_column": "chunk_key", "column": "embedding"}
        made = vector_index.train(rows, self.profile.index, runs=self.profile.sub_vectors, **names)
        vector_index.encode(rows, made, **names).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/index/codes")
        made = vector_index.calibrate(made, self._codes(), rows, least=recall, **names)
        vector_index.save(made, self.spark, f"{self.path}/index/model")
        return made

    def _codes(self) -> DataFrame:
        return self.spark.read.schema("id long, code binary, cell int").parquet(f"{self.path}/index/codes")

    def index_status(self) -> DataFrame:
        """One row: chunks, how many the index has and lacks, and codes whose chunk is gone."""
        return vector_index.status(self._keyed(), self._codes(), "chunk_key")

    def _nearest(self, store: DataFrame, vector: list[float], k: int, partly: bool) -> DataFrame:
        """The k nearest rows by the index; rows that it lacks are searched as they are. partly: store lacks rows that the index has."""
        system, folder = sinks._folder(self.spark, f"{self.path}/index/model")
        if not system.exists(folder):
            raise ValueError("the profile asks for an index, and none was built")
        index, codes = vector_index.load(self.spark, f"{self.path}/index/model"), self._codes()
        if index.kind != self.profile.index:
            raise ValueError(f"the index that was built is {index.kind}")
        asked = self.spark.createDataFrame([(0, vector)], "chunk_key long, embedding array<double>")
        own = codes.join(store.select(F.col("chunk_key").alias("id")), "id", "left_semi") if partly else codes
        hits = vector_index.search(asked, own, store, index, k, "chunk_key").select(F.col("id").alias("chunk_key"))
        later = search.top_k(store.join(codes.select(F.col("id").alias("chunk_key")), "chunk_key", "left_anti"), vector, k, id_column="start_node_id")
        both = store.join(F.broadcast(hits), "chunk_key", "left_semi").unionByName(later.drop("distance"))
        return search.top_k(both, vector, k, id_column="start_node_id")

    def embed(self, text: str) -> list[float]:
        if not text.strip():
            raise ValueError("an empty query has no vector")
        one = self.spark.createDataFrame([(text,)], "text string")
        return list(self._embedded(one).first()["embedding"])

    def search(self, text: str, k: int = 10, doc_id: int | None = None, exclude: tuple[int, ...] = ()) -> DataFrame:
        """The k nearest passages, each with its breadcrumb; in one document, or in all but some."""
        if doc_id is not None and exclude:
            raise ValueError("a search in one document excludes no others")
        self._same_dim(self.store.version())
        store = self._keyed().where(F.exists("embedding", lambda x: x != 0))
        if doc_id is not None:
            store = store.where((F.col("shelf") == doc_id // 1000) & (F.col("doc_id") == doc_id))
        if exclude:
            store = store.where(~F.col("doc_id").isin(list(exclude)))
        most = self.profile.top_k_in if self.profile.reranker else k
        if self.profile.index == "brute-force" or doc_id is not None:  # one document is a partition's part
            hits = search.top_k(store, self.embed(text), most, id_column="start_node_id")
        else:
            hits = self._nearest(store, self.embed(text), most, bool(exclude))
        if self.profile.reranker:
            hits = search.rerank(hits, self.scorer(F.col("text"), text), self.profile.top_k_in, self.profile.top_k_out, k, "start_node_id")
        # only the trees of the documents that were hit are walked
        near = self.table("nodes").join(F.broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")
        crumbs = structure.breadcrumbs(near).select(F.col("node_id").alias("start_node_id"), "breadcrumb")
        ranks = [F.desc("rerank_score")] if self.profile.reranker else []
        return hits.join(crumbs, "start_node_id", "left").orderBy(*ranks, "distance", "start_node_id")  # a join keeps no order

    def build_lexical(self) -> None:
        """Index the words of the chunks as they are."""
        lexical.save(lexical.build(self._keyed(), "chunk_key"), f"{self.path}/lexical")

    def hybrid(self, text: str, k: int = 10, reach: int = 5) -> DataFrame:
        """The k best passages by their ranks among the reach * k nearest by vectors and best by words.

        Words are those of the last build_lexical; passages that went since then are no hits.
        """
        rows = self._keyed()
        vector = self.spark.createDataFrame([(-1, self.embed(text), text)], "chunk_key long, embedding array<double>, text string")
        near = search.top_k_batch(vector, rows.where(F.exists("embedding", lambda x: x != 0)), reach * k, "chunk_key")
        by_words = lexical.search(vector, lexical.load(self.spark, f"{self.path}/lexical"), reach * k, "chunk_key")
        there = by_words.join(rows.select(F.col("chunk_key").alias("id")), "id", "left_semi")
        best = lexical.fuse([near, there], k).select(F.col("id").alias("chunk_key"), "rank", "score")
        return rows.join(F.broadcast(best), "chunk_key").drop("embedding").orderBy("rank")

    def contents(self, doc_id: int, max_depth: int | None = None, title: str | None = None) -> DataFrame:
        out = self.table("nodes").where((F.col("shelf") == doc_id // 1000) & (F.col("doc_id") == doc_id) & F.col("text").isNull())
        if max_depth is not None:
            out = out.where(F.col("depth") <= max_depth)
        if title:
            out = out.where(F.contains(F.lower("title"), F.lit(title.lower())))
        return out.orderBy("toc_lo", "depth", "ordinal").limit(2000)

    def read(self, doc_id: int, from_leaf: int = 0, budget: int = 30_000) -> DataFrame:
        """Leaves from a place on while they fit the budget; the last toc_lo is where to go on."""
        leaves = self.table("nodes").where((F.col("shelf") == doc_id // 1000) & (F.col("doc_id") == doc_id) & F.col("text").isNotNull() & (F.col("toc_lo") >= from_leaf))
        return sequences.within_budget(leaves, "doc_id", "toc_lo", F.col("char_count"), budget)

    def context(self, doc_id: int, leaf: int, reach: int = 5, budget: int = 30_000) -> DataFrame:
        leaves = self.table("nodes").where((F.col("shelf") == doc_id // 1000) & (F.col("doc_id") == doc_id) & F.col("text").isNotNull())
        anchor = leaves.where(F.col("toc_lo") == leaf).select("doc_id", "toc_lo")
        return sequences.context(leaves, anchor, "doc_id", "toc_lo", "text", min(reach, 20), budget)

    def books(self, items: DataFrame, overrides: DataFrame, ask: catalog.Filter, people: DataFrame, reviews: DataFrame, categories: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
        """A page of the items that fit, as curation has them."""
        curated = catalog.effective(items, overrides, [c for c in ("title", "publisher", "year", "language") if c in items.columns])
        return catalog.page(catalog.find(curated, people, reviews, categories, ask), "intake_id", offset, limit)

    def info(self) -> dict:
        rows = self.table("chunks").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("books")).first()
        return {"chunks": rows["chunks"], "books": rows["books"], "model": self.profile.model, "dim": self.profile.dim, "index": self.profile.index}

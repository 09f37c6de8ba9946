"""What happened: curation with its audit trail, runs, calls of tools, and the addresses of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import RUN_STATES, valid

# What a curator may do to a field, and limits of a batch for an embedding service.
ACTIONS = ("set", "clear", "void")
BATCH_CHARS, BATCH_ROWS = 8_000, 64


def checked(column: str, known: tuple[str, ...]) -> Column:
    """The column; a value outside the vocabulary fails the job."""
    value = F.col(column)
    other = F.raise_error(F.concat(F.lit(f"{column} is none of {', '.join(known)}: "), F.coalesce(value, F.lit("null"))))
    return F.when(value.isin(*known), value).otherwise(other.cast("string"))


def curate(base: DataFrame, overrides: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides after changes, and a trail with a row for each change: what the field said before and says now.

    base and overrides hold (intake_id, field, value); changes also seq, their order, and
    action: set a value, void the field (an override that is null), or clear the override,
    so that the base value shows again.
    """
    keys = ["intake_id", "field"]
    told = changes.withColumn("action", checked("action", ACTIONS))
    known = base.select(*keys, F.col("value").alias("_base"))
    over = overrides.select(*keys, F.struct("value").alias("_over"))
    seen = told.join(known, keys, "left").join(over, keys, "left")
    now = F.when(F.col("action") == "set", F.col("value")).when(F.col("action") == "clear", F.col("_base"))
    before = F.when(F.col("_over").isNotNull(), F.col("_over.value")).otherwise(F.col("_base"))
    order = Window.partitionBy(*keys).orderBy("seq")
    seen = seen.withColumn("new_value", now)
    old = F.when(F.row_number().over(order) == 1, before).otherwise(F.lag("new_value").over(order))
    trail = seen.withColumn("old_value", old).select(*keys, "seq", "action", "old_value", "new_value")
    last = told.groupBy(*keys).agg(F.max_by(F.struct("action", "value"), "seq").alias("l"))
    kept = overrides.select(*keys, "value").join(last, keys, "left_anti")
    put = last.where("l.action <> 'clear'").select(*keys, F.when(F.col("l.action") == "set", F.col("l.value")).alias("value"))
    return kept.unionByName(put), trail


def append_once(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """log with those of rows whose key it lacks: appending the same rows again adds nothing."""
    return log.unionByName(rows.dropDuplicates([key]).join(log.select(key), key, "left_anti").select(*log.columns))


def trail(log: DataFrame, column: str, value, *order: str) -> DataFrame:
    """The rows of one run, item or node in the order in which they were logged."""
    return log.where(F.col(column) == value).orderBy(*order)


# --- runs ---------------------------------------------------------------------


def close_runs(runs: DataFrame, closing: DataFrame) -> DataFrame:
    """runs with finished_at and status of closing (run_id, finished_at, status)."""
    new = closing.select("run_id", F.col("finished_at").alias("_at"), checked("status", RUN_STATES).alias("_status"))
    return runs.join(new, "run_id", "left").withColumns({"finished_at": F.coalesce("_at", "finished_at"), "status": F.coalesce("_status", "status")}).select(*runs.columns)


def list_runs(runs: DataFrame, command: str | None = None, last: int | None = None, status: str | None = None) -> DataFrame:
    """Runs, newest first; of one command, in one status, the last few."""
    out = runs if command is None else runs.where(F.col("command") == command)
    out = out if status is None else out.where(F.col("status") == valid(status, RUN_STATES))
    out = out.orderBy(F.desc("started_at"), F.desc("run_id"))
    return out if last is None else out.limit(last)


def merged_runs(catalogues: dict[str, tuple[DataFrame, DataFrame]], last: int, command: str | None = None) -> DataFrame:
    """The last runs of several catalogues (runs, summaries by run_id), each with its summary if it has one."""
    each = [r.join(s, "run_id", "left").withColumn("catalogue", F.lit(name)) for name, (r, s) in sorted(catalogues.items())]
    return list_runs(reduce(DataFrame.unionByName, each), command, last)


def profile_buckets(papers: DataFrame, books: DataFrame) -> DataFrame:
    """(kind, fingerprint, name, n): papers by profile fingerprint and name, books by profile_ref (an empty one is none)."""
    of_papers = papers.groupBy("fingerprint", "name").agg(F.count("*").alias("n")).withColumn("kind", F.lit("paper"))
    ref = F.nullif("profile_ref", F.lit("")).alias("name")
    of_books = books.groupBy(ref).agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("fingerprint"), "name", "n", F.lit("book").alias("kind"))
    return of_papers.unionByName(of_books).select("kind", "fingerprint", "name", "n")


def parse_counts(counts: Column) -> Column:
    """A map of counts from its JSON text."""
    return F.from_json(counts, "map<string,bigint>")


def dry_run_summary(reports: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, value, n) of each of the columns over all reports, from one pass; a null value is `none`."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns])
    return reports.select(F.explode(pairs).alias("p")).groupBy("p.measure", "p.value").agg(F.count("*").alias("n"))


# --- calls --------------------------------------------------------------------


def log_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls without their hits, and (call_id, rank, hit columns) of every hit in order."""
    hits = calls.select("call_id", F.posexplode("hits").alias("rank", "hit")).select("call_id", F.col("rank").alias("rank"), "hit.*")
    return calls.drop("hits"), hits


def prune_stale(calls: DataFrame, hits: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """Calls and hits that were made on the corpus as it is: those with another fingerprint, or none, go."""
    kept = calls.where(F.col("corpus_fingerprint") == fingerprint)
    return kept, hits.join(kept.select("call_id"), "call_id", "left_semi")


def take_ranked(candidates: DataFrame, ranked: DataFrame, by: str = "call_id") -> DataFrame:
    """candidates (by, index) in the order of ranked (by, rank, index, score); an index that is repeated or out of range fails the job.

    Each call's rows stand together, in order; calls are in no order among themselves.
    """
    found = ranked.join(candidates.withColumn("_there", F.lit(True)), [by, "index"], "left")
    times = F.count("*").over(Window.partitionBy(by, "index"))
    checks = found.withColumn("_bad", F.assert_true((times == 1) & F.coalesce("_there", F.lit(False)), F.lit("an index is repeated or out of range")))
    return checks.where("_bad is null").drop("_bad", "_there").repartition(by).sortWithinPartitions(by, "rank")


def greedy_batches(chunks: DataFrame, by: str, order: str, size: Column, chars: int = BATCH_CHARS, rows: int = BATCH_ROWS) -> DataFrame:
    """(by, order, batch): chunks of an item in order, as many in a batch as fit; one that is too large has its own.

    What fits depends on all that came before, so an item is one task's; the task reads its
    rows in order and holds one batch of them at a time.
    """
    sized = chunks.select(by, order, F.coalesce(size.cast("long"), F.lit(0)).alias("_n")).repartition(by).sortWithinPartitions(by, order)
    kinds = {c: chunks.schema[c].dataType for c in (by, order)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, number, filled, held = object(), 0, 0, 0
        for batch in batches:
            numbers = []
            for own, n in zip(batch[by], batch["_n"], strict=True):
                if own != item:
                    item, number, filled, held = own, 0, 0, 0
                elif held and (filled + n > chars or held >= rows):
                    number, filled, held = number + 1, 0, 0
                filled, held = filled + n, held + 1
                numbers.append(number)
            yield pd.DataFrame({by: batch[by], order: batch[order], "batch": numbers})

    # as text, so that long numbers among nulls are not made doubles
    texts = sized.select(F.col(by).cast("string").alias(by), F.col(order).cast("string").alias(order), "_n")
    done = texts.mapInPandas(cut, f"`{by}` string, `{order}` string, batch int")
    return done.select(F.col(by).cast(kinds[by]).alias(by), F.col(order).cast(kinds[order]).alias(order), "batch")


# --- addresses ----------------------------------------------------------------


def addresses(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, scope): `book` for a root, the signature of its subtree for a part, its anchor for a leaf."""
    scope = F.when(F.col("parent_id").isNull(), "book").when(F.col("text").isNull(), F.concat(F.lit("part:"), "subtree_sha256")).otherwise(F.concat(F.lit("leaf:"), "stable_anchor"))
    return nodes.select("doc_id", "node_id", scope.alias("scope"))


def resolve(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, scope, node_id, state) of asked (doc_id, scope): found, not_found, or ambiguous, which has no node."""
    return resolve_in(addresses(nodes), asked)


def resolve_in(own: DataFrame, asked: DataFrame) -> DataFrame:
    """As resolve, with the addresses (doc_id, node_id, scope) of the nodes as they were worked out before."""
    known = own.groupBy("doc_id", "scope").agg(F.count("*").alias("_n"), F.min("node_id").alias("_id"))
    state = F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "ambiguous").otherwise("found")
    return asked.join(known, ["doc_id", "scope"], "left").select("doc_id", "scope", F.when(F.col("_n") == 1, F.col("_id")).alias("node_id"), state.alias("state"))


def paper_breadcrumb(container: Column, title: Column, stem: Column, item: Column) -> Column:
    """`container › title`; without a title the file's stem, without that the item's number."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" › ", filled(container), F.coalesce(filled(title), filled(stem), F.concat(F.lit("paper #"), item.cast("string"))))

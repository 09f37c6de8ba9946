"""Queries that run the library's stages: dry runs, ingest with broken items, rebuild and audit from envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..library import Library
from ..operators import sinks
from ..streaming import queue
from .documents import _LINES, _docs, _level
from .registry import query, table

PAGES = 100_000_000


def _files(spark, sf_dir):
    """All documents as text files and all pages as HTML files; some of a format that nothing reads, without content, or empty."""
    d, p = F.col("doc_id"), F.col("page_id")
    name = F.concat(F.lit("doc-"), d.cast("string"), F.when(d % 17 == 3, ".docx").otherwise(".txt"))
    texts = _docs(spark, sf_dir).select("doc_id", name.alias("name"), F.when(d % 17 != 5, F.col("text").cast("binary")).alias("content"))
    body = F.when(p % 13 == 2, F.lit("")).otherwise(F.col("html")).cast("binary")
    pages = table(spark, sf_dir, "pages").select((p + PAGES).alias("doc_id"), F.concat(F.lit("page-"), p.cast("string"), F.lit(".html")).alias("name"), body.alias("content"))
    return texts.unionByName(pages)


_READ = f"""
{_LINES},
n AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE level IS NULL) AS leaves FROM l GROUP BY doc_id),
t AS (SELECT d.doc_id, CASE WHEN d.doc_id % 17 = 3 THEN 'unsupported' WHEN d.doc_id % 17 = 5 OR d.text IS NULL THEN 'error' WHEN n.blocks IS NULL THEN 'needs_ocr' ELSE 'extracted' END AS outcome,
  coalesce(n.blocks, 0) AS blocks, coalesce(n.leaves, 0) AS leaves FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id),
r AS (SELECT *, CASE WHEN outcome <> 'extracted' THEN 'extract' WHEN leaves = 0 THEN 'structure' END AS failed_at FROM t)"""


@query(f"""
WITH {_READ}
SELECT 'text' AS kind, outcome, coalesce(failed_at, 'none') AS failed_at, count(*) AS items, CAST(sum(CASE WHEN outcome = 'extracted' THEN blocks ELSE 0 END) AS BIGINT) AS blocks,
  CAST(sum(CASE WHEN outcome = 'extracted' THEN leaves ELSE 0 END) AS BIGINT) AS leaves FROM r GROUP BY 2, 3
UNION ALL SELECT 'page', CASE WHEN page_id % 13 = 2 THEN 'needs_ocr' ELSE 'extracted' END, CASE WHEN page_id % 13 = 2 THEN 'extract' ELSE 'none' END, count(*), 0, 0 FROM pages GROUP BY 2, 3""")
def dry_run_stages(spark, sf_dir):
    """What every file would come to, counted by outcome; blocks and leaves of text files only."""
    report = Library(spark, sinks.scratch(spark)).dry_run(_files(spark, sf_dir), _level())
    is_page = F.col("name").like("page-%")
    rows = report.select(F.when(is_page, "page").otherwise("text").alias("kind"), "outcome", F.coalesce("failed_at", F.lit("none")).alias("failed_at"), *[F.when(~is_page, F.col(c)).alias(c) for c in ("blocks", "leaves")])
    return rows.groupBy("kind", "outcome", "failed_at").agg(F.count("*").alias("items"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("blocks", "leaves")])


def _ingested(spark, sf_dir):
    library = Library(spark, sinks.scratch(spark))
    library.ingest_files(_files(spark, sf_dir).where(F.col("doc_id") < PAGES), _level())
    return library


@query(f"""
WITH {_READ}
SELECT CASE WHEN failed_at IS NOT NULL OR doc_id % 10 = 9 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'mismatched' ELSE 'rebuilt' END AS bucket, count(*) AS n, 2 AS version FROM r GROUP BY 1""")
def rebuild_run(spark, sf_dir):
    """All text files are read, then made again from their envelopes: some under another id that was never read, some of another file by now."""
    library = _ingested(spark, sf_dir)
    d = F.col("doc_id")
    intakes = _docs(spark, sf_dir).select(F.when(d % 10 == 9, d + PAGES).otherwise(d).alias("doc_id"), F.sha2(F.when(d % 5 == 1, "other").otherwise(F.col("text")).cast("binary"), 256).alias("source_sha256"))
    buckets = library.rebuild(intakes, _level())
    return buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.lit(library.store.version()).alias("version"))


@query(f"""
WITH {_READ},
k AS (SELECT doc_id, doc_id % 4 = 0 AS given FROM r WHERE failed_at IS NULL)
SELECT given, 'needs_work' AS old_verdict, verdict, old_verdict <> verdict AS changed, outcome, n FROM (
  SELECT given, 'needs_work' AS old_verdict, CASE WHEN given THEN 'clean' ELSE 'needs_work' END AS verdict, CASE WHEN given THEN 'ok' ELSE 'partial' END AS outcome, count(*) AS n FROM k GROUP BY ALL)""")
def reaudit_run(spark, sf_dir):
    """Text files have no title, so they need work; those that a curator gave a title, a language, a publisher and a year do not, unless their contents are flat."""
    library = _ingested(spark, sf_dir)
    d = F.col("doc_id")
    # the language of a body is another rule's matter here: a tag that agrees with any body
    given = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("title", F.concat(F.lit("A title of "), d.cast("string"))), ("language", F.lit("la")), ("publisher", F.lit("House")), ("year", F.lit("1990")))])
    over = _docs(spark, sf_dir).where(d % 4 == 0).select(d.alias("intake_id"), F.explode(given).alias("g")).select("intake_id", "g.*")
    told = library.reaudit(_level(), over)
    return told.groupBy((d % 4 == 0).alias("given"), "old_verdict", "verdict", "changed", "outcome").agg(F.count("*").alias("n"))


# --- the queue ------------------------------------------------------------------

_COMMANDS = """
e AS (SELECT ts, event_id AS seq, ['enqueue', 'start', 'done', 'heartbeat', 'cancel'][list_position(['signup', 'view', 'purchase', 'click', 'error'], event_type)] AS command,
  md5(CAST(user_id AS VARCHAR)) AS job_id FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS i FROM e)"""

#: the state of a job after each command: what a lease of six hours leaves of a running job, then what the command makes of it
_STATES = f"""
{_COMMANDS},
s AS (
  SELECT job_id, i, ts, command, CAST(NULL AS VARCHAR) AS found, CASE WHEN command = 'enqueue' THEN 'pending' END AS state, CAST(NULL AS TIMESTAMP) AS until, false AS ended FROM c WHERE i = 1
  UNION ALL
  SELECT c.job_id, c.i, c.ts, c.command, x.found,
    CASE WHEN c.command = 'enqueue' AND x.found IS NULL THEN 'pending' WHEN c.command = 'start' AND x.found = 'pending' THEN 'running'
      WHEN c.command = 'done' AND x.found = 'running' THEN NULL WHEN c.command = 'cancel' THEN NULL ELSE x.found END,
    CASE WHEN (c.command = 'start' AND x.found = 'pending') OR (c.command = 'heartbeat' AND x.found = 'running') THEN c.ts + INTERVAL 6 HOUR WHEN x.found = 'running' THEN s.until END,
    s.state = 'running' AND s.until < c.ts
  FROM s JOIN c ON c.job_id = s.job_id AND c.i = s.i + 1, LATERAL (SELECT CASE WHEN s.state = 'running' AND s.until < c.ts THEN 'pending' ELSE s.state END AS found) AS x),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1),
mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events),
moves AS (
  SELECT 'running' AS was, 'pending' AS state, 'lease ended' AS note FROM s WHERE ended
  UNION ALL SELECT 'running', 'pending', 'lease ended' FROM last, mark WHERE last.state = 'running' AND last.until < mark.w
  UNION ALL SELECT found, CASE WHEN command = 'done' AND found = 'running' THEN 'done' WHEN command = 'cancel' AND found IS NOT NULL THEN 'cancelled' ELSE state END,
    CASE WHEN command = 'cancel' AND found IS NULL THEN 'refused: no such job'
      WHEN (command = 'enqueue' AND found IS NOT NULL) OR (command = 'start' AND found IS DISTINCT FROM 'pending') OR (command IN ('done', 'heartbeat') AND found IS DISTINCT FROM 'running') THEN 'refused: ' || command END
  FROM s WHERE command <> 'heartbeat' OR found IS DISTINCT FROM 'running')"""


def _commands(spark, sf_dir):
    """Events as commands: each user is a job; the order of time and of numbers is the same."""
    kinds = F.create_map(*[F.lit(x) for pair in (("signup", "enqueue"), ("view", "start"), ("purchase", "done"), ("click", "heartbeat"), ("error", "cancel")) for x in pair])
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("command"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("job_id"))


@query(f"""
WITH RECURSIVE {_STATES}
SELECT coalesce(was, 'none') AS was, coalesce(state, 'none') AS state, coalesce(note, '') AS note, count(*) AS n FROM moves GROUP BY ALL""")
def queue_changes(spark, sf_dir):
    """What a stream of all events, read as commands, does to the jobs of a queue; counted by change. The stream runs in two parts, the second from the first's checkpoint."""
    place = sinks.scratch(spark)
    commands = _commands(spark, sf_dir)
    middle = commands.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5)).first()[0]
    for early in (True, False):
        commands.where((F.col("ts").cast("double") < middle) == early).coalesce(1).write.mode("append").parquet(f"{place}/inbox")
        queue.run(queue.commands_in(spark, f"{place}/inbox"), f"{place}/log", f"{place}/checkpoint", lease="6 hours").awaitTermination()
    log = spark.read.schema(queue.CHANGES).parquet(f"{place}/log")
    none = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return log.groupBy(none("was", "none"), none("state", "none"), none("note", "")).agg(F.count("*").alias("n"))

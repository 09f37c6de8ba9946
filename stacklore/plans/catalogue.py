"""Queries on a catalogue made from the driver's tables: items, attributes, overrides, people, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog
from ..streaming import ingest
from .registry import query, table

# The same frames in both tongues.
_ITEMS = """
items AS (SELECT doc_id AS intake_id, sha256(text) AS source_sha256, ['epub', 'pdf', 'txt', 'ocr-markdown'][doc_id % 4 + 1] AS format,
  ['pending', 'needs_ocr', 'extracted', 'structured', 'embedded'][doc_id % 5 + 1] AS status,
  'Item ' || doc_id || ' of ' || source AS title, lang AS language, CASE WHEN doc_id % 6 <> 0 THEN 'House ' || (doc_id % 9) END AS publisher,
  CAST(1900 + doc_id % 120 AS VARCHAR) AS year, ['low', 'medium', 'high'][doc_id % 3 + 1] AS confidence FROM documents)"""
_PEOPLE = """
people AS (SELECT doc_id AS intake_id, ['author', 'translator', 'editor'][k % 3 + 1] AS role, CAST(k AS INTEGER) AS ordinal, 'Person ' || (doc_id * 3 + k) % 50 AS name
  FROM documents, (VALUES (0), (1), (2)) AS v(k) WHERE (doc_id + k) % 4 <> 0)"""
_REVIEWS = "reviews AS (SELECT doc_id AS intake_id, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS review FROM labels)"
_CATS = "cats AS (SELECT doc_id AS intake_id, 'cat' || doc_id % 8 AS category FROM documents)"
_OVER = """
over_ AS (SELECT doc_id AS intake_id, 'title' AS field, CASE WHEN doc_id % 2 = 0 THEN 'Curated ' || doc_id END AS value FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'year', '2001' FROM documents WHERE doc_id % 7 = 1)"""
_AUDIT = """
audit AS (SELECT event_id, event_id % 20 AS run_id, CASE WHEN user_id % 2 = 0 THEN 'book' ELSE 'paper' END AS kind, ['clean', 'needs_work'][event_id % 2 + 1] AS verdict, ts,
  event_type = 'click' AS f_click, event_type = 'error' AS f_error, event_type = 'none' AS f_none FROM events)"""


def _pick(column: str, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def _items(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("intake_id"), F.sha2("text", 256).alias("source_sha256"), _pick("doc_id", "epub", "pdf", "txt", "ocr-markdown").alias("format"),
        _pick("doc_id", "pending", "needs_ocr", "extracted", "structured", "embedded").alias("status"),
        F.concat(F.lit("Item "), d.cast("string"), F.lit(" of "), "source").alias("title"), F.col("lang").alias("language"),
        F.when(d % 6 != 0, F.concat(F.lit("House "), (d % 9).cast("string"))).alias("publisher"), (1900 + d % 120).cast("string").alias("year"),
        _pick("doc_id", "low", "medium", "high").alias("confidence"),
    )


def _people(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).where("(doc_id + k) % 4 <> 0")
    name = F.concat(F.lit("Person "), ((F.col("doc_id") * 3 + F.col("k")) % 50).cast("string"))
    return rows.select(F.col("doc_id").alias("intake_id"), _pick("k", "author", "translator", "editor").alias("role"), F.col("k").alias("ordinal"), name.alias("name"))


def _reviews(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("intake_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("review"))


def _cats(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("intake_id"), F.concat(F.lit("cat"), (d % 8).cast("string")).alias("category"))


def _overrides(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    title = docs.where("doc_id % 7 = 0").select(d.alias("intake_id"), F.lit("title").alias("field"), F.when(d % 2 == 0, F.concat(F.lit("Curated "), d.cast("string"))).alias("value"))
    return title.unionByName(docs.where("doc_id % 7 = 1").select(d.alias("intake_id"), F.lit("year").alias("field"), F.lit("2001").alias("value")))


def _audit(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("user_id") % 2 == 0, "book").otherwise("paper")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 20).alias("run_id"), kind.alias("kind"), _pick("event_id", "clean", "needs_work").alias("verdict"), "ts",
        *[(F.col("event_type") == f).alias(f"f_{f}") for f in ("click", "error", "none")],
    )


_EFFECTIVE = """
eff AS (SELECT i.intake_id, i.format, i.status, i.language, i.publisher, i.confidence,
  CASE WHEN t.intake_id IS NULL THEN i.title ELSE t.value END AS title, CASE WHEN y.intake_id IS NULL THEN i.year ELSE y.value END AS year
  FROM items i LEFT JOIN over_ t ON t.intake_id = i.intake_id AND t.field = 'title' LEFT JOIN over_ y ON y.intake_id = i.intake_id AND y.field = 'year')"""


def _effective(spark, sf_dir) -> DataFrame:
    return catalog.effective(_items(spark, sf_dir), _overrides(spark, sf_dir), ["title", "year"])


@query(f"WITH {_ITEMS}, {_OVER}, {_EFFECTIVE} SELECT intake_id, title, year, publisher FROM eff")
def effective_overlay(spark, sf_dir):
    return _effective(spark, sf_dir).select("intake_id", "title", "year", "publisher")


@query(f"""
WITH {_ITEMS}, {_OVER}, {_EFFECTIVE}, f AS (SELECT * FROM eff WHERE contains(lower(title), 'src1'))
SELECT intake_id, title, (SELECT count(*) FROM f) AS total, 10 + 20 < (SELECT count(*) FROM f) AS more FROM f ORDER BY intake_id LIMIT 20 OFFSET 10""")
def title_filter_paging(spark, sf_dir):
    found = _effective(spark, sf_dir).where(F.contains(F.lower("title"), F.lit("src1"))).select("intake_id", "title")
    return catalog.page(found, "intake_id", 10, 20)


@query(f"""
WITH {_ITEMS}, {_PEOPLE}, {_REVIEWS}, {_CATS}
SELECT i.intake_id, i.title FROM items i WHERE i.status IN ('extracted', 'structured') AND i.confidence = 'high'
  AND EXISTS (SELECT 1 FROM people p WHERE p.intake_id = i.intake_id AND p.role = 'author' AND contains(lower(p.name), 'person 1'))
  AND coalesce((SELECT review FROM reviews r WHERE r.intake_id = i.intake_id), 'pending') = 'pending'
  AND EXISTS (SELECT 1 FROM cats c WHERE c.intake_id = i.intake_id AND c.category IN ('cat1', 'cat2', 'cat3'))""")
def catalogue_find(spark, sf_dir):
    ask = catalog.Filter(contributor="Person 1", role="author", statuses=("extracted", "structured"), confidence="high", review="pending", categories=("cat1", "cat2", "cat3"))
    return catalog.find(_items(spark, sf_dir), _people(spark, sf_dir), _reviews(spark, sf_dir), _cats(spark, sf_dir), ask).select("intake_id", "title")


@query(f"WITH {_PEOPLE} SELECT intake_id, arg_min(name, (role, ordinal)) AS name FROM people GROUP BY intake_id")
def top_contributors(spark, sf_dir):
    return catalog.top_contributor(_people(spark, sf_dir))


@query(f"""
WITH {_ITEMS}, {_PEOPLE}, {_REVIEWS}, p AS (SELECT intake_id, string_agg(role || ':' || name, ';' ORDER BY role, ordinal) AS contributors FROM people GROUP BY intake_id)
SELECT i.intake_id, i.title, p.contributors, coalesce(r.review, 'pending') AS review FROM items i LEFT JOIN p ON p.intake_id = i.intake_id LEFT JOIN reviews r ON r.intake_id = i.intake_id""")
def item_detail(spark, sf_dir):
    found = catalog.detail(_items(spark, sf_dir), _people(spark, sf_dir), _reviews(spark, sf_dir))
    people = F.array_join(F.transform("contributors", lambda c: F.concat(c["role"], F.lit(":"), c["name"])), ";")
    return found.select("intake_id", "title", people.alias("contributors"), "review")


@query(f"""
WITH {_ITEMS}, {_REVIEWS}
SELECT 'status' AS measure, v AS value, (SELECT count(*) FROM items WHERE status = v) AS n FROM (VALUES ('pending'), ('needs_ocr'), ('extracted'), ('structured'), ('embedded'), ('failed')) AS s(v)
UNION ALL SELECT 'format', format, count(*) FROM items GROUP BY format
UNION ALL SELECT 'stage', review, count(*) FROM reviews GROUP BY review
UNION ALL SELECT 'issue', event_type, count(*) FROM events GROUP BY event_type""")
def library_stats(spark, sf_dir):
    stages = _reviews(spark, sf_dir).select(F.col("review").alias("stage"))
    issues = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"))
    return catalog.library_stats(_items(spark, sf_dir), stages, issues)


@query(f"""
WITH {_AUDIT}
SELECT run_id, count(*) FILTER (WHERE kind = 'book') AS n_books, count(*) FILTER (WHERE kind = 'paper') AS n_papers, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS wall_ms,
  count(*) FILTER (WHERE verdict = 'clean') AS clean, count(*) FILTER (WHERE verdict = 'needs_work') AS needs_work,
  nullif(count(*) FILTER (WHERE f_click), 0) AS click, nullif(count(*) FILTER (WHERE f_none), 0) AS none FROM audit GROUP BY run_id""")
def run_rollup(spark, sf_dir):
    found = catalog.run_rollup(_audit(spark, sf_dir), ["f_click", "f_error", "f_none"])
    at = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    count = lambda k: F.coalesce(at("verdicts", k), F.lit(0))
    return found.select(
        "run_id", "n_books", "n_papers", "wall_ms", count("clean").alias("clean"), count("needs_work").alias("needs_work"),
        at("flags", "f_click").alias("click"), at("flags", "f_none").alias("none"),
    )


@query(f"""
WITH {_ITEMS}, i AS (SELECT *, CASE WHEN intake_id % 10 = 3 THEN sha256((SELECT text FROM documents d WHERE d.doc_id = items.intake_id - 2)) END AS derived FROM items),
done AS (SELECT derived FROM i WHERE derived IS NOT NULL AND status IN ('extracted', 'structured', 'embedded')),
w AS (SELECT event_id % 1000 AS intake_id, arg_max(event_type, (ts, event_id)) AS reason FROM events GROUP BY 1)
SELECT i.intake_id, w.reason FROM i LEFT JOIN w ON w.intake_id = i.intake_id WHERE i.status = 'needs_ocr' AND i.source_sha256 NOT IN (SELECT derived FROM done)""")
def ocr_worklist(spark, sf_dir):
    items = _items(spark, sf_dir)
    origin = items.select((F.col("intake_id") + 2).alias("intake_id"), F.col("source_sha256").alias("o")).where("intake_id % 10 = 3")
    items = items.join(origin, "intake_id", "left").withColumnRenamed("o", "derived_from_sha256")
    log = table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("intake_id"), F.col("event_type").alias("message"), "ts", F.col("event_id").alias("audit_id"))
    return catalog.ocr_worklist(items, log).select("intake_id", "reason")


@query("""
SELECT e.event_id AS call_id, e.event_type AS tool, c.role FROM events e JOIN conversations c ON c.conv_id = e.event_id AND c.turn = 0 ORDER BY call_id DESC LIMIT 50""")
def retrieval_log_join(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"))
    tools = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("call_id"), "role")
    return catalog.retrieval_log(calls, tools, 50)


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_log(spark, sf_dir):
    return catalog.recent(table(spark, sf_dir, "events"), "ts", "2024-01-10 00:00:00", "event_id", 25).select("event_id", "event_type")


@query("SELECT event_id, event_type || '-' || user_id || '-' || substr(sha256(event_type || '|' || user_id || '|' || event_id), 1, 8) AS run FROM events")
def run_ids(spark, sf_dir):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", catalog.run_id(F.col("event_type"), user, event).alias("run"))


@query("SELECT event_type AS kind, CAST(list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS DOUBLE) AS upper_median, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type")
def order_statistics(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"))
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)")
    # the upper median is the (n div 2 + 1)th value: the lower one of the values in descending order
    descending = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)")
    return grouped.agg(F.when(F.count("*") % 2 == 0, descending).otherwise(upper).alias("upper_median"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"))


@query("""
WITH g AS (SELECT conv_id, max(turn) + 2 AS n, list_distinct(list(CAST(turn AS INTEGER))) AS have FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort(list_filter(range(1, n + 1), lambda x: NOT list_contains(have, CAST(x AS INTEGER)))), ',') AS missing, CASE WHEN list_contains(have, 0) THEN '0' ELSE '' END AS excess FROM g""")
def page_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    want = rows.groupBy("conv_id").agg((F.max("turn") + 2).alias("expected"))
    found = catalog.missing_pages(rows.join(want, "conv_id"), "conv_id", "expected", "turn")
    return found.select("conv_id", F.array_join("missing", ",").alias("missing"), F.array_join("excess", ",").alias("excess"))


@query(f"""
WITH {_ITEMS}, c AS (SELECT intake_id, 'new ' || intake_id AS title FROM items WHERE intake_id % 3 = 0 UNION ALL SELECT 1000000 + intake_id, 'added' FROM items WHERE intake_id < 5)
SELECT intake_id, title FROM items WHERE intake_id NOT IN (SELECT intake_id FROM c) UNION ALL SELECT * FROM c""")
def upsert_attrs(spark, sf_dir):
    items = _items(spark, sf_dir).select("intake_id", "title")
    new = items.where("intake_id % 3 = 0").select("intake_id", F.concat(F.lit("new "), F.col("intake_id").cast("string")).alias("title"))
    added = items.where("intake_id < 5").select((F.col("intake_id") + 1000000).alias("intake_id"), F.lit("added").alias("title"))
    return catalog.upsert(items, new.unionByName(added), ["intake_id"])


@query("""
WITH k AS (SELECT doc_id AS intake_id, sha256(text) AS s FROM documents WHERE doc_id % 2 = 0), n AS (SELECT DISTINCT sha256(text) AS s FROM documents WHERE sha256(text) NOT IN (SELECT s FROM k))
SELECT intake_id, s AS source_sha256 FROM k UNION ALL SELECT (SELECT max(intake_id) FROM k) + row_number() OVER (ORDER BY s), s FROM n""")
def register_sources(spark, sf_dir):
    rows = _items(spark, sf_dir).select("intake_id", "source_sha256")
    return catalog.register(rows.where("intake_id % 2 = 0"), rows.select("source_sha256"))


@query(f"""
WITH {_ITEMS}, {_PEOPLE}, {_CATS}, gone AS (SELECT intake_id FROM items WHERE status = 'pending')
SELECT 'items' AS "table", count(*) AS n FROM items JOIN gone USING (intake_id) UNION ALL SELECT 'people', count(*) FROM people JOIN gone USING (intake_id) UNION ALL SELECT 'cats', count(*) FROM cats JOIN gone USING (intake_id)""")
def cascade_counts(spark, sf_dir):
    items = _items(spark, sf_dir)
    tables = {"items": items, "people": _people(spark, sf_dir), "cats": _cats(spark, sf_dir)}
    return catalog.cascade(tables, items.where("status = 'pending'").select("intake_id"))[1]


@query(f"""
WITH {_ITEMS}, b AS (SELECT 'k' || intake_id AS entry_key, CASE WHEN intake_id % 4 = 1 THEN upper(title) ELSE title END AS v FROM items WHERE intake_id % 5 <> 0),
l AS (SELECT 'k' || intake_id AS entry_key, title AS v FROM items WHERE intake_id % 7 <> 0)
SELECT entry_key, CASE WHEN l.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN l USING (entry_key) WHERE b.v IS DISTINCT FROM l.v""")
def rebuild_diff(spark, sf_dir):
    items = _items(spark, sf_dir)
    named = lambda d, v: d.select(F.concat(F.lit("k"), F.col("intake_id").cast("string")).alias("entry_key"), v.alias("v"))
    built = named(items.where("intake_id % 5 <> 0"), F.when(F.col("intake_id") % 4 == 1, F.upper("title")).otherwise(F.col("title")))
    return catalog.diff(built, named(items.where("intake_id % 7 <> 0"), F.col("title")))


@query(f"""
WITH {_ITEMS} SELECT CASE WHEN status = 'needs_ocr' AND intake_id % 2 = 0 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n,
  count(*) FILTER (WHERE format = 'ocr-markdown') AS ocr FROM items GROUP BY 1""")
def stale_counts(spark, sf_dir):
    state = F.when((F.col("status") == "needs_ocr") & (F.col("intake_id") % 2 == 0), "stale").otherwise("fresh")
    return _items(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("format") == "ocr-markdown").alias("ocr"))


@query(f"""
WITH {_ITEMS}, k AS (SELECT intake_id, CASE WHEN intake_id % 4 <> 0 THEN publisher END AS publisher, intake_id - intake_id % 4 AS parent_id FROM items)
SELECT k.intake_id, coalesce(k.publisher, p.publisher) AS publisher FROM k LEFT JOIN items p ON p.intake_id = k.parent_id""")
def inherited_fields(spark, sf_dir):
    items = _items(spark, sf_dir)
    children = items.select("intake_id", F.when(F.col("intake_id") % 4 != 0, F.col("publisher")).alias("publisher"), (F.col("intake_id") - F.col("intake_id") % 4).alias("parent_id"))
    return catalog.inherit(children, items, ["publisher"]).select("intake_id", "publisher")


@query("SELECT doc_id AS intake_id, 'Item ' || doc_id || ' of ' || source AS title, CAST(1900 + doc_id % 120 AS VARCHAR) AS year FROM documents")
def csl_round_trip(spark, sf_dir):
    attrs, _ = catalog.from_csl(catalog.to_csl(_items(spark, sf_dir), _people(spark, sf_dir)))
    return attrs.select("intake_id", "title", "year")


def _jobs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("event_id").alias("seq"), _pick("user_id", "high", "normal", "low").alias("priority"), _pick("event_id", "pending", "running", "done").alias("state")
    )


_JOBS = "jobs AS (SELECT event_id AS job_id, event_id AS seq, ['high', 'normal', 'low'][user_id % 3 + 1] AS priority, ['pending', 'running', 'done'][event_id % 3 + 1] AS state FROM events)"


@query(f"WITH {_JOBS} SELECT job_id, priority FROM jobs WHERE state = 'pending' ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, seq LIMIT 20")
def queue_next(spark, sf_dir):
    return ingest.next_jobs(_jobs(spark, sf_dir), 20).select("job_id", "priority")


@query(f"""
WITH {_JOBS} SELECT CASE WHEN job_id % 6 = 1 THEN 'skipped_duplicate' WHEN state = 'running' THEN 'pending' ELSE state END AS state, count(*) AS n FROM jobs GROUP BY 1""")
def queue_settle(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    outcomes = jobs.where("job_id % 6 = 1").select("job_id", F.lit("skipped_duplicate").alias("outcome"))
    return ingest.queue_counts(ingest.settle(jobs, outcomes))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query("""
SELECT s AS start, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT value, unnest(range(time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '45 minutes', time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '1 minute', INTERVAL '15 minutes')) AS s FROM events) GROUP BY s""")
def events_sliding(spark, sf_dir):
    return ingest.sliding(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query("""
WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def events_session(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"))

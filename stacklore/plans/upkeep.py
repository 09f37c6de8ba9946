"""Queries on trails, runs, addresses, attribute assembly and work that is done again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import abstracts, rework, sinks, sketches, trails
from .catalogue import _ITEMS, _OVER, _items, _overrides, _pick
from .documents import _docs, _tree
from .registry import query, spread, table

_BASE = """
base AS (SELECT doc_id AS intake_id, 'title' AS field, 'Item ' || doc_id || ' of ' || source AS value FROM documents
  UNION ALL SELECT doc_id, 'year', CAST(1900 + doc_id % 120 AS VARCHAR) FROM documents)"""
_CHANGES = """
ch AS (SELECT doc_id AS intake_id, ['title', 'year'][doc_id % 2 + 1] AS field, CAST(k AS INTEGER) AS seq, ['set', 'clear', 'void'][(doc_id + k) % 3 + 1] AS action,
  'new ' || doc_id || ' ' || k AS value FROM documents, (VALUES (0), (1), (2), (3)) AS v(k) WHERE doc_id % 3 <> 1 AND k <= doc_id % 4)"""


def _curated(spark, sf_dir):
    d = F.col("doc_id")
    base = _items(spark, sf_dir)
    base = base.select("intake_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("title", "year")])).alias("x")).select("intake_id", "x.*")
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("seq")).where("doc_id % 3 <> 1 AND seq <= doc_id % 4")
    changes = rows.withColumn("_k", d + F.col("seq")).select(
        d.alias("intake_id"), _pick("doc_id", "title", "year").alias("field"), "seq", _pick("_k", *trails.ACTIONS).alias("action"),
        F.concat(F.lit("new "), d.cast("string"), F.lit(" "), F.col("seq").cast("string")).alias("value"),
    )
    return trails.curate(base, _overrides(spark, sf_dir), changes)


@query(f"""
WITH {_OVER}, {_BASE}, {_CHANGES},
n AS (SELECT c.*, CASE c.action WHEN 'set' THEN c.value WHEN 'clear' THEN b.value END AS new_value, CASE WHEN o.intake_id IS NULL THEN b.value ELSE o.value END AS first_old
  FROM ch c LEFT JOIN base b ON b.intake_id = c.intake_id AND b.field = c.field LEFT JOIN over_ o ON o.intake_id = c.intake_id AND o.field = c.field)
SELECT intake_id, field, seq, action, CASE WHEN row_number() OVER w = 1 THEN first_old ELSE lag(new_value) OVER w END AS old_value, new_value
FROM n WINDOW w AS (PARTITION BY intake_id, field ORDER BY seq)""")
def metadata_trail(spark, sf_dir):
    return _curated(spark, sf_dir)[1]


@query(f"""
WITH {_OVER}, {_CHANGES}, l AS (SELECT intake_id, field, arg_max(action, seq) AS action, arg_max(value, seq) AS value FROM ch GROUP BY ALL)
SELECT intake_id, field, value FROM over_ o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.intake_id = o.intake_id AND l.field = o.field)
UNION ALL SELECT intake_id, field, CASE WHEN action = 'set' THEN value END FROM l WHERE action <> 'clear'""")
def curated_overrides(spark, sf_dir):
    return _curated(spark, sf_dir)[0]


_RUNS = """
runs AS (SELECT event_id AS run_id, event_type AS command, ts AS started_at, CASE WHEN event_id % 3 = 0 THEN ts END AS finished_at,
  ['ok', 'running', 'error'][event_id % 3 + 1] AS status FROM events)"""


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("command"), F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("finished_at"), _pick("event_id", "ok", "running", "error").alias("status"),
    )


@query(f"""
WITH {_RUNS} SELECT CASE WHEN run_id % 6 = 1 THEN 'abandoned' ELSE status END AS status, count(*) AS n,
  count(CASE WHEN run_id % 6 = 1 THEN started_at ELSE finished_at END) AS finished FROM runs GROUP BY 1""")
def runs_closed(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    closing = runs.where("run_id % 6 = 1").select("run_id", F.col("started_at").alias("finished_at"), F.lit("abandoned").alias("status"))
    return trails.close_runs(runs, closing).groupBy("status").agg(F.count("*").alias("n"), F.count("finished_at").alias("finished"))


@query(f"WITH {_RUNS} SELECT run_id, command, status FROM runs WHERE command = 'click' AND status = 'running' ORDER BY started_at DESC, run_id DESC LIMIT 30")
def runs_open_of_command(spark, sf_dir):
    return trails.list_runs(_runs(spark, sf_dir), "click", 30, "running").select("run_id", "command", "status")


@query(f"""
WITH {_RUNS}, s AS (SELECT event_id AS run_id, user_id AS n_books FROM events WHERE event_id % 2 = 0),
m AS (SELECT 'a' AS catalogue, r.*, s.n_books FROM runs r LEFT JOIN s USING (run_id) WHERE run_id % 2 = 0 UNION ALL
  SELECT 'b', r.*, s.n_books FROM runs r LEFT JOIN s USING (run_id) WHERE run_id % 5 = 0)
SELECT catalogue, run_id, n_books FROM m WHERE run_id % 10 <> 0 ORDER BY started_at DESC, run_id DESC LIMIT 40""")
def runs_merged(spark, sf_dir):
    runs = _runs(spark, sf_dir).where("run_id % 10 <> 0")
    summary = table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("n_books"))
    both = {"a": (runs.where("run_id % 2 = 0"), summary), "b": (runs.where("run_id % 5 = 0"), summary)}
    return trails.merged_runs(both, 40).select("catalogue", "run_id", "n_books")


@query("""
SELECT 'paper' AS kind, 'f' || user_id % 3 AS fingerprint, event_type AS name, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'book', NULL, nullif(['', 'plain', 'strict'][doc_id % 3 + 1], ''), count(*) FROM documents GROUP BY 3""")
def run_profile_buckets(spark, sf_dir):
    papers = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("fingerprint"), F.col("event_type").alias("name"))
    return trails.profile_buckets(papers, _docs(spark, sf_dir).select(_pick("doc_id", "", "plain", "strict").alias("profile_ref")))


@query("""
SELECT 'lang' AS measure, coalesce(lang, 'none') AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', coalesce(source, 'none'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'verdict', ['clean', 'needs_work', 'failed'][doc_id % 3 + 1], count(*) FROM documents GROUP BY 2""")
def dry_run_counts(spark, sf_dir):
    return trails.dry_run_summary(_docs(spark, sf_dir).withColumn("verdict", _pick("doc_id", "clean", "needs_work", "failed")), ["lang", "source", "verdict"])


@query("""
WITH c AS (SELECT event_id AS call_id, range(event_id % 4) AS h, 'f' || event_id % 3 AS f FROM events)
SELECT call_id, CAST(x AS INTEGER) AS rank, call_id * 10 + x AS node_id FROM c, unnest(h) AS t(x) WHERE f = 'f1'""")
def fresh_hits(spark, sf_dir):
    e = F.col("event_id")
    hits = F.transform(F.sequence(F.lit(0), (e % 4).cast("int")), lambda x: F.struct((e * 10 + x).alias("node_id")))
    calls = table(spark, sf_dir, "events").select(e.alias("call_id"), F.concat(F.lit("f"), (e % 3).cast("string")).alias("corpus_fingerprint"), F.slice(hits, F.lit(1), (e % 4).cast("int")).alias("hits"))
    return trails.prune_stale(*trails.log_calls(calls), "f1")[1]


@query("SELECT conv_id AS call_id, CAST(turn AS INTEGER) AS rank, role FROM conversations")
def ranked_citations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    candidates = rows.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("index"), "role")
    ranked = rows.select(F.col("conv_id").alias("call_id"), F.col("turn").cast("int").alias("rank"), F.col("turn").alias("index"))
    return trails.take_ranked(candidates, ranked).select("call_id", "rank", "role")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
b AS (SELECT conv_id, turn, i, n AS s, 1 AS r, 0 AS batch FROM c WHERE i = 1
  UNION ALL SELECT c.conv_id, c.turn, c.i, CASE WHEN b.s + c.n > 400 OR b.r >= 3 THEN c.n ELSE b.s + c.n END, CASE WHEN b.s + c.n > 400 OR b.r >= 3 THEN 1 ELSE b.r + 1 END,
    CASE WHEN b.s + c.n > 400 OR b.r >= 3 THEN b.batch + 1 ELSE b.batch END FROM b JOIN c ON c.conv_id = b.conv_id AND c.i = b.i + 1)
SELECT conv_id, turn, CAST(batch AS INTEGER) AS batch FROM b""")
def embed_batches(spark, sf_dir):
    return trails.greedy_batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.char_length("text"), 400, 3)


_L = "string_split(text, chr(10))"


@query(f"""
WITH l AS (SELECT doc_id, trim(unnest({_L})) AS line, generate_subscripts({_L}, 1) AS i FROM documents),
b AS (SELECT doc_id, line FROM l WHERE line <> '' AND length(line) > 24),
n AS (SELECT doc_id, line, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS state, count(*) AS leaves FROM n GROUP BY ALL
UNION ALL SELECT doc_id, 'not_found', 1 FROM documents UNION ALL SELECT doc_id, 'book', 1 FROM documents""")
def resolved_addresses(spark, sf_dir):
    """Every leaf's address, one that is not there and the book's, resolved; states counted by document (equal lines are ambiguous)."""
    own = sinks.stored(trails.addresses(_tree(spark, sf_dir)[2]))  # read twice, so the trees are worked out once
    leaves = own.where("scope like 'leaf:%'").select("doc_id", "scope").distinct()
    every = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("leaf:none"), F.lit("book"))).alias("scope"))
    found = trails.resolve_in(own, leaves.unionByName(every))
    state = F.when(F.col("scope") == "book", F.when(F.col("node_id") == F.col("doc_id") * 100_000_000 + 1, "book").otherwise("wrong")).otherwise(F.col("state"))
    return found.groupBy("doc_id", state.alias("state")).agg(F.count("*").alias("leaves"))


@query("""
SELECT doc_id, concat_ws(' › ', CASE WHEN doc_id % 2 = 0 THEN 'Proc. ' || source END, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id WHEN doc_id % 3 = 1 THEN 'file' || doc_id ELSE 'paper #' || doc_id END) AS breadcrumb FROM documents""")
def paper_breadcrumbs(spark, sf_dir):
    d, i = F.col("doc_id"), F.col("doc_id").cast("string")
    crumb = trails.paper_breadcrumb(
        F.when(d % 2 == 0, F.concat(F.lit("Proc. "), "source")), F.when(d % 3 == 0, F.concat(F.lit(" Title "), i)).otherwise(F.lit(" ")),
        F.when(d % 3 == 1, F.concat(F.lit("file"), i)), d,
    )
    return _docs(spark, sf_dir).select("doc_id", crumb.alias("breadcrumb"))


def _extracted(spark, sf_dir):
    d, i = F.col("doc_id"), F.col("doc_id").cast("string")
    stem = F.when(d % 2 == 0, F.concat(F.lit("Ann Author - Name "), i, F.lit(" (1987, House)"))).otherwise(F.concat(F.lit("scan"), i))
    return _docs(spark, sf_dir).select(
        "doc_id", F.when(d % 5 == 0, "UNTITLED!").when(d % 5 == 1, "A scan by BookShare").when(d % 5 == 2, "doc-1234").when(d % 5 == 3, F.concat(F.lit("Own "), i)).alias("title"),
        F.lit(None).cast("string").alias("subtitle"), F.when(d % 3 == 0, "Press").alias("publisher"), F.when(d % 4 < 2, "2019").alias("year"),
        F.when(d % 4 == 0, "D:20190101000000").otherwise("2019").alias("year_raw"), F.when(d % 6 == 0, "9780306406157").when(d % 6 == 1, "9780306406158").alias("isbn"),
        F.lit(None).cast("string").alias("series"), F.when(d % 7 == 0, F.col("lang")).alias("language"), F.when(d % 11 == 0, "ocr-pages").otherwise("pdf").alias("adapter"),
        ids.name_fields(stem).alias("name"),
    )


@query("""
WITH x AS (SELECT doc_id AS d, lang, doc_id % 2 = 0 AS named FROM documents),
k AS (SELECT *, CASE WHEN d % 5 = 3 THEN 'Own ' || d END AS t, CASE WHEN d % 3 = 0 THEN 'Press' END AS p, CASE WHEN d % 4 = 1 OR (d % 4 = 0 AND NOT named) THEN '2019' END AS y,
  CASE WHEN d % 6 = 0 THEN '9780306406157' END AS i, CASE WHEN d % 7 = 0 THEN lang END AS l FROM x)
SELECT d AS doc_id, coalesce(t, CASE WHEN named THEN 'Name ' || d END) AS title, coalesce(p, CASE WHEN named THEN 'House' END) AS publisher, coalesce(y, CASE WHEN named THEN '1987' END) AS year,
  i AS isbn, l AS language, CASE WHEN d % 11 = 0 THEN 'ocr_marker' WHEN coalesce(t, p, y, i, l) IS NOT NULL OR NOT named THEN 'extracted' ELSE 'filename' END AS source,
  concat_ws(',', CASE WHEN d % 6 = 1 THEN 'drop:isbn' END, CASE WHEN d % 4 = 0 AND named THEN 'drop:year' END,
    CASE d % 5 WHEN 0 THEN 'drop:title:placeholder' WHEN 1 THEN 'drop:title:substring' WHEN 2 THEN 'drop:title:regex' END,
    CASE WHEN named AND t IS NULL THEN 'filename:title' END, CASE WHEN named AND p IS NULL THEN 'filename:publisher' END, CASE WHEN named AND y IS NULL THEN 'filename:year' END) AS actions FROM k""")
def base_attributes(spark, sf_dir):
    found = rework.base_attributes(_extracted(spark, sf_dir), ("untitled",), ("bookshare",), (r"^doc-\d+$",))
    return found.select("doc_id", "title", "publisher", "year", "isbn", "language", "source", F.array_join("actions", ",").alias("actions"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Paper ' || doc_id || ' on things' WHEN 4 THEN 'Title of it' END AS title, CAST(CASE WHEN doc_id % 2 = 0 THEN 1990 + doc_id % 9 END AS INTEGER) AS year FROM documents""")
def sniffed_titles(spark, sf_dir):
    d, i = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = F.when(d % 5 == 0, F.concat(F.lit(" Paper "), i, F.lit(" on things "))).when(d % 5 == 1, "draft_final.docx").when(d % 5 == 2, "arXiv:2101.00001v1 [cs]").when(d % 5 == 3, "12-34/56 ab").otherwise("Title of it")
    date = F.when(d % 2 == 0, F.concat(F.lit("D:"), (1990 + d % 9).cast("string"), F.lit("0101"))).otherwise("unknown")
    return _docs(spark, sf_dir).select("doc_id", rework.sniff_title(raw).alias("title"), rework.pdf_year(date).alias("year"))


@query(f"""
WITH {_ITEMS} SELECT CASE WHEN intake_id % 4 = 0 THEN 'missing' WHEN intake_id % 4 = 1 THEN 'mismatched' WHEN intake_id % 4 = 2 THEN 'failed' ELSE 'rebuilt' END AS bucket, count(*) AS n
FROM items WHERE intake_id % 3 <> 0 GROUP BY 1""")
def rebuild_buckets(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("extractor_version", F.when(F.col("intake_id") % 3 == 0, 7).when(F.col("intake_id") % 3 == 1, 6))
    k = F.col("intake_id") % 4
    envelopes = items.where(k != 0).select("intake_id", F.when(k == 1, "other").otherwise(F.col("source_sha256")).alias("source_sha256"), F.when(k != 2, F.lit("{}")).alias("body"))
    return rework.rebuild_plan(items, envelopes, 7).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id AS intake_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE conv_id % 2 = 0 AND conv_id IN (SELECT doc_id FROM documents) GROUP BY conv_id""")
def reembed_items(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("intake_id"), "text")
    return rework.reembed_plan(_items(spark, sf_dir).where("intake_id % 2 = 0"), chunks)


@query(f"""
WITH {_ITEMS} SELECT status, count(*) AS n, count(*) FILTER (WHERE todo AND has) AS with_chunks, count(*) FILTER (WHERE todo AND NOT has) AS without
FROM (SELECT CASE WHEN status = 'embedded' THEN 'extracted' ELSE status END AS status, status IN ('embedded', 'extracted') AS todo, intake_id IN (SELECT conv_id FROM conversations) AS has FROM items) GROUP BY 1""")
def reset_items(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("intake_id"))
    items, todo = rework.reset(_items(spark, sf_dir), chunks)
    return items.join(todo, "intake_id", "left").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("has_chunks")).alias("with_chunks"), F.count_if(~F.col("has_chunks")).alias("without"))


@query("""
WITH r AS (SELECT doc_id, ['clean', 'needs_work'][doc_id % 2 + 1] AS v, ['low', 'medium', 'high'][doc_id % 3 + 1] AS c, CASE WHEN doc_id % 5 <> 0 THEN ['clean', 'needs_work', 'needs_work'][doc_id % 3 + 1] END AS nv,
  ['low', 'high'][doc_id % 2 + 1] AS nc FROM documents)
SELECT doc_id AS intake_id, v AS old_verdict, coalesce(nv, v) AS verdict, CASE WHEN nv IS NULL THEN c ELSE nc END AS confidence, nv IS NOT NULL AND (nv <> v OR nc <> c) AS changed, CASE WHEN nv IS NULL THEN 'partial' ELSE 'ok' END AS outcome FROM r""")
def reaudited(spark, sf_dir):
    ids_ = _docs(spark, sf_dir).select(F.col("doc_id").alias("intake_id"), "doc_id")
    old = ids_.select("intake_id", _pick("doc_id", "clean", "needs_work").alias("verdict"), _pick("doc_id", "low", "medium", "high").alias("confidence"))
    new = ids_.select("intake_id", F.when(F.col("doc_id") % 5 != 0, _pick("doc_id", "clean", "needs_work", "needs_work")).alias("verdict"), _pick("doc_id", "low", "high").alias("confidence"))
    return rework.reaudit(old, new).drop("old_confidence")


@query("""
SELECT conv_id AS intake_id, count(*) AS pages, 0 AS missing_kept, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_sha256, conv_id % 2 = 0 AS accepted
FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents) GROUP BY conv_id""")
def ocr_products(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("intake_id"), F.col("turn").alias("page"), "text")
    want = rows.groupBy("intake_id").agg((F.count("*") + F.col("intake_id") % 2).alias("expected"))
    found = rework.ocr_product(rows.join(want, "intake_id"), _items(spark, sf_dir))
    kept = F.when(F.col("accepted"), F.col("missing")).otherwise(F.col("missing") - 1)
    return found.select("intake_id", "pages", kept.cast("int").alias("missing_kept"), F.sha2("text", 256).alias("text_sha256"), "accepted")


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Head' || doc_id || ' one two leaf' WHEN 1 THEN 'Head' || doc_id || ' three leaf' ELSE 'Head' || doc_id || ' leaf' END AS words,
  CASE doc_id % 3 WHEN 0 THEN '["one","two"]' WHEN 1 THEN '["three"]' END AS names FROM documents""")
def entry_texts(spark, sf_dir):
    d = F.col("doc_id")
    payload = F.when(d % 3 == 0, '{"aliases": ["one", "two", ""]}').when(d % 3 == 1, '{"alias": "three", "aliases": []}').otherwise('{"x": 1}')
    names = rework.aliases(payload)
    head = F.concat(F.lit("Head"), d.cast("string"))
    return _docs(spark, sf_dir).select("doc_id", rework.full_text(head, names, F.lit("leaf")).alias("words"), rework.strings_as_json(names).alias("names"))


@query("""SELECT doc_id, '{"home": "<HOME>/x' || doc_id || '", "list": ["plain ' || source || '", "<HOME>/y"], "n": ' || doc_id || '}' AS scrubbed FROM documents""")
def scrubbed_json(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    value = F.concat(F.lit('{"home": "/home/ann/x'), d, F.lit('", "list": ["plain '), "source", F.lit('", "/Users/bob/y"], "n": '), d, F.lit("}"))
    return _docs(spark, sf_dir).select("doc_id", rework.scrub_json(value).alias("scrubbed"))


@query("""
SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS en, CAST(lang = 'de' AS INTEGER) AS de, CASE WHEN lang IN ('en', 'de') THEN lang ELSE '' END AS back,
  trim(regexp_replace(substr(text, 1, 5) || ' ' || substr(text, 11), '\\s+', ' ', 'g')) AS stripped FROM (SELECT doc_id, lang, left(regexp_replace(text, '[^ -~]', '', 'g'), 40) AS text FROM documents)""")
def flags_and_spans(spark, sf_dir):
    names = ("en", "de")
    rows = _docs(spark, sf_dir).select("doc_id", F.array("lang").alias("flags"), F.left(F.regexp_replace("text", "[^ -~]", ""), F.lit(40)).alias("text"))
    wide = rows.select("doc_id", "text", *rework.one_hot(F.col("flags"), names))
    return wide.select("doc_id", *names, F.array_join(rework.from_one_hot(names), "").alias("back"), rework.strip_span(F.col("text"), F.lit(5), F.lit(10)).alias("stripped"))


_HEADING = f"(?m){abstracts.LINE}{abstracts.HEADING}"


@query(rf"""
WITH p AS (SELECT doc_id, 'Item ' || doc_id || chr(10) || ['Abstract: ', '摘要' || chr(10), 'Summary ', ''][doc_id % 4 + 1] || substring(coalesce(text, ''), 1, 700) AS p0,
    ['Keywords owls ', '1 Introduction ', ''][doc_id % 3 + 1] || substring(coalesce(text, ''), 701, 800) AS p1, substring(coalesce(text, ''), 1501) AS p2 FROM documents),
f AS (SELECT doc_id, p0 || chr(10) || chr(10) || p1 || chr(10) AS front, front || chr(10) || p2 || chr(10) AS whole FROM p),
r AS (SELECT *, regexp_replace(regexp_extract(whole, '{_HEADING}((?s:.*))', 3), '([。.])\s+({abstracts.NEXT})', '\1' || chr(10) || '\2', 'g') AS rest FROM f),
a AS (SELECT *, trim(regexp_replace(left(regexp_split_to_array(rest, '(?im){abstracts.LINE}{abstracts.NEXT}')[1], {abstracts.MOST}), '\s+', ' ', 'g')) AS own,
  nullif(trim(regexp_replace(left(front, {abstracts.FRONT}), '\s+', ' ', 'g')), '') AS first_pages FROM r)
SELECT doc_id, CASE WHEN length(own) >= {abstracts.LEAST} THEN own ELSE first_pages END AS abstract,
  CASE WHEN length(own) >= {abstracts.LEAST} THEN CASE WHEN regexp_extract(whole, '{_HEADING}', 1) <> '' THEN 'heading-cn' ELSE 'heading-en' END
    WHEN first_pages IS NOT NULL THEN 'fallback-first-pages' END AS reason FROM a""")
def paper_abstracts(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    pages = F.array(
        F.concat(F.lit("Item "), F.col("doc_id").cast("string"), F.lit("\n"), _pick("doc_id", "Abstract: ", "摘要\n", "Summary ", ""), F.substring(text, 1, 700)),
        F.concat(_pick("doc_id", "Keywords owls ", "1 Introduction ", ""), F.substring(text, 701, 800)),
        F.expr("substring(coalesce(text, ''), 1501)"),
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return abstracts.paper_abstracts(docs.select("doc_id", F.posexplode(pages).alias("page", "text")))


@query("""
SELECT source AS shelf, count(*) AS n, count(DISTINCT word) AS words, true AS words_close, true AS lengths_close
FROM (SELECT source, unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY source""")
def shelf_sketches(spark, sf_dir):
    """Sketches of even documents, merged with those of odd ones, against exact counts and ranks of all words."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    words = docs.select("doc_id", "source", F.explode(F.split(F.lower("text"), " ", -1)).alias("word")).withColumn("size", F.char_length("word"))
    half = lambda odd: sketches.sketched(words.where(F.col("doc_id") % 2 == odd), "source", F.col("word"), F.col("size"))
    about = sketches.statistics(sketches.merged(half(0), half(1))).withColumnRenamed("distinct", "about")
    sizes = words.groupBy("source", "word", "size").count().groupBy("source", "size").agg(F.sum("count").alias("rows"), F.count("*").alias("words"))
    met = F.broadcast(about).join(sizes, F.col("shelf").eqNullSafe(F.col("source")))
    low = [F.sum(F.when(F.col("size") < F.col("quantiles")[i], F.col("rows")).otherwise(0)) for i in range(3)]
    high = [F.sum(F.when(F.col("size") <= F.col("quantiles")[i], F.col("rows")).otherwise(0)) for i in range(3)]
    n, error = F.first("n"), 2 * sketches.RANK_ERROR
    close = [(low[i] / n - error <= r) & (high[i] / n + error >= r) for i, r in enumerate((0.25, 0.5, 0.75))]
    return met.groupBy("shelf").agg(
        n.alias("n"), F.sum("words").alias("words"),
        (F.abs(F.first("about") - F.sum("words")) <= 1.5 * sketches.DISTINCT_ERROR * F.sum("words")).alias("words_close"),
        (close[0] & close[1] & close[2]).alias("lengths_close"),
    )

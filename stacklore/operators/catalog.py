"""The catalogue: curated metadata over extracted, filters, pages, counts, logs and upkeep of keyed tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vocabularies.
STATUSES = ("pending", "needs_ocr", "extracted", "structured", "embedded", "failed")
REVIEWS = ("pending", "approved", "acknowledged", "rejected")
RUN_STATES = ("running", "ok", "error", "abandoned")
CONFIDENCE = ("low", "medium", "high")
ROLES = ("author", "translator", "editor", "other")
FORMATS = ("epub", "pdf", "txt", "ocr-markdown")
MARC_ROLES = {"aut": "author", "trl": "translator", "trc": "translator", "edt": "editor"}


def valid(value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise ValueError(f"{value!r} is none of {', '.join(known)}")
    return value


def clamp_limit(limit: int) -> tuple[int, bool]:
    """Rows of a page: 20 if none are asked for, 100 at most; whether that cut what was asked."""
    return (20, False) if limit <= 0 else (min(limit, 100), limit > 100)


# --- layers -----------------------------------------------------------------


def effective(base: DataFrame, overrides: DataFrame, fields: list[str], key: str = "intake_id") -> DataFrame:
    """base with each of fields as its override has it; an override whose value is null hides the base value.

    overrides: key, field, value. One pivot and one join for all fields.
    """
    wide = overrides.where(F.col("field").isin(fields)).groupBy(key)
    found = wide.agg(*[F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"_o_{f}") for f in fields])
    joined = base.join(found, key, "left")
    value = lambda f: F.when(F.col(f"_o_{f}").isNull(), F.col(f)).otherwise(F.col(f"_o_{f}.value"))
    return joined.select(*[value(c).alias(c) if c in fields else c for c in base.columns])


def inherit(children: DataFrame, parents: DataFrame, fields: list[str], key: str = "intake_id", parent: str = "parent_id") -> DataFrame:
    """Fields that a child lacks, from its parent."""
    up = parents.select(F.col(key).alias("_p"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    out = children.join(up, children[parent] == up["_p"], "left")
    return out.select(*[F.coalesce(c, f"_p_{c}").alias(c) if c in fields else c for c in children.columns])


@dataclass(frozen=True)
class Filter:
    """What a listing asks for; all that is given must hold."""

    title: str | None = None
    contributor: str | None = None
    role: str | None = None
    statuses: tuple[str, ...] = ()
    formats: tuple[str, ...] = ()
    confidence: str | None = None
    review: str | None = None
    year: str | None = None
    categories: tuple[str, ...] = field(default=())


def find(items: DataFrame, contributors: DataFrame, reviews: DataFrame, categories: DataFrame, ask: Filter) -> DataFrame:
    """Items that fit. Contributors and categories are semi-joins, so an item comes once however many of them fit."""
    has = lambda c, needle: F.contains(F.lower(c), F.lit(needle.lower()))
    tests: list[Column] = []
    if ask.title:
        tests.append(has("title", ask.title))
    if ask.statuses:
        tests.append(F.col("status").isin([valid(s, STATUSES) for s in ask.statuses]))
    if ask.formats:
        tests.append(F.col("format").isin(list(ask.formats)))
    if ask.confidence:
        tests.append(F.col("confidence") == valid(ask.confidence, CONFIDENCE))
    if ask.year:
        tests.append(F.col("year") == ask.year)
    out = items.where(reduce(Column.__and__, tests, F.lit(True)))
    if ask.contributor or ask.role:
        people = contributors
        if ask.contributor:
            people = people.where(has("name", ask.contributor))
        if ask.role:
            people = people.where(F.col("role") == valid(ask.role, ROLES))
        out = out.join(people, "intake_id", "left_semi")
    if ask.review:  # an item without a review row is pending
        kept = out.join(reviews.select("intake_id", "review"), "intake_id", "left")
        out = kept.where(F.coalesce("review", F.lit("pending")) == valid(ask.review, REVIEWS)).select(*out.columns)
    if ask.categories:
        out = out.join(categories.where(F.col("category").isin(list(ask.categories))), "intake_id", "left_semi")
    return out


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A page in order with the total beside each row and whether more follow."""
    size, _ = clamp_limit(limit)
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(order).offset(offset).limit(size)
    return cut.crossJoin(F.broadcast(total)).withColumn("more", F.lit(offset + size) < F.col("total"))


def top_contributor(contributors: DataFrame) -> DataFrame:
    return contributors.groupBy("intake_id").agg(F.min_by("name", F.struct("role", "ordinal")).alias("name"))


def detail(items: DataFrame, contributors: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with their contributors in order and their review (pending if there is none)."""
    people = contributors.groupBy("intake_id").agg(F.array_sort(F.collect_list(F.struct("role", "ordinal", "name"))).alias("contributors"))
    out = items.join(people, "intake_id", "left").join(reviews, "intake_id", "left")
    return out.withColumn("review", F.coalesce("review", F.lit("pending")))


# --- counts -----------------------------------------------------------------


def counts(rows: DataFrame, column: str, vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """(value, n) of a column; with a vocabulary, its values that do not occur have 0."""
    found = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if not vocabulary:
        return found
    known = rows.sparkSession.createDataFrame([(v,) for v in vocabulary], "value string")
    return F.broadcast(known).join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def library_stats(items: DataFrame, stages: DataFrame, issues: DataFrame) -> DataFrame:
    """(measure, value, n): statuses with zeros, formats, stages and issues without."""
    named = [("status", counts(items, "status", STATUSES)), ("format", counts(items, "format")), ("stage", counts(stages, "stage")), ("issue", counts(issues, "status"))]
    return reduce(DataFrame.unionByName, [d.select(F.lit(m).alias("measure"), "value", "n") for m, d in named])


def run_rollup(audits: DataFrame, flags: list[str]) -> DataFrame:
    """One row for each run: books, papers, verdict counts, flag sums without zeros, milliseconds.

    audits: run_id, kind, verdict, ts and a boolean for each flag.
    """
    verdicts = audits.groupBy("run_id", "verdict").agg(F.count("*").alias("n")).groupBy("run_id")
    verdicts = verdicts.agg(F.array_sort(F.collect_list(F.struct("verdict", "n"))).alias("verdicts"))
    sums = audits.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "book").alias("n_books"),
        F.count_if(F.col("kind") == "paper").alias("n_papers"),
        (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("wall_ms"),
        F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*[F.count_if(F.col(f)) for f in flags])).alias("flags"),
    )
    sums = sums.withColumn("flags", F.map_filter("flags", lambda _, v: v > 0))
    return sums.join(verdicts.withColumn("verdicts", F.map_from_entries("verdicts")), "run_id")


def upper_median(values: Column) -> Column:
    """The upper of two middle values, not their mean."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def missing_pages(pages: DataFrame, key: str, expected: str, number: str) -> DataFrame:
    """Page numbers that should be there and are not, and those that should not be."""
    found = pages.groupBy(key).agg(F.max(expected).alias("n"), F.collect_set(number).alias("have"))
    want = F.when(F.col("n") >= 1, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>"))
    have = F.col("have").cast("array<int>")
    return found.select(key, F.array_sort(F.array_except(want, have)).alias("missing"), F.array_sort(F.array_except(have, want)).alias("excess"))


# --- logs and work lists ----------------------------------------------------


def ocr_worklist(items: DataFrame, audit: DataFrame) -> DataFrame:
    """Items that need OCR and have no derived product yet, with the reason that was logged last."""
    done = items.where(F.col("derived_from_sha256").isNotNull() & F.col("status").isin("extracted", "structured", "embedded"))
    todo = items.where("status = 'needs_ocr'").alias("i").join(
        done.select(F.col("derived_from_sha256").alias("done")), F.col("i.source_sha256") == F.col("done"), "left_anti"
    )
    why = audit.groupBy("intake_id").agg(F.max_by("message", F.struct("ts", "audit_id")).alias("reason"))
    return todo.join(why, "intake_id", "left")


def recent(log: DataFrame, ts: str, since: str, key: str, limit: int) -> DataFrame:
    return log.where(F.col(ts) >= F.lit(since).cast("timestamp")).orderBy(F.desc(ts), F.desc(key)).limit(limit)


def retrieval_log(calls: DataFrame, tools: DataFrame, limit: int) -> DataFrame:
    return calls.join(tools, "call_id").orderBy(F.desc("call_id")).limit(limit)


def displayed_status(held: Column) -> Column:
    """A run whose lock nobody holds is abandoned."""
    return F.when((F.col("status") == "running") & ~held, "abandoned").otherwise(F.col("status"))


def run_id(command: Column, started: Column, root: Column) -> Column:
    return F.concat_ws("-", command, started, F.substring(F.sha2(F.concat_ws("|", command, started, root), 256), 1, 8))


# --- upkeep of keyed tables -------------------------------------------------


def register(known: DataFrame, sources: DataFrame) -> DataFrame:
    """known and the sources whose hash it lacks, each once, with the next free ids in order of hash.

    Ids are counted within each of the 4,096 leading parts of the hashes, from the number
    of sources in the parts before: no task sees all of them.
    """
    new = sources.join(known, "source_sha256", "left_anti").dropDuplicates(["source_sha256"]).withColumn("_part", F.substring("source_sha256", 1, 3))
    parts = new.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = known.agg(F.coalesce(F.max("intake_id"), F.lit(0)).alias("_top"))
    starts = parts.select("_part", before.alias("_before")).crossJoin(F.broadcast(top))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("source_sha256"))
    numbered = new.join(F.broadcast(starts), "_part").withColumn("intake_id", F.col("_top") + F.col("_before") + nth)
    return known.unionByName(numbered.select(*known.columns), allowMissingColumns=True)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with changes by key; changes hold one row for each key."""
    return table.join(changes, keys, "left_anti").unionByName(changes.select(*table.columns))


def patch(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """table with columns that changes has a value for; keys that table lacks are added."""
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = table.join(new, keys, "full_outer")
    return out.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else c for c in table.columns])


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone, keys, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "intake_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the rows of gone, and (table, n) of the rows that go."""
    kept = {name: remove(t, gone, [key]) for name, t in tables.items()}
    lost = [t.join(gone, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    return kept, reduce(DataFrame.unionByName, lost)


def keep_days(log: DataFrame, ts: str, days: int, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return log.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def link_once(items: DataFrame, links: DataFrame) -> DataFrame:
    """Set derived_from_sha256; another value than one that is there is an error."""
    new = links.select("intake_id", F.col("derived_from_sha256").alias("_new"))
    out = items.join(new, "intake_id", "left")
    clash = F.col("_new").isNotNull() & F.col("derived_from_sha256").isNotNull() & (F.col("_new") != F.col("derived_from_sha256"))
    value = F.when(clash, F.raise_error(F.lit("derived_from_sha256 is set to another value")).cast("string")).otherwise(F.coalesce("_new", "derived_from_sha256"))
    return out.withColumn("derived_from_sha256", value).drop("_new")


def diff(built: DataFrame, live: DataFrame, key: str = "entry_key") -> DataFrame:
    """(key, change) of entries that were added, removed or changed."""
    mark = lambda d, n: d.select(key, F.sha2(F.to_json(F.struct("*")), 256).alias(n))
    both = mark(built, "_b").join(mark(live, "_l"), key, "full_outer")
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_b") != F.col("_l"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def to_csl(items: DataFrame, contributors: DataFrame) -> DataFrame:
    """(intake_id, csl): CSL-JSON of each item."""
    name = F.struct(F.substring_index("name", " ", -1).alias("family"), F.regexp_replace("name", r" ?\S+$", "").alias("given"))
    people = contributors.where("role = 'author'").groupBy("intake_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", name.alias("n")))).alias("p"))
    csl = F.to_json(F.struct(F.col("intake_id").cast("string").alias("id"), F.lit("book").alias("type"), "title", "publisher", F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts")).alias("issued"), F.col("p.n").alias("author")))
    return items.join(people, "intake_id", "left").select("intake_id", csl.alias("csl"))


def from_csl(rows: DataFrame, column: str = "csl") -> tuple[DataFrame, DataFrame]:
    """Attributes and contributors of CSL-JSON rows (intake_id, csl)."""
    kind = "struct<title:string,publisher:string,issued:struct<`date-parts`:array<array<int>>>,author:array<struct<family:string,given:string>>>"
    parsed = rows.select("intake_id", F.from_json(column, kind).alias("c"))
    attrs = parsed.select("intake_id", "c.title", "c.publisher", F.col("c.issued.date-parts")[0][0].cast("string").alias("year"))
    people = parsed.select("intake_id", F.posexplode("c.author").alias("ordinal", "a")).select(
        "intake_id", F.lit("author").alias("role"), "ordinal", F.trim(F.concat_ws(" ", "a.given", "a.family")).alias("name")
    )
    return attrs, people

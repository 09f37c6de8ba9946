"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

A cell (source, language, topic) weighs as many tokens as are wanted of it. Weights are
raked: scaled, one margin after the other, until their sums match the tokens wanted of
every source, language and topic. No cell can give more tokens than it has, so each step
also holds the weights at that bound, and the other cells make up for it in the next. A
document is then kept with the probability weight / tokens of its cell, which makes the
expected tokens of the cell, and so of all margins, equal to what was raked.

What is wanted of a value is its share of the target, or all its tokens if these are
fewer; the other values then share the rest in proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MARGINS = ("source", "lang", "topic")
#: cells up to this number are sent to every executor; beyond it they are joined by salted keys
SMALL_CELLS, SALTS = 50_000, 16
WORD = r"[^\x20\x09-\x0D]+"


def default_topic() -> Column:
    """A topic by the first cue that a text holds: an address, a licence, a table, or none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(F.lower(text), F.lit("license")), "legal")
        .when(F.contains(text, F.lit(" | ")), "tabular")
        .otherwise("prose")
    )


@dataclass(frozen=True)
class Plan:
    """fraction (0 to 1) of all tokens wanted; exponent < 1 flattens the shares that become targets."""

    fraction: float = 0.5
    exponent: float = 0.7
    rounds: int = 20
    seed: str = "mix"


def keyed(docs: DataFrame, topic: Column | None, seed: str) -> DataFrame:
    """The row itself, its cell, its tokens, and a number in [0, 1) that its id alone decides."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8)
    return docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
        (default_topic() if topic is None else F.coalesce(topic, F.lit("unknown"))).alias("topic"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("tokens"),
        (F.conv(digits, 16, 10).cast("double") / float(1 << 32)).alias("draw"),
    )


def targets(cells: DataFrame, margin: str, plan: Plan, wanted: DataFrame | None = None) -> DataFrame:
    """(value, target): tokens wanted of each value of a margin; no more than it has, and plan.fraction of all together.

    Shares are those of wanted (value, target), in which a value that is left out has none,
    or else the tokens to the power of plan.exponent. Values that cannot give their share
    give all they have; the running sums say for each value, in order of tokens by share,
    what the values from it on would get if all before it gave theirs.
    """
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("t").cast("double").alias("t")).where("t > 0")
    if wanted is None:
        sums = sums.withColumn("x", F.pow("t", F.lit(plan.exponent)))
    else:
        sums = sums.join(wanted.select("value", F.col("target").cast("double").alias("x")), "value").where("x > 0")
    order = Window.orderBy(F.col("t") / F.col("x"), "value")
    whole = cells.agg((F.sum("t") * plan.fraction).alias("whole"))
    rows = sums.crossJoin(F.broadcast(whole)).select(
        "value", "t", "x",
        F.greatest(F.col("whole") - F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("t"), F.lit(0.0)).alias("left"),
        F.sum("x").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    rate = F.min(F.when(F.col("left") * F.col("x") <= F.col("t") * F.col("rest"), F.struct((F.col("t") / F.col("x")).alias("at"), "value", (F.col("left") / F.col("rest")).alias("rate"))))
    rate = rows.agg(rate.alias("r")).select("r.rate")
    return rows.crossJoin(F.broadcast(rate)).select("value", F.coalesce(F.least("t", F.col("rate") * F.col("x")), F.col("t")).alias("target"))


def rake(cells: DataFrame, plan: Plan, wanted: dict[str, DataFrame] | None = None, small: int = SMALL_CELLS) -> DataFrame:
    """cells (source, lang, topic, t) with column w, the expected tokens of each, at most t, and to_<margin>, the targets.

    wanted may give (value, target) for a margin. Up to small cells are raked in one task, a
    window for each step. More are aggregated and joined in all tasks, a checkpoint for
    each step, so that a source with most of the cells is no bottleneck.
    """
    now = cells.withColumn("t", F.col("t").cast("double")).withColumn("w", F.col("t") * plan.fraction)
    for margin in MARGINS:
        aim = targets(cells, margin, plan, (wanted or {}).get(margin))
        aim = aim.select(F.col("value").alias(margin), F.col("target").alias(f"to_{margin}"))
        now = now.join(aim, margin, "left")
    now = cut(now)
    scaled = lambda margin, total: (
        F.when(total > 0, F.least("t", F.col("w") * (F.coalesce(f"to_{margin}", F.lit(0.0)) / total))).otherwise(0.0)
    )
    if now.count() <= small:
        for at in range(0, plan.rounds, 10):  # a longer chain of windows is more than a plan can hold
            now = now.coalesce(1)
            for margin in MARGINS * min(10, plan.rounds - at):
                now = now.withColumn("w", scaled(margin, F.sum("w").over(Window.partitionBy(margin))))
            now = cut(now)
        return now
    for margin in MARGINS * plan.rounds:
        sums = now.groupBy(margin).agg(F.sum("w").alias("sum"))
        now = cut(now.join(sums, margin).withColumn("w", scaled(margin, F.col("sum"))).drop("sum"))
    return now


def margins(raked: DataFrame) -> DataFrame:
    """(margin, value, tokens, target, expected) of raked cells: where expected falls short, the margins cannot all be met."""
    each = [
        raked.groupBy(F.col(m).alias("value")).agg(
            F.sum("t").alias("tokens"), F.coalesce(F.max(f"to_{m}"), F.lit(0.0)).alias("target"), F.sum("w").alias("expected")
        ).select(F.lit(m).alias("margin"), "*")
        for m in MARGINS
    ]
    return each[0].unionByName(each[1]).unionByName(each[2])


def calibrate(raked: DataFrame, plan: Plan) -> DataFrame:
    """p, the probability to keep a document of each raked cell: its expected tokens by its tokens.

    Cells without tokens keep their documents at the overall rate.
    """
    return raked.select(*MARGINS, F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(plan.fraction).alias("p"))


def mix(
    docs: DataFrame, plan: Plan = Plan(), topic: Column | None = None, wanted: dict[str, DataFrame] | None = None
) -> DataFrame:
    """row (all of docs), doc_id, source, lang, topic, tokens, probability and sampled of every row.

    docs needs doc_id, text, lang and source; other columns stay inside row, so their names
    cannot clash. Null sources, languages and topics are the value ``unknown``; null and
    empty texts have no tokens. Rows with an equal id share one draw, so repeats stay or
    go together; null ids count as one. An empty table gives an empty result.
    """
    rows = keyed(docs, topic, plan.seed)
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("t")))
    rates = cut(calibrate(rake(cells, plan, wanted), plan))
    if rates.count() <= SMALL_CELLS:
        found = rows.join(F.broadcast(rates), list(MARGINS))
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        found = rows.withColumn("salt", own).join(salted, [*MARGINS, "salt"])
    return found.select(
        "row", "doc_id", *MARGINS, "tokens", F.col("p").alias("probability"), (F.col("draw") < F.col("p")).alias("sampled")
    )


def sql(plan: Plan = Plan()) -> str:
    """The same for DuckDB, rounds written out: each round's tables are one link of a chain."""
    topic = (
        "CASE WHEN contains(coalesce(text, ''), '@') THEN 'contact' "
        "WHEN contains(lower(coalesce(text, '')), 'license') THEN 'legal' "
        "WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' ELSE 'prose' END"
    )
    links = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {topic} AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
        CAST(CAST('0x' || substr(md5('{plan.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS draw
        FROM documents)""",
        f"c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t, CAST(sum(tokens) AS DOUBLE) * {plan.fraction} AS w FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        links.append(f"s_{m} AS MATERIALIZED (SELECT {m}, sum(t) AS t, pow(sum(t), {plan.exponent}) AS x FROM c0 GROUP BY {m} HAVING sum(t) > 0)")
        links.append(
            f"b_{m} AS MATERIALIZED (SELECT {m}, t, x, greatest((SELECT sum(t) * {plan.fraction} FROM c0) - sum(t) OVER (ORDER BY t / x, {m} ROWS UNBOUNDED PRECEDING) + t, 0) AS rest, "
            f"sum(x) OVER (ORDER BY t / x, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xs FROM s_{m})"
        )
        links.append(
            f"t_{m} AS MATERIALIZED (SELECT {m}, coalesce(least(t, x * (SELECT rest / xs FROM b_{m} WHERE rest * x <= t * xs ORDER BY t / x, {m} LIMIT 1)), t) AS target FROM b_{m})"
        )
    n = 0
    for _ in range(plan.rounds):
        for m in MARGINS:
            n += 1
            links.append(
                f"c{n} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.t, CASE WHEN s.s > 0 THEN least(c.t, c.w * (coalesce(t.target, 0) / s.s)) ELSE 0 END AS w "
                f"FROM c{n - 1} c JOIN (SELECT {m}, sum(w) AS s FROM c{n - 1} GROUP BY {m}) s ON c.{m} = s.{m} LEFT JOIN t_{m} t ON c.{m} = t.{m})"
            )
    links.append(f"p AS (SELECT source, lang, topic, CASE WHEN t > 0 THEN w / t ELSE {plan.fraction} END AS p FROM c{n})")
    return (
        "WITH " + ",\n".join(links) + """
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(CAST(p.p AS DOUBLE), 9) AS probability, d.draw < p.p AS sampled
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
    )

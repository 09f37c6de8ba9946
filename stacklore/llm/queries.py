"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, langid, lm, mixing, multiset_hash, packing, quality, simhash, suffix_dedup, token_counts, token_files, topk, whitening
from .common import in_fold, outside_fold, shared_folder, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality.fit(docs, table(spark, sf_dir, "labels"), outside_fold("doc_id", 5, 0))
    return quality.score(docs, network).select(
        "doc_id",
        in_fold("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row").withColumn("probability", F.round("probability", 9))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lm.score(docs, outside_fold("doc_id", 7, 2))
    return scores.withColumn("held_out", in_fold("doc_id", 7, 2))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, outside_fold("doc_id", 4, 2))
    return langid.identify(docs, model).select(
        "doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return token_files.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) / 2 AS BIGINT) AS n
  FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, unnest(range(n - 49)) AS t(p) WHERE n >= 50),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
m AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s = f.s WHERE f.first < w.doc_id),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM m),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
r AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, span),
k AS (SELECT doc_id, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS c, a FROM r),
u AS (SELECT k.doc_id,
        string_agg(CASE WHEN k.c IS NULL THEN substr(d.h, 2 * k.b + 1) ELSE substr(d.h, 2 * k.b + 1, 2 * (k.c - k.b)) END,
                   '' ORDER BY k.a) AS tail,
        min(k.a) AS a, sum(k.b - k.a) AS gone, count(*) AS spans
      FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(u.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(u.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN u.doc_id IS NULL THEN d.h ELSE substr(d.h, 1, 2 * u.a) || u.tail END)) AS kept_sha256
FROM d LEFT JOIN u ON d.doc_id = u.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.sql(), "op5_topk": OP5_SQL, "op6_suffix_dedup": OP6_SQL, "op12_hard_negatives": hard_negatives.sql()}

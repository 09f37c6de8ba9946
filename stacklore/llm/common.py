"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows in an Arrow batch: long texts make the default of 10,000 rows too much memory for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; only a local session may do without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stacklore-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null for a null id)."""
    return F.crc32(F.col(id_column).cast("string")) % folds


def in_fold(id_column: str, folds: int, which: int) -> Column:
    """True where the id falls in that fold; false for a null id."""
    return F.coalesce(fold(id_column, folds) == which, F.lit(False))


def outside_fold(id_column: str, folds: int, which: int) -> Column:
    """True where the id is known and falls in another fold; such rows may be learned from."""
    return F.coalesce(fold(id_column, folds) != which, F.lit(False))


def utf8(column: str = "text") -> Column:
    """The text as bytes, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def whole_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts together."""
    return docs.select(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(rows: DataFrame, draw: Column, most: int) -> DataFrame:
    """Of rows (body and other columns) the most with the smallest draws, however rows are partitioned.

    Rows with equal draws and bodies count once, with the smallest of each other column.
    Only draws and hashes are sorted; the bodies are read again for those that were taken.
    """
    named = rows.withColumn("_draw", draw).withColumn("_hash", F.xxhash64("body"))
    keys = named.select("_draw", "_hash").distinct().orderBy("_draw", "_hash").limit(most)
    taken = named.join(F.broadcast(keys), ["_draw", "_hash"], "left_semi")
    return taken.groupBy("_draw", "_hash").agg(*[F.min(c).alias(c) for c in rows.columns]).drop("_draw", "_hash")


def join_hot(rows: DataFrame, names: DataFrame, key: str, most_hot: int = 10_000) -> DataFrame:
    """rows joined with names (one row for each key). Keys with more than one in most_hot of the rows are broadcast.

    These are fewer than most_hot, so their size is bounded, and their rows stay where they are.
    """
    counts = cut(rows.groupBy(key).agg(F.count("*").alias("_n")))
    edge = max(1000, (counts.agg(F.sum("_n")).first()[0] or 0) // most_hot)
    hot = cut(names.join(F.broadcast(counts.where(F.col("_n") > edge).select(key)), key, "left_semi"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)

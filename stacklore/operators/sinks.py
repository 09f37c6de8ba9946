"""Tables on disk: partitions of items, stamps of what built them, and what they hold."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMPS = ("model", "dim", "chunk_version", "normalize_version")


def append_vectors(chunks: DataFrame, path: str, dims: int) -> None:
    """Append chunk rows by partition_idx; a vector of another length fails the write."""
    right = F.assert_true(F.size("vector") == dims, F.lit(f"a vector has not {dims} components"))
    chunks.withColumn("_ok", right).where("_ok is null").drop("_ok").write.mode("append").partitionBy("partition_idx").parquet(path)


def replace_items(chunks: DataFrame, path: str) -> None:
    """Replace the whole partitions that chunks has rows of; the same call again changes nothing.

    A partition_idx holds one item here (see partition_of); where several share one, use merge_items.
    """
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_idx").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; only a local session may do without that."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if base is None and (known := context._jsc.sc().getCheckpointDir()).isDefined():
        base = known.get()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stacklore-")
    return f"{base}/stacklore-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read back, so that what is read twice is worked out once."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, by: Column | None, key: str) -> tuple[DataFrame, list[str]]:
    """rows, and what windows of key are partitioned by; where by, which key determines, is given, it alone deals out the rows."""
    return (rows, [key]) if by is None else (rows.withColumn("_deal", by).repartition("_deal"), ["_deal", key])


def among(rows: DataFrame, keys: DataFrame, key: str, most: int = 4_000_000) -> DataFrame:
    """rows whose key is among keys; as far as these are few enough to be broadcast, the rows are not shuffled."""
    ids = keys.select(key)
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, key, "left_semi")


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of so many rows, without copies: what a task makes of a slice is all that it holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def merge_items(new: DataFrame, gone: DataFrame, path: str, key: str, partition: str) -> None:
    """Put the rows of new in place of all rows of the keys in gone (key, partition), and leave every other row alone.

    Only the partitions named in gone are read and written again. The merged rows are
    written beside the table first, so a run that is lost on the way loses nothing, and the
    same call again gives the same table.
    """
    spark = new.sparkSession
    system, folder = _folder(spark, path)
    merged = new
    if system.exists(folder):
        touched = gone.select(partition).distinct()
        old = spark.read.schema(new.schema).parquet(path)
        kept = old.join(touched, partition, "left_semi").join(gone.select(key).distinct(), key, "left_anti")
        merged = kept.select(*new.columns).unionByName(new)
    merged = stored(merged)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    # a partition that lost all its rows has none to overwrite it with
    empty = gone.select(partition).distinct().join(merged.select(partition).distinct(), partition, "left_anti")
    for row in empty.toLocalIterator():
        system, folder = _folder(spark, f"{path}/{partition}={row[0]}")
        system.delete(folder, True)


def compact(spark: SparkSession, path: str, partition: int, into: str, files: int = 1) -> None:
    spark.read.parquet(path).where(F.col("partition_idx") == partition).coalesce(files).write.mode("overwrite").parquet(into)


def partition_of(node_id: Column, space: int = 100_000_000) -> Column:
    return F.floor(node_id / space)


def fingerprint(model: str, dim: int, chunk: int, norm: int, index: str) -> Column:
    return F.substring(F.sha2(F.lit(f"{model}|{dim}|{chunk}|{norm}|{index}"), 256), 1, 16)


def reconcile(stored: dict | None, wanted: dict) -> dict:
    """The first write stamps a store; later ones must agree with the stamps."""
    if stored is None:
        return {k: wanted[k] for k in STAMPS}
    other = [k for k in STAMPS if stored.get(k) != wanted.get(k)]
    if other:
        raise ValueError(f"the store was built with other values of {', '.join(other)}")
    return stored


def should_rebuild(built_rows: int, churn: int, floor: int = 20_000) -> bool:
    """Whether an index is due: none yet, or churn of twice what it was built from and at least floor."""
    return built_rows == 0 or churn >= max(2 * built_rows, floor)


def schema_differs(df: DataFrame, expected: str) -> list[str]:
    """Columns that are missing, extra or of another type than a DDL schema says."""
    want = {f.name: f.dataType.simpleString() for f in df.sparkSession.createDataFrame([], expected).schema}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    return [f"{n}: {have.get(n, 'missing')}, expected {want.get(n, 'none')}" for n in sorted(want.keys() | have.keys()) if want.get(n) != have.get(n)]

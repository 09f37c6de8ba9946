"""Streams: ingest that may be repeated, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Vocabularies of the queue.
PRIORITIES = ("high", "normal", "low")
OUTCOMES = ("pending", "done", "failed", "skipped_duplicate", "cancelled")


def ingest(spark: SparkSession, inbox: str, schema: str, library: str, checkpoint: str, key: str = "source_sha256") -> StreamingQuery:
    """Add the new sources of inbox (Parquet) to library, each hash once, and stop when all there is has been read.

    A batch that is run again after a failure adds nothing: its rows are in the library or
    are written under the number of the batch, which is overwritten.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(library).where(F.col("batch") != number).select(key)
        except Exception as error:  # the library's folder does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            known = new.select(key).limit(0)
        new.join(known, key, "left_anti").write.mode("overwrite").parquet(f"{library}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(inbox)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each kind of event in each window; works on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user with less than gap between one and the next."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def queue_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def next_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    """Pending jobs by priority (high, normal, low), then in the order they came."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    other = F.raise_error(F.concat(F.lit("no priority: "), F.coalesce("priority", F.lit("null")))).cast("long")
    rank = F.when(rank > 0, rank).otherwise(other)
    return jobs.where("state = 'pending'").orderBy(rank, "seq").limit(n)


def settle(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """jobs with the states of outcomes (job_id, outcome); running jobs without one are pending again."""
    out = jobs.join(outcomes, "job_id", "left")
    other = F.raise_error(F.concat(F.lit("no outcome of a job: "), F.col("outcome")))
    state = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).when(F.col("outcome").isNotNull(), other).when(F.col("state") == "running", "pending").otherwise(F.col("state"))
    return out.withColumn("state", state).select(*jobs.columns)

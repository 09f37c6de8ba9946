"""A queue of jobs as a stream: commands come in, changes of state come out, and the state outlives a restart.

Jobs are kept in buckets by the first letters of their ids, so that a cancel by prefix sees
every job that it could mean. Ids are hashes; a bucket holds a handful of open jobs, and a
job that has ended is kept only as long as it may be asked for again. A job that was
started and is not heard of for the length of a lease is pending again: by the next command
that means it, or by its bucket's timer once the watermark has passed. A command for another job
ends no lease, so what is logged does not hang on which jobs share a bucket.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: letters of an id that make a bucket; a prefix to cancel by has at least as many
BUCKET = 2
COMMANDS = ("enqueue", "start", "heartbeat", "done", "failed", "cancel")
SCHEMA = "ts timestamp, seq long, command string, job_id string"
CHANGES = "job_id string, ts timestamp, seq long, was string, state string, note string"


@dataclass
class Bucket:
    """Open jobs of one bucket: state and, for a running job, when its lease ends (microseconds)."""

    lease: int
    jobs: dict[str, list] = field(default_factory=dict)

    def expired(self, now: int, only: list[str] | None = None) -> Iterator[tuple]:
        """Jobs (all, or some) whose lease ended before now are pending again."""
        own = [(job, self.jobs[job]) for job in (self.jobs if only is None else only) if job in self.jobs]
        for job, (state, until) in sorted(own, key=lambda x: (x[1][1] or 0, x[0])):
            if state == "running" and until < now:
                self.jobs[job] = ["pending", None]
                yield job, until, None, "running", "pending", "lease ended"

    def apply(self, ts: int, seq: int, command: str, job: str) -> Iterator[tuple]:
        """The changes that a command brings about; a command that cannot be obeyed is a row whose state stays."""
        if command == "cancel":
            fitting = [j for j in self.jobs if j.startswith(job)]
            if len(fitting) == 1:  # a cancel that is refused means no job
                yield from self.expired(ts, fitting)
            yield self._cancel(ts, seq, job, fitting)
            return
        yield from self.expired(ts, [job])
        was = self.jobs[job][0] if job in self.jobs else None
        if command == "enqueue" and was is None:
            self.jobs[job] = ["pending", None]
        elif (command == "start" and was == "pending") or (command == "heartbeat" and was == "running"):
            self.jobs[job] = ["running", ts + self.lease]
        elif command in ("done", "failed") and was == "running":
            del self.jobs[job]
            yield job, ts, seq, was, command, None
            return
        else:
            yield job, ts, seq, was, was, f"refused: {command}"
            return
        now = self.jobs[job][0]
        if now != was:
            yield job, ts, seq, was, now, None

    def _cancel(self, ts: int, seq: int, prefix: str, found: list[str]) -> tuple:
        if len(found) != 1:
            return prefix, ts, seq, None, None, "refused: ambiguous prefix" if found else "refused: no such job"
        was = self.jobs.pop(found[0])[0]
        return found[0], ts, seq, was, "cancelled", None


def _checked(commands: DataFrame) -> DataFrame:
    """commands by bucket. A command that is none, or a prefix that is too short to name a bucket, fails the job."""
    known = F.col("command").isin(*COMMANDS) & (F.char_length("job_id") >= BUCKET)
    bad = F.raise_error(F.concat(F.lit("no command of the queue: "), F.to_json(F.struct("command", "job_id"))))
    rows = commands.withColumn("command", F.when(F.coalesce(known, F.lit(False)), F.col("command")).otherwise(bad.cast("string")))
    return rows.withColumn("bucket", F.substring("job_id", 1, BUCKET))


def changes(commands: DataFrame, lease: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(job_id, ts, seq, was, state, note) of a stream of commands (ts, seq, command, job_id).

    Commands of a batch are obeyed in the order of (ts, seq); those that come more than late
    after others are dropped by the watermark. enqueue of an open job, start of one that is not
    pending, and so on, are refused, with the state as it is. cancel takes a prefix: it must
    fit one open job, or it is refused.
    """
    lease_us = int(pd.Timedelta(lease).total_seconds() * 1e6)

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = Bucket(lease_us, json.loads(state.get[0]) if state.exists else {})
        # a bucket that is always busy has no timer: what the watermark has passed ends before its commands, which are all later
        out = list(bucket.expired(state.getCurrentWatermarkMs() * 1000))
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            times = rows["ts"].astype("datetime64[us]").astype("int64")
            out += [c for row in zip(times, rows["seq"], rows["command"], rows["job_id"], strict=True) for c in bucket.apply(*row)]
        if bucket.jobs:
            state.update((json.dumps(bucket.jobs),))
            if ends := [until for _, until in bucket.jobs.values() if until is not None]:
                state.setTimeoutTimestamp(max(min(ends) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        names = ["job_id", "ts", "seq", "was", "state", "note"]
        frame = pd.DataFrame(out, columns=names)
        yield frame.assign(ts=pd.to_datetime(frame["ts"], unit="us"), seq=frame["seq"].astype("Int64"))

    rows = _checked(commands.select("ts", "seq", "command", "job_id")).withWatermark("ts", late)
    return rows.groupBy("bucket").applyInPandasWithState(of, CHANGES, "jobs string", "append", GroupStateTimeout.EventTimeTimeout)


def run(commands: DataFrame, log: str, checkpoint: str, lease: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Append the changes of all commands there are to log (Parquet), and stop; the next run goes on where this one ended."""
    out = changes(commands, lease, late).writeStream.format("parquet").outputMode("append")
    return out.option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commands_in(spark: SparkSession, folder: str, most_files: int | None = None) -> DataFrame:
    """The commands in a folder of Parquet files, as a stream."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader if most_files is None else reader.option("maxFilesPerTrigger", most_files)).parquet(folder)


def current(log: DataFrame) -> DataFrame:
    """(job_id, state) of every job as the log has it; refusals change nothing."""
    moved = log.where("state is not null and (note is null or note = 'lease ended')")
    # the end of a lease has no number of its own: it comes before a command of the same moment
    last = moved.groupBy("job_id").agg(F.max_by("state", F.struct("ts", F.coalesce("seq", F.lit(-1)))).alias("state"))
    return last.select("job_id", "state")

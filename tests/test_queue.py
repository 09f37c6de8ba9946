"""The queue as a stream: against a plain machine, over batches, restarts and timers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stacklore.streaming import queue

START = dt.datetime(2024, 1, 1)
KIND = "ts timestamp, seq long, command string, job_id string"


def at(minute):
    return START + dt.timedelta(minutes=minute)


def put(spark, folder, *rows):
    spark.createDataFrame([(at(m), s, c, j) for m, s, c, j in rows], KIND).coalesce(1).write.mode("append").parquet(folder)


def run(spark, place, **options):
    queue.run(queue.commands_in(spark, f"{place}/in", options.pop("most_files", None)), f"{place}/log", f"{place}/checkpoint", **options).awaitTermination()
    return spark.read.schema(queue.CHANGES).parquet(f"{place}/log")


def plain(rows, lease):
    """The machine as a loop over all commands in order."""
    bucket, out = {}, []
    for m, s, c, j in sorted(rows, key=lambda r: (r[0], r[1])):
        own = bucket.setdefault(j[: queue.BUCKET], queue.Bucket(lease * 60_000_000))
        out += list(own.apply(int((at(m) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), s, c, j))
    return out


def test_cancel_needs_a_prefix_that_fits_one(spark, tmp_path):
    put(
        spark, f"{tmp_path}/in", (0, 1, "enqueue", "abc1"), (0, 2, "enqueue", "abc2"), (1, 3, "cancel", "abc"), (2, 4, "cancel", "abc1"), (3, 5, "cancel", "abx"),
        (4, 6, "start", "abc2"), (5, 7, "cancel", "ab"), (6, 8, "cancel", "abc2"), (7, 9, "enqueue", "abc1"), (8, 10, "enqueue", "abc1"),
    )
    log = run(spark, tmp_path)
    said = {r.seq: (r.job_id, r.was, r.state, r.note) for r in log.collect()}
    assert said[3] == ("abc", None, None, "refused: ambiguous prefix") and said[5] == ("abx", None, None, "refused: no such job")
    assert said[4] == ("abc1", "pending", "cancelled", None) and said[7] == ("abc2", "running", "cancelled", None)
    assert said[8][3] == "refused: no such job" and said[10] == ("abc1", "pending", "pending", "refused: enqueue")
    assert {r.job_id: r.state for r in queue.current(log).collect()} == {"abc1": "pending", "abc2": "cancelled"}


def test_a_lease_ends_by_timer_and_survives_a_restart(spark, tmp_path):
    put(spark, f"{tmp_path}/in", (0, 1, "enqueue", "aa1"), (1, 2, "start", "aa1"), (2, 3, "enqueue", "bb1"), (3, 4, "start", "bb1"))
    assert {r.state for r in queue.current(run(spark, tmp_path, lease="30 minutes")).collect()} == {"running"}
    # from the checkpoint: bb1 is heard of, time goes on by another bucket's command, so aa1's lease ends and bb1's does not
    put(spark, f"{tmp_path}/in", (25, 5, "heartbeat", "bb1"), (50, 6, "enqueue", "cc1"))
    log = run(spark, tmp_path, lease="30 minutes")
    assert {r.job_id: r.state for r in queue.current(log).collect()} == {"aa1": "pending", "bb1": "running", "cc1": "pending"}
    ended = log.where("note = 'lease ended'").collect()
    assert [(r.job_id, r.ts, r.seq) for r in ended] == [("aa1", at(31), None)]
    put(spark, f"{tmp_path}/in", (51, 7, "start", "aa1"), (52, 8, "done", "aa1"), (52, 9, "done", "bb1"))
    assert {r.job_id: r.state for r in queue.current(run(spark, tmp_path, lease="30 minutes")).collect()} == {"aa1": "done", "bb1": "done", "cc1": "pending"}


def test_a_command_for_another_job_ends_no_lease(spark, tmp_path):
    # aa1's lease ends at 31, aa2 shares its bucket and is heard of at 35, and the watermark stands at 26
    put(spark, f"{tmp_path}/in", (0, 1, "enqueue", "aa1"), (1, 2, "start", "aa1"), (35, 3, "enqueue", "aa2"), (36, 4, "cancel", "aa"))
    log = run(spark, tmp_path, lease="30 minutes")
    assert log.where("note = 'lease ended'").count() == 0
    assert {r.job_id: r.state for r in queue.current(log).collect()} == {"aa1": "running", "aa2": "pending"}
    # a command for the job itself does, and so does the watermark in a bucket that is busy
    put(spark, f"{tmp_path}/in", (37, 5, "start", "aa1"), (38, 6, "start", "aa2"), (90, 7, "enqueue", "aa3"))
    put(spark, f"{tmp_path}/in", (91, 8, "enqueue", "aa4"))
    ended = run(spark, tmp_path, lease="30 minutes").where("note = 'lease ended'").collect()
    assert sorted((r.job_id, r.ts) for r in ended) == [("aa1", at(31)), ("aa1", at(67)), ("aa2", at(68))]


def test_batches_and_restarts_give_what_a_loop_gives(spark, tmp_path):
    r = random.Random(4)
    jobs = [f"{a}{b}{i}" for a in "ab" for b in "xy" for i in range(4)]
    rows, minute = [], 0
    for seq in range(400):
        minute += r.choice([0, 1, 5, 40])
        job = r.choice(jobs)
        command = r.choice(["enqueue", "start", "start", "heartbeat", "done", "failed", "cancel"])
        rows.append((minute, seq, command, job[: r.choice([2, 3])] if command == "cancel" else job))
    for part in range(4):
        put(spark, f"{tmp_path}/in", *rows[part * 100 : part * 100 + 100])
        if part % 2:
            log = run(spark, tmp_path, most_files=1, lease="60 minutes")
    put(spark, f"{tmp_path}/in", (minute, 999, "enqueue", "zz"))
    log = run(spark, tmp_path, lease="60 minutes")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted(key((x.job_id, x.seq, x.was, x.state, x.note)) for x in log.where("job_id <> 'zz' and note is distinct from 'lease ended'").collect())
    want = plain(rows, 60)
    assert got == sorted(key((j, s, a, b, n)) for j, _, s, a, b, n in want if n != "lease ended")
    ended = {(x.job_id, x.ts) for x in log.where("note = 'lease ended'").collect()}
    told = {(j, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t)) for j, t, s, a, b, n in want if n == "lease ended"}
    assert ended >= told and all(t > at(minute - 400) for _, t in ended - told)  # timers may end a lease that no command has met yet
    assert log.agg(F.count("*")).first()[0] >= len(want)

"""Streams that skip, close and keep state: what is opened, what is written, what is late."""

import os
import random

import pytest
from pyspark.sql import functions as F

from batchloom.session import scratch
from batchloom.sources import files, revisions
from batchloom.streaming import balance, changes, ending, eventtime, progress, streams

SCHEMA = "revision bigint, key string"


def append(spark, log, first, n):
    rows = spark.range(first, first + n).select(F.col("id").alias("revision"), F.format_string("k%d", F.col("id") % 5).alias("key"))
    revisions.append_revisions(rows, log, "revision")


def spoil(log, first):
    """Make the files of an append unreadable."""
    hit = 0
    for folder, _, names in os.walk(log):
        if f"revisions={first}.." in folder:
            for name in names:
                if name.endswith(".parquet"):
                    with open(os.path.join(folder, name), "wb") as file:
                        file.write(b"no table")
                    hit += 1
    assert hit


def test_revisions_before_the_start_and_the_checkpoint_are_not_opened(spark):
    log, out, checkpoint = (scratch(spark, n) for n in ("log", "out", "checkpoint"))

    def run(start):
        streams.run_to_file(revisions.read_revisions(spark, log, SCHEMA, "revision", start), "follow", out, checkpoint)
        return sorted(r["revision"] for r in spark.read.parquet(out).collect())

    append(spark, log, 0, 100)
    append(spark, log, 100, 50)
    spoil(log, 0)
    assert run(120) == list(range(120, 150))  # inside an append
    spoil(log, 100)
    append(spark, log, 150, 40)
    assert run(0) == list(range(120, 190))  # the checkpoint goes before the start
    assert run(0) == list(range(120, 190))
    append(spark, log, 200, 5)  # a gap in the numbers
    assert run(0) == [*range(120, 190), *range(200, 205)]


def test_a_log_that_is_not_there_yet(spark):
    log, out, checkpoint = (scratch(spark, n) for n in ("log", "out", "checkpoint"))
    stream = lambda: revisions.read_revisions(spark, log, SCHEMA, "revision", 7)
    streams.run_to_file(stream(), "empty", out, checkpoint)
    append(spark, log, 0, 10)
    streams.run_to_file(stream(), "empty", out, checkpoint)
    assert sorted(r["revision"] for r in spark.read.schema(SCHEMA).parquet(out).collect()) == [7, 8, 9]
    revisions.append_revisions(spark.createDataFrame([], SCHEMA), log, "revision")  # no rows, no folder
    assert [x[:2] for x in revisions.folders(revisions.qualified(spark, log))] == [(0, 9)]


def small_batches(spark, parts, schema, run):
    """Let parts of rows arrive one by one; ``run(stream, checkpoint)`` after each."""
    path, checkpoint = scratch(spark, "arrivals"), scratch(spark, "checkpoint")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        run(streams.watch_folder(spark, path, spark.createDataFrame([], schema).schema), checkpoint)


def bytes_of(path):
    return sum(os.path.getsize(os.path.join(folder, n)) for folder, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_fences_of_small_batches_over_a_large_store(spark):
    rng = random.Random(5)
    parts = [[(n, n % 3000, n % 40) for n in range(6000)]]
    parts += [[(10_000 + 100 * b + i, rng.randrange(3000), rng.randrange(60)) for i in range(10)] for b in range(6)]
    path, sizes = scratch(spark, "fenced"), []

    def run(stream, checkpoint):
        changes.fenced_upsert(stream, path, "k", "fence", "n", checkpoint)
        sizes.append(bytes_of(path))

    with streams.RocksDB(spark):
        small_batches(spark, parts, "n bigint, k bigint, fence bigint", run)
    top, want = {}, set()
    for n, k, fence in (x for part in parts for x in part):
        want.add((n, k, fence, fence >= top.get(k, fence)))
        top[k] = max(fence, top.get(k, fence))
    assert {(r["n"], r["k"], r["fence"], r["accepted"]) for r in changes.fenced_store(spark, path).collect()} == want
    written = [b - a for a, b in zip(sizes, sizes[1:])]
    assert max(written) < sizes[0] / 2


def test_members_of_small_batches_over_a_large_list(spark):
    rng = random.Random(6)
    parts = [[(n, "list") for n in range(20_000)]]
    parts += [[(rng.randrange(20_100), rng.choice(("add", "remove"))) for _ in range(8)] for _ in range(4)]
    parts += [[(n, "list") for n in range(50)] + [(60, "add"), (3, "remove")], [(3, "add"), (60, "remove"), (61, "remove"), (61, "add")]]
    log, sizes, now = scratch(spark, "members"), [], set()

    def run(stream, checkpoint):
        changes.snapshot_plus_watch(stream, log, "member", "kind", lambda rows: rows, checkpoint)
        sizes.append(bytes_of(log))
        part = parts[len(sizes) - 1]
        of = lambda kind: {n for n, k in part if k == kind}
        nonlocal now
        now = ((of("list") or now) | of("add")) - of("remove")
        assert {r["member"] for r in changes.listed_members(spark, log, "member").collect()} == now

    small_batches(spark, parts, "member bigint, kind string", run)
    assert max(b - a for a, b in zip(sizes, sizes[1:])) < sizes[0] / 10


def test_waiting_batches_are_written_once(spark):
    """Two members; the second reports late. What waits is handed out then, and only what is left over is written again."""
    parts = [[("a", n) for n in range(20_000)], [("a", 20_000)], [("a", 20_001)], [("b", 30_000)], [("a", 40_000), ("b", 40_001)]]
    members = spark.createDataFrame([("a",), ("b",)], "m string")
    path, sizes = scratch(spark, "balance"), []

    def run(stream, checkpoint):
        balance.stream_barrier_balance(spark, stream, path, "m", "n", members, checkpoint=checkpoint)
        sizes.append(bytes_of(path))

    small_batches(spark, parts, "m string, n bigint", run)
    assert all(b - a < sizes[0] / 5 for a, b in zip(sizes[:3], sizes[1:3]))
    handed = spark.read.parquet(f"{path}/handed").collect()
    waiting = balance.still_waiting(spark, path).collect()
    every = [x for part in parts for x in part]
    assert sorted([(r["m"], r["n"]) for r in handed] + [(r["m"], r["n"]) for r in waiting]) == sorted(every)
    counts = {m: [sum(r["consumer"] == m and r["batch"] == b for r in handed) for b in (3, 4)] for m in "ab"}
    assert counts["a"] == counts["b"] == [10_001, 1] and len(waiting) == len(every) - 2 * 10_002


def test_parts_close_at_their_markers(spark):
    """A marker in the middle, one that comes late, rows of a closed part, a part without an end, and the end of all."""
    parts = [
        [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 4, False), ("c", 5, False)],
        [("a", 0, False), ("b", 7, True), ("b", 6, False), ("b", 8, True), (None, 9, False)],
        [("b", 10, False), ("c", 11, False)],
        [("c", 12, True), ("a", 13, True)],
        [("c", 14, False)],
    ]
    path, ends = scratch(spark, "closed"), []
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "p string")

    def run(stream, checkpoint):
        ending.close_parts(spark, stream, path, "p", "n", F.col("mark"), expected, checkpoint)
        ends.append(ending.closed_rows(spark, path).where("kind = 'end'").count())

    small_batches(spark, parts, "p string, n bigint, mark boolean", run)
    kinds = {}
    for r in ending.closed_rows(spark, path).where("kind <> 'end'").collect():
        kinds.setdefault(r["kind"], set()).add(r["n"])
    assert kinds == {"row": {1, 4, 5, 6, 9, 11}, "marker": {2, 7, 12}, "late": {0, 3, 8, 10, 13, 14}}
    assert ends == [0, 0, 0, 1, 1]


def test_windows_and_late_rows(spark):
    """A row that is late for one window but not for a later one still counts; one behind all its windows is set aside, once."""
    minute = 60
    parts = [[(0, 10), (1, 125), (2, 600)], [(3, 130), (4, 290), (5, 9), (6, None)], [(7, 9), (8, 700)], [(9, 121)]]
    paths = [scratch(spark, n) for n in ("sliding", "sessions")]

    def run(stream, checkpoint):
        timed = stream.select("n", F.timestamp_seconds("s").alias("t"), F.lit("k").alias("k"))
        eventtime.sliding_sums(spark, timed, paths[0], "t", ["k"], {"n": F.lit(1)}, 4 * minute, 2 * minute, 5 * minute, f"{checkpoint}-a")
        eventtime.sessions(spark, timed, paths[1], "t", "k", 2 * minute, 5 * minute, f"{checkpoint}-b")

    small_batches(spark, parts, "n bigint, s bigint", run)
    # watermarks: none, 600 - 300, 600 - 300, 700 - 300
    late = {5, 7, 9}  # 9 s: in windows that end at 240 at most; 121 s: at 360
    assert sorted(r["n"] for r in eventtime.late_rows(spark, paths[0]).collect()) == sorted(late)
    want = {}
    for n, s in (x for part in parts for x in part if x[0] not in late and x[1] is not None):
        for start in range(s // 120 * 120 - 120, s // 120 * 120 + 1, 120):
            want[start] = want.get(start, 0) + 1
    assert {r["start_us"] // 1000000: r["n"] for r in eventtime.windows_now(spark, paths[0], ["k"], ["n"]).collect()} == want
    assert sorted(r["n"] for r in eventtime.late_rows(spark, paths[1]).collect()) == [3, 5, 7, 9]
    spans = sorted((r["start_us"] // 1000000, r["end_us"] // 1000000, r["beats"]) for r in eventtime.sessions_now(spark, paths[1], "k").collect())
    assert spans == [(10, 245, 2), (290, 410, 1), (600, 820, 2)]


def test_steps_go_on_over_batches_and_lost_checkpoints(spark):
    path, folder, checkpoint = (scratch(spark, n) for n in ("steps", "in", "steps-checkpoint"))
    schema = "at bigint, key string"

    def arrive(rows, folder):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)

    def run(folder, number, checkpoint):
        stream = streams.watch_folder(spark, folder, spark.createDataFrame([], schema).schema)
        progress.follow_steps(spark, stream, path, ["at", "key"], 4, 2, number, checkpoint)
        rows = sorted(progress.stepped_rows(spark, path).collect(), key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(len(rows)))
        assert all(r["step"] == r["position"] // 4 and r["epoch"] == r["position"] // 8 for r in rows)
        return [(r["at"], r["key"]) for r in rows]

    first = [(3, "c"), (None, "n"), (1, "a"), (1, None), (2, "b")]
    arrive(first, folder)
    want = [(None, "n"), (1, None), (1, "a"), (2, "b"), (3, "c")]
    assert run(folder, 0, checkpoint) == want
    arrive([], folder)
    assert run(folder, 0, checkpoint) == want
    arrive([(0, "z")], folder)
    want += [(0, "z")]
    assert run(folder, 0, checkpoint) == want

    later = scratch(spark, "in-again")
    arrive([(5, "e"), (4, "d"), (6, "f")], later)
    want += [(4, "d"), (5, "e"), (6, "f")]
    assert run(later, 1, scratch(spark, "new")) == want
    assert run(later, 1, scratch(spark, "new")) == want  # the micro-batch is repeated

    states = scratch(spark, "states")
    files.save_state(spark.createDataFrame([("other", 9, 2, 4)], "name string, version long, epoch long, step long"), states)
    assert progress.rows_from_state(spark, path, states, "train").count() == 9
    files.save_state(spark.createDataFrame([("train", 1, 0, 0), ("train", 2, 0, 1)], "name string, version long, epoch long, step long"), states)
    again = progress.rows_from_state(spark, path, states, "train")
    assert sorted(r["position"] for r in again.collect()) == [4, 5, 6, 7, 8]
    assert "GreaterThanOrEqual(step,1)" in again._jdf.queryExecution().toString()

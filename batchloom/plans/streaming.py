"""Queries: streams over the event and embedding tables, run to the end of their input."""

from __future__ import annotations


from pyspark.sql import functions as F

from batchloom.functions.scalars import epoch_micros
from batchloom.operators import metrics, scoring
from batchloom.operators.carry import id_block

from batchloom.plans.registry import query
from batchloom.plans.relations import FOLDED
from batchloom.plans.scoring import FETCH, STUDENT, place_sum, place_sum_sql, teacher
from batchloom.session import scratch, table
from batchloom.sources import files, revisions
from batchloom.streaming import balance, changes, ending, eventtime, leases, progress, streams

PART_DAYS = ("2024-01-11", "2024-01-21")  # where the event table is cut into the parts that arrive one by one


def event_parts(spark, sf):
    events = table(spark, sf, "events")
    first, second = PART_DAYS
    ts = F.col("ts")
    return [events.where(ts < first), events.where((ts >= first) & (ts < second)), events.where(ts >= second)]


def replay(spark, parts, name, run):
    """Let the parts arrive one after the other; after each one ``run(stream, checkpoint)`` takes what is new."""
    path, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    for part in parts:
        part.write.mode("append").parquet(path)
        run(streams.watch_folder(spark, path, parts[0].schema), checkpoint)


def replay_to_table(spark, parts, name, operator):
    """What a stream operator appends while the parts arrive."""
    out = scratch(spark, f"{name}-out")
    replay(spark, parts, name, lambda stream, checkpoint: streams.run_to_file(operator(stream), name, out, checkpoint))
    return spark.read.parquet(out)


SESSIONS = """b AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
  g AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM b),
  sessions AS (SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS beats FROM g GROUP BY user_id, k)"""
TTL = 6 * 3600


@query(f"WITH {SESSIONS} SELECT user_id, start_us, end_us, beats FROM sessions")
def lease_liveness(spark, sf):
    return leases.alive_intervals(table(spark, sf, "events"), "user_id", "ts", TTL, "event_id", id_block("event_id"))


def arriving_late(spark, sf):
    """The parts, where every seventh event of the first one arrives with the last one only."""
    first, second, third = event_parts(spark, sf)
    return [first.where("event_id % 7 <> 0"), second, third.unionByName(first.where("event_id % 7 = 0"))]


@query(f"WITH {SESSIONS} SELECT user_id, start_us, end_us, beats, end_us <= (SELECT max(epoch_us(ts)) FROM events) AS closed FROM sessions")
def lease_liveness_stream(spark, sf):
    """All intervals, the open ones too, from a stream with late beats."""
    log = scratch(spark, "lease-log")
    replay(
        spark, arriving_late(spark, sf), "beats", lambda s, cp: leases.watch_leases(s, log, "user_id", "ts", TTL, checkpoint=cp)
    )
    merged = leases.merged_intervals(spark.read.parquet(log), "user_id")
    return merged.select("user_id", "start_us", "end_us", "beats", "closed")


@query(FOLDED)
def watch_changes(spark, sf):
    op = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    log = scratch(spark, "change-log")
    replay(
        spark,
        event_parts(spark, sf),
        "changes",
        lambda s, checkpoint: changes.watch_changes(s, log, ["user_id"], op, "value", "event_id", checkpoint=checkpoint),
    )
    return changes.folded_log(spark, log, ["user_id"])


@query(f"WITH half AS (SELECT count(*) // 2 AS n FROM events), {FOLDED.replace('SELECT', 'folded AS (SELECT', 1).replace('FROM events', 'FROM (SELECT events.* FROM events, half WHERE event_id >= n)')}) SELECT * FROM folded")
def watch_from_revision(spark, sf):
    """The log is read by a source whose offset is the revision: from the middle on, then again from the checkpoint."""
    log, folded, checkpoint = scratch(spark, "revision-log"), scratch(spark, "change-log"), scratch(spark, "revision-checkpoint")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    start = table(spark, sf, "events").count() // 2
    parts = [p.select("event_id", "user_id", "event_type", "value") for p in event_parts(spark, sf)]
    for appended in (parts[:2], parts[2:]):
        for part in appended:
            revisions.append_revisions(part, log, "event_id")
        stream = revisions.read_revisions(spark, log, "event_id bigint, user_id bigint, event_type string, value double", "event_id", start)
        changes.watch_changes(stream, folded, ["user_id"], op, "value", "event_id", start, checkpoint)
    return changes.folded_log(spark, folded, ["user_id"])


VERSIONS = """WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events),
  v AS (SELECT *, sum((old IS DISTINCT FROM event_type)::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS version FROM c)
SELECT user_id, event_id, event_type, version FROM v WHERE old IS DISTINCT FROM event_type"""


@query(VERSIONS)
def versioned_delta(spark, sf):
    states = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return changes.versioned_delta(states, "user_id", "event_type", "event_id", id_block("event_id"))


@query(VERSIONS)
def versioned_delta_stream(spark, sf):
    with streams.RocksDB(spark):
        return replay_to_table(
            spark, event_parts(spark, sf), "states", lambda s: changes.stream_versioned_delta(s, "user_id", "event_type", "event_id")
        )


@query(f"""WITH v AS ({VERSIONS}), n AS (SELECT user_id, max(version) AS version, arg_max(event_type, version) AS value FROM v GROUP BY user_id)
SELECT user_id, user_id % 50 AS known, version, value FROM n WHERE version > user_id % 50""")
def newer_versions(spark, sf):
    """What clients are sent that already know some version; those that know the newest one get nothing."""
    clients = table(spark, sf, "events").select("user_id", (F.col("user_id") % 50).alias("known")).distinct()
    deltas = versioned_delta(spark, sf).withColumnRenamed("event_type", "value")
    return changes.newer_than(deltas, clients, "user_id", "known").select("user_id", "known", "version", "value")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf):
    """Every third report is sent twice in the same part, every fifth one of the first part again with the last; some come late."""
    parts = [p.unionByName(p.where("event_id % 3 = 0")) for p in arriving_late(spark, sf)]
    parts[2] = parts[2].unionByName(parts[0].where("event_id % 5 = 0"))
    with streams.RocksDB(spark):
        kept = replay_to_table(spark, parts, "reports", lambda s: changes.stream_dedup(s, ["event_id"]))
    return kept.select("event_id", "user_id", "event_type")


@query("""SELECT count(*) - count(*) % 8 AS handed, count(*) % 8 AS waiting, count(*) AS distinct_batches,
  (count(*) - count(*) % 8) // 8 AS smallest, (count(*) - count(*) % 8) // 8 AS largest FROM events""")
def stream_barrier_balance(spark, sf):
    """Eight members report events as batches; all members end with the same number of batches."""
    parts = [p.select((F.col("user_id") % 8).alias("member"), "event_id") for p in event_parts(spark, sf)]
    members = table(spark, sf, "events").select((F.col("user_id") % 8).alias("member")).distinct()
    path = scratch(spark, "balance")
    replay(
        spark, parts, "reports", lambda s, cp: balance.stream_barrier_balance(spark, s, path, "member", "event_id", members, checkpoint=cp)
    )
    handed = spark.read.parquet(f"{path}/handed")
    sizes = handed.groupBy("consumer").agg(F.count(F.lit(1)).alias("n"))
    waiting = balance.still_waiting(spark, path)
    every = handed.select("event_id").unionByName(waiting.select("event_id")).distinct()
    return sizes.agg(
        F.sum("n").alias("handed"),
        waiting.agg(F.count(F.lit(1))).scalar().alias("waiting"),
        every.agg(F.count(F.lit(1))).scalar().alias("distinct_batches"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
    )


@query(f"""WITH e AS (SELECT event_id, CASE WHEN ts >= '{PART_DAYS[1]}' AND user_id % 8 = 3 THEN 4 ELSE user_id % 8 END AS member,
    CASE WHEN ts < '{PART_DAYS[0]}' THEN 0 WHEN ts < '{PART_DAYS[1]}' THEN 1 ELSE 2 END AS round FROM events),
  r AS (SELECT round, sum(count(*)) OVER (ORDER BY round) // 8 AS upto FROM e GROUP BY round),
  h AS (SELECT round, (upto - coalesce(lag(upto) OVER (ORDER BY round), 0))::BIGINT AS n FROM r)
SELECT event_id, member, 1::BIGINT AS places, NULL::INT AS round, NULL::BIGINT AS consumer, NULL::BIGINT AS n FROM e
UNION ALL SELECT NULL, NULL, NULL, round, c.range AS consumer, n FROM h, range(8) c""")
def stream_barrier_ended(spark, sf):
    """A member ends in the second part and reports nothing in the last; all go on to get equal shares.

    Every batch with the number of places at which it is, handed out or waiting, and how many each consumer got in each round.
    """
    user = F.col("user_id") % 8
    first, second, third = event_parts(spark, sf)
    moved = F.when(user == 3, 4).otherwise(user)  # the ended member's users go to another one
    marks = spark.range(1).select(F.lit(3).cast("bigint").alias("member"), F.lit(None).cast("bigint").alias("event_id"), F.lit(True).alias("ended"))
    parts = [p.select(m.alias("member"), "event_id", F.lit(False).alias("ended")) for p, m in ((first, user), (second, user), (third, moved))]
    parts[1] = parts[1].unionByName(marks)
    members = table(spark, sf, "events").select(user.alias("member")).distinct()
    path = scratch(spark, "balance")
    replay(
        spark, parts, "reports", lambda s, cp: balance.stream_barrier_balance(spark, s, path, "member", "event_id", members, "ended", cp)
    )
    handed = spark.read.parquet(f"{path}/handed")
    every = handed.select("event_id", "member").unionByName(balance.still_waiting(spark, path).select("event_id", "member"))
    batches = every.groupBy("event_id", "member").agg(F.count(F.lit(1)).alias("places"))
    shares = handed.groupBy(F.col("batch").alias("round"), "consumer").agg(F.count(F.lit(1)).alias("n"))
    return batches.unionByName(shares, allowMissingColumns=True)


@query("""WITH s1 AS (SELECT user_id FROM events WHERE ts >= '2024-01-11' AND ts < '2024-01-21' AND event_type IN ('purchase', 'signup')
    EXCEPT SELECT user_id FROM events WHERE ts >= '2024-01-11' AND ts < '2024-01-21' AND event_type = 'error' AND user_id % 3 = 0)
SELECT user_id AS member FROM (SELECT user_id FROM s1 UNION SELECT user_id FROM events WHERE ts >= '2024-01-21' AND event_type = 'signup')
EXCEPT SELECT user_id FROM events WHERE ts >= '2024-01-21' AND event_type = 'error' AND user_id % 3 = 0""")
def snapshot_plus_watch(spark, sf):
    """Purchases list members in the first two parts; signups add and some errors remove in every part."""

    def kinds(batch):
        kind = (
            F.when((F.col("event_type") == "purchase") & (F.col("ts") < PART_DAYS[1]), "list")
            .when(F.col("event_type") == "signup", "add")
            .when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "remove")
        )
        return batch.select(F.col("user_id").alias("member"), kind.alias("kind"))

    log = scratch(spark, "members")
    replay(spark, event_parts(spark, sf), "watch", lambda s, checkpoint: changes.snapshot_plus_watch(s, log, "member", "kind", kinds, checkpoint))
    return changes.listed_members(spark, log, "member")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY event_type")
def resume_from_checkpoint(spark, sf):
    """Two runs with one checkpoint: the second one reads only what came after the first."""
    parts = event_parts(spark, sf)
    path, out, checkpoint = scratch(spark, "drops"), scratch(spark, "copied"), scratch(spark, "resume-checkpoint")
    for arrived in (parts[:1], parts[1:]):
        for part in arrived:
            part.write.mode("append").parquet(path)
        stream = streams.watch_folder(spark, path, parts[0].schema)
        streams.run_to_file(stream, "resume", out, checkpoint)
    rows = spark.read.parquet(out)
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"), F.sum("event_id").alias("id_sum")
    )


@query("""SELECT epoch_us(ts) // 3600000000 * 3600000000 AS tick_us, count(*) AS submitted, count(*) FILTER (event_type = 'view') AS running,
  count(*) FILTER (event_type = 'signup') AS pending, printf('%.2f', 100.0 * sum(CASE WHEN event_type = 'view' THEN round(value * 1000)::BIGINT ELSE 0 END) / 70001.0) AS utilisation,
  (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) AS closed
FROM events GROUP BY epoch_us(ts) // 3600000000""")
def metric_ticks(spark, sf):
    """One report per hour from the sums that each micro-batch appends; late rows count, the hour that still runs is not closed."""
    hour = 3_600_000_000
    running = F.col("event_type") == "view"
    us = epoch_micros(F.col("ts"))
    log = scratch(spark, "tick-log")

    def each(batch, batch_id):
        sums = batch.groupBy((F.floor(us / hour) * hour).alias("tick_us")).agg(
            F.count(F.lit(1)).alias("submitted"),
            F.count_if(running).alias("running"),
            F.count_if(F.col("event_type") == "signup").alias("pending"),
            F.sum(F.when(running, F.round(F.col("value") * 1000).cast("bigint")).otherwise(0)).alias("used"),
            F.max(us).alias("last_us"),
        )
        sums.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    replay(spark, arriving_late(spark, sf), "ticks", lambda s, cp: streams.run_batches(s, each, "ticks", cp))
    sums = spark.read.parquet(log)
    ticks = sums.groupBy("tick_us").agg(*[F.sum(c).alias(c) for c in ("submitted", "running", "pending", "used")])
    percent = F.format_string("%.2f", 100.0 * F.col("used") / 70001.0)
    closed = F.col("tick_us") + hour <= sums.agg(F.max("last_us")).scalar()
    return ticks.select("tick_us", "submitted", "running", "pending", percent.alias("utilisation"), closed.alias("closed"))


@query(f"WITH {STUDENT} SELECT vec_id, label, {place_sum_sql('s')} AS logit_sum FROM lg")
def stream_scoring(spark, sf):
    samples = table(spark, sf, "embeddings")
    parts = [samples.where("vec_id % 2 = 0"), samples.where("vec_id % 2 = 1")]
    scored = replay_to_table(
        spark, parts, "samples", lambda s: scoring.score_with_teacher(s, teacher(), {"img": "embedding"}, FETCH, 16, keep=["vec_id", "label"])
    )
    return scored.select("vec_id", "label", place_sum(F.col("prediction")).alias("logit_sum"))


@query(f"""WITH {STUDENT}, p AS (SELECT *, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS position FROM lg)
SELECT vec_id, position, position // 16 AS step, position // 160 AS epoch, {place_sum_sql('s')} AS logit_sum FROM p""")
def ordered_stream_scoring(spark, sf):
    """The teacher sees whole steps, wherever their rows lie; positions go on from one arrival to the next."""
    samples = table(spark, sf, "embeddings")
    path = scratch(spark, "ordered")

    def score(numbered):
        dealt = numbered.repartition("step").sortWithinPartitions("step", "position")
        return scoring.score_with_teacher(
            dealt, teacher(), {"img": "embedding"}, FETCH, 16, together="step", keep=["vec_id", "position", "step", "epoch"]
        )

    parts = [samples.where("vec_id % 2 = 0"), samples.where("vec_id % 2 = 1")]
    replay(spark, parts, "ordered-in", lambda s, cp: progress.follow_steps(spark, s, path, ["vec_id"], 16, 10, 0, cp, score))
    rows = progress.stepped_rows(spark, path)
    return rows.select("vec_id", "position", "step", "epoch", place_sum(F.col("prediction")).alias("logit_sum"))


@query(f"""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts >= '{PART_DAYS[0]}', ts >= '{PART_DAYS[1]}', event_id) - 1 AS position FROM events),
  s AS (SELECT *, position // 100 AS step FROM p)
SELECT event_id, position, step, step // 5 AS epoch, step >= (SELECT max(step) FROM s WHERE step % 7 = 0) AS again FROM s""")
def resume_from_state(spark, sf):
    """Steps of 100 events, saved every seventh step. The checkpoint is lost after the first part; ``again`` marks what a restart reads again."""
    path, states = scratch(spark, "stepped"), scratch(spark, "saved")
    parts = event_parts(spark, sf)
    for run, arrived in enumerate((parts[:1], parts[1:])):
        replay(spark, arrived, "arrived", lambda s, cp: progress.follow_steps(spark, s, path, ["event_id"], 100, 5, run, cp))
    rows = progress.stepped_rows(spark, path)
    saved = rows.where("step % 7 = 0").select(F.lit("train").alias("name"), F.col("step").alias("version"), "epoch", "step").distinct()
    files.save_state(saved, states)
    again = progress.rows_from_state(spark, path, states, "train").select("position", F.lit(True).alias("again"))
    columns = ["event_id", "position", "step", "epoch"]
    return rows.join(again, "position", "left").select(*columns, F.coalesce("again", F.lit(False)).alias("again"))


@query("""WITH e AS (SELECT user_id, min(event_id) FILTER (event_type = 'error') AS ending FROM events GROUP BY user_id)
SELECT events.user_id, count(*) FILTER (ending IS NULL OR event_id < ending) AS n_before_end, bool_and(ending IS NOT NULL) AS ended FROM events JOIN e ON events.user_id = e.user_id GROUP BY events.user_id""")
def end_of_data(spark, sf):
    """An error event is a member's end marker; its later rows are not read."""
    rows = replay_to_table(spark, event_parts(spark, sf), "members", lambda s: s.select("user_id", "event_id", "event_type"))
    markers = rows.where(F.col("event_type") == "error").groupBy("user_id").agg(F.min("event_id").alias("ending"))
    placed = rows.join(markers, "user_id", "left")
    open_rows = F.count_if(F.col("ending").isNull() | (F.col("event_id") < F.col("ending")))
    counts = placed.groupBy("user_id").agg(open_rows.alias("n_before_end"))
    flags = metrics.all_reach_end(placed, F.col("ending").isNotNull(), ["user_id"]).withColumnRenamed("all_ended", "ended")
    return counts.join(flags, "user_id")


ARRIVED = f"""a AS (SELECT event_id, user_id, event_type, round(value * 1000)::BIGINT AS cents, epoch_us(ts) AS us,
    CASE WHEN ts < '{PART_DAYS[0]}' AND event_id % 7 <> 0 THEN 0 WHEN ts >= '{PART_DAYS[0]}' AND ts < '{PART_DAYS[1]}' THEN 1 ELSE 2 END AS round FROM events),
  newest AS (SELECT r.round, (SELECT max(us) FROM a WHERE a.round < r.round) - 432000000000 AS w FROM (SELECT DISTINCT round FROM a) r)"""
FIVE_DAYS = 5 * 86400


@query(f"""WITH {ARRIVED}, t AS (SELECT a.*, w IS NOT NULL AND us // 21600000000 * 21600000000 + 86400000000 <= w AS late FROM a JOIN newest ON a.round = newest.round),
  s AS (SELECT us // 21600000000 * 21600000000 - 21600000000 * unnest(range(4)) AS start_us, event_type, cents FROM t WHERE NOT late)
SELECT start_us, start_us + 86400000000 AS end_us, event_type, count(*) AS n, sum(cents)::BIGINT AS cents, NULL::BIGINT AS late_id FROM s GROUP BY start_us, event_type
UNION ALL SELECT NULL, NULL, event_type, NULL, NULL, event_id FROM t WHERE late""")
def sliding_windows(spark, sf):
    """Days that start every six hours, per kind of event, and the events that came over five days late."""
    path, sums = scratch(spark, "sliding"), {"n": F.lit(1).cast("bigint"), "cents": F.round(F.col("value") * 1000).cast("bigint")}
    replay(
        spark,
        arriving_late(spark, sf),
        "arrivals",
        lambda s, cp: eventtime.sliding_sums(spark, s, path, "ts", ["event_type"], sums, 86400, 21600, FIVE_DAYS, cp),
    )
    late = eventtime.late_rows(spark, path).select("event_type", F.col("event_id").alias("late_id"))
    return eventtime.windows_now(spark, path, ["event_type"], list(sums)).unionByName(late, allowMissingColumns=True)


@query(f"""WITH {ARRIVED}, t AS (SELECT a.*, w IS NOT NULL AND us + 21600000000 <= w AS late FROM a JOIN newest ON a.round = newest.round),
  b AS (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before, event_id FROM t WHERE NOT late),
  g AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM b)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS beats, NULL::BIGINT AS late_id FROM g GROUP BY user_id, k
UNION ALL SELECT user_id, NULL, NULL, NULL, event_id FROM t WHERE late""")
def session_windows(spark, sf):
    """Sessions of users with gaps of six hours, and the events that came over five days late."""
    path = scratch(spark, "sessions")
    replay(spark, arriving_late(spark, sf), "arrivals", lambda s, cp: eventtime.sessions(spark, s, path, "ts", "user_id", TTL, FIVE_DAYS, cp))
    late = eventtime.late_rows(spark, path).select("user_id", F.col("event_id").alias("late_id"))
    return eventtime.sessions_now(spark, path, "user_id").drop("closed").unionByName(late, allowMissingColumns=True)


CLOSED = f"""e AS (SELECT event_id, user_id % 8 AS part, event_type = 'error' AND ts >= (CASE WHEN user_id % 8 = 3 THEN '{PART_DAYS[1]}' ELSE '{PART_DAYS[0]}' END)::TIMESTAMP AS mark,
    CASE WHEN ts < '{PART_DAYS[0]}' AND event_id % 7 <> 0 THEN 0 WHEN ts >= '{PART_DAYS[0]}' AND ts < '{PART_DAYS[1]}' THEN 1 ELSE 2 END AS round FROM events),
  m AS (SELECT part, round, min(event_id) AS ending FROM e WHERE mark GROUP BY part, round QUALIFY row_number() OVER (PARTITION BY part ORDER BY round) = 1)"""


@query(f"""WITH {CLOSED}
SELECT event_id, e.part, CASE WHEN ending IS NULL OR e.round < m.round THEN 'row' WHEN e.round > m.round OR event_id > ending THEN 'late'
  WHEN event_id = ending THEN 'marker' ELSE 'row' END AS kind FROM e LEFT JOIN m ON e.part = m.part
UNION ALL SELECT NULL, NULL, 'end' FROM m HAVING count(*) = (SELECT count(DISTINCT part) FROM e)""")
def close_parts(spark, sf):
    """Each of eight parts ends at its first error event of the second or third arrival; older rows that arrive after that are late."""
    kinds = F.when(F.col("user_id") % 8 == 3, PART_DAYS[1]).otherwise(PART_DAYS[0]).cast("timestamp_ntz")
    mark = (F.col("event_type") == "error") & (F.col("ts").cast("timestamp_ntz") >= kinds)
    parts = [p.select("event_id", (F.col("user_id") % 8).alias("part"), mark.alias("mark")) for p in arriving_late(spark, sf)]
    expected = table(spark, sf, "events").select((F.col("user_id") % 8).alias("part"))
    path = scratch(spark, "closed")
    replay(spark, parts, "parts", lambda s, cp: ending.close_parts(spark, s, path, "part", "event_id", F.col("mark"), expected, cp))
    return ending.closed_rows(spark, path).select("event_id", "part", "kind")


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def watch_model_drops(spark, sf):
    """The event file is picked up from its folder as a stream."""
    schema = table(spark, sf, "events").schema
    drops = streams.watch_folder(spark, sf, schema, 8, "events*.parquet")
    path = streams.run_to_file(drops.select("event_type", "user_id"), "drops")
    return spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("users")
    )


@query("""WITH w AS (SELECT event_id, user_id, event_id // 100 + (event_id * 7919) % 40 AS fence FROM events),
  m AS (SELECT *, max(fence) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM w)
SELECT event_id, user_id, fence, top IS NULL OR fence >= top AS accepted FROM m""")
def fenced_upsert(spark, sf):
    fence = F.expr("event_id div 100 + (event_id * 7919) % 40").alias("fence")
    parts = [p.select("event_id", "user_id", fence) for p in event_parts(spark, sf)]
    path = scratch(spark, "fenced")
    with streams.RocksDB(spark):
        replay(spark, parts, "writes", lambda s, cp: changes.fenced_upsert(s, path, "user_id", "fence", "event_id", cp))
    return changes.fenced_store(spark, path).select("event_id", "user_id", "fence", "accepted")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def user_state_hook(spark, sf):
    """State kept as JSON: rows seen, the last one, and errors."""

    def adjust(state, frame):
        return {
            "n": state["n"] + len(frame),
            "last_id": max(state["last_id"], int(frame["event_id"].max())),
            "errors": state["errors"] + int((frame["event_type"] == "error").sum()),
        }

    parts = [p.select("user_id", "event_id", "event_type") for p in event_parts(spark, sf)]
    out = scratch(spark, "user-state")

    def each(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/run={batch_id}")

    def run(stream, checkpoint):
        states = changes.user_state(stream, "user_id", {"n": 0, "last_id": -1, "errors": 0}, adjust)
        streams.run_batches(states, each, "hook", checkpoint, "update")

    with streams.RocksDB(spark):
        replay(spark, parts, "hook", run)
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max_by("state", "batch").alias("state"))
    body = F.from_json("state", "n bigint, last_id bigint, errors bigint")
    return last.select("user_id", body.alias("b")).select("user_id", "b.n", "b.last_id", "b.errors")


@query(f"""WITH {SESSIONS}, w AS (SELECT max(epoch_us(ts)) // 1000 AS ms FROM events)
SELECT user_id, end_us - 21600000000 AS last_us FROM sessions WHERE (end_us + 999) // 1000 <= (SELECT ms FROM w) - 600000
  OR end_us - 21600000000 < (SELECT max(epoch_us(ts)) FROM events e WHERE e.user_id = sessions.user_id)""")
def lease_expiry(spark, sf):
    """Expiry events of a stream: at the end each closed interval has given one."""
    with streams.RocksDB(spark):
        return replay_to_table(
            spark, event_parts(spark, sf), "leases", lambda s: leases.expired_keys(s, "user_id", "ts", TTL, "10 minutes")
        )

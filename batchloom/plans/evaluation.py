"""Queries: counts, job reports, run metrics, metrics along steps, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.functions.scalars import epoch_micros
from batchloom.operators import batching, metrics, windows
from batchloom.operators.carry import id_block
from batchloom.plans.batching import WORDS
from batchloom.plans.registry import query
from batchloom.plans.scoring import rounded
from batchloom.session import spread, table
from batchloom.sources.text import words


def events_by_day(spark, sf):
    """Events with their day number in 2024 and their hour of the month."""
    seconds = epoch_micros(F.col("ts")) - 1704067200 * 1000000
    return table(spark, sf, "events").withColumn("day", F.floor(seconds / 86400e6)).withColumn("hour", F.floor(seconds / 3600e6))


def cents():
    """The event value in whole hundredths, whose mean does not depend on the order of the rows."""
    return F.round(F.col("value") * 100).cast("bigint")


DAYS = """ev AS (SELECT *, (epoch_us(ts) - 1704067200000000) // 86400000000 AS day, (epoch_us(ts) - 1704067200000000) // 3600000000 AS hour FROM events)"""


@query("""WITH c AS (SELECT l_suppkey, count(*) AS size FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, size, (SELECT sum(size)::BIGINT FROM c) AS total, (SELECT round(avg(size), 6) FROM c) AS average FROM c""")
def queue_sizes(spark, sf):
    sizes = metrics.queue_sizes(table(spark, sf, "lineitem"), "l_suppkey")
    return sizes.withColumn("average", F.round("average", 6))


@query(f"""WITH {DAYS}, m AS (SELECT s.day, u.user_id FROM (SELECT DISTINCT day FROM ev) s, (SELECT DISTINCT user_id FROM ev WHERE day = 0) u),
  d AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'error' AND day < 2),
  r AS (SELECT DISTINCT day, user_id FROM ev)
SELECT m.day, count(*) AS expected, count(*) FILTER (r.user_id IS NULL AND d.user_id IS NULL) AS missing,
  count(*) FILTER (r.user_id IS NULL AND d.user_id IS NULL) = 0 AS complete
FROM m LEFT JOIN r ON m.day = r.day AND m.user_id = r.user_id LEFT JOIN d ON m.user_id = d.user_id GROUP BY m.day""")
def barrier_complete(spark, sf):
    """Stages are days; the members of the first day are expected on each later day unless they ended early."""
    events = events_by_day(spark, sf)
    expected = events.where("day = 0").select("user_id")
    ended = events.where((F.col("event_type") == "error") & (F.col("day") < 2))
    return metrics.barrier_complete(events, ended, expected, "day", "user_id")


@query("""SELECT o_orderpriority, bool_and(o_orderstatus IN ('F', 'O', 'P')) AS all_known, bool_and(o_orderstatus = 'F') AS all_ended FROM orders GROUP BY 1""")
def all_reach_end(spark, sf):
    orders = table(spark, sf, "orders")
    known = metrics.all_reach_end(orders, F.col("o_orderstatus").isin("F", "O", "P"), ["o_orderpriority"])
    ended = metrics.all_reach_end(orders, F.col("o_orderstatus") == "F", ["o_orderpriority"])
    return known.withColumnRenamed("all_ended", "all_known").join(ended, "o_orderpriority")


@query("SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status, o_custkey FROM orders")
def status_sets(spark, sf):
    name = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("PENDING")
    return metrics.status_sets(table(spark, sf, "orders"), name, "o_custkey")


PODS = """pods AS (SELECT user_id AS job, value, CASE event_type WHEN 'signup' THEN 'master' WHEN 'error' THEN 'pserver' ELSE 'trainer' END AS role,
  CASE WHEN value < 1 THEN 'Pending' WHEN value < 25 THEN 'Running' ELSE 'Succeeded' END AS phase, event_id FROM events)"""


def pods(spark, sf):
    role = F.when(F.col("event_type") == "signup", "master").when(F.col("event_type") == "error", "pserver").otherwise("trainer")
    phase = F.when(F.col("value") < 1, "Pending").when(F.col("value") < 25, "Running").otherwise("Succeeded")
    return table(spark, sf, "events").select(F.col("user_id").alias("job"), "value", role.alias("role"), phase.alias("phase"), "event_id")


def phase_list_sql(role):
    return f"string_agg(phase || ':' || n, ',' ORDER BY phase) FILTER (role = '{role}')"


@query(f"""WITH {PODS}, c AS (SELECT job, role, phase, count(*) AS n FROM pods GROUP BY ALL)
SELECT job, coalesce({phase_list_sql('master')}, '') AS master, coalesce({phase_list_sql('pserver')}, '') AS pserver,
  coalesce({phase_list_sql('trainer')}, '') AS trainer FROM c GROUP BY job""")
def job_phase_table(spark, sf):
    return metrics.job_phase_table(pods(spark, sf), "job", "role", "phase").na.fill("", list(metrics.ROLES))


@query(f"""WITH {PODS}, r AS (SELECT job, CASE WHEN bool_or(role <> 'trainer' AND phase = 'Pending') THEN 0 ELSE count(*) FILTER (role = 'trainer' AND phase = 'Running') END AS running FROM pods GROUP BY job)
SELECT job, running, job || ':' || running AS report FROM r""")
def running_trainers(spark, sf):
    return metrics.running_trainers(pods(spark, sf), "job", "role", "phase")


@query(f"""WITH {PODS}, r AS (SELECT job, bool_or(role <> 'trainer' AND phase = 'Pending') AS blocked, count(*) FILTER (role = 'trainer') AS t,
  count(*) FILTER (role = 'trainer' AND phase = 'Pending') AS p FROM pods GROUP BY job)
SELECT count(*) AS submitted, count(*) FILTER (blocked OR t = p) AS pending FROM r""")
def submitted_pending_jobs(spark, sf):
    return metrics.submitted_pending_jobs(pods(spark, sf), "job", "role", "phase")


@query(f"""WITH {PODS} SELECT role, printf('%.2f', 100.0 * sum(CASE WHEN phase = 'Running' THEN round(value * 1000)::BIGINT ELSE 0 END) / 99999999.0) AS utilisation, '0' AS gpu FROM pods GROUP BY role""")
def utilisation(spark, sf):
    """CPU requests are whole thousandths, so the sum does not depend on the order of the rows."""
    rows = pods(spark, sf)
    cpu = metrics.utilisation(rows, "phase", F.round(F.col("value") * 1000).cast("bigint"), F.lit(99999999.0), ["role"])
    gpu = metrics.utilisation(rows, "phase", F.lit(1), F.lit(0), ["role"]).withColumnRenamed("utilisation", "gpu")
    return cpu.join(gpu, "role")


@query(f"""WITH {PODS} SELECT role, printf('%.2f', 100.0 * sum(CASE WHEN phase = 'Running' THEN round(value * 1000)::BIGINT + event_id % 4 * 1000 ELSE 0 END) / 99999999.0) AS cpu,
  printf('%.2f', 100.0 * sum(CASE WHEN phase = 'Running' THEN event_id % 3 ELSE 0 END) / 64.0) AS gpu FROM pods GROUP BY role""")
def container_utilisation(spark, sf):
    """Pods of two containers: one asks for thousandths of a CPU and some GPUs, one for whole CPUs or nothing."""
    cores = F.col("event_id") % 4
    milli = F.concat(F.round(F.col("value") * 1000).cast("bigint").cast("string"), F.lit("m"))
    containers = F.array(
        F.struct(milli.alias("cpu"), (F.col("event_id") % 3).alias("gpu")),
        F.struct(F.when(cores > 0, cores.cast("string")).alias("cpu"), F.lit(None).cast("bigint").alias("gpu")),
    )
    rows = pods(spark, sf).withColumn("containers", containers)
    cpu, gpu = metrics.container_requests(F.col("containers"))
    used = metrics.utilisation(rows, "phase", cpu, F.lit(99999999.0), ["role"]).withColumnRenamed("utilisation", "cpu")
    return used.join(metrics.utilisation(rows, "phase", gpu, F.lit(64.0), ["role"]).withColumnRenamed("utilisation", "gpu"), "role")


@query(f"""WITH {DAYS}, b AS (SELECT user_id, max(value) AS best FROM ev GROUP BY user_id)
SELECT user_id, best, (SELECT round(avg(best), 6) FROM b) AS mean_best, (SELECT max(best) FROM b) AS max_best FROM b""")
def run_summary(spark, sf):
    summary = metrics.run_summary(table(spark, sf, "events"), "user_id", "value")
    return summary.withColumn("mean_best", F.round("mean_best", 6))


SCORED = "sc AS (SELECT l.doc_id, l.quality, l.toxic, lang, (n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def scored_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") % 1000 / 1000.0).alias("p"))
    return table(spark, sf, "labels").join(docs, "doc_id")


def auc_sql(source, group):
    """AUC of bucket counts (group, bucket, pos, neg)."""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT {group + ',' if group else ''} sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
      CASE WHEN sum(pos) * sum(neg) > 0 THEN round(sum(neg * (above + pos / 2.0)) / (sum(pos) * sum(neg)), 6) END AS auc
    FROM (SELECT *, coalesce(sum(pos) OVER ({part}ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM {source}) {'GROUP BY ' + group if group else ''}"""


@query(f"""WITH {SCORED}, b AS (SELECT lang, floor(p * 4096)::INT AS bucket, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM sc GROUP BY ALL)
{auc_sql('b', 'lang')}""")
def auc_histogram(spark, sf):
    report = metrics.auc_histogram(scored_documents(spark, sf), F.col("p"), F.col("quality") == 1, group=["lang"])
    return report.withColumn("auc", F.round("auc", 6))


@query(f"""WITH {SCORED}, b AS (SELECT doc_id // 10 AS step, floor(p * 4096)::INT AS bucket, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM sc GROUP BY ALL),
  s AS (SELECT DISTINCT step FROM b),
  w AS (SELECT s.step, bucket, sum(pos) AS pos, sum(neg) AS neg FROM s JOIN b ON b.step BETWEEN s.step - 19 AND s.step GROUP BY ALL)
{auc_sql('w', 'step')}""")
def sliding_auc(spark, sf):
    rows = scored_documents(spark, sf).withColumn("step", F.expr("doc_id div 10"))
    return metrics.sliding_auc(rows, "step", F.col("p"), F.col("quality") == 1).withColumn("auc", F.round("auc", 6))


@query(f"""WITH {DAYS}, b AS (SELECT day AS epoch, hour, avg(value) AS v FROM ev GROUP BY ALL)
SELECT epoch, count(*) AS batches, round(avg(v), 6) AS mean_value FROM b GROUP BY epoch""")
def epoch_means(spark, sf):
    means = metrics.epoch_means(events_by_day(spark, sf), F.col("day"), F.col("hour"), ["value"])
    return means.withColumn("mean_value", F.round("mean_value", 6))


@query("""WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, n, round(avg(o_totalprice), 4) AS median FROM r WHERE pos BETWEEN CASE WHEN n = 2 THEN 1 ELSE (n - 1) // 2 END AND n // 2 GROUP BY ALL""")
def median(spark, sf):
    middle = metrics.median(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"])
    return middle.withColumn("median", F.round("median", 4))


@query(f"""WITH {DAYS}, t AS (SELECT day AS epoch, count(*) AS batches, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0 AS s FROM ev GROUP BY day)
SELECT epoch, batches, round(batches * 32 / s, 6) AS speed, (SELECT round(max(batches * 32 / s) * 8, 6) FROM t) AS max_speed FROM t""")
def throughput(spark, sf):
    speeds = metrics.throughput(events_by_day(spark, sf), F.col("day"), "ts", 32)
    best = speeds.agg(F.round(F.max("speed") * 8, 6)).scalar()
    return speeds.select("epoch", "batches", F.round("speed", 6).alias("speed"), best.alias("max_speed"))


@query(f"""WITH {DAYS} SELECT day AS epoch_no, count(DISTINCT user_id) AS world_size, count(*) AS step_num, avg(round(value * 100)::BIGINT) AS avg_step_time FROM ev GROUP BY day""")
def epoch_attributes(spark, sf):
    return metrics.epoch_attributes(events_by_day(spark, sf), F.col("day"), "user_id", cents())


BOW_WEIGHTS = [[((c * 31 + d * 17) % 13 - 6) / 10.0 for d in range(64)] for c in range(2)]


@query(f"""WITH tk AS (SELECT d.doc_id, unnest({WORDS}) AS w FROM documents d),
  ids AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS id FROM tk),
  e AS (SELECT ids.doc_id, unnest(range(64)) AS d, embedding FROM ids JOIN embeddings ON ids.id = vec_id WHERE ids.id <> 0),
  s AS (SELECT doc_id, d, sum(embedding[d + 1]::DOUBLE) AS x FROM e GROUP BY ALL),
  f AS (SELECT doc_id, d, x / (1 + abs(x)) AS y FROM s)
SELECT t.doc_id, round(coalesce(sum(y * (((0 * 31 + d * 17) % 13) - 6) / 10.0), 0), 6) + 0.0 AS logit0, round(coalesce(sum(y * (((1 * 31 + d * 17) % 13) - 6) / 10.0), 0), 6) + 0.0 AS logit1
FROM (SELECT DISTINCT doc_id FROM tk) t LEFT JOIN f ON t.doc_id = f.doc_id GROUP BY t.doc_id""")
def bag_of_words_pool(spark, sf):
    """Words go to any of the vectors by their hash; the vector 0 stands for padding."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hashed = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint")
    tokens = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    ids = tokens.select("doc_id", F.pmod(hashed, vectors.agg(F.count(F.lit(1))).scalar()).alias("id"))
    pooled = metrics.bag_of_words_pool(ids, "doc_id", "id", vectors, 64, BOW_WEIGHTS)
    return pooled.select("doc_id", rounded(F.col("logits")[0]).alias("logit0"), rounded(F.col("logits")[1]).alias("logit1"))


@query(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents d),
  g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5)
SELECT w[i + 4] AS next_word, count(*) AS n, sum(length(w[i]) + length(w[i + 1]) + length(w[i + 2]) + length(w[i + 3]))::BIGINT AS context_chars FROM g GROUP BY 1""")
def ngram_samples(spark, sf):
    samples = windows.ngram_samples(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", words(F.col("text")))
    chars = F.length(F.array_join("context", ""))
    return samples.groupBy("next_word").agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("context_chars"))


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS us FROM events)
SELECT user_id, (step + 9) // 10 * 10 AS step, count(us) AS steps, sum(us)::BIGINT AS total_us, round(256 / (sum(us) / count(us) / 1000000.0), 6) AS speed FROM s GROUP BY ALL HAVING count(us) > 0""")
def every_n_steps_mean(spark, sf):
    means = windows.every_n_steps_mean(table(spark, sf, "events"), "user_id", "event_id", "ts", 10, 256)
    total = F.round(F.col("period") * F.col("steps") * 1e6).cast("bigint")
    return means.select("user_id", "step", "steps", total.alias("total_us"), F.round("speed", 6).alias("speed"))


@query("""WITH s AS (SELECT user_id, event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) AS us FROM events)
SELECT user_id, event_type, count(us) AS n, coalesce(sum(us), 0)::BIGINT // 1000 AS total_ms FROM s GROUP BY ALL""")
def op_durations(spark, sf):
    spans = windows.op_durations(table(spark, sf, "events"), "user_id", "event_type", "ts", ["event_id"], id_block("event_id"))
    us = F.coalesce(F.sum(F.round(F.col("ms") * 1000).cast("bigint")), F.lit(0))
    return spans.groupBy("user_id", "event_type").agg(F.count("ms").alias("n"), us.alias("us")).select(
        "user_id", "event_type", "n", F.expr("us div 1000").alias("total_ms")
    )


@query(f"""WITH {DAYS}, a AS (SELECT user_id, day, max(value) AS v FROM ev GROUP BY ALL)
SELECT user_id, day, v, max(v) OVER (PARTITION BY user_id ORDER BY day) AS best FROM a""")
def best_so_far(spark, sf):
    scores = events_by_day(spark, sf).groupBy("user_id", "day").agg(F.max("value").alias("v"))
    return windows.best_so_far(scores, "user_id", "day", "v")


@query(f"""WITH {DAYS}, m AS (SELECT DISTINCT event_type, day, user_id FROM ev),
  s AS (SELECT event_type, day, lag(day) OVER (PARTITION BY event_type ORDER BY day) AS before FROM (SELECT DISTINCT event_type, day FROM m)),
  p AS (SELECT s.event_type, s.day, m.user_id FROM s JOIN m ON m.event_type = s.event_type AND m.day = s.before),
  c AS (SELECT m.event_type, m.day, m.user_id FROM m JOIN s ON m.event_type = s.event_type AND m.day = s.day WHERE s.before IS NOT NULL),
  f AS (SELECT coalesce(c.event_type, p.event_type) AS event_type, coalesce(c.day, p.day) AS day, p.user_id IS NULL AS is_new, c.user_id IS NULL AS is_gone
        FROM c FULL JOIN p ON c.event_type = p.event_type AND c.day = p.day AND c.user_id = p.user_id)
SELECT event_type, day, count(*) FILTER (is_new) AS added, count(*) FILTER (is_gone) AS removed,
  bool_or(is_new OR is_gone) OR day // 7 <> (SELECT before // 7 FROM s WHERE s.event_type = f.event_type AND s.day = f.day) AS changed FROM f GROUP BY event_type, day""")
def membership_changed(spark, sf):
    """Members of a day per event type; the stage is the week."""
    return windows.membership_changed(events_by_day(spark, sf), "event_type", "day", F.expr("day div 7"), "user_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_custkey % 4 AS num, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey FROM o WHERE num <= 0 OR rn <= num""")
def pop_n(spark, sf):
    queue = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_custkey") % 4).alias("num"))
    return windows.pop_n(queue, "o_custkey", "o_orderkey", "num").select("o_custkey", "o_orderkey")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) - 1 AS pos FROM documents")
def seeded_shuffle(spark, sf):
    return batching.seeded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", 3)


@query("""WITH s AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p FROM supplier)
SELECT s_nationkey, p // 16 AS line, count(*) AS n, string_agg(s_name, ',' ORDER BY p) AS listing FROM s GROUP BY ALL""")
def sorted_listing(spark, sf):
    names = table(spark, sf, "supplier").select("s_nationkey", "s_name", "s_suppkey")
    return windows.sorted_listing(names, "s_nationkey", "s_name", "s_suppkey", 16)


@query("""SELECT s_suppkey, s_name || ':7000' AS same_port, s_name || ':' || (7000 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS rising_port FROM supplier""")
def endpoint_listing(spark, sf):
    names = table(spark, sf, "supplier").select("s_nationkey", "s_name", "s_suppkey")
    same = windows.endpoints(names, "s_nationkey", "s_name", "s_suppkey", 7000, True).withColumnRenamed("endpoint", "same_port")
    both = windows.endpoints(same, "s_nationkey", "s_name", "s_suppkey", 7000, False)
    return both.select("s_suppkey", "same_port", F.col("endpoint").alias("rising_port"))


@query(f"""WITH {DAYS}, l AS (SELECT day AS epoch, avg(round(value * 100)::BIGINT) AS loss FROM ev GROUP BY day)
SELECT arg_min(epoch, loss) AS epoch, min(loss) AS loss FROM l""")
def best_pass(spark, sf):
    losses = events_by_day(spark, sf).groupBy(F.col("day").alias("epoch")).agg(F.avg(cents()).alias("loss"))
    return windows.best_pass(losses, "epoch", "loss")


@query("""WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rank FROM customer)
SELECT * FROM c WHERE rank < 10""")
def limit_members(spark, sf):
    return windows.limit_members(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 10)

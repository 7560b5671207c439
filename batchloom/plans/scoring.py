"""Queries: teacher scoring, losses and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.functions import losses
from batchloom.operators import batching, filters, metrics, scoring, windows
from batchloom.plans.registry import query
from batchloom.session import scratch, table

CLASSES, DIM, TEACHER_BATCH = 10, 64, 16
FETCH = {"prediction": "array<double>"}


def logits_sql(name, salt=0):
    weight = f"(((c * 31 + d * 17 + {salt} * 7) % 13) - 6) / 10.0"
    return f"list_transform(range(10), lambda c: list_sum(list_transform(range(64), lambda d: embedding[d + 1]::DOUBLE * ({weight})))) AS {name}"


def softmax_sql(x, t="1.0"):
    """Log-softmax of a list expression in DuckDB."""
    return f"list_transform({x}, lambda x: x / {t} - list_max({x}) / {t} - ln(list_sum(list_transform({x}, lambda y: exp(y / {t} - list_max({x}) / {t})))))"


STUDENT = f"lg AS (SELECT vec_id, label, {logits_sql('s')}, {logits_sql('t', 1)} FROM embeddings)"
LOGS = f"""{STUDENT},
  ls AS (SELECT *, {softmax_sql('s')} AS p, {softmax_sql('t')} AS q, {softmax_sql('s', '2.0')} AS p2, {softmax_sql('t', '2.0')} AS q2 FROM lg)"""


def teacher(salt=0):
    return scoring.linear_teacher(CLASSES, DIM, salt)


def scored(spark, sf, keep=("vec_id", "label")):
    """Columns of the embeddings with the logits of one linear teacher."""
    return scoring.score_with_teacher(table(spark, sf, "embeddings"), teacher(), {"img": "embedding"}, FETCH, TEACHER_BATCH, keep=keep)


def student_and_teacher(spark, sf):
    both = scoring.open_several({"s": teacher(0), "t": teacher(1)}, "prediction")
    fetches = {"s": "array<double>", "t": "array<double>"}
    return scoring.score_with_teacher(
        table(spark, sf, "embeddings"), both, {"img": "embedding"}, fetches, TEACHER_BATCH, keep=("vec_id", "label")
    )


def rounded(column, digits=6):
    return F.round(column, digits) + 0.0


def place_sum(column):
    """One number that depends on every element and its place."""
    return rounded(losses.total(F.transform(column, lambda x, i: x * (i + 1))))


def place_sum_sql(x):
    return f"round(list_sum(list_transform({x}, lambda x, i: x * i)), 6) + 0.0"


@query(f"""WITH {STUDENT} SELECT vec_id, label, round(s[1], 6) + 0.0 AS first_logit, {place_sum_sql('s')} AS logit_sum FROM lg""")
def score_with_teacher(spark, sf):
    return scored(spark, sf).select(
        "vec_id", "label", rounded(F.col("prediction")[0]).alias("first_logit"), place_sum(F.col("prediction")).alias("logit_sum")
    )


@query(f"""WITH {LOGS} SELECT vec_id, label, list_position(s, list_max(s)) - 1 AS answer, round(exp(list_max(p)), 6) AS confidence FROM ls""")
def append_predictions(spark, sf):
    both = scored(spark, sf).select("vec_id", "label", F.struct(
        metrics.argmax(F.col("prediction")).alias("answer"), rounded(F.array_max(losses.softmax(F.col("prediction")))).alias("confidence")
    ).alias("fetched"))
    return filters.append_predictions(both, "fetched", ["confidence", "answer"])


DISTILLED = f"""WITH {STUDENT}, o AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM lg)"""


@query(f"""{DISTILLED} SELECT pos, vec_id, label, {place_sum_sql('s')} AS logit_sum FROM o""")
def distill_samples(spark, sf):
    job = scoring.Distillation({"img": "embedding"}, FETCH).with_teacher(teacher()).with_teacher_batch_size(TEACHER_BATCH)
    answered = job.samples(table(spark, sf, "embeddings"), "vec_id").run()
    return answered.select("pos", "vec_id", "label", place_sum(F.col("prediction")).alias("logit_sum"))


LISTED = f"""WITH {STUDENT} SELECT vec_id // 10 AS batch_id, count(*) AS list_size, string_agg(label::VARCHAR, ',' ORDER BY vec_id) AS labels,
  round(sum(list_sum(list_transform(s, lambda x, i: x * i))), 5) + 0.0 AS logit_sum FROM lg GROUP BY ALL"""


def list_report(df, labels, predictions):
    sums = F.aggregate(predictions, F.lit(0.0), lambda a, v: a + losses.total(F.transform(v, lambda x, i: x * (i + 1))))
    return df.select(
        "batch_id", "list_size", F.array_join(labels.cast("array<string>"), ",").alias("labels"), rounded(sums, 5).alias("logit_sum")
    )


@query(LISTED)
def distill_sample_lists(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("batch_id", F.expr("vec_id div 10"))
    job = scoring.Distillation({"img": "embedding"}, FETCH).with_teacher(teacher()).with_teacher_batch_size(4)
    lists = job.sample_lists(rows, "batch_id", "vec_id").run()
    return list_report(lists, F.col("rows.label"), F.col("rows.prediction"))


@query(LISTED)
def distill_columnar_batches(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("batch_id", F.expr("vec_id div 10"))
    slots = ["embedding", "label"]
    batches = batching.to_columnar(batching.collect_ordered(rows, ["batch_id"], "vec_id", slots), "rows", slots)
    job = scoring.Distillation({"img": "embedding"}, FETCH).with_teacher(teacher()).with_teacher_batch_size(4)
    return list_report(job.columnar_batches(batches, "batch_id", slots).run(), F.col("label"), F.col("prediction"))


@query(f"""WITH {STUDENT}, e AS (SELECT vec_id, list_transform(range(10), lambda i: s[i + 1] * 0.75 + t[i + 1] * 0.25) AS m FROM lg)
SELECT vec_id, {place_sum_sql('m')} AS logit_sum FROM e""")
def ensemble_teachers(spark, sf):
    mixed = scoring.ensemble_teachers(
        table(spark, sf, "embeddings"), [(teacher(0), 3.0), (teacher(1), 1.0)], {"img": "embedding"}, "prediction", TEACHER_BATCH, ["vec_id"]
    )
    return mixed.select("vec_id", place_sum(F.col("prediction")).alias("logit_sum"))


@query(f"""WITH {STUDENT} SELECT vec_id, vec_id % 37 = 5 AS dead, CASE WHEN vec_id % 37 <> 5 THEN {place_sum_sql('s')} END AS logit_sum FROM lg""")
def retry_and_dead_letter(spark, sf):
    """Vectors cut short fail with their batch, are tried alone, and end as dead letters."""
    vector = F.when(F.col("vec_id") % 37 == 5, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    rows = table(spark, sf, "embeddings").select("vec_id", vector.alias("embedding"))
    answered = scoring.score_or_dead_letter(rows, teacher(), {"img": "embedding"}, FETCH, TEACHER_BATCH)
    return answered.select("vec_id", F.col("error").isNotNull().alias("dead"), place_sum(F.col("prediction")).alias("logit_sum"))


@query("""WITH o AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS task_id FROM embeddings)
SELECT task_id, count(*) AS feed_count, count(*) FILTER (vec_id % 37 <> 5) AS predict_count, count(*) FILTER (vec_id % 37 = 5) = 0 AS matches FROM o GROUP BY task_id""")
def audit_counts(spark, sf):
    job = scoring.Distillation({"img": "embedding"}, FETCH, teacher()).samples(table(spark, sf, "embeddings"), "vec_id")
    fed = job.tasks().drop("embedding", "label")
    answered = job.scored().where("vec_id % 37 <> 5")
    return scoring.audit_counts(fed, answered, "task_id")


@query("""SELECT vec_id, count(*) OVER () AS feed_count, (SELECT count(*) FROM embeddings WHERE vec_id % 37 <> 5) AS predict_count,
  (SELECT count(*) FROM embeddings WHERE vec_id % 37 = 5) = 0 AS matches FROM embeddings QUALIFY vec_id % 37 <> 5""")
def audited_write(spark, sf):
    """What a teacher answers that loses some rows, with the counts that its one job observed."""
    path = scratch(spark, "answers")

    def score(rows):
        return scoring.score_with_teacher(rows, teacher(), {"img": "embedding"}, FETCH, TEACHER_BATCH, keep=["vec_id"]).where("vec_id % 37 <> 5")

    counts = scoring.audited_write(table(spark, sf, "embeddings").select("vec_id", "embedding"), score, path)
    return spark.read.parquet(path).select("vec_id", *[F.lit(v).alias(n) for n, v in counts.items()])


@query("""SELECT vec_id, label + 1 AS label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""")
def map_records(spark, sf):
    def mapper(frame):
        import numpy as np

        vectors = np.stack(frame["embedding"].to_list()).astype("f8") if len(frame) else np.zeros((0, 1))
        out = frame[["vec_id", "label"]].copy()
        out["label"] += 1
        out["norm"] = np.sqrt((vectors**2).sum(axis=1))
        return out

    mapped = scoring.map_records(table(spark, sf, "embeddings"), mapper, "vec_id bigint, label int, norm double")
    return mapped.withColumn("norm", F.round("norm", 6))


RANKED = f"""{STUDENT},
  r AS (SELECT *, len(list_filter(range(10), lambda i: s[i + 1] > s[label + 1] OR (s[i + 1] = s[label + 1] AND i < label))) AS rank FROM lg)"""


@query(f"""WITH {RANKED} SELECT label, count(*) AS n_rows, round(avg((rank < 1)::INT), 6) AS acc1, round(avg((rank < 5)::INT), 6) AS acc5 FROM r GROUP BY label""")
def topk_accuracy(spark, sf):
    """Flagship: score the embeddings in teacher batches and report top-1 and top-5 accuracy per label."""
    shares = metrics.topk_accuracy(scored(spark, sf, ["label"]), F.col("prediction"), F.col("label"), (1, 5), ["label"])
    return shares.select("label", "n_rows", F.round("acc1", 6).alias("acc1"), F.round("acc5", 6).alias("acc5"))


@query(f"""WITH {STUDENT}, a AS (SELECT label, list_position(s, list_max(s)) - 1 AS g FROM lg),
  k AS (SELECT label AS c FROM a UNION SELECT g FROM a),
  f AS (SELECT c, count(*) FILTER (label = c AND g = c) AS tp, count(*) FILTER (label = c AND g <> c) AS fn, count(*) FILTER (label <> c AND g = c) AS fp FROM k, a GROUP BY c)
SELECT round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fn + fp) ELSE 0 END), 6) AS macro_f1, (SELECT round(avg((label = g)::INT), 6) FROM a) AS accuracy FROM f""")
def macro_f1_accuracy(spark, sf):
    report = metrics.macro_f1_accuracy(scored(spark, sf, ["label"]), F.col("label"), metrics.argmax(F.col("prediction")))
    return report.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {STUDENT}, x AS (SELECT vec_id, unnest(range(10)) AS c, s FROM lg),
  o AS (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY s[c + 1] DESC, c DESC) AS k FROM x)
SELECT vec_id, string_agg(c::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS top FROM o GROUP BY vec_id""")
def argsort_topk(spark, sf):
    top = windows.argsort_topk(F.col("prediction"), 3)
    return scored(spark, sf, ["vec_id"]).select("vec_id", F.array_join(top.cast("array<string>"), ",").alias("top"))


@query(f"""WITH {LOGS} SELECT vec_id, {place_sum_sql('list_transform(p, lambda x: exp(x))')} AS softmax_sum, {place_sum_sql('p')} AS log_sum,
  round(exp(q2[label + 1]), 6) AS soft_label, round(-p[label + 1], 6) + 0.0 AS ce,
  round(-list_sum(list_transform(range(10), lambda i: p2[i + 1] * exp(q2[i + 1]))), 6) + 0.0 AS soft_ce,
  round(list_sum(list_transform(range(10), lambda i: exp(q[i + 1]) * (q[i + 1] - p[i + 1]))), 6) + 0.0 AS kl,
  round((s[1] - t[1]) * (s[1] - t[1]), 6) AS squared FROM ls""")
def softmax_losses(spark, sf):
    s, t = F.col("s"), F.col("t")
    return student_and_teacher(spark, sf).select(
        "vec_id",
        place_sum(losses.softmax(s)).alias("softmax_sum"),
        place_sum(losses.log_softmax(s)).alias("log_sum"),
        rounded(F.get(losses.softmax(t, 2.0), F.col("label"))).alias("soft_label"),
        rounded(losses.cross_entropy(s, F.col("label"))).alias("ce"),
        rounded(losses.soft_cross_entropy(s, losses.softmax(t, 2.0), 2.0)).alias("soft_ce"),
        rounded(losses.total(losses.kl_terms(s, t))).alias("kl"),
        rounded(losses.squared_error(s[0], t[0])).alias("squared"),
    )


@query(f"""WITH {LOGS}, l AS (SELECT label, -p[label + 1] AS ce,
    -list_sum(list_transform(range(10), lambda i: p2[i + 1] * exp(q2[i + 1]))) AS soft,
    list_sum(list_transform(range(10), lambda i: exp(q[i + 1]) * (q[i + 1] - p[i + 1]))) / 10 AS kl FROM ls)
SELECT label, count(*) AS n_rows, round(avg(4.0 * (0.3 * ce + 0.7 * soft)), 6) AS loss_with_t, round(avg(0.3 * ce + 0.7 * kl), 6) AS loss_without_t FROM l GROUP BY label""")
def distill_loss(spark, sf):
    s, t, label = F.col("s"), F.col("t"), F.col("label")
    return student_and_teacher(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        rounded(F.avg(losses.distill_loss(s, label, t, 0.3, 2.0))).alias("loss_with_t"),
        rounded(F.avg(losses.distill_loss(s, label, t, 0.3, None))).alias("loss_without_t"),
    )


@query(f"""WITH {LOGS} SELECT vec_id, label + 1.0 AS hot_place, round(0.9 * (label + 1) + 0.1 / 10 * 55, 6) AS smooth_sum,
  round(0.3 * -p[label + 1] + 0.7 * -p[(label + 3) % 10 + 1], 6) + 0.0 AS mixed FROM ls""")
def label_encoding(spark, sf):
    hot = losses.one_hot(F.col("label"), CLASSES)
    other = losses.cross_entropy(F.col("prediction"), (F.col("label") + 3) % CLASSES)
    return scored(spark, sf).select(
        "vec_id",
        place_sum(hot).alias("hot_place"),
        place_sum(losses.smooth_labels(hot, 0.1)).alias("smooth_sum"),
        rounded(losses.mixup(losses.cross_entropy(F.col("prediction"), F.col("label")), other, F.lit(0.3))).alias("mixed"),
    )


@query(f"""WITH {RANKED}, b AS (SELECT vec_id // 100 AS pass, vec_id // 20 AS batch, avg((rank < 1)::INT) AS acc1, avg((rank < 5)::INT) AS acc5 FROM r GROUP BY ALL),
  m AS (SELECT pass, avg(acc1) AS acc1, avg(acc5) AS acc5, count(*) * 20 / 2.0 AS speed FROM b GROUP BY pass)
SELECT round(arg_max(acc1, pass), 6) AS acc1, round(arg_max(acc5, pass), 6) AS acc5, string_agg(printf('%.5f', acc1), ',' ORDER BY pass) AS acc1_log,
  max(speed) * 8 AS max_speed, 16 AS batch_size FROM m""")
def write_metric_log(spark, sf):
    """Result of a run: last accuracies, their history, top speed times trainers (a pass takes two seconds here)."""
    from batchloom.session import scratch
    from batchloom.sources.files import write_metric_log as write_log

    ranked = scored(spark, sf).withColumn("rank", metrics.label_rank(F.col("prediction"), F.col("label")))
    hits = ranked.select(
        F.expr("vec_id div 100").alias("pass"),
        F.expr("vec_id div 20").alias("batch"),
        (F.col("rank") < 1).cast("double").alias("acc1"),
        (F.col("rank") < 5).cast("double").alias("acc5"),
    )
    passes = metrics.epoch_means(hits, F.col("pass"), F.col("batch"), ["acc1", "acc5"]).withColumn("speed", F.col("batches") * 20 / 2.0)
    path = scratch(spark, "metric-log")
    write_log(passes, path, trainers=8, batch_size=16)
    log = spark.read.schema(
        "acc1 double, acc5 double, result_log array<struct<epoch:bigint,acc1:double,acc5:double>>, max_speed double, batch_size int"
    ).json(path)
    texts = F.transform(F.array_sort("result_log"), lambda x: F.format_string("%.5f", x.acc1))
    return log.select(
        F.round("acc1", 6).alias("acc1"), F.round("acc5", 6).alias("acc5"), F.array_join(texts, ",").alias("acc1_log"), "max_speed", "batch_size"
    )


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_quantity, count(*) AS n_rows, round(any_value(a) * l_quantity + any_value(b), 3) AS answer FROM lineitem, m GROUP BY l_quantity""")
def fit_linear(spark, sf):
    """Fit the price on the quantity, then score every row."""
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    answered = scoring.fit_linear(rows, ["l_quantity"], "l_extendedprice").transform(rows)
    return answered.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.max("prediction"), 3).alias("answer"))


@query("""SELECT feature, (SELECT count(*) FROM embeddings) AS n_rows, true AS orthogonal FROM (SELECT unnest(range(13))::INT AS feature)""")
def fit_linear_features(spark, sf):
    """Least squares on thirteen features: each feature must be orthogonal to what the fit leaves."""
    names = [f"x{i}" for i in range(13)]
    features = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    rows = table(spark, sf, "embeddings").select(*features, F.col("label").cast("double").alias("y"))
    left = scoring.fit_linear(rows, names, "y").transform(rows).withColumn("left", F.col("y") - F.col("prediction"))
    pairs = left.select("left", F.posexplode(F.array(*names)).alias("feature", "x"))
    size = F.sqrt(F.sum(F.col("left") * F.col("left")) * F.sum(F.col("x") * F.col("x")))
    return pairs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.abs(F.sum(F.col("left") * F.col("x"))) <= 1e-6 * size).alias("orthogonal")
    )


@query("SELECT label, count(*) AS n_rows, true AS stationary, true AS better FROM embeddings GROUP BY label")
def fit_softmax(spark, sf):
    """Is the fit of a softmax regression right? The gradient of the mean loss vanishes, and the loss is below that of the shares."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    samples = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    model = scoring.fit_softmax(samples, "x", "label")
    answered = model.transform(samples.withColumn("features", array_to_vector("x")))
    chances = answered.select("label", "x", F.posexplode(vector_to_array("probability")).alias("class", "p"))
    own = (F.col("class") == F.col("label")).cast("double")
    classes = chances.groupBy("class").agg(
        F.sum(own).alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(-own * F.log("p")).alias("loss"),
        F.array(*[F.abs(F.sum((F.col("p") - own) * F.col("x")[i])) for i in range(DIM)]).alias("slopes"),
    )
    known = classes.where("n > 0")
    better = known.agg(F.sum("loss") < F.sum(-F.col("n") * F.log(F.col("n") / F.col("rows")))).scalar()
    return known.select(
        F.col("class").alias("label"),
        F.col("n").cast("bigint").alias("n_rows"),
        (F.array_max("slopes") / F.col("rows") < 1e-3).alias("stationary"),
        better.alias("better"),
    )

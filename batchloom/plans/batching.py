"""Queries: batches of samples, lists and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from batchloom.operators import batching, sharding
from batchloom.operators.positions import range_positions
from batchloom.plans.registry import query
from batchloom.plans.sharding import RECORD_ORDER, SQL_ORDER, supplier_batches, supplier_records
from batchloom.plans.sources import WS
from batchloom.session import table
from batchloom.sources.text import words


def array_sum(column):
    return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)


SAMPLE_TASKS = """WITH e AS (SELECT *, {order} AS pos FROM embeddings)
SELECT pos // 16 AS task_id, count(*) AS n, arg_min(vec_id, pos) AS first_vec, arg_max(vec_id, pos) AS last_vec,
       sum(label)::BIGINT AS label_sum FROM e GROUP BY task_id"""


def task_rows(tasks):
    return tasks.select(
        "task_id",
        F.size("rows").cast("bigint").alias("n"),
        F.col("rows")[0]["vec_id"].alias("first_vec"),
        F.element_at("rows", -1)["vec_id"].alias("last_vec"),
        array_sum(F.col("rows.label").cast("array<bigint>")).alias("label_sum"),
    )


@query(SAMPLE_TASKS.format(order="row_number() OVER (ORDER BY vec_id) - 1"))
def batch_samples(spark, sf):
    return task_rows(batching.batch_samples(table(spark, sf, "embeddings"), "vec_id", ["vec_id", "embedding", "label"], 16))


LISTS = """
  l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
               count(*) OVER (PARTITION BY conv_id) AS list_size FROM conversations),
  o AS (SELECT conv_id, sum(nt) OVER (ORDER BY conv_id) - nt AS first FROM
         (SELECT conv_id, ceil(count(*) / 3.0)::BIGINT AS nt FROM conversations GROUP BY conv_id)),
  tasks AS (SELECT l.*, (first + pos // 3)::BIGINT AS task_id, pos % 3 AS place FROM l JOIN o ON l.conv_id = o.conv_id)
"""


def conversation_tasks(spark, sf):
    return batching.rebatch_lists(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", 3)


@query(f"WITH {LISTS} SELECT conv_id, turn, list_size, task_id, place, md5(text) AS digest FROM tasks")
def rebatch_lists(spark, sf):
    tasks = conversation_tasks(spark, sf)
    return tasks.select("conv_id", "turn", "list_size", "task_id", "place", F.md5("text").alias("digest"))


@query("""WITH l AS (SELECT vec_id // 10 AS batch_id, vec_id % 10 AS item, label FROM embeddings),
  c AS (SELECT batch_id, count(*) AS list_size, ceil(count(*) / 4.0)::BIGINT AS nt FROM l GROUP BY batch_id),
  o AS (SELECT batch_id, list_size, (sum(nt) OVER (ORDER BY batch_id) - nt)::BIGINT AS first FROM c),
  p AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY item) - 1 AS pos FROM l)
SELECT p.batch_id, pos, list_size, first + pos // 4 AS task_id, label FROM p JOIN o ON p.batch_id = o.batch_id""")
def rebatch_columnar(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("batch_id", F.expr("vec_id div 10"))
    slots = ["vec_id", "embedding", "label"]
    columnar = batching.to_columnar(batching.collect_ordered(rows, ["batch_id"], "vec_id", slots), "rows", slots)
    tasks = batching.rebatch_lists(batching.explode_columnar(columnar, slots), "batch_id", "item", 4)
    return tasks.select("batch_id", "pos", "list_size", "task_id", "label")


@query("""SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS task_id, row_number() OVER (ORDER BY vec_id) - 1 AS seq
FROM embeddings""")
def restore_order(spark, sf):
    """Tasks come back in any order; their rows are put in input order, shown as a sequence number."""
    tasks = batching.batch_samples(table(spark, sf, "embeddings"), "vec_id", ["vec_id"], 16)
    mixed = tasks.repartition(F.md5(F.col("task_id").cast("string"))).select("task_id", F.inline("rows"))
    return range_positions(mixed, ["task_id", "place"], "seq").select("vec_id", "task_id", "seq")


@query(f"""WITH {LISTS} SELECT conv_id, 0 AS chunk, list_size, true AS complete, string_agg(turn::VARCHAR, ',' ORDER BY pos) AS turns,
  md5(string_agg(text, '|' ORDER BY pos)) AS digest FROM tasks GROUP BY conv_id, list_size""")
def regroup_lists(spark, sf):
    tasks = conversation_tasks(spark, sf)
    lists = batching.regroup_lists(tasks, "conv_id", "pos", "list_size", ["turn", "text"])
    return lists.select(
        "conv_id",
        "chunk",
        "list_size",
        "complete",
        F.array_join(F.col("rows.turn").cast("array<string>"), ",").alias("turns"),
        F.md5(F.array_join("rows.text", "|")).alias("digest"),
    )


@query("""SELECT vec_id // 10 AS batch_id, count(*) AS n, string_agg(label::VARCHAR, ',' ORDER BY vec_id) AS labels,
  round(sum(embedding[1]::DOUBLE), 6) + 0.0 AS first_sum FROM embeddings GROUP BY ALL""")
def regroup_columnar(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("batch_id", F.expr("vec_id div 10"))
    tasks = batching.rebatch_lists(rows.withColumn("item", F.col("vec_id")), "batch_id", "item", 4)
    lists = batching.regroup_lists(tasks, "batch_id", "pos", "list_size", ["embedding", "label"])
    columnar = batching.to_columnar(lists, "rows", ["embedding", "label"])
    first = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v[0].cast("double"))
    return columnar.select(
        "batch_id",
        F.size("label").cast("bigint").alias("n"),
        F.array_join(F.col("label").cast("array<string>"), ",").alias("labels"),
        (F.round(first, 6) + 0.0).alias("first_sum"),
    )


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) - 1 AS pos FROM orders)
SELECT pos // 100 AS task_id, count(*) AS n, arg_min(o_orderkey, pos) AS first_key, sum(o_custkey)::BIGINT AS cust_sum FROM o GROUP BY task_id""")
def fixed_batches(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    tasks = batching.shuffled_batches(orders, "o_orderkey", 7, ["o_orderkey", "o_custkey"], 100)
    return tasks.select(
        "task_id",
        F.size("rows").cast("bigint").alias("n"),
        F.col("rows")[0]["o_orderkey"].alias("first_key"),
        array_sum(F.col("rows.o_custkey")).alias("cust_sum"),
    )


WORDS = rf"list_filter(regexp_split_to_array(d.text, '{WS}+'), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT d.doc_id, d.text, {WORDS} AS w, coalesce(l.quality, -1) AS label,
    row_number() OVER (ORDER BY d.doc_id) - 1 AS pos FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT pos // 32 AS task_id, count(*) AS n, sum(len(w))::BIGINT AS n_tokens, string_agg(label::VARCHAR, ',' ORDER BY pos) AS labels,
  md5(string_agg(text, '|' ORDER BY pos)) AS digest FROM d GROUP BY task_id""")
def columnar_batches(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    samples = docs.select(
        "doc_id", F.transform(words(F.col("text")), F.length).alias("ids"), F.coalesce("quality", F.lit(-1)).alias("label"), "text"
    )
    slots = ["ids", "label", "text"]
    columnar = batching.to_columnar(batching.batch_samples(samples, "doc_id", slots, 32), "rows", slots)
    return columnar.select(
        "task_id",
        F.size("label").cast("bigint").alias("n"),
        F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x)).alias("n_tokens"),
        F.array_join(F.col("label").cast("array<string>"), ",").alias("labels"),
        F.md5(F.array_join("text", "|")).alias("digest"),
    )


@query(f"""WITH d AS (SELECT doc_id, {WORDS} AS w, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS task_id FROM documents d)
SELECT doc_id, task_id, max(len(w)) OVER (PARTITION BY task_id) AS padded_len, len(w) AS n_tokens,
  list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS id_sum FROM d""")
def pad_batch(spark, sf):
    from batchloom.operators.positions import id_positions

    docs = table(spark, sf, "documents").select(
        "doc_id", F.transform(words(F.col("text")), lambda w: F.length(w).cast("bigint")).alias("ids")
    )
    tasks = batching.number_tasks(id_positions(docs, "doc_id"), "pos", 32)
    padded = batching.pad_batch(tasks, "task_id", "ids")
    return padded.select(
        "doc_id",
        "task_id",
        F.size("padded").cast("bigint").alias("padded_len"),
        F.size(F.filter("padded", lambda x: x != 0)).cast("bigint").alias("n_tokens"),
        F.when(F.size("ids") > 0, array_sum(F.col("padded"))).alias("id_sum"),
    )


QUEUED = f"""
  q AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_ORDER}) - 1 AS record_no FROM lineitem),
  batch AS (SELECT l_suppkey, record_no // 32 AS batch_no, count(*) AS n_records, min(record_no) AS first_record,
    string_agg(l_orderkey || ':' || l_partkey, ',' ORDER BY record_no) AS fields FROM q GROUP BY ALL)
"""


FIELDS = ["l_orderkey", "l_partkey"]


def supplier_batch_data(spark, sf):
    records = sharding.queue_positions(supplier_records(spark, sf), "l_suppkey", [*RECORD_ORDER, "_file", "_row"], 32)
    return batching.make_batch_data(records, "l_suppkey", "batch_no", "record_no", FIELDS)


@query(f"WITH {QUEUED} SELECT l_suppkey || '_' || batch_no AS batch_data_id, n_records, first_record, md5(fields) AS digest FROM batch")
def make_batch_data(spark, sf):
    text = F.transform("records", lambda r: F.array_join(r.field_data.cast("array<string>"), ":"))
    return supplier_batch_data(spark, sf).select(
        "batch_data_id",
        F.size("records").cast("bigint").alias("n_records"),
        F.col("records")[0]["record_no"].alias("first_record"),
        F.md5(F.array_join(text, ",")).alias("digest"),
    )


@query(f"""WITH {QUEUED} SELECT 'reader_0' AS reader_name, l_suppkey::VARCHAR AS producer, NULL::VARCHAR AS consumer, 'host-' || l_suppkey || ':7000' AS endpoint, batch_no // 10 AS report_no,
  string_agg(l_suppkey || '_' || batch_no, ',' ORDER BY batch_no) AS ids FROM batch GROUP BY ALL""")
def report_batch_meta(spark, sf):
    endpoint = F.concat(F.lit("host-"), F.col("l_suppkey").cast("string"), F.lit(":7000"))
    queued = supplier_batches(spark, sf, 32).withColumn("batch_data_id", F.concat_ws("_", "l_suppkey", "batch_no"))
    reports = batching.report_batch_meta(queued, "reader_0", "l_suppkey", "batch_no", endpoint)
    return reports.withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {QUEUED} SELECT l_suppkey || '_' || batch_no AS batch_data_id, n_records, 2 AS fields_per_record FROM batch""")
def batch_summary(spark, sf):
    """Sizes follow from the record counts, so no batch is built."""
    return supplier_batches(spark, sf, 32).select(
        F.concat_ws("_", "l_suppkey", "batch_no").alias("batch_data_id"), "n_records", F.lit(len(FIELDS)).alias("fields_per_record")
    )


JOB_TABLES = ["customer", "documents", "embeddings", "events", "lineitem", "orders", "pages", "part"]


@query(" UNION ALL ".join(
    f"""SELECT '{t}' AS job, count(*) AS images, 32 AS batch_size, ceil(count(*) / 256.0)::BIGINT AS steps,
    ceil(count(*) / 8.0)::BIGINT AS images_per_trainer FROM {t}""" for t in JOB_TABLES))
def plan_steps(spark, sf):
    counts = [table(spark, sf, t).agg(F.lit(t).alias("job"), F.count(F.lit(1)).alias("images")) for t in JOB_TABLES]
    return batching.plan_steps(reduce(lambda a, b: a.unionByName(b), counts), "images", 256, 8)


@query("""WITH p AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS lot FROM events)
SELECT event_id, lot * 500 + row_number() OVER (PARTITION BY lot ORDER BY md5('7|' || event_id), event_id) - 1 AS pos FROM p""")
def buffered_shuffle(spark, sf):
    """Events shuffled inside a buffer of 500."""
    return batching.buffered_shuffle(table(spark, sf, "events").select("event_id"), "event_id", 7, 500)

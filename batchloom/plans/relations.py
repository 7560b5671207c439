"""Queries: filters, lookups, joins and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from batchloom.operators import batching, colocated, filters, lookups, metrics, ranges, sets, sharding

from batchloom.plans.batching import QUEUED, WORDS, array_sum, supplier_batch_data
from batchloom.plans.registry import query
from batchloom.plans.sharding import supplier_batches
from batchloom.plans.sources import DOC_LINES, PLACE_SUM, place_sum
from batchloom.operators.positions import id_positions
from batchloom.session import scratch, spread, table
from batchloom.sources.text import drop_blank_records as drop_blank
from batchloom.sources.text import words


@query(f"WITH {DOC_LINES} SELECT doc_id, line_no - 1 AS line_no, value FROM kept WHERE length(value) > 0")
def drop_blank_records(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return drop_blank(lines, "value").withColumn("line_no", F.col("line_no").cast("bigint"))


@query(f"SELECT vec_id, len(embedding) AS dim, embedding[1]::DOUBLE AS first_value, {PLACE_SUM} AS place_sum FROM embeddings")
def select_feeds(spark, sf):
    fed = filters.select_feeds(table(spark, sf, "embeddings"), ["vec_id"], {"img": "embedding"})
    return fed.select(
        "vec_id",
        F.size("feed.img").cast("bigint").alias("dim"),
        F.col("feed.img")[0].cast("double").alias("first_value"),
        place_sum(F.col("feed.img")).alias("place_sum"),
    )


@query("""WITH s AS (SELECT page_id AS idx, url AS server_path FROM pages WHERE page_id % 61 <> 1),
  c AS (SELECT page_id AS idx, CASE WHEN page_id % 50 = 0 THEN url || '?old' ELSE url END AS client_path FROM pages WHERE page_id % 71 <> 2)
SELECT coalesce(s.idx, c.idx) AS idx, client_path, server_path FROM s FULL JOIN c ON s.idx = c.idx
WHERE client_path IS DISTINCT FROM server_path""")
def check_against_manifest(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("idx"), F.col("url").alias("path"))
    server = pages.where("idx % 61 <> 1")
    stale = F.when(F.col("idx") % 50 == 0, F.concat("path", F.lit("?old"))).otherwise(F.col("path"))
    client = pages.where("idx % 71 <> 2").withColumn("path", stale)
    return lookups.check_against_manifest(client, server, "idx", "path")


RANGES = """
  rg AS (SELECT l_suppkey, l_orderkey AS b, l_orderkey + l_linenumber * 20 AS e FROM lineitem WHERE l_linenumber >= 6),
  rm AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rg),
  ri AS (SELECT *, sum(CASE WHEN pe IS NULL OR b > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM rm),
  merged AS (SELECT l_suppkey, min(b) AS begin_no, max(e) AS end_no FROM ri GROUP BY l_suppkey, g)
"""


def processed_ranges(spark, sf):
    """Record ranges per supplier from the line numbers 6 and 7; they touch and overlap."""
    return table(spark, sf, "lineitem").where("l_linenumber >= 6").select(
        "l_suppkey", F.col("l_orderkey").alias("begin"), (F.col("l_orderkey") + F.col("l_linenumber") * 20).alias("end")
    )


@query(f"WITH {RANGES.replace(' WHERE l_linenumber >= 6', '')} SELECT l_suppkey, begin_no, end_no FROM merged")
def merge_ranges(spark, sf):
    """The ranges of all line items."""
    rows = table(spark, sf, "lineitem")
    every = rows.select("l_suppkey", F.col("l_orderkey").alias("begin"), (F.col("l_orderkey") + F.col("l_linenumber") * 20).alias("end"))
    merged = ranges.merge_ranges(every, "l_suppkey", "begin", "end")
    return merged.select("l_suppkey", F.col("begin").alias("begin_no"), F.col("end").alias("end_no"))


@query(f"""WITH {RANGES}
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS
  (SELECT 1 FROM merged m WHERE m.l_suppkey = l.l_suppkey AND l.l_orderkey BETWEEN begin_no AND end_no)""")
def skip_processed_records(spark, sf):
    records = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    merged = ranges.merge_ranges(processed_ranges(spark, sf), "l_suppkey", "begin", "end")
    return lookups.skip_processed_records(records, merged, "l_suppkey", "l_orderkey")


def numbered_line_items(spark, sf):
    """Line items with a file for each 1000 orders and a record number that grows with the order."""
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record")
    return table(spark, sf, "lineitem").select(F.expr("l_orderkey div 1000").alias("file"), number, "l_partkey")


@query("""WITH r AS (SELECT l_orderkey // 1000 AS file, l_orderkey * 8 + l_linenumber AS record, l_partkey FROM lineitem),
  m AS (SELECT file, min(record) AS first, max(record) AS last FROM r GROUP BY file)
SELECT r.* FROM r JOIN m ON r.file = m.file WHERE r.file % 3 = 2 OR r.file % 3 = 1 AND record > first + (last - first) // 2""")
def skip_finished_files(spark, sf):
    """One file of three is processed in two parts that touch, one up to its middle, one not at all."""
    path = scratch(spark, "records")
    rows = numbered_line_items(spark, sf)
    rows.repartition("file").write.partitionBy("file").parquet(path)
    manifest = rows.groupBy("file").agg(F.min("record").alias("first"), F.max("record").alias("last"))
    middle = F.expr("first + (last - first) div 2")
    early = F.struct(F.col("first").alias("begin"), middle.alias("end"))
    late = F.struct((middle + 1).alias("begin"), F.col("last").alias("end"))
    done = F.when(F.col("file") % 3 == 0, F.array(early, late)).when(F.col("file") % 3 == 1, F.array(early))
    merged = ranges.merge_ranges(manifest.select("file", F.inline(done)), "file", "begin", "end")
    records = spark.read.schema("record bigint, l_partkey bigint, file bigint").parquet(path)
    return lookups.skip_finished_files(records, manifest, merged, "file", "record").select("file", "record", "l_partkey")


@query("""WITH c AS (SELECT s_suppkey AS l_suppkey, (s_suppkey * 37) % 9000 AS b, (s_suppkey * 37) % 9000 + 400 AS e, 0 AS chunk FROM supplier
  UNION ALL SELECT s_suppkey, (s_suppkey * 37) % 9000 + 300, (s_suppkey * 37) % 9000 + 2500, 1 FROM supplier)
SELECT l.l_suppkey, chunk, l_orderkey, l_linenumber, l_partkey FROM lineitem l JOIN c ON l.l_suppkey = c.l_suppkey AND l_orderkey BETWEEN b AND e""")
def record_range_lookup(spark, sf):
    begin = F.col("s_suppkey") * 37 % 9000
    wanted = F.array(
        F.struct(begin.alias("begin"), (begin + 400).alias("end"), F.lit(0).alias("chunk")),
        F.struct((begin + 300).alias("begin"), (begin + 2500).alias("end"), F.lit(1).alias("chunk")),
    )
    chunks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.inline(wanted))
    records = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    found = lookups.record_range_lookup(records, chunks, "l_suppkey", "l_orderkey")
    return found.select("l_suppkey", "chunk", "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Terminating'
    WHEN o_orderstatus = 'O' THEN 'Running' WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Succeeded' END AS phase FROM orders)
SELECT * FROM o WHERE phase = 'Running'""")
def filter_by_status(spark, sf):
    phase = F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "P", "Pending").otherwise("Succeeded")
    deleted = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))
    return filters.filter_by_status(table(spark, sf, "orders"), phase, deleted, "Running").select("o_orderkey", "o_custkey", "phase")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS label FROM events WHERE json_extract_string(props, '$.k') IN ('9', '99')""")
def filter_by_label(spark, sf):
    labels = F.from_json("props", "map<string,string>")
    events = table(spark, sf, "events").select("event_id", labels.alias("labels"))
    either = (filters.matches_labels(F.col("labels"), {"k": "9"}) + filters.matches_labels(F.col("labels"), {"k": "99"})) > 0
    return events.where(filters.has_label_prefix(F.col("labels"), "k") & either).select(
        "event_id", F.col("labels")["k"].alias("label")
    )


@query(f"""WITH t AS (SELECT d.doc_id, list_transform({WORDS}, lambda w: CASE WHEN length(w) > 3 THEN length(w) ELSE 0 END) AS ids FROM documents d)
SELECT doc_id, len(ids) AS n_ids, coalesce(list_sum(ids), 0)::BIGINT AS first_dim, coalesce(list_sum(ids), 0)::BIGINT + len(list_filter(ids, lambda i: i <> 0)) AS second_dim FROM t""")
def mask_padding(spark, sf):
    """Ids of short words are padding; the vector of id i is [i, i + 1], so padding would count in the second place."""
    ids = F.transform(words(F.col("text")), lambda w: F.when(F.length(w) > 3, F.length(w)).otherwise(0).cast("bigint"))
    docs = table(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    vectors = F.transform("ids", lambda i: F.array(i, i + 1))
    masked = docs.withColumn("v", filters.mask_padding(F.col("ids"), vectors))
    return masked.select(
        "doc_id",
        F.size("v").cast("bigint").alias("n_ids"),
        array_sum(F.transform("v", lambda x: x[0])).alias("first_dim"),
        array_sum(F.transform("v", lambda x: x[1])).alias("second_dim"),
    )


VOCABULARY = f"""
  tokens AS (SELECT d.doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM documents d),
  counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
  vocabulary AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM counts WHERE n >= 3)
"""


def document_vocabulary(spark, sf):
    return metrics.build_vocabulary(spread(table(spark, sf, "documents").select("text")), words(F.col("text")), 3)


@query(f"WITH {VOCABULARY} SELECT word, n, id FROM vocabulary")
def build_vocabulary(spark, sf):
    return document_vocabulary(spark, sf)


@query(f"""WITH {VOCABULARY}, unk AS (SELECT max(id) + 1 AS u FROM vocabulary),
  ids AS (SELECT doc_id, pos, coalesce(id, (SELECT u FROM unk)) AS id FROM tokens LEFT JOIN vocabulary ON tokens.word = vocabulary.word)
SELECT d.doc_id, count(id) AS n_ids, coalesce(sum(id * (pos % 7)), 0)::BIGINT AS place_sum FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id GROUP BY d.doc_id""")
def vocab_lookup(spark, sf):
    known = document_vocabulary(spark, sf).select("word", "id")
    unknown = known.agg(F.lit("[UNK]").alias("word"), (F.max("id") + 1).alias("id"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = lookups.vocab_lookup(docs, "doc_id", words(F.col("text")), known.unionByName(unknown))
    weighted = F.transform("ids", lambda x, i: x * ((i + 1) % 7))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), array_sum(weighted).alias("place_sum"))


@query("""WITH p AS (SELECT c_custkey, s, unnest([(c_custkey * (s + 1)) % 601, (c_custkey + s * 7) % 601]) AS id FROM customer, range(26) t(s)),
  j AS (SELECT c_custkey, s, embedding FROM p LEFT JOIN embeddings ON p.id = vec_id),
  g AS (SELECT c_custkey, s, greatest(count(embedding), 1) AS n, sum(coalesce(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 0)) AS w, sum(coalesce(embedding[1], 0)::DOUBLE) AS a, sum(coalesce(embedding[64], 0)::DOUBLE) AS z FROM j GROUP BY ALL)
SELECT c_custkey, 26 * 64 + 2 AS n_features, round(sum(w / n), 6) + 0.0 AS place_sum, round(sum(a / n), 6) + 0.0 AS first_sum, round(sum(z / n), 6) + 0.0 AS last_sum, c_custkey * 2.0 AS last_dense
FROM g GROUP BY c_custkey""")
def embedding_lookup_pool(spark, sf):
    key = F.col("c_custkey")
    slots = {f"C{s + 1}": F.array(key * (s + 1) % 601, (key + s * 7) % 601) for s in range(26)}
    dense = F.array(key * 1.0, key * 2.0)
    rows = table(spark, sf, "customer").select("c_custkey", *[c.alias(n) for n, c in slots.items()], dense.alias("dense"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    pooled = lookups.embedding_lookup_pool(rows, "c_custkey", list(slots), "dense", vectors, 64)

    def slot_sum(place):
        places = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda s: F.get("features", s * 64 + place))
        return F.round(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 6) + 0.0

    placed = F.transform(F.slice("features", 1, 26 * 64), lambda x, i: x * (i % 64 + 1))
    return pooled.select(
        "c_custkey",
        F.size("features").alias("n_features"),
        (F.round(F.aggregate(placed, F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("place_sum"),
        slot_sum(0).alias("first_sum"),
        slot_sum(63).alias("last_sum"),
        F.element_at("features", -1).alias("last_dense"),
    )


BALANCED_32 = f"""{QUEUED},
  z AS (SELECT s_suppkey AS m, count(batch_no) AS size FROM supplier LEFT JOIN batch ON s_suppkey = l_suppkey GROUP BY s_suppkey),
  lv AS (SELECT m, size, share, greatest(size - share, 0) AS over_n, greatest(share - size, 0) AS short_n
         FROM z, (SELECT sum(size)::BIGINT // count(*) AS share FROM z)),
  l2 AS (SELECT *, sum(over_n) OVER (ORDER BY m) - over_n AS over_from, sum(short_n) OVER (ORDER BY m) - short_n AS short_from FROM lv),
  s AS (SELECT batch.*, batch_no - share + over_from AS spot FROM batch JOIN l2 ON l_suppkey = m WHERE batch_no >= share),
  taken AS (SELECT batch.*, l_suppkey AS consumer FROM batch JOIN l2 ON l_suppkey = m WHERE batch_no < share
    UNION ALL SELECT s.* EXCLUDE (spot), g.m FROM s JOIN (SELECT * FROM l2 WHERE short_n > 0) g ON s.spot >= g.short_from AND s.spot < g.short_from + g.short_n)
"""


@query(f"WITH {BALANCED_32} SELECT consumer, l_suppkey || '_' || batch_no AS batch_data_id, n_records, md5(fields) AS digest FROM taken")
def fetch_batches(spark, sf):
    data = supplier_batch_data(spark, sf)
    members = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    queued = supplier_batches(spark, sf, 32).select("l_suppkey", "batch_no")
    metas = sharding.balance_batches(queued, "l_suppkey", "batch_no", members)
    fetched = lookups.fetch_batches(metas.where(F.col("consumer").isNotNull()), data, ["l_suppkey", "batch_no"])
    text = F.transform("records", lambda r: F.array_join(r.field_data.cast("array<string>"), ":"))
    return fetched.select(
        "consumer",
        "batch_data_id",
        F.size("records").cast("bigint").alias("n_records"),
        F.md5(F.array_join(text, ",")).alias("digest"),
    )


@query("""WITH e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS prediction FROM embeddings)
SELECT pos // 16 AS task_id, pos % 16 AS place, vec_id, label, prediction FROM e""")
def attach_predictions(spark, sf):
    placed = batching.number_tasks(id_positions(table(spark, sf, "embeddings"), "vec_id"), "pos", 16)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    answers = placed.select("task_id", "place", (F.round(total, 6) + 0.0).alias("prediction"))
    joined = lookups.attach_predictions(placed.select("task_id", "place", "vec_id", "label"), answers)
    return joined.select("task_id", "place", "vec_id", "label", "prediction")


@query("""WITH k AS (SELECT o_orderkey, (o_custkey * 7) % 701 AS key FROM orders)
SELECT o_orderkey, key, label, embedding[1]::DOUBLE AS first_value FROM k LEFT JOIN embeddings ON key = vec_id""")
def kv_multi_get(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 7 % 701).alias("key"))
    values = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), "label", F.col("embedding")[0].cast("double").alias("first_value")
    )
    return lookups.kv_multi_get(keys, values, "key").select("o_orderkey", "key", "label", "first_value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey AS key, p_brand, p_retailprice FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def bucketed_multi_get(spark, sf):
    """The part of each line item, from a table of parts in 16 buckets."""
    name = f"parts_{uuid.uuid4().hex}"
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_brand", "p_retailprice")
    colocated.save_bucketed(parts, "key", 16, name, scratch(spark, "buckets"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"))
    return colocated.bucketed_multi_get(items, name, "key")


@query("""WITH j AS (SELECT c_custkey AS job, (c_custkey * 13) % 20011 AS leader FROM customer)
SELECT job, leader, o_orderstatus AS status, o_orderkey IS NOT NULL AS found FROM j LEFT JOIN orders ON leader = o_orderkey""")
def leader_lookup(spark, sf):
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") * 13 % 20011).alias("leader"))
    pods = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pod"), F.col("o_orderstatus").alias("status"))
    return lookups.leader_lookup(jobs, "leader", pods, "pod").select("job", "leader", "status", "found")


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS member FROM lineitem WHERE l_suppkey % 9 <> 4), p AS (SELECT s_suppkey AS member FROM supplier WHERE s_suppkey % 10 <> 0)
SELECT coalesce(r.member, p.member) AS member, CASE WHEN p.member IS NULL THEN 'reader' WHEN r.member IS NULL THEN 'pod' ELSE 'both' END AS side
FROM r FULL JOIN p ON r.member = p.member""")
def known_members_only(spark, sf):
    readers = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member")).where("member % 9 <> 4")
    pods = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("member")).where("member % 10 <> 0")
    return lookups.known_members_only(readers, pods, "member")


def month_customers(spark, sf, first, after):
    day = F.col("o_orderdate")  # compared as it is, so the filter reaches the scan
    return table(spark, sf, "orders").where((day >= F.lit(first).cast("date")) & (day < F.lit(after).cast("date"))).select(F.col("o_custkey").alias("member"))


@query("""WITH m AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month, o_custkey AS member FROM orders),
  e AS (SELECT min(month) AS lo, max(month) AS hi FROM m),
  a AS (SELECT month + 1 AS month, member FROM m, e WHERE month < hi), b AS (SELECT month, member FROM m, e WHERE month > lo)
SELECT coalesce(a.month, b.month)::INT AS month, coalesce(a.member, b.member) AS member,
  CASE WHEN a.member IS NULL THEN 'added' WHEN b.member IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM a FULL JOIN b ON a.month = b.month AND a.member = b.member""")
def membership_diff(spark, sf):
    """The customers of every month against those of the month before."""
    day = F.col("o_orderdate")
    months = table(spark, sf, "orders").select((F.year(day) * 12 + F.month(day) - 1).alias("month"), F.col("o_custkey").alias("member"))
    ends = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    before = months.where(F.col("month") < ends.select("hi").scalar()).withColumn("month", F.col("month") + 1)
    return sets.membership_diff(before, months.where(F.col("month") > ends.select("lo").scalar()), ["month", "member"])


@query("""SELECT DISTINCT user_id AS server FROM events WHERE ts < '2024-01-02' OR event_type = 'signup'
EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND ts < '2024-01-03'""")
def apply_membership_delta(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("server"), "event_type", "ts")
    servers = events.where(F.col("ts") < "2024-01-02")
    added = events.where(F.col("event_type") == "signup")
    removed = events.where((F.col("event_type") == "error") & (F.col("ts") < "2024-01-03"))
    return sets.apply_membership_delta(servers, added, removed, ["server"])


@query("""WITH s AS (SELECT o_custkey AS m, arg_max(CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'inited' END, o_orderkey) AS st
    FROM orders WHERE o_orderdate < '1995-06-01' GROUP BY o_custkey),
  r AS (SELECT DISTINCT o_custkey AS m FROM orders WHERE o_orderdate >= '2001-01-01')
SELECT c_custkey AS member, coalesce(st, CASE WHEN r.m IS NOT NULL THEN 'alive' ELSE 'disappeared' END) AS class
FROM customer LEFT JOIN s ON c_custkey = s.m LEFT JOIN r ON c_custkey = r.m""")
def member_classes(spark, sf):
    orders = table(spark, sf, "orders").withColumn("member", F.col("o_custkey"))
    name = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("inited")
    statuses = orders.where(F.col("o_orderdate") < "1995-06-01").groupBy("member").agg(F.max_by(name, "o_orderkey").alias("status"))
    resource = orders.where(F.col("o_orderdate") >= "2001-01-01")
    current = table(spark, sf, "customer").select(F.col("c_custkey").alias("member"))
    return sets.member_classes(current, resource, statuses, "member", "status")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS m FROM lineitem), b AS (SELECT s_suppkey AS m FROM supplier WHERE s_acctbal > 0),
  f AS (SELECT a.m AS am, b.m AS bm FROM a FULL JOIN b ON a.m = b.m)
SELECT count(*) FILTER (am IS NULL OR bm IS NULL) = 0 AS equal, count(*) FILTER (bm IS NULL) AS only_left, count(*) FILTER (am IS NULL) AS only_right FROM f""")
def sets_equal(spark, sf):
    readers = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member"))
    pods = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("member"))
    return sets.sets_equal(readers, pods, ["member"])


@query("""SELECT user_id, event_type, strftime(ts, '%Y%m%d') AS day, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL""")
def dedup_batches(spark, sf):
    reports = table(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day"), "event_id", "value")
    return sets.dedup_batches(reports, ["user_id", "event_type", "day"], "event_id")


FOLDED = """SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'remove' ELSE 'add' END AS op,
  CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(value, event_id) END AS value, max(event_id) AS revision FROM events GROUP BY user_id"""


@query(FOLDED)
def fold_changes(spark, sf):
    op = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    return sets.fold_changes(table(spark, sf, "events"), ["user_id"], op, "value", "event_id")

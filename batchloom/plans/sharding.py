"""Queries: shards, ring assignment, balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.operators import sharding
from batchloom.operators.positions import id_positions, range_positions
from batchloom.plans.registry import query
from batchloom.session import scratch, table, table_with_ref

RECORD_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
SQL_ORDER = ", ".join(RECORD_ORDER)


def supplier_records(spark, sf, columns=()):
    """Line items in reading order per supplier; equal rows are told apart by their place in the file."""
    wanted = ["l_suppkey", *RECORD_ORDER, *[c for c in columns if c not in RECORD_ORDER], "_file", "_row"]
    return table_with_ref(spark, sf, "lineitem").select(*wanted)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       row_number() OVER (ORDER BY {SQL_ORDER}) - 1 AS pos FROM lineitem""")
def global_positions(spark, sf):
    placed = range_positions(supplier_records(spark, sf), [*RECORD_ORDER, "_file", "_row"])
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "pos")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT) - 1 AS pos
FROM orders""")
def sparse_positions(spark, sf):
    """Positions by ids that lie far apart, so that nearly every row has a block of its own."""
    far = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 15), 16, 10).cast("bigint")
    orders = table(spark, sf, "orders").select("o_orderkey", far.alias("far"))
    return id_positions(orders, "far").select("o_orderkey", "pos")


@query("""WITH m AS (SELECT n_name AS member, row_number() OVER (ORDER BY n_name) - 1 AS r FROM nation),
  f AS (SELECT url AS path, row_number() OVER (ORDER BY page_id) - 1 AS idx FROM pages)
SELECT idx, path, member FROM f JOIN m ON f.idx % (SELECT count(*) FROM nation) = m.r""")
def round_robin_files(spark, sf):
    files = id_positions(table(spark, sf, "pages").select("page_id", F.col("url").alias("path")), "page_id", name="idx")
    members = table(spark, sf, "nation").select(F.col("n_name").alias("member"))
    return sharding.round_robin_files(files, "idx", members, "member").select("idx", "path", "member")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT o_orderkey, pos, o_totalprice FROM o WHERE pos % 8 = 3""")
def modulo_shard(spark, sf):
    return sharding.modulo_shard(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 8, 3)


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
  a AS (SELECT doc_id, pos FROM d UNION ALL SELECT doc_id, pos + n FROM d WHERE pos < ceil(n / 7.0) * 7 - n)
SELECT doc_id, pos % 7 AS shard, pos // 7 AS step FROM a""")
def stride_shard_padded(spark, sf):
    return sharding.stride_shard_padded(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, pos, (pos * 6) // n AS shard FROM d""")
def contiguous_shard(spark, sf):
    return sharding.contiguous_shard(table(spark, sf, "documents").select("doc_id"), "doc_id", 6)


def ring_sql(name, nodes):
    return f"""{name}_v AS (SELECT md5(n_name || '-v' || i) AS slot, min(n_name) AS node
      FROM ({nodes}) x, range(300) t(i) GROUP BY slot),
  {name} AS (SELECT slot, node FROM {name}_v
    UNION ALL SELECT 'g', arg_min(node, slot) FROM {name}_v)"""


ALL_NODES = "SELECT n_name FROM nation"
NEW_NODES = "SELECT n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'NATION_99'"


def customer_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name")


@query(f"""WITH {ring_sql('ring', ALL_NODES)}, k AS (SELECT c_custkey, md5(c_name) AS h FROM customer)
SELECT c_custkey, node FROM k ASOF JOIN ring ON k.h <= ring.slot""")
def consistent_hash_assign(spark, sf):
    nodes = table(spark, sf, "nation").select("n_name")
    assigned = sharding.consistent_hash_assign(customer_keys(spark, sf), F.col("c_name"), nodes, "n_name")
    return assigned.select("c_custkey", "node")


@query(f"""WITH {ring_sql('r1', ALL_NODES)}, {ring_sql('r2', NEW_NODES)},
  k AS (SELECT c_custkey, md5(c_name) AS h FROM customer),
  a AS (SELECT c_custkey, h, node AS old_node FROM k ASOF JOIN r1 ON k.h <= r1.slot),
  b AS (SELECT c_custkey, old_node, node AS new_node FROM a ASOF JOIN r2 ON a.h <= r2.slot)
SELECT c_custkey, old_node, new_node FROM b WHERE old_node <> new_node""")
def ring_membership_change(spark, sf):
    old = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joining = old.where("n_nationkey = 0").select(F.lit("NATION_99").alias("n_name"))
    new = old.where("n_nationkey <> 3").select("n_name").unionByName(joining)
    moved = sharding.ring_membership_change(customer_keys(spark, sf), F.col("c_name"), old, new, "n_name")
    return moved.select("c_custkey", "old_node", "new_node")


@query(f"""WITH {ring_sql('ring', ALL_NODES)}, k AS (SELECT c_custkey, md5(c_name) AS h FROM customer),
  a AS (SELECT node FROM k ASOF JOIN ring ON k.h <= ring.slot)
SELECT node, count(*) AS n_keys FROM a GROUP BY node""")
def key_distribution(spark, sf):
    return consistent_hash_assign(spark, sf).groupBy("node").agg(F.count(F.lit(1)).alias("n_keys"))


def supplier_batches(spark, sf, size=8):
    """Batches of line items queued per supplier; their numbers and sizes follow from the record counts."""
    records = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return sharding.queued_batches(records, "l_suppkey", "n", size)


BALANCED = f"""
  q AS (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_ORDER}) - 1) // 8 AS batch_no FROM lineitem),
  b AS (SELECT l_suppkey, batch_no, count(*) AS n_records FROM q GROUP BY ALL),
  z AS (SELECT s_suppkey AS m, count(b.batch_no) AS size FROM supplier LEFT JOIN b ON s_suppkey = l_suppkey GROUP BY s_suppkey),
  lv AS (SELECT m, size, share, greatest(size - share, 0) AS over_n, greatest(share - size, 0) AS short_n
         FROM z, (SELECT sum(size)::BIGINT // count(*) AS share FROM z)),
  l2 AS (SELECT *, sum(over_n) OVER (ORDER BY m) - over_n AS over_from, sum(short_n) OVER (ORDER BY m) - short_n AS short_from FROM lv),
  s AS (SELECT b.*, batch_no - share + over_from AS at FROM b JOIN l2 ON l_suppkey = m WHERE batch_no >= share),
  balanced AS (
    SELECT l_suppkey, batch_no, n_records, l_suppkey AS consumer FROM b JOIN l2 ON l_suppkey = m WHERE batch_no < share
    UNION ALL
    SELECT s.l_suppkey, s.batch_no, s.n_records, g.m FROM s LEFT JOIN (SELECT * FROM l2 WHERE short_n > 0) g
      ON s.at >= g.short_from AND s.at < g.short_from + g.short_n)
"""


def balanced_batches(spark, sf):
    members = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return sharding.balance_batches(supplier_batches(spark, sf), "l_suppkey", "batch_no", members)


@query(f"WITH {BALANCED} SELECT l_suppkey, batch_no, n_records, consumer FROM balanced")
def balance_batches(spark, sf):
    return balanced_batches(spark, sf)


@query("""WITH c AS (SELECT c_nationkey AS service, c_custkey AS client, 1 + c_custkey % 3 AS need,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS nc FROM customer),
  s AS (SELECT s_nationkey AS service, s_suppkey AS server, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS j,
    count(*) OVER (PARTITION BY s_nationkey) AS ns FROM supplier)
SELECT c.service, client, server FROM c JOIN s ON c.service = s.service
WHERE CASE WHEN ns >= nc THEN j % nc = i AND j // nc < least(greatest(1, ns // nc), need) ELSE i % ns = j END
UNION ALL
SELECT 100 + c.service, client, server FROM (SELECT service, server AS client, j AS i, ns AS nc, 1 + server % 3 AS need FROM s) c
JOIN (SELECT service, client AS server, i AS j, nc AS ns FROM c) s ON c.service = s.service
WHERE CASE WHEN ns >= nc THEN j % nc = i AND j // nc < least(greatest(1, ns // nc), need) ELSE i % ns = j END""")
def balance_clients_servers(spark, sf):
    """Customers as clients of suppliers, and the other way round as services 100 and up."""
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("service"), F.col("c_custkey").alias("id"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("service"), F.col("s_suppkey").alias("id"))

    def link(clients, servers, shift):
        c = clients.select("service", F.col("id").alias("client"), (F.col("id") % 3 + 1).alias("need"))
        s = servers.select("service", F.col("id").alias("server"))
        links = sharding.balance_clients_servers(c, s, "service", "client", "server", "need")
        return links.withColumn("service", F.col("service") + shift)

    return link(customers, suppliers, 0).unionByName(link(suppliers, customers, 100))


@query("""SELECT ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 4 AS shard, count(*) AS n_rows, sum(vec_id)::BIGINT AS id_sum
FROM embeddings GROUP BY ALL""")
def shard_table_by_key(spark, sf):
    path = scratch(spark, "shards")
    sharding.shard_table(table(spark, sf, "embeddings"), "vec_id", 4, path)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("vec_id").alias("id_sum")
    )


@query("""WITH m AS (SELECT DISTINCT event_type AS job, user_id AS member FROM events),
  l AS (SELECT job, CASE WHEN job = 'signup' THEN -1 WHEN job <> 'error' THEN max(member) FILTER (WHERE member % 7 = 0) END AS leader, count(*) >= 3 AS enough FROM m GROUP BY job),
  r AS (SELECT m.job, member, enough, row_number() OVER (PARTITION BY m.job ORDER BY (member <> leader)::INT, member) - 1 AS rank
        FROM m JOIN l ON m.job = l.job)
SELECT job, member, CASE WHEN job NOT IN ('signup', 'error') THEN rank END AS rank, enough, job NOT IN ('signup', 'error') AS leader_found FROM r WHERE rank < 16""")
def rank_members(spark, sf):
    members = table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("user_id").alias("member")).distinct()
    leaders = members.where("job <> 'error'").where(F.col("member") % 7 == 0).groupBy("job").agg(F.max("member").alias("leader"))
    leaders = leaders.withColumn("leader", F.when(F.col("job") == "signup", -1).otherwise(F.col("leader")))  # no member
    return sharding.rank_members(members, "job", "member", leaders, "leader", 3, 16)

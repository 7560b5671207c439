"""Queries: links of clients and servers that are kept while both come and go."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.operators import rebalance, sharding
from batchloom.plans.registry import query
from batchloom.session import table

# customers as clients of suppliers, and the other way round as services 100 and up; who is there before and who after
STICKY = """c AS (SELECT c_nationkey AS service, c_custkey AS client FROM customer UNION ALL SELECT 100 + s_nationkey, s_suppkey FROM supplier),
  s AS (SELECT s_nationkey AS service, s_suppkey AS server FROM supplier UNION ALL SELECT 100 + c_nationkey, c_custkey FROM customer),
  c1 AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY client) - 1 AS i, count(*) OVER (PARTITION BY service) AS nc FROM c WHERE client % 4 <> 0),
  s1 AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY server) - 1 AS j, count(*) OVER (PARTITION BY service) AS ns FROM s WHERE server % 5 <> 1),
  old AS (SELECT c1.service, client, server FROM c1 JOIN s1 ON c1.service = s1.service
    WHERE CASE WHEN ns >= nc THEN j % nc = i AND j // nc < least(greatest(1, ns // nc), 1 + client % 3) ELSE i % ns = j END),
  c2 AS (SELECT *, count(*) OVER (PARTITION BY service) AS nc FROM c WHERE client % 7 <> 0),
  s2 AS (SELECT *, count(*) OVER (PARTITION BY service) AS ns FROM s WHERE server % 3 <> 0),
  n AS (SELECT DISTINCT c2.service, nc, ns FROM c2 JOIN s2 ON c2.service = s2.service),
  cc AS (SELECT c2.service, client, least(greatest(1, ns // n.nc), 1 + client % 3) AS cap FROM c2 JOIN n ON c2.service = n.service),
  sc AS (SELECT s2.service, server, (n.nc + n.ns - 1) // n.ns AS cap FROM s2 JOIN n ON s2.service = n.service),
  r AS (SELECT old.*, cc.cap AS c_cap, sc.cap AS s_cap, row_number() OVER (PARTITION BY old.service, old.server ORDER BY old.client) AS by_server,
      row_number() OVER (PARTITION BY old.service, old.client ORDER BY old.server) AS by_client
    FROM old JOIN cc ON old.service = cc.service AND old.client = cc.client JOIN sc ON old.service = sc.service AND old.server = sc.server),
  k AS (SELECT service, client, server FROM r WHERE by_server <= s_cap AND by_client <= c_cap),
  cp AS (SELECT cc.service, cc.client, unnest(range((SELECT count(*) FROM k WHERE k.service = cc.service AND k.client = cc.client), cap)) AS place FROM cc),
  sp AS (SELECT sc.service, sc.server, unnest(range((SELECT count(*) FROM k WHERE k.service = sc.service AND k.server = sc.server), cap)) AS place FROM sc),
  cf AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY place, client) AS slot FROM cp),
  sf AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY place, server) AS slot FROM sp),
  links AS (SELECT service, client, server, true AS kept FROM k
    UNION ALL SELECT cf.service, client, server, false FROM cf JOIN sf ON cf.service = sf.service AND cf.slot = sf.slot)"""


def before_and_after(spark, sf):
    """Old links, and the links after a quarter or so of the members has changed."""
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("service"), F.col("c_custkey").alias("id"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("service"), F.col("s_suppkey").alias("id"))
    later = F.col("service") + 100
    clients = customers.unionByName(suppliers.withColumn("service", later)).select("service", F.col("id").alias("client"), (F.col("id") % 3 + 1).alias("need"))
    servers = suppliers.unionByName(customers.withColumn("service", later)).select("service", F.col("id").alias("server"))
    old = sharding.balance_clients_servers(clients.where("client % 4 <> 0"), servers.where("server % 5 <> 1"), "service", "client", "server", "need")
    new = rebalance.sticky_rebalance(old, clients.where("client % 7 <> 0"), servers.where("server % 3 <> 0"), "service", "client", "server", "need")
    return old, new


@query(f"WITH {STICKY} SELECT service, client, server, kept FROM links")
def sticky_rebalance(spark, sf):
    return before_and_after(spark, sf)[1]


@query(f"""WITH {STICKY}, v AS (SELECT DISTINCT service, client FROM old),
  m AS (SELECT DISTINCT service, client FROM (SELECT service, client, server, 1 AS side FROM old UNION ALL SELECT service, client, server, 2 FROM links)
    GROUP BY service, client, server HAVING count(*) = 1)
SELECT coalesce(v.service, m.service) AS service, coalesce(v.client, m.client) AS client,
  ((v.client IS NOT NULL)::BIGINT + (m.client IS NOT NULL)::BIGINT)::BIGINT AS version
FROM v FULL JOIN m ON v.service = m.service AND v.client = m.client""")
def link_versions(spark, sf):
    """Clients that were linked have version 1; a change of their servers is one more, new clients start at 1."""
    old, new = before_and_after(spark, sf)
    versions = old.select("service", "client").distinct().withColumn("version", F.lit(1).cast("bigint"))
    return rebalance.link_versions(versions, old, new, "service", "client", "server")

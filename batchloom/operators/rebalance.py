"""Rebalancing of clients and servers that keeps the links it can: only what the caps forbid is broken, only free places are filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.positions import grouped_positions
from batchloom.session import cut

SALTS = 64  # tasks in which the links of one client or server are looked through
STEP = 1 << 16  # places that one row is turned into at a time


def first_of(rows: DataFrame, keys: list[str], order: str, most: str) -> DataFrame:
    """The first rows of each group up to the number in its column ``most``; they are among the first of each salt of the group."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(SALTS)))
    for group in ([*keys, "_salt"], keys):
        ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
        salted = ranked.where(F.col("_n") <= F.col(most)).drop("_n")
    return salted.drop("_salt")


def with_caps(clients: DataFrame, servers: DataFrame, service: str, client: str, server: str, require: str) -> tuple[DataFrame, DataFrame]:
    """Clients and servers of the services that have both, with ``_cap``, the links that one may have.

    A server takes ``ceil(clients / servers)`` links, a client ``min(max(1, servers div clients), require)``; so one of the two takes one at most.
    """
    c = clients.groupBy(service, client).agg(F.max(require).alias("_need"))
    s = servers.select(service, server).distinct()
    counts = c.groupBy(service).agg(F.count(F.lit(1)).alias("_c")).join(s.groupBy(service).agg(F.count(F.lit(1)).alias("_s")), service)
    c_cap = F.least(F.greatest(F.lit(1), F.expr("_s div _c")), F.col("_need")).cast("bigint")
    s_cap = F.ceil(F.col("_c") / F.col("_s")).cast("bigint")
    return (
        c.join(counts, service).select(service, client, c_cap.alias("_cap")),
        s.join(counts, service).select(service, server, s_cap.alias("_cap")),
    )


def kept_links(links: DataFrame, clients: DataFrame, servers: DataFrame, service: str, client: str, server: str) -> DataFrame:
    """Old links that stay: each goes only if its client or its server is gone, or has reached its cap with others that stay.

    In each round the servers offer their first links and the clients take the first of these, up to their free places. The ends that are full
    drop out, so every round settles at least the links of one offer of each server.
    """
    c_free = clients.select(service, client, F.col("_cap").alias("_c_free"))
    s_free = servers.select(service, server, F.col("_cap").alias("_s_free"))
    open_links = links.select(service, client, server).distinct().join(c_free, [service, client]).join(s_free, [service, server])
    open_links = cut(open_links.where("_c_free > 0 and _s_free > 0"))
    kept = open_links.select(service, client, server).limit(0)
    while not open_links.isEmpty():
        offered = first_of(open_links, [service, server], client, "_s_free")
        taken = cut(first_of(offered, [service, client], server, "_c_free").select(service, client, server))
        kept = kept.unionByName(taken)
        left = open_links.join(taken, [service, client, server], "left_anti")
        for end, free in ((client, "_c_free"), (server, "_s_free")):
            used = taken.groupBy(service, end).agg(F.count(F.lit(1)).alias("_used"))
            left = left.join(used, [service, end], "left").withColumn(free, F.col(free) - F.coalesce("_used", F.lit(0))).drop("_used")
        open_links = cut(left.where("_c_free > 0 and _s_free > 0"))
    return kept


def free_places(members: DataFrame, kept: DataFrame, service: str, member: str) -> DataFrame:
    """``(service, member, _slot)``: the free places of all members, numbered per service; all first places come before all second ones."""
    used = kept.groupBy(service, member).agg(F.count(F.lit(1)).alias("_used"))
    runs = members.join(used, [service, member], "left").withColumn("_used", F.coalesce("_used", F.lit(0))).where("_used < _cap")
    runs = runs.withColumn("_from", F.explode(F.sequence("_used", F.col("_cap") - 1, F.lit(STEP).cast("bigint"))))
    last: Column = F.least(F.col("_from") + (STEP - 1), F.col("_cap") - 1)
    places = runs.select(service, member, F.explode(F.sequence("_from", last)).alias("_place"))
    return grouped_positions(places, [service], ["_place", member], "_slot").drop("_place")


def sticky_rebalance(
    links: DataFrame, clients: DataFrame, servers: DataFrame, service: str, client: str, server: str, require: str
) -> DataFrame:
    """``(service, client, server, kept)``: links after clients and servers have come and gone.

    ``links`` are the old ones. Those stay that the caps allow, first by client name and then by server name; the free places of clients and servers
    are then linked in the order of their numbers, those with the fewest links first. As one side has one place at most, no pair is linked
    twice. Names are of any type that can be sorted. A service without clients or without servers has no links.
    """
    c, s = (cut(x) for x in with_caps(clients, servers, service, client, server, require))
    kept = kept_links(links, c, s, service, client, server)
    filled = free_places(c, kept, service, client).join(free_places(s, kept, service, server), [service, "_slot"])
    new = filled.select(service, client, server, F.lit(False).alias("kept"))
    return kept.withColumn("kept", F.lit(True)).unionByName(new)


def link_versions(versions: DataFrame, before: DataFrame, after: DataFrame, service: str, client: str, server: str) -> DataFrame:
    """``(service, client, version)``: one more than before for the clients whose servers change; new clients start at 1.

    Clients without links before and after keep their version.
    """
    old = before.select(service, client, server, F.lit(-1).alias("_sign"))
    both = old.unionByName(after.select(service, client, server, F.lit(1).alias("_sign")))
    moved = both.groupBy(service, client, server).agg(F.sum("_sign").alias("_net")).where("_net <> 0")
    changed = moved.select(service, client).distinct().withColumn("_changed", F.lit(1))
    joined = versions.join(changed, [service, client], "full")
    return joined.select(service, client, (F.coalesce("version", F.lit(0)) + F.coalesce("_changed", F.lit(0))).cast("bigint").alias("version"))

"""Sharding of files and records, consistent hashing, balancing of batches and of servers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.carry import id_block, with_latest, with_previous, with_running
from batchloom.operators.positions import grouped_positions, id_positions, range_positions
from batchloom.session import cut

SALTS = 64  # parts of a job that are looked through for its first members


def total(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def round_robin_files(files: DataFrame, idx: str, members: DataFrame, member: str) -> DataFrame:
    """File number i goes to member ``i mod n`` of the sorted members."""
    ranked = range_positions(members.select(member).distinct(), [member], "_rank")
    return files.withColumn("_rank", F.pmod(F.col(idx), total(ranked))).join(ranked, "_rank").drop("_rank")


def modulo_shard(df: DataFrame, id_col: str, shards: int, shard: int) -> DataFrame:
    """The rows at positions ``shard, shard + shards, ...`` of the sorted rows."""
    return id_positions(df, id_col).where(F.pmod("pos", F.lit(shards)) == shard)


def stride_shard_padded(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    """Deal rows to shards in turn; all are dealt again, from the head on, until all shards have the same length."""
    n = total(df)
    missing = F.pmod(-n, F.lit(shards))
    placed = id_positions(df, id_col, name="_pos")
    copies = F.sequence(F.col("_pos"), n + missing - 1, n)
    return (
        placed.withColumn("_at", F.explode(copies))
        .withColumn("shard", F.pmod("_at", F.lit(shards)))
        .withColumn("step", F.expr(f"_at div {shards}"))
        .drop("_pos", "_at")
    )


def contiguous_shard(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    """Equal runs of consecutive rows per shard."""
    placed = id_positions(df, id_col, name="pos").withColumn("_n", total(df))
    return placed.withColumn("shard", F.expr(f"(pos * {shards}) div _n")).drop("_n")


def hash_ring(nodes: DataFrame, node: str, virtual: int = 300, digits: int = 3) -> DataFrame:
    """Arcs ``(lo, hi]`` of the md5 ring with their node, one row per hash prefix they touch."""
    vnodes = nodes.select(F.col(node).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
    # equal slots go to the smaller node
    slots = vnodes.groupBy(F.md5(F.concat_ws("-v", "node", F.col("v").cast("string"))).alias("hi")).agg(F.min("node").alias("node"))
    arcs = with_previous(slots, {"hi": "lo"}, [], ["hi"], F.substring("hi", 1, digits))
    # keys above the largest slot belong to the smallest one; 'g' sorts after every hex digit
    ends = slots.agg(F.max("hi").alias("lo"), F.min_by("node", "hi").alias("node")).withColumn("hi", F.lit("g"))
    arcs = arcs.withColumn("lo", F.coalesce("lo", F.lit(""))).unionByName(ends)
    last = 16**digits - 1

    def prefix(column: str) -> Column:
        return F.conv(F.substring(column, 1, digits), 16, 10).cast("int")

    first = F.when(F.col("lo") == "", 0).otherwise(prefix("lo"))
    final = F.when(F.col("hi") == "g", last).otherwise(prefix("hi"))
    return arcs.withColumn("prefix", F.explode(F.sequence(first, final)))


def consistent_hash_assign(
    keys: DataFrame, key: Column, nodes: DataFrame, node: str, name: str = "node", virtual: int = 300, digits: int = 3
) -> DataFrame:
    """The node of the first virtual node at or after the key's md5, around the ring.

    Keys and arcs meet by hash prefix; Spark broadcasts the ring where its bytes allow it.
    """
    ring = hash_ring(nodes, node, virtual, digits).select(
        F.col("prefix").alias("_prefix"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("node").alias(name)
    )
    hashed = keys.withColumn("_slot", F.md5(key)).withColumn("_p", F.conv(F.substring("_slot", 1, digits), 16, 10).cast("int"))
    inside = (F.col("_p") == F.col("_prefix")) & (F.col("_slot") > F.col("_lo")) & (F.col("_slot") <= F.col("_hi"))
    return hashed.join(ring, inside).drop("_slot", "_p", "_prefix", "_lo", "_hi")


def ring_membership_change(keys: DataFrame, key: Column, old: DataFrame, new: DataFrame, node: str, virtual: int = 300) -> DataFrame:
    """The keys whose node changes between two member lists."""
    both = consistent_hash_assign(keys, key, old, node, "old_node", virtual)
    both = consistent_hash_assign(both, key, new, node, "new_node", virtual)
    return both.where(F.col("old_node") != F.col("new_node"))


def balance_batches(batches: DataFrame, producer: str, pos: str, members: DataFrame) -> DataFrame:
    """Give every member ``floor(total / members)`` batches.

    ``batches`` has the position of each batch in its producer's queue. A member keeps its own first
    ones; the surplus, in order, fills the members that are short; what is left has no consumer, and
    neither have the batches of producers that are no members.
    """
    sizes = cut(
        members.select(F.col(producer).alias("_m"))
        .distinct()
        .join(batches.groupBy(F.col(producer).alias("_p")).agg(F.count(F.lit(1)).alias("_size")), F.col("_m") == F.col("_p"), "left")
        .select("_m", F.coalesce("_size", F.lit(0)).alias("_size"))
    )
    share = sizes.agg(F.floor(F.sum("_size") / F.count(F.lit(1)))).scalar()
    levels = range_positions(
        sizes.withColumn("_share", share)
        .withColumn("_over", F.greatest(F.col("_size") - F.col("_share"), F.lit(0)))
        .withColumn("_short", F.greatest(F.col("_share") - F.col("_size"), F.lit(0))),
        ["_m"],
        "_rank",
    )
    for amount in ("_over", "_short"):
        levels = with_running(levels, F.col(amount), f"{amount}_from", [], ["_rank"], id_block("_rank"), include_current=False, dense=True)
    levels = cut(levels)  # one row per member, read three times below
    shares = levels.select("_m", "_share", "_over_from")
    queued = batches.join(shares, F.col(producer) == F.col("_m"))
    strangers = batches.join(shares, F.col(producer) == F.col("_m"), "left_anti").withColumn("consumer", F.lit(None).cast(batches.schema[producer].dataType))
    own = queued.where(F.col(pos) < F.col("_share")).withColumn("consumer", F.col(producer))
    surplus = queued.where(F.col(pos) >= F.col("_share")).withColumn(
        "_at", F.col("_over_from") + F.col(pos) - F.col("_share")
    )
    gap = F.struct(F.col("_short_from").alias("start"), (F.col("_short_from") + F.col("_short")).alias("end"), F.col("_m").alias("who"))
    gaps = levels.where(F.col("_short") > 0).select(F.col("_short_from").alias("_at"), gap.alias("_open"))
    filled = with_latest(surplus, gaps, [], "_at", "_open", dense=True)  # the surplus is numbered without gaps
    taken = filled.withColumn("consumer", F.when(F.col("_at") < F.col("_open.end"), F.col("_open.who")))
    columns = [*batches.columns, "consumer"]
    return own.select(columns).unionByName(taken.select(columns)).unionByName(strangers.select(columns))


def balance_clients_servers(
    clients: DataFrame, servers: DataFrame, service: str, client: str, server: str, require: str
) -> DataFrame:
    """Links between the clients and servers of each service.

    With at least as many servers as clients, servers are dealt to clients up to each client's cap
    ``min(max(1, servers // clients), require)``; otherwise clients are dealt to servers.
    """
    c = id_positions(clients, client, [service], "_i")
    s = id_positions(servers, server, [service], "_j")
    counts = clients.groupBy(service).agg(F.count(F.lit(1)).alias("_c")).join(
        servers.groupBy(service).agg(F.count(F.lit(1)).alias("_s")), service
    )
    c, s = c.join(counts, service), s.join(counts.select(service, "_c", "_s"), service)
    slots = F.least("_c", "_s")
    c = c.withColumn("_k", F.pmod("_i", slots)).select(service, client, require, "_k", "_c", "_s")
    s = s.withColumn("_k", F.pmod("_j", F.least("_c", "_s"))).select(service, server, "_j", "_k")
    cap = F.least(F.greatest(F.lit(1), F.expr("_s div _c")), F.col(require))
    links = c.join(s, [service, "_k"]).where(F.expr("_c > _s") | (F.expr("_j div _c") < cap))
    return links.select(service, client, server)


def shard_table(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write a table split by key hash, one folder per shard."""
    hashed = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    spread = df.withColumn("shard", F.pmod(hashed, F.lit(shards)))
    # AQE splits the partitions of large shards after this hint
    spread.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def rank_members(members: DataFrame, job: str, member: str, leaders: DataFrame, leader: str, min_nodes: int, max_nodes: int) -> DataFrame:
    """The leader gets rank 0, the others the next ranks by id, up to ``max_nodes``; too few members are marked.

    Where a job has no leader, or one that is no member, ``leader_found`` is false and ranks are null.
    """
    known = leaders.select(F.col(job).alias("_job"), leader)
    marked = members.join(known, F.col(job) == F.col("_job"), "left")
    counts = marked.groupBy(F.col(job).alias("_job")).agg(
        (F.count(F.lit(1)) >= min_nodes).alias("enough"),
        F.coalesce(F.max(F.col(member) == F.col(leader)), F.lit(False)).alias("leader_found"),
    )
    heads = counts.join(known, "_job", "left").withColumnRenamed("_job", job)
    ranked = members.join(heads, job).withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(SALTS)))
    # the first members of a job are among the first of each of its salts, so a hot job is sorted in many tasks
    for group in ([job, "_salt"], [job]):
        order = Window.partitionBy(*group).orderBy(F.col(member) != F.col(leader), member)
        ranked = ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_nodes)
    rank = F.when(F.col("leader_found"), F.col("_n") - 1).cast("bigint")
    return ranked.select(job, member, rank.alias("rank"), "enough", "leader_found")


def queue_positions(records: DataFrame, producer: str, order: Sequence, size: int) -> DataFrame:
    """Number records per producer and name the batch of ``size`` records each one falls into."""
    placed = grouped_positions(records, [producer], order, "record_no")
    return placed.withColumn("batch_no", F.expr(f"record_no div {size}"))


def queued_batches(counts: DataFrame, producer: str, records: str, size: int, step: int = 1 << 16) -> DataFrame:
    """Batch numbers and sizes of each producer from its record count.

    Numbers are made in two steps of at most ``step``, as one producer may have very many batches.
    """
    runs = counts.withColumn("_n", F.ceil(F.col(records) / size)).where(F.col("_n") > 0)
    runs = runs.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(step).cast("bigint"))))
    last = F.least(F.col("_from") + (step - 1), F.col("_n") - 1)
    numbered = runs.select(producer, records, F.explode(F.sequence("_from", last)).alias("batch_no"))
    return numbered.select(producer, "batch_no", F.least(F.lit(size), F.col(records) - F.col("batch_no") * size).alias("n_records"))

"""Links that stay while clients and servers come and go."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from batchloom.operators import rebalance


def caps(clients, servers):
    nc, ns = Counter(s for s, _, _ in clients), Counter(s for s, _ in servers)
    c = {(s, c): min(max(1, ns[s] // nc[s]), need) for s, c, need in clients if ns[s]}
    return c, {(s, x): -(-nc[s] // ns[s]) for s, x in servers if nc[s]}


def check(spark, old, clients, servers):
    df = rebalance.sticky_rebalance(
        spark.createDataFrame(old, "service string, client string, server string"),
        spark.createDataFrame(clients, "service string, client string, need int"),
        spark.createDataFrame(servers, "service string, server string"),
        "service", "client", "server", "need",
    )
    links = [tuple(r) for r in df.select("service", "client", "server", "kept").collect()]
    pairs = {x[:3] for x in links}
    kept = {x[:3] for x in links if x[3]}
    assert len(pairs) == len(links) and kept <= set(old) and not (pairs - kept) & kept
    c_cap, s_cap = caps(clients, servers)
    by_client, by_server = Counter(x[:2] for x in pairs), Counter((x[0], x[2]) for x in pairs)
    assert all(n <= c_cap[k] for k, n in by_client.items()) and all(n <= s_cap[k] for k, n in by_server.items())
    of_client, of_server = Counter(x[:2] for x in kept), Counter((x[0], x[2]) for x in kept)
    for s, c, x in set(old) - kept:  # what was broken had to go
        assert (s, c) not in c_cap or (s, x) not in s_cap or of_client[s, c] == c_cap[s, c] or of_server[s, x] == s_cap[s, x]
    for service in {s for s, _ in c_cap}:  # and no two free places are left
        free = [sum(cap[k] - n[k] for k in cap if k[0] == service) for cap, n in ((c_cap, by_client), (s_cap, by_server))]
        assert min(free) == 0
    return pairs, kept


def test_random_links_are_kept_up_to_the_caps(spark):
    rng = random.Random(3)
    clients, servers, old = [], [], []
    for n in range(12):
        service = f"s{n}"
        cs, ss = ([f"{k}{i}" for i in range(rng.choice((0, 1, 3, 20)))] for k in "cx")
        clients += [(service, c, rng.randint(1, 4)) for c in cs]
        servers += [(service, x) for x in ss]
        ends = [*cs, "gone"], [*ss, "gone"]
        old += {(service, rng.choice(ends[0]), rng.choice(ends[1])) for _ in range(rng.choice((0, 5, 60)))}  # also more links than any cap
    check(spark, old, clients, servers)


@pytest.mark.parametrize("n_clients, n_servers", [(5, 40), (40, 5), (8, 8)])
def test_nothing_moves_without_need(spark, n_clients, n_servers):
    clients = [("s", f"c{i:03}", 100) for i in range(n_clients)]
    servers = [("s", f"x{i:03}") for i in range(n_servers)]
    first, _ = check(spark, [], clients, servers)
    again, kept = check(spark, sorted(first), clients, servers)
    assert again == kept == first
    less, kept = check(spark, sorted(first), clients, servers[1:])  # one server leaves: only its links go
    assert all(x in kept for x in first if x[2] != "x000") or n_clients != n_servers
    more, kept = check(spark, sorted(first), clients, [*servers, ("s", "y")])
    assert len(first - kept) <= max(1, n_clients // len(servers))


def test_one_client_and_very_many_places(spark):
    old = rebalance.STEP
    rebalance.STEP = 3
    try:
        check(spark, [], [("s", f"c{i}", 9) for i in range(50)], [("s", "x")])
        check(spark, [("s", "c", "x1")], [("s", "c", 40)], [("s", f"x{i}") for i in range(50)])
    finally:
        rebalance.STEP = old


def test_versions_of_changed_clients(spark):
    links = lambda rows: spark.createDataFrame(rows, "service string, client string, server string")
    versions = spark.createDataFrame([("s", "a", 4), ("s", "b", 2), ("s", "idle", 7)], "service string, client string, version bigint")
    found = rebalance.link_versions(versions, links([("s", "a", "x"), ("s", "b", "y")]), links([("s", "a", "x"), ("s", "b", "z"), ("s", "n", "y")]), "service", "client", "server")
    assert {r["client"]: r["version"] for r in found.collect()} == {"a": 4, "b": 3, "idle": 7, "n": 1}


def test_a_hot_end_is_cut_in_many_tasks(spark):
    links = spark.range(5000).select(F.lit("s").alias("k"), F.col("id").alias("v"), F.lit(10).alias("most"))
    assert sorted(r["v"] for r in rebalance.first_of(links, ["k"], "v", "most").collect()) == list(range(10))

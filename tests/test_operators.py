"""Fixtures and properties of the operators, against brute force in plain Python."""

import bisect
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchloom.operators import batching, lookups, metrics, positions, ranges, scoring, sets, sharding, windows
from batchloom.operators.carry import id_block, with_latest, with_previous, with_running
from batchloom.session import scratch
from batchloom.sources import files, text
from batchloom.streaming import changes, leases

rng = random.Random(7)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows of 5 groups, the first of which holds most of them."""
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 5), n, rng.randrange(50)) for n in rng.sample(range(100_000), 2000)]
    return rows, spark.createDataFrame(rows, "g int, id bigint, v int")


def by_group(rows):
    groups = {}
    for g, n, v in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(g, []).append((n, v))
    return groups


def test_sparse_and_negative_ids(spark):
    ids = sorted(rng.sample(range(-(1 << 60), 1 << 60), 500) + list(range(-3, 4)))
    rows = [(None if n % 3 == 0 else n % 2, n, k % 50) for k, n in enumerate(ids)]
    df = spark.createDataFrame(rows, "g int, id bigint, v int")
    assert pairs(positions.id_positions(df, "id").select("id", "pos")) == [(n, k) for k, n in enumerate(ids)]
    inside, sums, before = {}, {}, {}
    for g, n, v in rows:
        own = [(m, w) for h, m, w in rows if h == g and m < n]
        inside[n], sums[n], before[n] = len(own), sum(w for _, w in own) + v, own[-1][1] if own else None
    assert dict(pairs(positions.id_positions(df, "id", ["g"]).select("id", "pos"))) == inside
    assert dict(pairs(with_running(df, F.col("v"), "s", ["g"], ["id"], id_block("id")).select("id", "s"))) == sums
    assert dict(with_previous(df, {"v": "p"}, ["g"], ["id"], id_block("id")).select("id", "p").collect()) == before


def test_positions_of_all_kinds(skewed):
    rows, df = skewed
    grouped = {(g, n): i for g, items in by_group(rows).items() for i, (n, _) in enumerate(items)}
    found = positions.id_positions(df, "id", ["g"], width=512).collect()
    assert {(r.g, r.id): r.pos for r in found} == grouped
    found = positions.grouped_positions(df, ["g"], ["v", "id"]).collect()
    order = {}
    for g, n, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        order[(g, n)] = sum(1 for key in order if key[0] == g)
    assert {(r.g, r.id): r.pos for r in found} == order
    everything = {n: i for i, (_, n, _) in enumerate(sorted(rows, key=lambda r: r[1]))}
    assert {r.id: r.pos for r in positions.range_positions(df, ["id"]).collect()} == everything
    hashed = sorted((hashlib.md5(str(n).encode()).hexdigest(), n) for _, n, _ in rows)
    found = positions.hash_positions(df, F.col("id").cast("string"), ["id"]).collect()
    assert {r.id: r.pos for r in found} == {n: i for i, (_, n) in enumerate(hashed)}


def test_positions_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id bigint")
    assert {r.id: r.pos for r in positions.id_positions(df, "id", ["g"]).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r.id: r.pos for r in positions.grouped_positions(df, ["g"], ["id"]).collect()} == {1: 0, 2: 1, 3: 0}


def test_carried_windows(skewed):
    rows, df = skewed
    block = id_block("id", 1000)
    previous = with_previous(df, {"v": "old"}, ["g"], ["id"], block).collect()
    total = with_running(df, F.col("v"), "t", ["g"], ["id"], block).collect()
    top = with_running(df, F.col("v"), "t", ["g"], ["id"], block, "max", include_current=False).collect()
    expected = {}
    for g, items in by_group(rows).items():
        old, running, best = None, 0, None
        for n, v in items:
            running += v
            expected[n] = (old, running, best)
            old, best = v, v if best is None else max(best, v)
    assert {r.id: r.old for r in previous} == {n: e[0] for n, e in expected.items()}
    assert {r.id: r.t for r in total} == {n: e[1] for n, e in expected.items()}
    assert {r.id: r.t for r in top} == {n: e[2] for n, e in expected.items()}


def test_latest_mark(spark, skewed):
    rows, df = skewed
    marks = sorted({(rng.randrange(5), rng.randrange(100_000)) for _ in range(60)})
    frame = spark.createDataFrame(marks, "g int, id bigint").withColumn("m", F.struct(F.col("id").alias("start")))
    found = {r.id: r.m.start if r.m else None for r in with_latest(df, frame, ["g"], "id", "m", 1000).collect()}
    for g, n, _ in rows:
        starts = [s for h, s in marks if h == g and s <= n]
        assert found[n] == (max(starts) if starts else None)


def test_merge_ranges_and_skip(spark):
    given = spark.createDataFrame([("0", 0, 1), ("0", 2, 3), ("1", 4, 5), ("1", 6, 7), ("1", 6, 7)], "f string, begin bigint, end bigint")
    merged = ranges.merge_ranges(given, "f", "begin", "end")
    assert pairs(merged) == [("0", 0, 3), ("1", 4, 7)]
    records = spark.createDataFrame([(f, n) for f in "012" for n in range(10)], "f string, n bigint")
    left = lookups.skip_processed_records(records, merged, "f", "n")
    done = {("0", n) for n in range(4)} | {("1", n) for n in range(4, 8)}
    assert pairs(left) == sorted({(f, n) for f in "012" for n in range(10)} - done)


def test_merge_ranges_random(spark):
    given = [(0 if rng.random() < 0.7 else 1, b, b + rng.randrange(12)) for b in (rng.randrange(3000) for _ in range(400))]
    merged = ranges.merge_ranges(spark.createDataFrame(given, "f int, begin bigint, end bigint"), "f", "begin", "end", width=64)
    expected = []
    for f in (0, 1):
        covered = sorted({n for g, b, e in given if g == f for n in range(b, e + 1)})
        for n in covered:
            if expected and expected[-1][0] == f and expected[-1][2] == n - 1:
                expected[-1][2] = n
            else:
                expected.append([f, n, n])
    assert pairs(merged) == sorted(map(tuple, expected))


def ring_brute_force(nodes, keys):
    slots = {}
    for node in nodes:
        for i in range(300):
            slot = hashlib.md5(f"{node}-v{i}".encode()).hexdigest()
            slots[slot] = min(node, slots.get(slot, node))
    order = sorted(slots)
    return {k: slots[order[bisect.bisect_left(order, hashlib.md5(k.encode()).hexdigest()) % len(order)]] for k in keys}


def test_consistent_hash(spark):
    nodes = [f"127.0.0.1:{p}" for p in (1234, 2345, 3456)]
    keys = [f"1.1.1.1:{n}" for n in range(10_000)]
    frame = spark.createDataFrame([(k,) for k in keys], "k string")

    def assign(names):
        members = spark.createDataFrame([(n,) for n in names], "n string")
        return {r.k: r.node for r in sharding.consistent_hash_assign(frame, F.col("k"), members, "n").collect()}

    first = assign(nodes)
    assert first == ring_brute_force(nodes, keys)
    sizes = [list(first.values()).count(n) for n in nodes]
    assert sizes == [3177, 3530, 3293]
    less = assign(nodes[:2])
    assert nodes[2] not in less.values()
    assert all(less[k] == first[k] for k in keys if first[k] != nodes[2])
    more = assign([*nodes, "127.0.0.1:4567"])
    assert all(more[k] in (first[k], "127.0.0.1:4567") for k in keys)


def test_balance_batches_conserves(spark):
    sizes = {m: rng.randrange(0, 40) for m in range(12)}
    sizes[3] = 400
    batches = [(m, n) for m, size in sizes.items() for n in range(size)]
    members = spark.createDataFrame([(m,) for m in sizes], "p bigint")
    shared = sharding.balance_batches(spark.createDataFrame(batches, "p bigint, n bigint"), "p", "n", members).collect()
    assert sorted((r.p, r.n) for r in shared) == sorted(batches)
    share = len(batches) // len(sizes)
    taken = [r.consumer for r in shared if r.consumer is not None]
    assert all(taken.count(m) == share for m in sizes)
    assert all(r.consumer == r.p for r in shared if r.n < min(sizes[r.p], share))


def test_queued_batches_in_steps(spark):
    counts = spark.createDataFrame([(1, 25), (2, 0), (3, 8)], "p bigint, n bigint")
    found = pairs(sharding.queued_batches(counts, "p", "n", 8, step=2))
    assert found == [(1, 0, 8), (1, 1, 8), (1, 2, 8), (1, 3, 1), (3, 0, 8)]


@pytest.mark.parametrize("n_clients, n_servers, per_client, per_server", [(3, 97, 32, 1), (97, 3, 1, 33)])
def test_balance_clients_servers(spark, n_clients, n_servers, per_client, per_server):
    clients = spark.range(n_clients).select(F.lit("s").alias("service"), F.col("id").alias("c"), F.lit(100).alias("need"))
    servers = spark.range(n_servers).select(F.lit("s").alias("service"), F.col("id").alias("s"))
    links = pairs(sharding.balance_clients_servers(clients, servers, "service", "c", "s", "need"))
    assert len(set(links)) == len(links)
    by_client = [sum(1 for _, c, _ in links if c == n) for n in range(n_clients)]
    by_server = [sum(1 for _, _, s in links if s == n) for n in range(n_servers)]
    assert set(by_client) == {per_client}
    assert max(by_server) <= per_server


def test_lookup_with_hot_and_null_keys(spark):
    rows = [(n, None if n % 5 == 0 else 0 if n % 3 else n % 40) for n in range(3000)]
    table = [(k, k * 10) for k in range(30)]
    left = spark.createDataFrame(rows, "n bigint, k bigint")
    right = spark.createDataFrame(table, "k bigint, v bigint")
    values = dict(table)
    for how in ("left", "inner"):
        found = lookups.skewed_lookup(left, right, "k", how, salts=4, hot_rows=500).select("n", "k", "v")
        expected = [(n, k, values.get(k)) for n, k in rows if how == "left" or k in values]
        assert {tuple(r) for r in found.collect()} == set(expected) and found.count() == len(expected)
    assert lookups.hot_keys(left, "k", least=500) == [0]


def test_pooled_slots(spark):
    vectors = {k: [float(k), k * 0.5, 1.0] for k in range(20)}
    rows = [(n, [n % 25, n % 7], [] if n % 2 else [n % 3] * 40, None, [0.5 * n]) for n in range(300)]
    df = spark.createDataFrame(rows, "n bigint, a array<bigint>, b array<bigint>, c array<bigint>, d array<double>")
    table = spark.createDataFrame(list(vectors.items()), "id bigint, vec array<float>")
    found = lookups.embedding_lookup_pool(df, "n", ["a", "b", "c"], "d", table, 3, hot_rows=100, salts=3).collect()

    def mean(ids):
        known = [vectors[i] for i in ids or [] if i in vectors]
        return np.mean(known, axis=0) if known else np.zeros(3)

    assert len(found) == 300
    for r in found:
        assert np.allclose(r.features, [*mean(r.a), *mean(r.b), *mean(r.c), *r.d])


def test_pooled_slots_shuffle_no_sums(spark):
    df = spark.createDataFrame([(1, [1, 2], [0.5]), (1, [3], [1.5]), (2, [9, None], [2.5]), (None, [1], [3.5])], "n bigint, a array<bigint>, d array<double>")
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, None), (3, [5.0, 0.0]), (3, [7.0, 2.0])], "id bigint, vec array<float>")
    found = lookups.embedding_lookup_pool(df, "n", ["a"], "d", table, 2)
    # rows of one key share their ids, a repeated vector counts twice, a null one not at all
    assert pairs(found.select("n", "features")) == [(1, [4.0, 2.0, 0.5]), (1, [4.0, 2.0, 1.5]), (2, [0.0, 0.0, 2.5])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_bag_of_words_asks_once_for_each_block(spark):
    rows = [(1, 1), (1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 2), (4, 9)]
    ids = spark.createDataFrame(rows, "d bigint, id bigint")
    table = spark.createDataFrame([(0, [9.0, 9.0]), (1, [1.0, 0.5]), (2, [-3.0, 1.0]), (2, [0.0, 0.0])], "id bigint, vec array<float>")
    found = metrics.bag_of_words_pool(ids, "d", "id", table, 2, [[1, 0], [0, 1]])
    soft = {r.d: r.logits for r in found.collect()}
    assert soft == {1: [2 / 3, 0.5], 2: [0.0, 0.0], 3: [0.0, 0.0], None: [0.0, 0.0], 4: [-0.75, 0.5]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_chunks_of_any_width(spark):
    records = [(f, n) for f in (0, 1) for n in range(0, 5000, 7)]
    chunks = [(0, 0, 6, "a"), (0, 10, 4999, "b"), (1, 100, 100_000_000_000, "c"), (1, 105, 105, "d"), (1, 50, 49, "e")]
    found = lookups.record_range_lookup(
        spark.createDataFrame(records, "f int, n bigint"), spark.createDataFrame(chunks, "f int, begin bigint, end bigint, c string"), "f", "n", 8
    )
    assert pairs(found.select("c", "n")) == sorted((c, n) for f, b, e, c in chunks for g, n in records if f == g and b <= n <= e)


def test_bad_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "clicks").write_text("1 0.5 7 8\n0 x 7 8\n1 0.5 7\n\n0 1 2 3\n")
    good, bad = text.read_ctr_records(spark, str(tmp_path / "clicks"), 1, 2)
    assert pairs(good) == [([0.5], [7], [8], 1), ([1.0], [2], [3], 0)]
    assert pairs(bad) == [("", 1), ("0 x 7 8", 4), ("1 0.5 7", 3)]
    (tmp_path / "images").write_text("a.JPEG 3\nb.JPEG\nc.JPEG x\n")
    good, bad = text.read_labelled_list(spark, str(tmp_path / "images"), "train", "r")
    assert pairs(good) == [("r/train/a.jpeg", 3)] and pairs(bad) == [("b.JPEG",), ("c.JPEG x",)]


def test_first_members_of_a_hot_job(spark):
    members = spark.range(5000).select((F.col("id") % 100 == 0).cast("int").alias("job"), F.col("id").alias("member"))
    found = windows.limit_members(members, "job", "member", 1200, 8)
    hot = [n for n in range(5000) if n % 100][:1200]
    assert pairs(found) == sorted([(0, n, k) for k, n in enumerate(hot)] + [(1, n * 100, n) for n in range(50)])


def test_late_and_open_leases_merge(spark):
    pieces = [("a", 0, 100, 1, 0), ("a", 250, 350, 1, 250), ("a", 90, 260, 3, 160), ("b", 400, 500, 1, 400), ("b", 501, 601, 1, 501)]
    df = spark.createDataFrame(pieces, "k string, start_us long, end_us long, beats long, last_us long")
    found = leases.merged_intervals(df, "k").select("k", "start_us", "end_us", "beats", "closed")
    assert pairs(found) == [("a", 0, 350, 5, True), ("b", 400, 500, 1, True), ("b", 501, 601, 1, False)]


def test_lists_round_trip(spark):
    lists = {b: list(range(8)) for b in range(24)} | {24: [0, 1]}
    rows = [(b, i, f"{b}:{i}") for b, items in lists.items() for i in items]
    tasks = batching.rebatch_lists(spark.createDataFrame(rows, "b bigint, i bigint, x string"), "b", "i", 4)
    assert tasks.count() == 194
    assert sorted({r.task_id for r in tasks.collect()}) == list(range(49))
    back = batching.regroup_lists(tasks, "b", "pos", "list_size", ["x"], chunk=5)
    assert all(r.complete for r in back.collect())
    found = {}
    for r in sorted(back.collect(), key=lambda r: (r.b, r.chunk)):
        found.setdefault(r.b, []).extend(x.x for x in r["rows"])
    assert found == {b: [f"{b}:{i}" for i in items] for b, items in lists.items()}


def test_distillation_forms(spark):
    samples = [(b * 16 + i, b, i, [float(b), float(i)], b) for b in range(10) for i in range(16)]
    df = spark.createDataFrame(samples, "id bigint, b bigint, i bigint, img array<float>, label int")
    job = scoring.Distillation({"img": "img"}, {"prediction": "array<double>"}, scoring.linear_teacher(10, 2), 6)
    answered = job.samples(df.select("id", "img", "label"), "id").run().collect()
    assert [r.id for r in answered] == list(range(160))
    weights = np.array([[((c * 31 + d * 17) % 13 - 6) / 10 for d in range(2)] for c in range(10)])
    assert np.allclose([r.prediction for r in answered], [weights @ s[3] for s in samples])
    lists = job.sample_lists(df.select("b", "i", "img", "label"), "b", "i").run().collect()
    assert len(lists) == 10 and all(len(r["rows"]) == 16 and len(r["rows"][0].prediction) == 10 for r in lists)


def test_teacher_batches(spark):
    def open_teacher():
        return lambda feeds: {"n": np.full(len(feeds["x"]), len(feeds["x"]))}

    df = spark.range(0, 50, 1, 1).withColumn("task", F.expr("id div 7"))
    sized = scoring.score_with_teacher(df, open_teacher, {"x": "id"}, {"n": "bigint"}, 16).collect()
    assert [r.n for r in sized] == [16] * 48 + [2] * 2
    tasks = scoring.score_with_teacher(df, open_teacher, {"x": "id"}, {"n": "bigint"}, 7, "task").collect()
    assert [r.n for r in tasks] == [7] * 49 + [1]


def test_dead_letters_keep_every_row(spark):
    def open_teacher():
        def teach(feeds):
            if (feeds["x"] == 13).any():
                raise ValueError("bad sample")
            return {"y": feeds["x"] * 2}

        return teach

    rows = scoring.score_or_dead_letter(spark.range(40), open_teacher, {"x": "id"}, {"y": "bigint"}, 8).collect()
    assert len(rows) == 40
    assert [(r.id, r.error, r.attempts) for r in rows if r.error] == [(13, "ValueError: bad sample", 3)]
    assert all(r.y == r.id * 2 for r in rows if not r.error)


def test_dead_letters_of_odd_lists_and_lost_answers(spark):
    def open_teacher():
        def teach(feeds):
            total = feeds["x"].sum(axis=1)
            return {"y": np.stack([total, -total], axis=1)[total != 99]}

        return teach

    made = [(1, [1.0, 2.0]), (2, None), (3, [4.0]), (4, [99.0, 0.0]), (5, [5.0, 6.0])]
    df = spark.createDataFrame(made, "id long, x array<double>").coalesce(1)
    rows = {r.id: r for r in scoring.score_or_dead_letter(df, open_teacher, {"x": "x"}, {"y": "array<double>"}, 8, 2).collect()}
    assert {k: r.y for k, r in rows.items()} == {1: [3, -3], 2: None, 3: [4, -4], 4: None, 5: [11, -11]}
    assert sorted(k for k, r in rows.items() if r.error) == [2, 4] and all(r.x == x for r, x in zip(rows.values(), dict(made).values()))
    assert scoring.score_or_dead_letter(df.limit(0), open_teacher, {"x": "x"}, {"y": "array<double>"}, 8).collect() == []


def test_text_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a0\na1\n\n  \na2\n a3 \n")
    (tmp_path / "b.txt").write_text("b0\nb1\nb2")
    rows = text.read_text_records(spark, str(tmp_path)).collect()
    found = {(r.file_path.rsplit("/", 1)[1], r.record_no): r.value for r in rows}
    assert found == {("a.txt", n + 1): f"a{n}" for n in range(4)} | {("b.txt", n + 1): f"b{n}" for n in range(3)}


def test_text_records_of_split_files(spark, tmp_path):
    lines = [f"line {n} " + "x" * rng.randrange(60) for n in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(x if n % 9 else x + "\n" for n, x in enumerate(lines)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = text.read_text_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in sorted(rows, key=lambda r: r.record_no)] == [x.strip() for x in lines]
    assert sorted(r.record_no for r in rows) == list(range(1, 4001))


def test_vocabulary_last_duplicate_wins(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\nb\na\n[UNK]\n")
    rows = text.read_vocabulary(spark, str(tmp_path)).select("word", "idx")
    assert pairs(rows) == [("[UNK]", 3), ("a", 2), ("b", 1)]


def test_chunks_hold_at_most_n_rows(spark):
    path = scratch(spark, "chunks")
    files.write_chunks(spark.range(0, 1000, 1, 3), path, 64)
    sizes = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) <= 64
    shards = [files.read_chunk_files(spark, path, 3, n).collect() for n in range(3)]
    assert sorted(r.id for s in shards for r in s) == list(range(1000))


def test_feed_schema_names_the_bad_column(spark):
    feeds = files.declare_feed_schema([("img", [1, 2], "float32")])
    with pytest.raises(ValueError, match="feed img"):
        files.check_feed_schema(spark.createDataFrame([([1],)], "img array<bigint>"), feeds)


def test_strict_manifest(spark):
    client = spark.createDataFrame([(0, "a"), (1, "x")], "idx bigint, path string")
    server = spark.createDataFrame([(0, "a"), (1, "b")], "idx bigint, path string")
    assert pairs(lookups.check_against_manifest(client, server, "idx", "path")) == [(1, "x", "b")]
    with pytest.raises(Exception, match="file list differs at 1"):
        lookups.check_against_manifest(client, server, "idx", "path", strict=True).collect()


def test_median_of_two_is_the_larger(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2), ("b", 1.0, 3), ("b", 2.0, 4), ("b", 9.0, 5), ("b", 4.0, 6)], "g string, v double, i int")
    assert pairs(metrics.median(df, ["g"], "v", ["i"])) == [("a", 2, 5.0), ("b", 4, 3.0)]
    assert pairs(metrics.median(df, ["g"], "v", ["i"], pair_takes_larger=False))[0] == ("a", 2, 3.0)


def test_auc_against_all_pairs(spark):
    rows = [(rng.randrange(4096) / 4096, rng.random() < 0.4) for _ in range(300)]
    report = metrics.auc_histogram(spark.createDataFrame(rows, "p double, y boolean"), F.col("p"), F.col("y")).first()
    wins = [(a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z]
    assert report.auc == pytest.approx(sum(wins) / len(wins))


def test_membership_changes(spark):
    rows = [("j", 1, "0", "a"), ("j", 2, "1", "a"), ("j", 3, "1", "a"), ("j", 3, "1", "b"), ("j", 4, "1", "a"), ("j", 4, "1", "b")]
    df = spark.createDataFrame(rows, "job string, version int, stage string, pod string")
    found = windows.membership_changed(df, "job", "version", F.col("stage"), "pod")
    assert pairs(found) == [("j", 2, 0, 0, True), ("j", 3, 1, 0, True), ("j", 4, 0, 0, False)]


def test_barrier(spark):
    members = spark.createDataFrame([("s", "a"), ("s", "b")], "stage string, pod string")
    nobody = spark.createDataFrame([], "pod string")
    strangers = members.where("pod = 'a'").unionByName(spark.createDataFrame([("s", "x")], "stage string, pod string"))
    one = metrics.barrier_complete(strangers, nobody, members, "stage", "pod")
    assert [tuple(r) for r in one.select("missing", "complete").collect()] == [(1, False)]
    both = metrics.barrier_complete(members, nobody, members, "stage", "pod")
    assert [tuple(r) for r in both.select("missing", "complete").collect()] == [(0, True)]


def test_dedup_and_fold(spark):
    rows = [("p", "0", 1, "x"), ("p", "1", 2, "y"), ("p", "0", 3, "z")]
    df = spark.createDataFrame(rows, "pod string, batch string, at int, v string")
    assert pairs(sets.dedup_batches(df, ["pod", "batch"], "at")) == [("p", "0", 1, "x"), ("p", "1", 2, "y")]
    ops = spark.createDataFrame([("s", "add", "1", 1), ("s", "remove", "", 2), ("t", "add", "5", 3)], "k string, op string, v string, r bigint")
    assert pairs(sets.fold_changes(ops, ["k"], F.col("op"), "v", "r"))[1] == ("t", "add", "5", 3)


def test_linear_fit_of_many_features(spark):
    x = np.random.default_rng(3).normal(size=(400, 13))
    y = x @ np.arange(1, 14) + 2.5
    names = [f"x{i}" for i in range(13)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], [*names, "y"])
    model = scoring.fit_linear(df, names, "y").stages[-1]
    assert np.allclose(model.coefficients.toArray(), np.arange(1, 14), atol=1e-6)
    assert model.intercept == pytest.approx(2.5, abs=1e-6)


def test_vocabulary_with_hot_words(spark):
    docs = spark.createDataFrame([(n, "the cat the dog" if n % 2 else "the xyz") for n in range(200)] + [(200, "")], "d bigint, t string")
    words = spark.createDataFrame([("the", 0), ("cat", 1), ("[UNK]", 2)], "word string, id bigint")
    for hot_rows in (10, 1000):
        found = lookups.vocab_lookup(docs, "d", text.words(F.col("t")), words, hot_rows=hot_rows).collect()
        assert {r.d: r.ids for r in found} == {n: [0, 1, 0, 2] if n % 2 else [0, 2] for n in range(200)} | {200: []}


def test_leases_end_after_silence(spark):
    beats = [("127.0.0.1:1", n, f"2024-01-01 00:00:{2 * n:02d}") for n in range(5)]
    beats += [("127.0.0.1:2", 10 + n, f"2024-01-01 00:00:{s:02d}") for n, s in enumerate((1, 30))]
    df = spark.createDataFrame(beats, "server string, n bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    alive = leases.alive_intervals(df, "server", "ts", 10, "n", id_block("n", 3))
    start = 1704067200
    assert sorted((r.server, r.start_us // 10**6 - start, r.end_us // 10**6 - start, r.beats) for r in alive.collect()) == [
        ("127.0.0.1:1", 0, 18, 5), ("127.0.0.1:2", 1, 11, 1), ("127.0.0.1:2", 30, 40, 1)
    ]
    for second, servers in ((5, 2), (15, 1), (25, 0)):
        assert leases.alive_at(alive, F.lit((start + second) * 10**6)).count() == servers


def test_versions_are_sent_once(spark):
    states = spark.createDataFrame([("c", 1, "a"), ("c", 2, "a"), ("c", 3, "b"), ("d", 4, "x")], "client string, n bigint, value string")
    deltas = changes.versioned_delta(states, "client", "value", "n", id_block("n", 2))
    assert pairs(deltas.select("client", "n", "version")) == [("c", 1, 1), ("c", 3, 2), ("d", 4, 1)]
    known = spark.createDataFrame([("c", 1), ("d", 1)], "client string, known bigint")
    assert [(r.client, r.value, r.version) for r in changes.newer_than(deltas, known, "client", "known").collect()] == [("c", "b", 2)]


def test_hot_group_takes_many_tasks(spark):
    """One group holds all rows; no task of the numbering sees more rows than a block holds."""
    df = spark.range(100_000).withColumn("g", F.lit(1))
    placed = positions.id_positions(df, "id", ["g"], width=5000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 1 and placed.where("pos <> id").isEmpty()


def test_more_shards_than_rows(spark):
    from batchloom.operators import sharding

    for n, shards in ((2, 8), (3, 8), (7, 7), (5, 2)):
        got = sharding.stride_shard_padded(spark.range(n), "id", shards).collect()
        sizes = [sum(r["shard"] == s for r in got) for s in range(shards)]
        assert sizes == [-(-n // shards)] * shards and {r["id"] for r in got} == set(range(n))


def test_absent_leader(spark):
    from batchloom.operators import sharding

    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 5), ("c", 4)], "job string, member long")
    leaders = spark.createDataFrame([("a", 99), ("c", 5)], "job string, leader long")
    got = {(r["job"], r["member"]): (r["rank"], r["leader_found"]) for r in sharding.rank_members(members, "job", "member", leaders, "leader", 1, 9).collect()}
    assert got == {("a", 1): (None, False), ("a", 2): (None, False), ("b", 3): (None, False), ("c", 5): (0, True), ("c", 4): (1, True)}


def test_listing_goes_by_name(spark):
    from batchloom.operators import windows

    names = spark.createDataFrame([(1, 1, "zeta"), (1, 2, "alpha"), (2, 3, "x")], "g long, id long, name string")
    got = {r["g"]: r["listing"] for r in windows.sorted_listing(names, "g", "name", "id").collect()}
    assert got == {1: "alpha,zeta", 2: "x"}
    ports = {r["name"]: r["endpoint"] for r in windows.endpoints(names, "g", "name", "id", 70, False).collect()}
    assert ports == {"alpha": "alpha:70", "zeta": "zeta:71", "x": "x:70"}


def test_batches_of_strangers_stay(spark):
    from batchloom.operators import sharding

    batches = spark.createDataFrame([("a", 0), ("a", 1), ("z", 0), ("z", 1)], "who string, pos long")
    members = spark.createDataFrame([("a",), ("b",)], "who string")
    got = {(r["who"], r["pos"]): r["consumer"] for r in sharding.balance_batches(batches, "who", "pos", members).collect()}
    assert got == {("a", 0): "a", ("a", 1): "b", ("z", 0): None, ("z", 1): None}


def test_raw_pairs_of_any_file_and_cut_files(spark, tmp_path):
    import struct

    import pytest

    from batchloom.sources import binary

    pair = struct.pack("=I", 1) + b"k" + struct.pack("=I", 3) + b"abc"
    (tmp_path / "x.kv").write_bytes(pair)
    (tmp_path / "y.bin").write_bytes(pair * 2)
    assert [(bytes(r["key"]), bytes(r["value"])) for r in binary.read_raw_kv(spark, str(tmp_path)).collect()] == [(b"k", b"abc")] * 3
    (tmp_path / "z.bin").write_bytes(pair[:-2])
    with pytest.raises(Exception, match="cut inside the pair"):
        binary.read_raw_kv(spark, str(tmp_path)).collect()


def test_features_come_in_windows(spark):
    from batchloom.functions.features import model_features

    df = spark.createDataFrame([(1, list(range(1, 8))), (2, []), (3, None)], "id long, ids array<long>")
    got = {(r["id"], r["window_no"]): (r["input_ids"], sum(r["input_mask"])) for r in model_features(df, "ids", 3).collect()}
    assert got == {(1, 0): ([1, 2, 3], 3), (1, 1): ([4, 5, 6], 3), (1, 2): ([7, 0, 0], 1), (2, 0): ([0, 0, 0], 0), (3, 0): ([0, 0, 0], 0)}


def test_buffered_shuffle_moves_rows_less_than_a_buffer(spark):
    ids = sorted(rng.sample(range(-5000, 5000), 1203))
    df = spark.createDataFrame([(n, "x") for n in ids], "id bigint, pos string")
    found = {r["id"]: r["at"] for r in batching.buffered_shuffle(df, "id", 3, 100, "at").collect()}
    assert sorted(found.values()) == list(range(len(ids)))
    assert all(at // 100 == n // 100 for n, at in zip(range(len(ids)), (found[i] for i in ids)))
    assert sum(at == n for n, at in zip(range(len(ids)), (found[i] for i in ids))) < 50
    again = {r["id"]: r["at"] for r in batching.buffered_shuffle(df.repartition(7), "id", 3, 100, "at").collect()}
    assert again == found
    assert batching.buffered_shuffle(df.limit(0), "id", 3, 100, "at").collect() == []


def test_observed_counts_tell_of_lost_rows(spark):
    df = spark.range(500)
    kept = scoring.audited_write(df, lambda rows: rows.withColumn("y", F.col("id") * 2), scratch(spark, "answers"))
    assert kept == {"feed_count": 500, "predict_count": 500, "matches": True}
    path = scratch(spark, "answers")
    lost = scoring.audited_write(df.repartition(5), lambda rows: rows.where("id <> 77"), path)
    assert lost == {"feed_count": 500, "predict_count": 499, "matches": False} and spark.read.parquet(path).count() == 499
    none = scoring.audited_write(df.limit(0), lambda rows: rows, scratch(spark, "answers"))
    assert none == {"feed_count": 0, "predict_count": 0, "matches": True}


def test_sliding_auc_by_pairs_of_rows(spark):
    rows = [(rng.choice([-70, -3, 0, 1, 2, 5, 6, 40, 41, 79, 80, 81, 200]), rng.choice([None, 0.0, 0.1, 0.1, 0.5, 0.9, 1.0]), rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "s int, p double, y boolean")
    found = {r["s"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in metrics.sliding_auc(df, "s", F.col("p"), F.col("y"), steps=4, thresholds=10).collect()}
    for s in {r[0] for r in rows}:
        held = [(-1 if p is None else int(p * 10), y) for t, p, y in rows if s - 4 < t <= s]
        pos, neg = [p for p, y in held if y], [p for p, y in held if not y]
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert found[s][:2] == (len(pos), len(neg))
        assert found[s][2] == (pytest.approx(wins / (len(pos) * len(neg))) if pos and neg else None)
    assert len(found) == len({r[0] for r in rows})
    assert metrics.sliding_auc(df.limit(0), "s", F.col("p"), F.col("y")).collect() == []


def test_sliding_auc_copies_a_count_once_at_most(spark):
    df = spark.range(10_000).select(F.col("id").alias("s"), F.lit(0.5).alias("p"), (F.col("id") % 2 == 0).alias("y"))
    plan = metrics.sliding_auc(df, "s", F.col("p"), F.col("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "array_distinct" in plan


def pair_rows(spark, n, width=5):
    value = F.expr(f"cast(repeat(cast(id % 10 as string), cast(id % {width} as int)) as binary)")
    return spark.range(n).select(F.col("id").cast("string").cast("binary").alias("key"), value.alias("value"))


def test_pair_files_are_read_by_block(spark, tmp_path):
    from batchloom.sources import binary

    path = str(tmp_path / "kv")
    df = pair_rows(spark, 5000).repartition(2)
    binary.write_raw_kv(df, path, rows_per_file=2000, block_bytes=1000)
    back = binary.read_raw_kv(spark, path, split_bytes=4000)
    assert back.rdd.getNumPartitions() > 3  # more than the files
    assert pairs(back) == pairs(df)
    binary.write_raw_kv(pair_rows(spark, 7), path)
    assert binary.read_raw_kv(spark, path).count() == 5007
    binary.write_raw_kv(pair_rows(spark, 3), path, mode="overwrite")
    assert pairs(binary.read_raw_kv(spark, path)) == pairs(pair_rows(spark, 3))
    assert len(list((tmp_path / "kv").glob("*.json"))) == 1
    binary.write_raw_kv(pair_rows(spark, 0), str(tmp_path / "none"))
    assert binary.read_raw_kv(spark, str(tmp_path / "none")).collect() == []


def test_large_pair_file_has_many_tasks(spark, tmp_path):
    from batchloom.sources import binary

    path = str(tmp_path / "kv")
    wide = spark.range(100, numPartitions=1).select(F.col("id").cast("string").cast("binary").alias("key"), F.expr("cast(repeat('x', 1000000 + cast(id as int)) as binary)").alias("value"))
    binary.write_raw_kv(wide, path, block_bytes=1 << 23)
    assert len(list((tmp_path / "kv").glob("*.kv"))) == 1
    back = binary.read_raw_kv(spark, path, split_bytes=1 << 24)
    assert back.rdd.getNumPartitions() >= 4
    assert pairs(back.select(F.col("key").cast("string"), F.length("value"))) == sorted((str(n), 1000000 + n) for n in range(100))


def test_failed_pair_job_leaves_nothing(spark, tmp_path):
    from batchloom.sources import binary

    path = str(tmp_path / "kv")
    bad = pair_rows(spark, 400).withColumn("value", F.when(F.col("key") != F.lit("399").cast("binary"), F.col("value"))).repartitionByRange(4, "key")
    with pytest.raises(Exception, match="no key or no value"):
        binary.write_raw_kv(bad, path, rows_per_file=10)
    left = [p for p in (tmp_path / "kv").rglob("*") if not p.name.endswith(".crc")]
    assert not [p for p in left if p.name.startswith("_index")]
    binary.write_raw_kv(pair_rows(spark, 40), path)
    assert pairs(binary.read_raw_kv(spark, path)) == pairs(pair_rows(spark, 40))
    cut_file = next((tmp_path / "kv").glob("*.kv"))
    cut_file.write_bytes(cut_file.read_bytes()[:-1])
    with pytest.raises(Exception, match=f"{cut_file.name} is cut inside the pair"):
        binary.read_raw_kv(spark, path).collect()


def test_bucketed_lookup_with_hot_and_null_keys(spark, tmp_path):
    from batchloom.operators import colocated

    values = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    colocated.save_bucketed(values, "k", 4, "bucket_test", str(tmp_path / "b"))
    keys = [None] * 20 + [7] * 3000 + [rng.randrange(600) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(keys)), "n int, k bigint")
    found = {r["n"]: r["v"] for r in colocated.bucketed_multi_get(rows, "bucket_test", "k", hot_rows=100).collect()}
    assert found == {n: k * 3 if k is not None and k < 500 else None for n, k in enumerate(keys)}
    assert pairs(colocated.bucketed_get(spark, "bucket_test", "k", [3, 499, 600]).select("k", "v")) == [(3, 9), (499, 1497)]
    assert colocated.bucketed_multi_get(rows.limit(0), "bucket_test", "k").collect() == []


def test_finished_files_are_not_opened(spark, tmp_path):
    rows = [(f, n) for f in (1, 2, 3, 4) for n in range(10 * f, 10 * f + 8)]
    path = tmp_path / "records"
    spark.createDataFrame(rows, "f bigint, n bigint").repartition("f").write.partitionBy("f").parquet(str(path))
    for part in (path / "f=1").glob("*.parquet"):
        part.write_bytes(b"no parquet")  # whoever opens it fails
    for crc in (path / "f=1").glob(".*.crc"):
        crc.unlink()
    records = spark.read.schema("n bigint, f bigint").parquet(str(path))
    manifest = spark.createDataFrame([(f, 10 * f, 10 * f + 7) for f in (1, 2, 3, 4)], "f bigint, first bigint, last bigint")
    done = spark.createDataFrame([(1, 5, 99), (2, 20, 22), (2, 24, 27), (3, 31, 37)], "f bigint, begin bigint, end bigint")
    found = lookups.skip_finished_files(records, manifest, done, "f", "n")
    assert pairs(found.select("f", "n")) == [(2, 23), (3, 30), *[(4, n) for n in range(40, 48)]]
    with pytest.raises(Exception):
        lookups.skip_processed_records(records, done, "f", "n").collect()

"""Repeated byte strings and word windows against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import awkward, empty, words

from batchloom.llm import bwtmerge, recompression, repeats
from batchloom.llm.queries import QUERIES
from batchloom.session import table

SF = "/root/testdata/sf0.001"


def distinct_rows(df):
    return {(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()}


def slow_bytes(docs, length=400):
    """Removed bytes of each document; a window may occur once only, anywhere."""
    data = {d: d[1].encode() for d in docs}
    seen = Counter(x[i : i + length] for x in data.values() for i in range(len(x) - length + 1))
    out = {}
    for d, x in data.items():
        edges = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                edges[i] += 1
                edges[i + length] -= 1
        gone = np.cumsum(edges)[: len(x)] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(x) else 0
        left = bytes(np.frombuffer(x, np.uint8)[~gone])
        out[d] = (len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def slow_words(docs, window=20):
    first = {}
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, repeats.text_id(d[1].encode())))
    split = {d: d[1].encode().split() for d in docs}
    for d in order:
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), (d, i))
    out = {}
    for d, own in split.items():
        gone = set()
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] != (d, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        out[d] = (len(own), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def check(df, docs, names, want):
    ids = defaultdict(Counter)
    for (k, _), value in want.items():
        ids[k][value] += 1
    got = defaultdict(Counter)
    for r in df.collect():
        got[r["doc_id"]][tuple(r[n] for n in names)] += 1
    assert set(got) == set(ids)
    for k in ids:
        assert set(got[k]) == set(ids[k]), k


BYTES = ("n_bytes", "n_removed", "n_spans", "kept")
WORDS = ("n_words", "n_removed", "kept")


def passages(seed, n=60):
    """Texts that share passages of many lengths, also around the limits, cut from each other, with a crowd around one passage."""
    rng = random.Random(seed)
    pool = [words(rng, rng.choice([15, 19, 20, 21, 25, 60, 70, 80, 100, 300])) for _ in range(12)]
    crowd = words(rng, 68)
    made = []
    for i in range(n):
        parts = [words(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            if rng.random() < 0.4:
                cut = rng.randint(0, len(p) // 2)
                p = p[cut : cut + rng.randint(len(p) // 3, len(p))]
            if rng.random() < 0.2:
                p = p.replace("a", "z", 1)
            parts += [p, words(rng, rng.randint(0, 10))]
        if i % 3 == 0:
            parts += [crowd, words(rng, 30)]
        made.append((i, " ".join(parts)))
    made += [(n, "ab" * 700), (n + 1, "ab " * 300), (n + 2, "x" * 401), (n + 3, "y" * 400), (n + 4, "w " * 21), (n + 5, "v " * 20)]
    made += [(n + 6, made[0][1]), (n + 7, made[0][1] + "q"), (n + 8, "ab" * 650 + "c"), (n + 9, "a b c " * 60)]
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, monkeypatch):
    monkeypatch.setattr(bwtmerge, "CHUNK", 700 * seed)
    monkeypatch.setattr(bwtmerge, "SHARD", 6000)  # many shards, so transforms are merged
    made = passages(seed)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    want = slow_bytes(set(made))
    assert 0 < sum(v[1] for v in want.values()) < sum(v[0] for v in want.values())
    check(bwtmerge.drop_repeated_bytes(df, digest=True), made, BYTES, want)
    monkeypatch.setattr(bwtmerge, "CROWD", 1)
    check(bwtmerge.drop_repeated_bytes(df, digest=True), made, BYTES, want)


def test_a_crowd_gives_few_rows_for_each_block(spark, monkeypatch):
    """Unlike texts around one passage: 8 parts a block at most, not one row for each window; the repeats are those of all windows."""
    rng = random.Random(8)
    common = words(rng, 68)[:300]
    texts = [f"{words(rng, 60)[:350]} {common} {words(rng, 60)[:350]}" for _ in range(30)]
    texts += [texts[3][200:700], texts[5][:500], "z" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {k[0]: v for k, v in slow_bytes(distinct_rows(docs)).items()}
    for crowd in (1, 4):
        monkeypatch.setattr(bwtmerge, "CROWD", crowd)
        found = bwtmerge.drop_repeated_bytes(docs, digest=True)
        assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == want
    data = [x.encode() for x in texts]
    k, g, doc, pos, n = bwtmerge.byte_blocks(data)
    blocks = [(a, b, 1, m, data[d][p : p + m + 399]) for a, b, d, p, m in zip(k.view("int64").tolist(), g.view("int64").tolist(), doc.tolist(), pos.tolist(), n.tolist())]
    parts = bwtmerge.block_parts(spark.createDataFrame(blocks, "k long, g long, weight long, n long, bytes binary"))
    assert parts.count() <= 8 * len(blocks) < sum(n.tolist()) and parts.agg({"n": "sum"}).first()[0] == n.sum()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words(spark, seed, monkeypatch):
    monkeypatch.setattr(recompression, "CHUNK", [50, 500, 10**6][seed - 1])  # long documents are looked at in pieces
    made = passages(seed)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    want = slow_words(set(made))
    assert 0 < sum(v[1] for v in want.values()) < sum(v[0] for v in want.values())
    check(recompression.drop_repeated_words(df, digest=True), made, WORDS, want)


def test_merged_transform_is_that_of_all():
    rng = random.Random(4)
    texts = [words(rng, 200).encode()[:900] for _ in range(6)]
    texts += [texts[0][100:700], texts[1], texts[2][:500] + texts[3][:500], b"z" * 600]
    for shard in (500, 1500, 100000):
        joined = b"".join(texts)
        weights = np.concatenate([np.where(np.arange(len(x)) <= len(x) - 400, 1, 0) for x in texts])
        place = [i for i in np.flatnonzero(weights)]
        seen = Counter(joined[i : i + 400] for i in place)
        want = [i for i in place if seen[joined[i : i + 400]] > 1]
        assert bwtmerge.repeated_rows(texts, weights, shard).tolist() == want and want


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    for _ in range(30):
        vocabulary = "a b c d e f g h".split()[: rng.randint(2, 8)]
        common = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        texts = [" ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + common + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]) for _ in range(4)]
        k, g, doc, pos, n = recompression.word_blocks([t.encode().split() for t in texts])
        key = {}
        for kk, d, p, m in zip(k.tolist(), doc.tolist(), pos.tolist(), n.tolist()):
            for i in range(p, p + m):
                key[d, i] = kk
        by_window = defaultdict(set)
        for d, t in enumerate(texts):
            split = t.split()
            for i in range(len(split) - 19):
                by_window[tuple(split[i : i + 20])].add(key[d, i])
        assert all(len(v) == 1 for v in by_window.values())


def test_sliding_min():
    values = np.random.default_rng(1).integers(0, 100, 57)
    for width in (1, 5, 7, 57):
        assert bwtmerge.sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(58 - width)]


def test_query_bytes(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op3_bwt_merge"](spark, SF).collect()}
    assert got == {k[0]: v for k, v in slow_bytes(distinct_rows(docs)).items()}


def test_query_words(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op6_recompression"](spark, SF).collect()}
    assert got == {k[0]: v for k, v in slow_words(distinct_rows(docs)).items()}


def test_awkward_rows(spark):
    df = awkward(spark)
    docs = distinct_rows(df)
    found = bwtmerge.drop_repeated_bytes(df, digest=True)
    assert found.count() == df.count()
    check(found, docs, BYTES, slow_bytes(docs))
    found = recompression.drop_repeated_words(df, digest=True)
    assert found.count() == df.count()
    check(found, docs, WORDS, slow_words(docs))
    assert bwtmerge.drop_repeated_bytes(empty(spark)).collect() == []
    assert recompression.drop_repeated_words(empty(spark)).collect() == []

"""Token counts, phrases and whitening against brute force."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import awkward, empty, texts, words

from batchloom.llm import phrases, tokencounts, whitening
from batchloom.llm.queries import QUERIES
from batchloom.session import scratch, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rows(df):
    return [r.asDict() for r in df.collect()]


def slow_count(text):
    return len(tokencounts.processor(tokencounts.MODEL).encode(text or ""))


def test_token_counts(spark, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(QUERIES["op12_token_counts"](spark, SF))}
    want = {k: (len((t or "").encode()), slow_count(t), slow_count(t) > 4096) for k, t in texts(docs).items()}
    assert got == want


def test_only_misses_are_encoded(spark, docs):
    cache, version = scratch(spark, "cache"), tokencounts.tokenizer_version(tokencounts.MODEL)
    held = lambda: spark.read.parquet(os.path.join(cache, f"tokenizer={version}"))
    first = docs.where("doc_id % 2 = 0")
    tokencounts.count_tokens(first, cache=cache).collect()
    n = held().count()
    assert n == len({t or "" for t in texts(first).values()}) == held().select("digest").distinct().count()
    marked = held().selectExpr("digest", "n_tokens + 1000000 AS n_tokens")  # a cache that lies shows what is read from it
    lying = scratch(spark, "lying")
    marked.write.parquet(os.path.join(lying, f"tokenizer={version}"))
    known = {t or "" for t in texts(first).values()}
    got = {r["doc_id"]: r["n_tokens"] for r in rows(tokencounts.count_tokens(docs, cache=lying))}
    assert got == {k: slow_count(t) + (1000000 if (t or "") in known else 0) for k, t in texts(docs).items()}
    before = spark.read.parquet(os.path.join(lying, f"tokenizer={version}")).count()
    tokencounts.count_tokens(docs, cache=lying).collect()
    assert spark.read.parquet(os.path.join(lying, f"tokenizer={version}")).count() == before == len({t or "" for t in texts(docs).values()})
    other = os.path.join(lying, "tokenizer=another")  # counts of another tokenizer are not looked at
    marked.write.parquet(other)
    assert {r["doc_id"]: r["n_tokens"] for r in rows(tokencounts.count_tokens(docs, cache=lying))} == got


def test_texts_of_one_normal_form_have_one_count(spark):
    rng = random.Random(31)
    made = ["", " ", "▁", "a▁b", "a b", "▁▁a  b ▁", "<s> x</s> <unk>", "<0x0A>", "​﻿", "\U0001f600 é́ß"]
    made += ["".join(rng.choice(" ▁ab\t\nxé1.") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    made += ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(12)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in rows(tokencounts.count_tokens(df))} == {k: slow_count(t) for k, t in enumerate(made)}


def test_awkward_counts(spark):
    df = awkward(spark)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows(tokencounts.count_tokens(df)))
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), slow_count(r["text"])) for r in df.collect())
    assert rows(tokencounts.count_tokens(empty(spark))) == []


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def slow_phrases(table_rows, least, top=2000):
    """``{(lang, rank): (phrase, a, l, r, n, score)}`` from plain counts of all phrases."""
    seen, total = Counter(), Counter()
    for lang, text in table_rows:
        for own in pieces(text):
            total[lang or "und"] += len(own)
            seen.update((lang or "und", tuple(own[i : i + k])) for k in range(1, 5) for i in range(len(own) - k + 1))
    often = {p: a for p, a in seen.items() if a >= least and len(p[1]) > 1}
    covered = Counter()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                covered[lang, p[i : i + k]] = max(covered[lang, p[i : i + k]], a)
    scored = {}
    for (lang, p), a in often.items():
        if 100 * covered[lang, p] >= 80 * a:
            continue
        score, cut = min((2000000 * a // (seen[lang, p[:k]] + seen[lang, p[k:]]), k) for k in range(1, len(p)))
        scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), seen[lang, p[:cut]], seen[lang, p[cut:]]))
    return {
        (lang, rank): (phrase.decode(), -a, left, right, total[lang], -score)
        for lang, own in scored.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1)
    }


def mined(df, **settings):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(phrases.mine_phrases(df, **settings))}


def test_phrases(spark, docs):
    held = [(r["lang"], r["text"]) for r in docs.collect()]
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows(QUERIES["op13_phrases"](spark, SF))}
    assert got == slow_phrases(held, 30) and len(got) > 20


@pytest.mark.parametrize("sampled, proposed", [(1, 3), (3, 1), (1 << 40, 1)])
def test_passes_close_whatever_was_proposed(spark, sampled, proposed):
    """The whole table as sample, a third, and none at all: then each pass adds a word to the longest known phrases."""
    rng = random.Random(6)
    pool = ["a", "B", "c", "Dé", "e\x00", "▁", "ü"]
    glue = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\x0b", " ", " ", " "]
    made = [(rng.choice(["x", "y", "und", None]), "".join(rng.choice(pool) + rng.choice(glue) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    made += [("x", "one two three four five " * 9), ("z", "only a few"), ("x", None)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "doc_id long, lang string, text string")
    want = slow_phrases(made, 8, 60)
    assert mined(df, least=8, top=60, sampled=sampled, proposed=proposed) == want and len(want) > 100


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb", "ccc", "d" * 40]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 60)))
        want, got = Counter(), Counter()
        for own in pieces(text):
            want.update(tuple(own[i : i + k]) for k in range(1, 5) for i in range(len(own) - k + 1))
        for part in phrases.segments(text.encode().translate(phrases.LOWER), 4, 25):
            words_of = phrases.Words("x", [part])
            names = [w.decode() for w in words_of.words.to_pylist()]
            for k in range(1, 5):
                for i in range(len(words_of.codes) - k + 1):
                    if words_of.starts[i] and words_of.inside(k)[i]:
                        got[tuple(names[c] for c in words_of.codes[i : i + k])] += 1
        assert got == want


def test_filters_know_what_they_were_given(spark):
    rng = random.Random(8)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(5000)]
    for bits in (16, 22):
        made = phrases.filled(spark.createDataFrame([(v,) for v in values], "hash long"), bits)
        assert made.has(np.array(values, np.int64).view(np.uint64)).all()
        other = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
        assert made.has(other).mean() < (0.1 if bits == 16 else 0.001)


def test_awkward_phrases(spark):
    df = awkward(spark)
    held = [(r["lang"], r["text"]) for r in df.collect()]
    want = slow_phrases(held, 3)
    assert mined(df, least=3) == want and ("und", 1) in want
    assert rows(phrases.mine_phrases(empty(spark))) == []


def test_phrase_counts_are_not_broadcast(spark):
    """Their files may be small and they still fill a driver: the explode by salts is not seen in their size."""
    df = spark.createDataFrame([(i, "x", "one two three four five " * 9) for i in range(9)], "doc_id long, lang string, text string")
    mined_df = phrases.mine_phrases(df, least=3)
    plan = mined_df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan
    assert mined_df.count() > 3


def slow_whitening(vectors, wanted=4):
    """``{vec_id: (n, deviation)}``, eigenvalues, eigenvectors, mean and trace from a full decomposition."""
    usable = {k: v for k, v in vectors.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    width = max(map(len, usable.values()))
    x = {k: np.floor(256 * np.array(list(v) + [0] * (width - len(v)), float)).astype(np.int64) for k, v in usable.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vecs = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(width, width))
    exact = {k: (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total))) for k, v in x.items()}
    return exact, x, values[::-1][:wanted], vecs[:, ::-1][:, :wanted], total / n, values.sum()


def check_whitening(got, vectors, close=1e-9):
    exact, x, values, vecs, mean, trace = slow_whitening(vectors)
    found = {}
    for r in got:
        assert (r["n"], r["deviation"]) == exact[r["vec_id"]]
        assert r["identity_error"] <= 1e-9 and r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-10)
        found[r["vec_id"], r["component"]] = r["whitened"]
    components = sum(values > 1e-9 * values[0])
    assert set(found) == {(k, c + 1) for k in x for c in range(components)}
    for c in range(components):
        want = {k: (v - mean) @ vecs[:, c] / np.sqrt(values[c]) for k, v in x.items()}
        sign = np.sign(sum(want[k] * found[k, c + 1] for k in x))
        assert all(abs(sign * found[k, c + 1] - w) <= close for k, w in want.items())


def test_whitening(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, SF, "embeddings").collect()}
    check_whitening(rows(QUERIES["op11_whitening"](spark, SF)), vectors)


def test_components_of_spectra():
    """Close, equal, fast falling and missing eigenvalues; every pass is one product."""
    rng = np.random.default_rng(11)
    for width, values in ((80, 1000 - 0.5 * np.arange(80)), (80, np.exp(-np.arange(80.0))), (60, np.repeat([9.0, 4.0], 30)), (50, np.r_[3.0, 2.0, np.zeros(48)]), (3, np.r_[5.0, 4.0, 1.0])):
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        v, passes = (turn * values) @ turn.T, []
        found, block = whitening.leading_components(lambda q: passes.append(1) or v @ q, width, min(4, width))
        assert np.allclose(found, values[: len(found)], rtol=0, atol=1e-12 * values[0] * width) and len(passes) < 400
        assert np.linalg.norm(v @ block - block * found, axis=0).max() <= 1e-11 * values[0]
        assert np.abs(block.T @ block - np.eye(block.shape[1])).max() < 1e-12


def test_whitening_awkward(spark):
    rng = np.random.default_rng(12)
    made = {i: [float(v) for v in rng.normal(3.0, 0.5, 6)] for i in range(60)}
    made |= {100: made[3], 101: made[3], 102: None, 103: [None] + made[4][1:], 104: [float("nan")] * 6, 105: [float("inf")] + made[5][1:], 106: made[6][:4], 107: []}
    made[108] = [-0.0] * 6
    df = spark.createDataFrame([(k, v, 1, "c", 2.0) for k, v in made.items()], "vec_id long, embedding array<double>, n long, component string, x double")
    check_whitening(rows(whitening.whiten(df)), made)
    line = {i: [float(i), 2.0 * i, 0.0] for i in range(9)}  # one component only
    check_whitening(rows(whitening.whiten(spark.createDataFrame(list(line.items()), "vec_id long, embedding array<float>"))), line)
    for few in ([], [(1, None)], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, [])]):
        assert rows(whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == []
    wide = [(None, [1e9, 0.0]), (None, [-1e9, 1.0]), (2, [3.0, 1e12])]
    got = rows(whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")))
    assert len(got) == 6 and all(r["deviation"] is None for r in got if r["vec_id"] == 2) and all(r["identity_error"] < 1e-9 for r in got)

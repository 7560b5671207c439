"""Quality rules, line deduplication, SimHash, mixing, packing and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import awkward, empty, texts, words

import corpus_pipeline
from batchloom.llm import linededup, mixing, nearcopies, packing, quality, simhash
from batchloom.llm.common import components, forest, slices
from batchloom.llm.queries import QUERIES
from batchloom.session import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rows(df):
    return [r.asDict() for r in df.collect()]


def slow_measures(text):
    text = text or ""
    found = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(found) - 7):
        grams[tuple(found[i : i + 8])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_measures(spark, docs):
    want = {k: slow_measures(t) for k, t in texts(docs).items()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = rows(QUERIES["op8_quality_rules"](spark, SF))
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == want
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_repeated_words_overlapping():
    for text in ("a " * 30, "a b " * 9, "a b c d e f g h i " * 2, "a b c d e f g h " * 2, "x " + "a b c d e f g h " * 2, "a " * 9, "a " * 8, ""):
        assert quality.measure(text.encode()) == slow_measures(text)


def test_frequent_lines(spark):
    rng = random.Random(1)
    line = "all rights reserved by the owners of this 2024 site"
    made = [(i, f"{words(rng, 30)}\n{line.upper() if i % 2 else line.replace('4', '5')}", "h") for i in range(100)]
    made += [(100, line + "\n" + words(rng, 5), "h"), (101, line + "\n" + words(rng, 30), "other")]
    made += [(200 + i, "copied text " + "and more words here " * 1 + "that fill the line so it has twenty words or a few more than that at least", "h") for i in range(90)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in rows(quality.apply_quality(df))}
    assert 100 not in kept and len(kept) == len(made) - 1  # a copied text is no frequent line
    assert all(line.lower()[:20] not in kept[i].lower() for i in range(100)) and line in kept[101]
    assert quality.apply_quality(df).columns == df.columns


def test_frequent_lines_of_small_and_large_hosts(spark):
    rng = random.Random(16)
    line = "all rights reserved by the owners of this site"
    made = [(i, f"{words(rng, 30)}\n{line}", "small") for i in range(12)]
    made += [(100 + i, f"{words(rng, 30)}\n{line}" if i < 9 else words(rng, 30), "large") for i in range(120)]
    made += [(300 + i, f"{words(rng, 30)}\n{line}" if i < 3 else words(rng, 30), "rare") for i in range(12)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in rows(quality.apply_quality(df))}
    assert len(kept) == len(made)
    assert {k for k, t in kept.items() if line in t} == set(range(100, 109)) | {300, 301, 302}  # 7.5 %, and three documents
    kept = {r["doc_id"]: r["text"] for r in rows(quality.apply_quality(df, most_documents=8))}
    assert {k for k, t in kept.items() if line in t} == {300, 301, 302}


def slow_fingerprint(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    prints = {k: slow_fingerprint(t) for k, t in texts(docs).items()}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = slow_components(ids, near)
    got = rows(QUERIES["op9_simhash"](spark, SF))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in ids}


@pytest.mark.parametrize("limit", [1, 3, 5])
def test_pigeonhole_finds_all_links(spark, limit):
    rng = random.Random(limit)
    values = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(700):  # a crowd around few values, larger than a block
        v = rng.choice(values[:3] if rng.random() < 0.8 else values)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            v ^= 1 << b
        values.append(v)
    values = sorted({simhash.signed(v) for v in values})
    nodes = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fp long, first long")
    masks = simhash.plan_masks(nodes, limit)
    from pyspark.sql import functions as F

    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks)])).alias("p")
    keyed = nodes.select("fp", probes).select(F.xxhash64("p.i", F.col("fp").bitwiseAND(F.col("p.m"))).alias("key"), "fp")
    old, simhash.BLOCK = simhash.BLOCK, 40
    try:
        got = {r["node"]: r["root"] for r in rows(components(simhash.bucket_links(keyed, limit)))}
    finally:
        simhash.BLOCK = old
    near = [(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= limit]
    want = slow_components(values, near)
    assert {v: got.get(v, v) for v in values} == want


def slow_shingle_print(text):
    """Four 64-bit fingerprints of the different five-word shingles, each of hashes mixed in its own way."""
    found = (text or "").encode().lower().split()
    shingles = {b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()
    whole, prints = 2**64, []
    for stream in range(4):
        counts = [0] * 64
        for shingle in shingles:
            z = (xxhash.xxh64_intdigest(shingle, 42) + 0x9E3779B97F4A7C15 * (stream + 1)) % whole
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % whole
            z = (z ^ z >> 27) * 0x94D049BB133111EB % whole
            z ^= z >> 31
            for bit in range(64):
                counts[bit] += z >> bit & 1
        prints.append(sum(1 << bit for bit in range(64) if counts[bit] * 2 > len(shingles)))
    return prints


def slow_copies(one, other):
    """Fingerprints within 3 bits, or within 9 and 43 of the 256 bits of the second ones."""
    first = (one[0] ^ other[0]).bit_count()
    return first <= 3 or first <= 9 and sum((a ^ b).bit_count() for a, b in zip(one[1], other[1])) <= 43


def edited(rng, text, changes):
    found = text.split()
    for at in rng.sample(range(len(found)), changes):
        found[at] = "changed" + str(rng.randrange(1000))
    return " ".join(found)


@pytest.mark.parametrize("block", [16, 4096])
def test_near_copies_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "HELD", 50)
    rng = random.Random(31)
    made = [words(rng, rng.randint(1, 200)) for _ in range(40)]
    made += [edited(rng, t, rng.randint(1, 6)) for t in made if len(t.split()) > 60 for _ in range(6)]
    made += [edited(rng, max(made, key=len), 1) for _ in range(60)] + ["", None, " "]
    docs = {i: t for i, t in enumerate(made)}
    prints = {i: (slow_fingerprint(t), slow_shingle_print(t)) for i, t in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and slow_copies(prints[a], prints[b])]
    want = slow_components(docs, links)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in rows(nearcopies.drop_near_copies(df))} == {k for k, v in want.items() if k == v}
    assert any((prints[a][0] ^ prints[b][0]).bit_count() > 3 for a, b in links)


def test_near_copies_of_a_similarity_are_found(spark):
    """Texts with one word in about 60 changed share 0.8 or more of their five-word shingles; others stay."""
    rng = random.Random(32)
    alone = [words(rng, 300) for _ in range(150)]
    copies = [edited(rng, t, 4) for t in alone]
    df = spark.createDataFrame(list(enumerate(alone + copies)), "doc_id long, text string")
    kept = {r["doc_id"] for r in rows(nearcopies.drop_near_copies(df))}
    assert kept >= set(range(150)) and len(kept) <= 150 + 15


def test_allocation_covers_the_limit():
    sample = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    for parts in (2, 3, 4):
        groups = simhash.bit_groups(sample, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, thresholds = simhash.allocate(sample, groups, 10**6, 3)
        assert sum(t + 1 for t in thresholds) == 4


def test_forest_and_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = slow_components(range(461), edges)
    a, b = (np.array(x) for x in zip(*edges))
    assert forest(a, b, 461).tolist() == [want[i] for i in range(461)]
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert {n: got.get(n, n) for n in range(461)} == want


def test_patience():
    a, b = list("xabcdeyfg"), list("abczdefgq")
    pairs = linededup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and [a[i] for i, _ in pairs] == list("abcdefg")
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert linededup.patience(a, a) == [(i, i) for i in range(len(a))]


def plain_blocks(docs_by_id, least=linededup.BLOCK_WORDS):
    """Lines in runs of ``least`` words that an earlier document has somewhere, without partners or alignment."""
    lines = {k: [x.strip(" \t\n\r\x0b\x0c") for x in (t or "").split("\n")] for k, t in docs_by_id.items()}
    first, held, out = {}, set(), {}
    for k, own in sorted(lines.items()):
        count = [len(WORD.findall(x)) for x in own]
        if tuple(own) in first:
            out[k] = list(range(len(own))) if sum(count) >= least else []
            continue
        first[tuple(own)] = k
        runs = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if sum(count[i:j]) >= least]
        out[k] = sorted({x for i, j in runs if tuple(own[i:j]) in held for x in range(i, j)})
        held |= {tuple(own[i:j]) for i, j in runs}
    return out


def test_line_dedup(spark, docs):
    want = plain_blocks(texts(docs))
    got = {r["doc_id"]: [int(x) for x in r["removed"].split(",") if x] for r in rows(QUERIES["op1_line_dedup"](spark, SF))}
    assert got == want and any(want.values())
    cut = texts(linededup.drop_common_lines(docs))
    for k, t in texts(docs).items():
        assert cut[k] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(want[k]))


def test_line_blocks_go_from_the_later(spark):
    rng = random.Random(9)
    block = [words(rng, 8) for _ in range(5)]
    made = [(9, "\n".join([words(rng, 9), *block, words(rng, 9)])), (4, "\n".join([words(rng, 9), *block])), (5, block[0] + "\n" + words(rng, 9))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in rows(linededup.common_lines(df))}
    assert got == {4: [], 5: [], 9: [1, 2, 3, 4, 5]}


def removed_lines(spark, made):
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    return {r["doc_id"]: r["removed"] for r in rows(linededup.common_lines(df))}


def test_frequent_passages_and_runs_of_scattered_lines(spark):
    rng = random.Random(12)
    passage, other = words(rng, 25), words(rng, 9)
    made = {i: f"{words(rng, 9)}\n{passage}" for i in range(150)}
    made |= {200: other, 201: f"{other}\n{words(rng, 9)}\n{passage}"}  # the rarest line leads to 200 only
    block = [words(rng, 8) for _ in range(4)]
    made |= {300 + i: f"{x}\n{words(rng, 9)}" for i, x in enumerate(block)}  # each line of the block alone
    made |= {400: "\n".join([words(rng, 9), *block]), 401: "\n".join([*block, words(rng, 9)])}
    got = removed_lines(spark, made)
    assert got == plain_blocks(made)
    assert got[201] == [2] and got[401] == [0, 1, 2, 3]


def test_passages_that_stand_twice_or_in_another_order(spark):
    rng = random.Random(14)
    line, block = words(rng, 22), "\n".join(words(rng, 12) for _ in range(3))
    other = lambda: words(rng, 9)
    made = {1: "\n".join([other(), line, other(), other()]), 2: "\n".join([other(), line, other(), line, other()])}
    made |= {3: "\n".join([other(), block, other(), block, other()]), 4: "\n".join([other(), other(), block, other()])}
    made |= {5: "\n".join([other(), block, other(), line, other()]), 6: "\n".join([other(), line, other(), block, other()])}
    got = removed_lines(spark, made)
    assert got == plain_blocks(made) and got[2] == [1, 3] and got[4] == [2, 3, 4]
    for _ in range(200):
        pool = [words(rng, n) for n in (0, 0, 4, 8, 8, 13, 21)]
        made = {k: "\n".join(rng.choices(pool, k=rng.randint(1, 12))) for k in (1, 2)}
        keys = {k: linededup.line_keys(t.encode()) for k, t in made.items()}
        count = [len(x.split()) for x in made[2].split("\n")]
        if keys[1] != keys[2]:
            assert linededup.common_blocks(keys[1], keys[2], count, 20) == plain_blocks(made)[2]


def test_runs_cover_every_block():
    rng = random.Random(13)
    for _ in range(300):
        count = [rng.choice((0, 0, 1, 3, 8, 20, 25)) for _ in range(rng.randint(0, 14))]
        found = linededup.spans(count, 20)
        assert all(sum(count[i:j]) >= 20 for i, j in found)
        for i in range(len(count)):
            for j in range(i + 1, len(count) + 1):
                if sum(count[i:j]) >= 20:
                    assert {x for a, b in found if i <= a and b <= j for x in range(a, b)} == set(range(i, j))
    keys = linededup.line_keys(b"a\nb\na\nb\nc")
    runs = [(0, 2), (2, 4), (1, 3), (0, 1)]
    got = linededup.run_keys(keys, runs)
    assert got[0] == got[1] and len(set(got)) == 3


def slow_targets(sizes, epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        spare, heavy = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if spare * weight[s] / heavy > epochs * sizes[s]]
        if not over:
            return fixed | {s: spare * weight[s] / heavy for s in rest}
        fixed |= {s: float(epochs * sizes[s]) for s in over}


def check_mix(df, got):
    own = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in df.collect()]
    sizes = defaultdict(int)
    for _, n, s in own:
        sizes[s] += n
    want = slow_targets(sizes)
    source = {k: s for k, _, s in own}
    taken, most = Counter(), Counter()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((k, n) for k, n, _ in own)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1


def test_mixing(spark, docs):
    got = rows(QUERIES["op10_mixing"](spark, SF))
    check_mix(docs, got)
    again = rows(QUERIES["op10_mixing"](spark, SF))
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixing_clamps_small_sources(spark):
    rng = random.Random(4)
    made = [(i, words(rng, rng.randint(0, 40)), rng.choice(["a"] * 50 + ["b", "c", "é", "z", None])) for i in range(600)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = rows(mixing.mix(df))
    check_mix(df, got)
    assert any(r["target"] == 3 * r["source_size"] for r in got)
    times = {r["doc_id"]: r["times"] for r in got}
    assert Counter(r["doc_id"] for r in rows(mixing.take_mix(df))) == Counter({k: n for k, n in times.items() if n})


def test_mix_tells_sources_of_an_id_apart(spark):
    rng = random.Random(21)
    made = [(i, words(rng, 20), rng.choice("xy")) for i in range(60)] + [(None, words(rng, 6), "x"), (None, words(rng, 9), "y")]
    made += [(7, words(rng, 5), s) for s in ("x", "y")] + [(200 + i, words(rng, 3), "z") for i in range(3)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    plan = Counter()
    for r in rows(mixing.planned(df)):
        plan[r["source"]] += r["taken"]
    took = Counter()
    for r in rows(mixing.take_mix(df)):
        took[r["source"]] += len(r["text"].split())
    assert took == plan


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(found, want):
    by_doc = defaultdict(list)
    bins = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for k, ids in want.items():
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or all(r["length"] == 1024 for r in own[1:]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_packing(spark, docs):
    model = tokenizer()
    want = {k: model.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts(docs).items()}
    bins = check_packing(rows(QUERIES["op7_best_fit_packing"](spark, SF)), want)
    assert bins <= 1.01 * sum(map(len, want.values())) / 1024 + 2


@pytest.mark.parametrize("text", ["a  b", " a b", "a b ", "a \n b", "a  b", "x <|endoftext|> y", "it's we'll 12 34  ", "é è\tç ", "  ", "a\n\n\nb c", "　 a", "日本 語 !? ..."])
def test_ids_equal_the_tokenizer(text):
    got = np.frombuffer(packing.byte_bpe("byte_bpe_50k.json", "byte_bpe_50k.tiktoken").ids(text), "<u4").tolist()
    assert got == tokenizer().encode(text, add_special_tokens=False).ids


def test_slices_hold_few_rows_and_give_memory_back(monkeypatch):
    given = []

    class Pool:
        def release_unused(self):
            given.append(True)

    batches = [pa.RecordBatch.from_pydict({"x": list(range(k))}) for k in (0, 1, 1100)]
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    cut = list(slices(batches, 500))
    assert [b.num_rows for b in cut] == [1, 500, 500, 100]
    assert [x for b in cut for x in b.column("x").to_pylist()] == [0, *range(1100)]
    assert given == [True]
    assert next(slices(batches, 500)).num_rows == 1
    assert given == [True, True]  # also if the task ends early


def test_many_rows_in_one_batch(spark):
    made = [(i, f"s{i % 3}", "\n".join(f"w{i * k % 7919} common line {k}" for k in range(i % 9))) for i in range(1300)]
    table = spark.createDataFrame(made, "doc_id long, source string, text string").coalesce(1)
    measured = {r["doc_id"]: (r["n_words"], r["n_dup_lines"]) for r in quality.measured_lines(table, "doc_id", "source", "text").collect()}
    assert measured == {i: slow_measures(t)[::3] for i, _, t in made}
    assert {r["doc_id"]: r["size"] for r in mixing.sizes(table, "doc_id", "source", "text").collect()} == {i: len(t.split()) for i, _, t in made}
    assert {r["doc_id"]: len(r["keys"]) for r in linededup.sequences(table, "doc_id", "text").collect()} == {i: t.count("\n") + 1 for i, _, t in made}
    model = packing.byte_bpe("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    assert {r["doc_id"]: r["length"] for r in packing.pieces(table).collect()} == {i: len(model.ids(t)) // 4 + 1 for i, _, t in made}
    model.units.clear()


def test_no_units_are_kept_after_a_task():
    model = packing.byte_bpe("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1100)), "text": [f"some words of text {i}" for i in range(1100)]})
    task = packing.encoded([batch], model, 1024, False)
    assert next(task).num_rows and model.units
    assert sum(b.num_rows for b in task) and not model.units


def test_packing_in_rounds(spark):
    rng = random.Random(8)
    lengths = [rng.randint(1, 1024) for _ in range(3000)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE.format(kind="long"))
    old, packing.TASK_BINS = packing.TASK_BINS, 1000
    try:
        found = rows(packing.pack(df))
    finally:
        packing.TASK_BINS = old
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(r["doc_id"] for r in found) == Counter(range(3000))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.03 * sum(lengths) / 1024 + 2


def test_awkward_rows(spark):
    df = awkward(spark).cache()
    n = df.count()
    judged = rows(quality.quality_rules(df))
    assert Counter(r["n_words"] for r in judged) == Counter(slow_measures(r["text"])[0] for r in df.collect())
    assert len(quality.apply_quality(df).collect()) <= n and quality.apply_quality(df).columns == df.columns
    lines = linededup.drop_common_lines(df)
    left = [(r["doc_id"], r["text"]) for r in lines.collect()]
    assert len(left) == n and lines.columns == df.columns
    assert (6, "") in left and len([x for x in left if x == (5, df.where("doc_id = 5").first()["text"])]) == 2
    near = rows(simhash.near_duplicates(df))
    assert len(near) == n and {r["component_id"] for r in near if r["doc_id"] in (5, 6)} == {5}
    assert {r["component_id"] for r in near if r["doc_id"] in (1, 2, 9)} == {1}
    kept = nearcopies.drop_near_copies(df)
    assert Counter(r["doc_id"] for r in kept.collect())[5] == 1 and kept.columns == df.columns
    mixed = rows(mixing.mix(df))
    assert len(mixed) == n and all(r["taken"] <= 3 * r["size"] for r in mixed)
    assert mixing.take_mix(df).columns == df.columns
    packed = rows(packing.best_fit_packing(df, keep_ids=True))
    assert sum(r["piece"] == 0 for r in packed) == n and all(len(r["ids"]) == r["length"] for r in packed)


def test_rows_without_id_or_with_two_texts(spark):
    rng = random.Random(15)
    copied, alone, second, twin = (words(rng, 60) for _ in range(4))
    made = [(3, copied, "h"), (None, copied, "h"), (None, alone, "h"), (5, copied, "h"), (5, second, "h"), (None, twin, "h"), (None, twin, "h")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    kept = [(r["doc_id"], r["text"]) for r in nearcopies.drop_near_copies(df).collect()]
    assert Counter(kept) == Counter([(3, copied), (None, alone), (5, second), (None, twin)])
    made = [(None, alone, "h"), (None, "too short", "h"), (5, second, "h"), (5, "short too", "h")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    assert Counter(r["text"] for r in quality.apply_quality(df).collect()) == Counter([alone, second])


def test_empty_tables(spark):
    df = empty(spark)
    for made in (
        quality.quality_rules(df),
        quality.apply_quality(df),
        linededup.drop_common_lines(df),
        simhash.near_duplicates(df),
        nearcopies.drop_near_copies(df),
        mixing.mix(df),
        mixing.take_mix(df),
        packing.best_fit_packing(df),
    ):
        assert made.collect() == []


def test_pipeline(spark, docs):
    """Each stage on what the one before kept, by the operators that the tests above hold against brute force."""
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        if name == "quality_rules":
            verdict = {r["doc_id"]: r["kept"] for r in rows(QUERIES["op8_quality_rules"](spark, SF))}
            assert {r["doc_id"] for r in rows(out)} == {k for k, v in verdict.items() if v}
        elif name == "line_dedup":
            want = plain_blocks(texts(df))
            assert texts(out) == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(want[k])) for k, t in texts(df).items()}
        elif name == "simhash_near_dedup":
            prints = {k: (slow_fingerprint(t), slow_shingle_print(t)) for k, t in texts(df).items()}
            want = slow_components(prints, [(a, b) for a in prints for b in prints if a < b and slow_copies(prints[a], prints[b])])
            assert {r["doc_id"] for r in rows(out)} == {k for k, v in want.items() if k == v}
        elif name == "mix_sources":
            assert Counter(r["doc_id"] for r in rows(out)) == Counter({r["doc_id"]: r["times"] for r in rows(mixing.mix(df)) if r["times"]})
        if name != "pack":
            assert out.columns == docs.columns
        df = out.cache()
    assert Counter(r["doc_id"] for r in rows(df) if r["piece"] == 0)

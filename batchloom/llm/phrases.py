"""Phrase mining after Toivonen: a sample proposes phrases, full passes count them and their negative border exactly.

A phrase is on the border if it was not proposed but the phrases one word shorter inside it were. A frequent phrase on the border is a
failure of the sample; it joins the proposed ones, and another pass counts what that adds to the border, until none is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.common import shuffle_partitions, store, text_bytes
from batchloom.llm.repeats import mix

LEAST = 30
LONGEST = 4
SAMPLED = 8  # one document of so many proposes phrases
PROPOSED = 2  # occurrences in the sample that propose a phrase; 30 in all are 3.75 in the sample on average
CHUNK = 1 << 23  # bytes of texts that are counted before they go on
FILTER_BITS = (16, 28)  # least and most powers of two for the size of the broadcast filter: 32 MB at most
BLOCK_BITS = 19  # a block of the filter has 64 KB
SALTS = 8  # tasks that the phrases with one common part are dealt over
TOP_SALTS = 32  # tasks that the candidates of one language are dealt over

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
WORD_OR_END = re.compile(rb"[^ \n]+|\n")
SPACE = re.compile(rb"[ \n]")
ROWS = 1 << 16  # rows in a batch that a task gives


def segments(data: bytes, longest: int, most: int = CHUNK) -> Iterator[bytes]:
    """Parts of about ``most`` bytes of a text in which pieces end with a line feed.

    Parts end at a piece's end where they can. A longer piece is cut between words; after a carriage return its part repeats
    the next words, where phrases may end but not start.
    """
    start = 0
    while len(data) - start > most:
        cut = data.rfind(b"\n", start, start + most)
        if cut >= start:
            yield data[start:cut]
            start = cut + 1
            continue
        cut = data.rfind(b" ", start, start + most)
        if cut <= start:
            found = SPACE.search(data, start + most)
            cut = found.start() if found else len(data)
        tail = []
        for found in WORD_OR_END.finditer(data, cut):
            if found[0] == b"\n" or len(tail) == longest - 1:
                break
            tail.append(found[0])
        yield data[start:cut] + b" \r " + b" ".join(tail)
        start = cut
    yield data[start:]


class Words:
    """The words of some texts of one language: codes of equal words, the piece of each, and whether phrases may start there."""

    def __init__(self, lang: str, parts: list[bytes]):
        data = b"\n".join(parts).replace(b"\n", b" \n ")
        coded = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").values.dictionary_encode()
        self.lang, self.words = lang, coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64)
        nothing, end, again = (pc.index(self.words, pa.scalar(x, self.words.type)).as_py() for x in (b"", b"\n", b"\r"))
        codes = codes[codes != nothing]
        ends, cuts, at = codes == end, codes == again, np.arange(len(codes))
        repeated = np.maximum.accumulate(np.where(cuts, at, -1)) > np.maximum.accumulate(np.where(ends, at, -1))
        real = ~(ends | cuts)
        self.codes, self.piece, self.starts = codes[real], np.cumsum(ends)[real], ~repeated[real]

    def hashes(self, longest: int) -> list[np.ndarray]:
        """For k = 1, 2, ...: 64-bit hashes of the k words from every word on, whatever piece they are in."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        own = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words.to_pylist()], np.uint64)
        found = [own[self.codes]]
        for k in range(2, longest + 1):
            before = found[-1][: max(0, len(self.codes) - k + 1)]
            found.append(longer(before, found[0][k - 1 :]))
        return found

    def inside(self, k: int) -> np.ndarray:
        """Do the k words from here on lie in one piece?"""
        n = max(0, len(self.codes) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :]

    def counted(self, at: np.ndarray, k: int) -> pa.Table:
        """How often each phrase of k words starts at the places ``at``; equal phrases are told by their words, not by hashes."""
        pairs = self.codes[:-1] * len(self.words) + self.codes[1:] if k > 1 else self.codes
        columns = [pairs[at + j] for j in range(0, k - 1, 2)] + ([self.codes[at + k - 1]] if k % 2 else [])
        order = np.lexsort(columns)
        fresh = np.zeros(len(at), bool)
        fresh[:1] = True
        for column in columns:
            fresh[1:] |= column[order[1:]] != column[order[:-1]]
        first = np.flatnonzero(fresh)
        where = at[order[first]]
        words = [self.words.take(pa.array(self.codes[where + j])) for j in range(k)]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", self.words.type))
        return self.rows(phrase, np.diff(np.append(first, len(at))))

    def rows(self, phrase: pa.Array, n: np.ndarray) -> pa.Table:
        """``(key, n)``: one column for language and phrase, as one string is grouped by faster than two; words hold no line feed."""
        key = pc.binary_join_element_wise(pa.scalar(self.lang.encode(), self.words.type), phrase, pa.scalar(b"\n", self.words.type))
        return pa.table({"key": key.cast(pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})


def longer(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all its words but the last, and the last one's."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def chunks(batches: Iterable[pa.RecordBatch], longest: int) -> Iterator[Words]:
    """The words of the rows ``(lang, text)``, some megabytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), text_bytes(batch)):
            for part in segments(data.translate(LOWER), longest):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= CHUNK:
                    yield from (Words(k, v) for k, v in held.items())
                    held, size = {}, 0
    yield from (Words(k, v) for k, v in held.items())


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits of a filter for each hash, from its low and its high end."""
    mask = np.uint64((1 << bits) - 1)
    return [(hashes & mask).astype(np.int64), (hashes >> np.uint64(64 - FILTER_BITS[1]) & mask).astype(np.int64)]


class Filter:
    """A Bloom filter of phrase hashes: what was proposed is always found, and its size has a bound.

    A phrase that it finds by mistake is counted for nothing; counts stay exact, as the filter treats all places of a phrase alike.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(max(1, 1 << (bits - 6)), np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in positions(hashes, self.bits):
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found

    def admits(self, hashes: np.ndarray) -> np.ndarray:
        """Are the phrases from here on proposed or on the border, by the ``hashes`` of those that are one word shorter?"""
        both = self.has(hashes)
        return both[:-1] & both[1:]


def filled(hashes: DataFrame, bits: int) -> Filter:
    """A filter of the column ``hash``. Its blocks are made by tasks; the driver puts them side by side."""
    made = Filter(bits)
    span = min(bits, BLOCK_BITS)

    def spots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(positions(batch.column("hash").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> span), pa.array(at & ((1 << span) - 1))], names=["block", "spot"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            block, spot = batch.column("block").to_numpy(), batch.column("spot").to_numpy()
            for b in np.unique(block).tolist():
                words = own.setdefault(b, np.zeros(max(1, 1 << (span - 6)), np.uint64))
                at = spot[block == b]
                np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([w.tobytes() for w in own.values()], pa.binary())], names=["block", "bits"])

    placed = hashes.select("hash").mapInArrow(spots, "block long, spot long").repartition(shuffle_partitions(hashes.sparkSession), "block")
    for block, bits_of in placed.mapInArrow(blocks, "block long, bits binary").toLocalIterator():
        part = np.frombuffer(bits_of, np.uint64)
        made.words[block * len(part) : (block + 1) * len(part)] |= part
    return made


def proposals(texts: DataFrame, least: int, longest: int) -> DataFrame:
    """``hash`` of the phrases shorter than ``longest`` with ``least`` occurrences in ``texts``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in chunks(batches, longest):
            for k, hashes in enumerate(words.hashes(longest - 1), 1):
                found, n = np.unique(hashes[words.inside(k) & words.starts[: len(hashes)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    return texts.mapInArrow(rows, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")


def counts(texts: DataFrame, proposed: Filter, before: Filter | None, least: int, longest: int) -> DataFrame:
    """``(lang, phrase, k, n)`` of the phrases that ``proposed`` admits and ``before`` did not, and that occur ``least`` times.

    The first pass, without ``before``, counts all single words too, and all words of a language as the empty phrase of k = 0.
    """
    context = texts.sparkSession.sparkContext
    new, old = context.broadcast(proposed), context.broadcast(before)

    def found(words: Words) -> Iterator[pa.Table]:
        if old.value is None:
            at = np.flatnonzero(words.starts)
            yield words.rows(pa.array([b""], words.words.type), np.array([len(at)]))
            yield words.counted(at, 1)
        for k, hashes in enumerate(words.hashes(longest - 1), 2):
            here = words.inside(k) & words.starts[: max(0, len(words.codes) - k + 1)] & new.value.admits(hashes)
            if old.value is not None:
                here &= ~old.value.admits(hashes)
            yield words.counted(np.flatnonzero(here), k)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in chunks(batches, longest):
            for counted in found(words):
                yield from counted.to_batches(max_chunksize=ROWS)

    # most phrases stand once in a task's chunks, which are counts already: a second count before the shuffle would only cost memory
    partial = texts.mapInArrow(rows, "key string, n long").repartition("key")
    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    k = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1)
    often = partial.groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.endswith("key", F.lit("\n")))
    return often.select(lang.alias("lang"), phrase.alias("phrase"), k.alias("k"), "n")


def phrase_hashes(frequent: DataFrame, known: Filter) -> DataFrame:
    """``hash`` of the phrases ``(lang, phrase)`` that ``known`` does not have."""
    has = frequent.sparkSession.sparkContext.broadcast(known)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                own = [np.array([xxhash.xxh3_64_intdigest(w, seed)], np.uint64) for w in phrase.encode().split(b" ")]
                value = own[0]
                for word in own[1:]:
                    value = longer(value, word)
                found.append(value[0])
            hashes = np.array(found, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[~has.value.has(hashes)].view(np.int64))], names=["hash"])

    return frequent.select("lang", "phrase").mapInArrow(rows, "hash long")


def frequent_phrases(
    docs: DataFrame,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    longest: int = LONGEST,
    sampled: int = SAMPLED,
    proposed: int = PROPOSED,
) -> DataFrame:
    """``(lang, phrase, k, n)`` for every phrase of up to ``longest`` words with ``least`` occurrences ``n``, and the words of each language as k = 0.

    The sample (``sampled``, ``proposed``) changes the number of passes alone. Longer phrases are counted only where both phrases inside them that
    are one word shorter were proposed, so a pass moves little more than what is frequent.

    Null texts count as empty, a null language as ``und``; very long texts are counted in parts of some megabytes that lose no phrase; rows
    with equal or null ids all count; other columns are not looked at; an empty table gives no rows.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.col(text_col).alias("text"))
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(sampled)) == 0).select(lang, F.col(text_col).alias("text"))
    hashes = store(proposals(drawn, proposed, longest), "proposed")
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * hashes.count()).bit_length()))
    border, before, parts = filled(hashes, bits), None, []
    while True:
        found = store(counts(texts, border, before, least, longest), "phrases")
        parts.append(found)
        failures = store(phrase_hashes(found.where((F.col("k") > 0) & (F.col("k") < longest)), border), "failures")
        if failures.isEmpty():
            break
        before, border = border, filled(failures, bits)
        border.words |= before.words
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def words_from(column: Column, start, length) -> Column:
    return F.array_join(F.slice(column, start, length), " ")


def with_part(cuts: DataFrame, frequent: DataFrame, part: str, name: str) -> DataFrame:
    """Add the count of the phrase in column ``part``. Phrases that share a very common part are dealt over some tasks.

    The counts are never broadcast: Spark sizes them by their compressed files and does not see that the salts repeat them.
    """
    salted = frequent.select(
        F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("p_salt")
    )
    match = (F.col("lang") == F.col("p_lang")) & (F.col(part) == F.col("p_phrase")) & (F.pmod(F.xxhash64("phrase"), F.lit(SALTS)) == F.col("p_salt"))
    return cuts.join(salted.hint("merge"), match).drop("p_lang", "p_phrase", "p_salt")


def mine_phrases(docs: DataFrame, top: int = 2000, covered: int = 80, scale: int = 2_000_000, **settings) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two words or more of each language.

    ``a`` is the count of the phrase; it is cut in two where ``scale * a div (l + r)``, with the counts of its parts, is lowest, at the first of equal places.
    A phrase goes if a longer frequent one that contains it has ``covered`` per cent of its count or more. Rows are told apart by score, count and
    phrase in that order, in the order of code points. Further ``settings``, and the rows that are odd, are those of :func:`frequent_phrases`.
    """
    every = frequent_phrases(docs, **settings)
    frequent = every.where("k > 0")
    wide = "decimal(20,0)"  # products of counts may pass 64 bits
    candidates = frequent.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "k", "words", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut",
        words_from(F.col("words"), F.lit(1), F.col("cut")).alias("left"),
        words_from(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"),
    )
    parts = with_part(with_part(cuts, frequent, "left", "l"), frequent, "right", "r")
    score = F.expr(f"(cast({scale} as {wide}) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    scored = parts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"), F.first("a").alias("a"))
    longer_ones = candidates.where("k > 2").select("lang", "words", "k", "a", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inside = longer_ones.select("lang", "words", "a", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("start"))
    holders = inside.groupBy(F.col("lang").alias("h_lang"), words_from(F.col("words"), F.col("start"), F.col("size")).alias("h_phrase")).agg(F.max("a").alias("most"))
    both = scored.join(holders.hint("merge"), (F.col("lang") == F.col("h_lang")) & (F.col("phrase") == F.col("h_phrase")), "left")
    kept = both.where(F.expr(f"most is null or 100 * cast(most as {wide}) < {covered} * cast(a as {wide})")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = every.where("k = 0").select(F.col("lang").alias("t_lang"), F.col("n"))
    return ranked.join(totals.hint("merge"), F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))

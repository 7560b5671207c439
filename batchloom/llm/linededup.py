"""Line deduplication: documents that share runs of lines are aligned by patience diff; later copies of common blocks go."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import slices, store, text_bytes

BLOCK_WORDS = 20
PRIME = (1 << 127) - 1
BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15 % PRIME


def line_keys(data: bytes) -> list[bytes]:
    """128-bit hashes of the lines without white space at their ends."""
    return [xxhash.xxh3_128_digest(x.strip()) for x in data.split(b"\n")]


def sequence_key(keys: Sequence[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(keys))


def spans(words: Sequence[int], least_words: int) -> list[tuple[int, int]]:
    """Shortest runs of lines ``[start, end)`` with ``least_words`` words: from every line on, and up to every line.

    Every line of a block of that many words is in a run inside the block: in the first line's run, or in the run
    that ends with the line.
    """
    found = set()
    total = end = 0
    for start in range(len(words)):
        while end < len(words) and (total < least_words or end == start):
            total, end = total + words[end], end + 1
        if total < least_words:
            break
        found.add((start, end))
        total -= words[start]
    total, start = 0, len(words)
    for end in range(len(words), 0, -1):
        while start > 0 and (total < least_words or start == end):
            start -= 1
            total += words[start]
        if total < least_words:
            break
        found.add((start, end))
        total -= words[end - 1]
    return sorted(found)


def run_keys(keys: Sequence[bytes], runs: Sequence[tuple[int, int]]) -> list[bytes]:
    """127-bit hashes of runs of lines, from running sums, so that long runs of empty lines cost no more."""
    if not runs:
        return []
    sums, powers = [0], [1]
    for key in keys:
        sums.append((sums[-1] * BASE + int.from_bytes(key, "little")) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    return [((sums[end] - sums[start] * powers[end - start]) % PRIME).to_bytes(16, "little") for start, end in runs]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first part, whose second parts rise too (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    chain = []
    k = at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned positions of equal items: equal ends, then lines unique on both sides in rising order, then the gaps between."""
    found = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = increasing([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if k < a1:
                found.append((k, m))
            work.append((i + 1, k, j + 1, m))
    return sorted(found)


def shared_runs(earlier: Sequence[bytes], later: Sequence[bytes], words: Sequence[int], least_words: int) -> set[int]:
    """Lines of ``later`` in runs of ``least_words`` words that stand anywhere in ``earlier``, in any order and number."""
    known = dict(zip(later, words))
    held: set[bytes] = set()
    start = 0
    for end in range(len(earlier) + 1):  # stretches of lines that ``later`` has too
        if end == len(earlier) or earlier[end] not in known:
            stretch = earlier[start:end]
            held.update(run_keys(stretch, spans([known[x] for x in stretch], least_words)))
            start = end + 1
    runs = spans(words, least_words) if held else []
    return {x for (i, j), key in zip(runs, run_keys(later, runs)) if key in held for x in range(i, j)}


def common_blocks(earlier: Sequence, later: Sequence, words: Sequence[int], least_words: int) -> list[int]:
    """Lines of ``later`` in blocks, consecutive on both sides, that hold at least ``least_words`` words.

    The alignment leaves out gaps without unique lines, passages that stand twice and passages in another order; these
    are found by their runs.
    """
    gone: set[int] = set()
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-1, -1)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[x] for x in block) >= least_words:
                gone.update(block)
            block = []
        block.append(j)
        last = (i, j)
    if len(gone) < len(later):
        gone |= shared_runs(earlier, later, words, least_words)
    return sorted(gone)


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = text_bytes(batch)
            keys = [line_keys(x) for x in data]
            words = [[len(line.split()) for line in x.split(b"\n")] for x in data]
            columns = [
                batch.column("doc_id"),
                pa.array([sequence_key(x) for x in keys], pa.binary()),
                pa.array(keys, pa.list_(pa.binary())),
                pa.array(words, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "seq", "keys", "words"])

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(rows, f"doc_id {kind}, seq binary, keys array<binary>, words array<int>")


def with_runs(each: DataFrame, least_words: int) -> DataFrame:
    """``(id, seq, runs)``: the different hashes of each document's shortest runs of ``least_words`` words."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column("keys").to_pylist(), batch.column("words").to_pylist())
            runs = [list(dict.fromkeys(run_keys(keys, spans(words, least_words)))) for keys, words in pairs]
            columns = [batch.column("id"), batch.column("seq"), pa.array(runs, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "seq", "runs"])

    kind = dict(each.dtypes)["id"]
    return each.select("id", "seq", "keys", "words").mapInArrow(rows, f"id {kind}, seq binary, runs array<binary>")


def common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, seq, n_lines, removed)`` for every row; ``removed`` has the numbers of the lines that go.

    Documents with the same lines are one; all but the one with the smallest id lose every line if they have
    ``least_words`` words. Each other document is aligned with the first document of every shortest run of lines with
    ``least_words`` words that it shares, however many documents hold the run; so each run leads to one partner, and no
    group of documents is paired with itself. Common blocks of ``least_words`` words or more
    go from the later document. All is judged on the input.

    Null texts are one empty line. Rows without an id come after all others. Rows that repeat an id are told apart by their
    lines; rows that repeat id and lines are one document and get the same result. Empty tables give no rows.
    """
    lines = store(sequences(docs, id_col, text_col), "sequences")
    several = lines.groupBy("seq").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("words").alias("words"))
    each = store(several, "different")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "seq").alias("o")
    shown = with_runs(each, least_words).select(order, F.explode("runs").alias("key"))
    shared = (
        shown.groupBy(F.col("key").alias("of_key")).agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first")).where("n > 1")
    )
    partners = (
        shown.join(shared, F.col("key") == F.col("of_key"))
        .where("o > first")
        .select("o.seq", F.col("first.seq").alias("with"))
        .distinct()
    )
    later = each.select("seq", F.col("keys").alias("b"), "words")
    earlier = each.select(F.col("seq").alias("with"), F.col("keys").alias("a"))
    met = partners.join(later, "seq").join(earlier, "with").select("seq", "a", "b", "words")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "words")]
            gone = [common_blocks(a, b, w, least_words) for a, b, w in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(gone, pa.list_(pa.int32()))], names=["seq", "gone"])

    aligned = (
        met.mapInArrow(align, "seq binary, gone array<int>")
        .select("seq", F.explode("gone").alias("line"))
        .groupBy(F.col("seq").alias("of_seq"))
        .agg(F.sort_array(F.collect_set("line")).alias("gone"))
    )
    firsts = each.select(F.col("seq").alias("first_seq"), "id")
    known = lines.join(firsts, F.col("seq") == F.col("first_seq")).join(aligned, F.col("seq") == F.col("of_seq"), "left")
    total = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x)
    copy = F.col("id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("id"))
    nothing = F.array().cast("array<int>")
    removed = (
        F.when(copy & (total >= least_words), F.sequence(F.lit(0), F.size("words") - 1))
        .when(copy, nothing)
        .otherwise(F.coalesce("gone", nothing))
    )
    return known.select("doc_id", "seq", F.size("words").cast("long").alias("n_lines"), removed.alias("removed"))


def without_lines(texts: pd.Series, found: pd.Series) -> pd.Series:
    out = []
    for text, choices in zip(texts, found):
        if text is not None and choices is not None and len(choices):
            seq = sequence_key(line_keys(text.encode()))
            gone = next((set(c["removed"]) for c in choices if bytes(c["seq"]) == seq), set())
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text
        out.append(text)
    return pd.Series(out, dtype=object)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the lines that :func:`common_lines` finds; every row stays, its text may become empty."""
    found = common_lines(docs, id_col, text_col, **settings).where(F.size("removed") > 0)
    by_id = found.groupBy("doc_id").agg(F.collect_set(F.struct("seq", "removed")).alias("found"))
    joined = docs.alias("d").join(by_id.alias("f"), docs[id_col].eqNullSafe(by_id["doc_id"]), "left")
    own, choices = F.col(f"d.`{text_col}`"), F.col("f.found")
    text = F.when(choices.isNull(), own).otherwise(F.pandas_udf(without_lines, "string")(own, choices))
    return joined.select(*[(text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])

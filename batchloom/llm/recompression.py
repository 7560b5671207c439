"""Substring deduplication by recompression of word sequences.

Rounds name runs of equal symbols and then pairs of neighbours; a name is a hash of what it stands for, so every task gives equal
content equal names. Each symbol carries the words on which its forming depends. A window of words takes as its anchor the
highest symbol that depends on words of the window alone, so equal windows have equal anchors wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.repeats import (
    BASES,
    Sums,
    apply_spans,
    block_table,
    classes_of,
    identified,
    mix,
    runs_of,
    shared_blocks,
    spans_by_document,
    text_id,
    with_text,
)
from batchloom.llm.common import store, text_bytes

WINDOW = 20
ROUNDS = 2
CHUNK = 1 << 18  # words that are looked at together
LAST = np.int64((1 << 63) - 1)


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def compress(name: np.ndarray, lo: np.ndarray, hi: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round. Symbols are names with the words ``[lo, hi)`` they depend on; the first and last one are separators.

    A run depends on the symbols beside it too, as these end it. A pair of a left and a right symbol (by a bit of their
    names) depends on itself alone; a symbol that finds no partner depends on the neighbour that refused.
    """
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    length = np.diff(np.append(first, len(name)))
    last = first + length - 1
    lo, hi = lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(name) - 1)]
    name = np.where(length > 1, mix(name[first] + length.astype(np.uint64) * np.uint64(BASES[0])), name[first])

    left = (mix(name ^ np.uint64(BASES[1] >> turn)) & np.uint64(1)) == 0
    joins = np.flatnonzero(left[:-1] & ~left[1:])
    second = np.zeros(len(name), bool)
    second[joins + 1] = True
    is_first = np.zeros(len(name), bool)
    is_first[joins] = True
    before, after = np.maximum(np.arange(len(name)) - 1, 0), np.minimum(np.arange(len(name)) + 1, len(name) - 1)
    new_lo = np.where(left, lo, lo[before])
    new_hi = np.where(left, hi[after], hi)
    both = mix(name * np.uint64(BASES[0]) + name[after] + np.uint64(turn))
    new_name = np.where(is_first, both, name)
    keep = ~second
    return new_name[keep], new_lo[keep], new_hi[keep]


def anchors(names: np.ndarray, valid: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: number of its anchor, -1 for windows over a separator; and the words of each anchor.

    The highest level that has a symbol in the window decides, then the smallest scrambled name, then the leftmost symbol.
    """
    n = len(names)
    levels = [(names, np.arange(n), np.arange(1, n + 1))]
    for turn in range(rounds):
        levels.append(compress(*levels[-1], turn))
    chosen = np.full(len(valid), -1, np.int64)
    los, his, offset = [], [], 0
    open_windows = valid.copy()
    for name, lo, hi in reversed(levels):
        if not open_windows.any():
            break
        usable = np.flatnonzero(hi - lo <= window)
        lo_u, hi_u = lo[usable], hi[usable]
        start = np.maximum(hi_u - window, 0)
        stop = np.minimum(lo_u, len(valid) - 1)
        waiting = np.concatenate([[0], np.cumsum(open_windows)])
        wanted = (stop >= start) & (waiting[np.maximum(stop, start - 1) + 1] > waiting[start])
        usable, lo_u, hi_u, start, stop = usable[wanted], lo_u[wanted], hi_u[wanted], start[wanted], stop[wanted]
        key = ((mix(name[usable]) >> np.uint64(29)) << np.uint64(28)).astype(np.int64) | np.arange(len(usable))
        best = np.full(len(valid), LAST)
        for step in range(int((stop - start).max(initial=-1)) + 1):
            at = start + step
            inside = at <= stop
            np.minimum.at(best, at[inside], key[inside])
        found = open_windows & (best != LAST)
        chosen[found] = (best[found] & ((1 << 28) - 1)) + offset
        los.append(lo_u)
        his.append(hi_u)
        offset += len(usable)
        open_windows &= ~found
    return chosen, np.concatenate(los or [np.zeros(0, int)]), np.concatenate(his or [np.zeros(0, int)])


def sequence(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words, with separators of unequal names around the texts, and the first word of each text."""
    sizes = np.array([len(x) for x in split])
    starts = np.cumsum(sizes + 1) - sizes
    names = mix(np.arange(int(sizes.sum()) + len(split) + 1, dtype=np.uint64))
    if sizes.sum():
        inside = np.ones(len(names), bool)
        inside[starts - 1] = False
        inside[-1] = False
        names[inside] = word_names([w for x in split for w in x])
    return names, starts


def word_blocks(texts: list[list[bytes]], window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Blocks of windows of all texts, given as words."""
    names, starts = sequence(texts)
    count = max(0, len(names) - window + 1)
    separators = np.zeros(len(names) + 1, int)
    separators[np.append(starts - 1, len(names) - 1) + 1] = 1
    before = np.cumsum(separators)
    valid = before[window : window + count] == before[:count]
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    chosen, lo, hi = anchors(names, valid, window, rounds)
    first, last = runs_of(chosen)
    anchor = chosen[first]
    one, two = Sums(names, BASES[0]), Sums(names, BASES[1])
    k = one.of(lo[anchor], hi[anchor])
    g = mix(two.of(first, last + window) + (lo[anchor] - first).astype(np.uint64))
    doc = np.searchsorted(starts, first, "right") - 1
    return k, g, doc, first - starts[doc], last - first + 1


def window_digests(named_texts: DataFrame, window: int) -> DataFrame:
    """``(d1, d2, id, tid, pos)`` of the windows in the blocks ``(pos, n)`` of ``found``: 128-bit hashes of their words."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(text_bytes(batch)):
                tid = batch.column("tid")[k].as_py()
                if text_id(data) != tid:
                    continue
                names = word_names(data.split())
                flat = batch.column("found")[k].values
                at = np.unique(np.concatenate([np.arange(p, p + n) for p, n in zip(flat.field("pos").to_pylist(), flat.field("n").to_pylist())]))
                columns = [Sums(names, base).of(at, at + window).view(np.int64) for base in BASES]
                columns += [np.full(len(at), batch.column("id")[k].as_py()), np.full(len(at), tid), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d1", "d2", "id", "tid", "pos"])

    return named_texts.mapInArrow(rows, "d1 long, d2 long, id long, tid long, pos long")


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``(id, tid, spans)``: the words of each document in windows that also start earlier; documents without any are left out.

    Blocks that equal an earlier block are repeated as a whole. Where blocks share their anchor but differ, the windows of
    the first of each kind are compared one by one, by 128-bit hashes of their words.
    """
    named = identified(docs, id_col, text_col)
    blocks = block_table(named, lambda words: word_blocks(words, window, rounds), bytes.split, window, CHUNK, "word-blocks")
    shared = shared_blocks(blocks, "word")
    classes = classes_of(shared, "word")
    place = F.struct("id", "tid", "pos")
    first = classes.select(F.col("k").alias("of_k"), F.col("g").alias("of_g"), "first")
    later = shared.join(first, (F.col("k") == F.col("of_k")) & (F.col("g") == F.col("of_g"))).where(place != F.col("first"))
    whole = later.select("id", "tid", F.col("pos").alias("start"), (F.col("pos") + F.col("n") + window - 1).alias("end"))
    several = classes.groupBy(F.col("k").alias("of_k")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    unlike = classes.join(several, F.col("k") == F.col("of_k"), "left_semi").select("first.id", "first.tid", "first.pos", "n")
    single = store(window_digests(with_text(named, unlike, "pos n", "word"), window), "word-windows")
    earliest = single.groupBy(F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    again = single.join(earliest.where("times > 1"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).where(place != F.col("first"))
    windows = again.select("id", "tid", F.col("pos").alias("start"), (F.col("pos") + window).alias("end"))
    return spans_by_document(whole.unionByName(windows), "word-spans")


def kept_words(data: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple[int, list[bytes]]:
    words = data.split()
    if starts is None:
        return 0, words
    kept, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words) - len(kept), kept


def drop_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, **settings) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row; ``kept`` is the other words, or their SHA-256 if ``digest``.

    Null texts have no words; rows with a null id come after all others; rows that repeat id and text are one document
    and get the same result; rows that repeat an id alone are told apart by a hash of their text. An empty table gives no rows.
    """
    spans = repeated_words(docs, id_col, text_col, **settings)

    def edit(data: bytes, starts, ends) -> tuple[int, int, str]:
        removed, kept = kept_words(data, starts, ends)
        text = b" ".join(kept)
        return removed + len(kept), removed, hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace")

    return apply_spans(docs, spans, edit, "n_words long, n_removed long, kept string", id_col, text_col, "word-kept")

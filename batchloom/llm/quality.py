"""Quality rules: measures of each document, and the frequency of lines across the documents of a host."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import slices, store, text_bytes, text_ref

SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))  # white space, and bytes inside a code point
DIGITS = bytes.maketrans(b"0123456789", b"0" * 10)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the list; the first ones count too."""
    if len(words) <= width:
        return 0
    index: dict[bytes, int] = defaultdict(count().__next__)
    names = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    if len(index) > len(words) - width:  # two equal windows have at least ``width`` words that are repeats
        return 0
    grams, span = names, 1
    while span < width:  # names of pairs, of pairs of pairs, ...
        step = min(span, width - span)
        pairs = grams[: len(grams) - step] * (int(grams.max()) + 1) + grams[step:]
        grams, span = np.unique(pairs, return_inverse=True)[1], span + step
    hit = np.flatnonzero(np.bincount(grams)[grams] > 1)
    if not len(hit):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + width, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def normal_line(line: bytes) -> bytes:
    """Lower case, digits as 0, single spaces."""
    return b" ".join(line.lower().translate(DIGITS).split())


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of the normalised line. Equal hashes of unequal lines only add up their counts."""
    value = xxhash.xxh64_intdigest(normal_line(line))
    return value - (1 << 64) if value >= 1 << 63 else value


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(data.translate(None, NOT_COUNTED)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured_lines(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> DataFrame:
    """A row per document: its measures, a hash of its text, and hash and words of each line that has a word."""
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")
    )
    chosen = chosen.withColumn("ref", text_ref(F.col("text")))
    kind = dict(chosen.dtypes)["doc_id"]
    schema = f"doc_id {kind}, host string, ref binary, {MEASURES}, text_key long, line_keys array<long>, line_words array<int>"

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = text_bytes(batch)
            made = [measure(x) for x in data]
            lines = [[x for x in d.split(b"\n") if x.strip()] for d in data]
            columns = [batch.column("doc_id"), batch.column("host"), batch.column("ref")]
            columns += [pa.array([m[i] for m in made], pa.int64()) for i in range(5)]
            columns.append(pa.array([line_key(b"\n".join(x)) for x in lines], pa.int64()))
            columns.append(pa.array([[line_key(x) for x in own] for own in lines], pa.list_(pa.int64())))
            columns.append(pa.array([[len(x.split()) for x in own] for own in lines], pa.list_(pa.int32())))
            names = ["doc_id", "host", "ref", *(m.split()[0] for m in MEASURES.split(", ")), "text_key", "line_keys", "line_words"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return chosen.mapInArrow(rows, schema)


def frequent_lines(lines: DataFrame, least_documents: int, share: float, most_documents: int) -> DataFrame:
    """``(host, line)`` of the lines that stand in more than ``share`` of a host's different documents, or in over ``most_documents``.

    Documents with the same lines count once, so a text that is copied as a whole does not make its own
    lines frequent. Limits below ``least_documents`` are raised to it: fewer documents tell nothing of a share.
    """
    different = lines.groupBy("host", "text_key").agg(F.min("line_keys").alias("line_keys"))
    totals = different.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("documents"))
    counts = (
        different.select("host", F.explode(F.array_distinct("line_keys")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > least_documents)
    )
    many = (F.col("n") > share * F.col("documents")) | (F.col("n") > most_documents)
    return counts.join(totals, counts["host"].eqNullSafe(totals["of_host"])).where(many).select("host", "line")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    least_words: int = 20,
    most_repeated: int = 30,
    least_documents: int = 3,
    share: float = 0.1,
    most_documents: int = 10_000,
    least_left: float = 0.3,
) -> DataFrame:
    """Judge every row of ``docs``.

    ``doc_id``, the five measures, ``base_failed`` (fewer than ``least_words`` words, or over ``most_repeated``
    per cent of them in repeated windows), ``frequent`` (hashes of its lines that are too frequent in
    its host), ``words_left`` (words in its other lines) and ``kept``: not base_failed, and not depleted, that
    is with ``least_words`` words and a ``least_left`` share of its words left.

    Null texts count as empty, null hosts as one host, rows with a null or repeated id are judged row by
    row by their own text, an empty table gives no rows, other columns are not looked at.
    """
    lines = store(measured_lines(docs, id_col, host_col, text_col), "lines")
    often = frequent_lines(lines, least_documents, share, most_documents)
    found = (
        lines.select("doc_id", F.col("host").alias("in_host"), "ref", F.explode(F.array_distinct("line_keys")).alias("key"))
        .join(often, F.col("in_host").eqNullSafe(F.col("host")) & (F.col("key") == F.col("line")), "left_semi")
        .groupBy(F.col("doc_id").alias("found_id"), F.col("in_host").alias("found_host"), F.col("ref").alias("found_ref"))
        .agg(F.sort_array(F.collect_set("key")).alias("frequent"))
    )
    same = lines["doc_id"].eqNullSafe(found["found_id"]) & lines["host"].eqNullSafe(found["found_host"])
    both = lines.join(found, same & (lines["ref"] == found["found_ref"]), "left")
    left = F.aggregate(
        F.zip_with(
            "line_keys", "line_words", lambda key, words: F.when(F.array_contains("frequent", key), F.lit(0)).otherwise(words)
        ),
        F.lit(0).cast("long"),
        lambda total, words: total + words,
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = both.withColumn("words_left", F.when(F.col("frequent").isNull(), F.col("n_words")).otherwise(left))
    depleted = F.col("frequent").isNotNull() & ((F.col("words_left") < least_words) | (F.col("words_left") < least_left * F.col("n_words")))
    return judged.select(
        "doc_id",
        *[m.split()[0] for m in MEASURES.split(", ")],
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        "words_left",
        F.coalesce("frequent", F.array().cast("array<bigint>")).alias("frequent"),
        "host",
        "ref",
    )


def apply_quality(docs: DataFrame, **settings) -> DataFrame:
    """The kept rows of ``docs`` without their too frequent lines, with the columns of ``docs``."""
    id_col, host_col, text_col = (settings.get(k, d) for k, d in (("id_col", "doc_id"), ("host_col", "source"), ("text_col", "text")))
    judged = store(quality_rules(docs, **settings), "judged")
    # rows that share id, host and text have one verdict
    verdict = judged.groupBy("doc_id", "host", "ref").agg(F.first("kept").alias("kept"), F.first("frequent").alias("frequent"))
    touched = verdict.where(~F.col("kept") | (F.size("frequent") > 0))
    match = docs[id_col].eqNullSafe(touched["doc_id"]) & docs[host_col].cast("string").eqNullSafe(touched["host"])
    match &= text_ref(docs[text_col]) == touched["ref"]
    kept = docs.alias("d").join(touched.alias("v"), match, "left").where(F.coalesce("v.kept", F.lit(True)))
    without = drop_lines(F.col(f"d.`{text_col}`"), F.col("v.frequent"))
    return kept.select(*[(without if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


def drop_lines(text, keys):
    """The text without the lines whose hash is in ``keys``; a text without such lines stays as it is."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for value, drop in zip(texts, gone):
            if value is not None and drop is not None and len(drop):
                drop = set(drop)
                value = "\n".join(x for x in value.split("\n") if not x.strip() or line_key(x.encode()) not in drop)
            out.append(value)
        return pd.Series(out, dtype=object)

    return F.when(keys.isNull() | (F.size(keys) == 0), text).otherwise(cut(text, keys))

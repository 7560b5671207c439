"""Token counts from a digest cache: texts whose normal form was counted before, by the same tokenizer file, are not encoded again."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import store
from batchloom.session import scratch

MODEL = "piece_bpe_32k.model"
ENTRY = "digest binary, n_tokens long"
SALTS = 64  # tasks that the rows of one text are dealt over when they are joined to its count
CHUNK = 1 << 22  # bytes of texts that are encoded in one call


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def processor(name: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model_path(name))


def tokenizer_version(name: str) -> str:
    """SHA-256 of the tokenizer file: counts of another file are never mistaken for its own."""
    with open(model_path(name), "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def normal_form(text: Column) -> Column:
    """What the tokenizer cannot tell apart: null and empty, and a space and the mark U+2581 that it puts in a space's place.

    The model has no other normalisation, so texts of one normal form have one count.
    """
    return F.translate(F.coalesce(text, F.lit("")), "▁", " ")


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` that the cache holds for this tokenizer; a digest that two runs have appended stands once."""
    try:
        held = spark.read.schema(ENTRY).parquet(os.path.join(cache, f"tokenizer={version}"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], ENTRY)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def first_in_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest in the task, so that copies are dropped before the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for digest in batch.column("digest").to_pylist():
            fresh.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def encoded(texts: DataFrame, model: str) -> DataFrame:
    """``(digest, n_tokens)`` of the rows ``(digest, text)``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = processor(model)
        for batch in batches:
            counts, held, size = [], [], 0
            for text in batch.column("text").to_pylist():
                held.append(text)
                size += len(text)
                if size >= CHUNK:
                    counts += map(len, encoder.encode(held, num_threads=1))
                    held, size = [], 0
            counts += map(len, encoder.encode(held, num_threads=1))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(rows, ENTRY)


def fill_cache(texts: DataFrame, wanted: DataFrame, cache: str, version: str, model: str) -> None:
    """Append the counts of the ``wanted`` digests; each is encoded once, however many rows of ``texts`` have it.

    The append is committed as a whole: a run that fails leaves nothing, one that runs twice leaves equal entries.
    """
    distinct = texts.mapInArrow(first_in_task, "digest binary, text string").join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    encoded(distinct, model).write.mode("append").parquet(os.path.join(cache, f"tokenizer={version}"))


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    cache: str | None = None,
    limit: int = 4096,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row: tokens of the whole text without begin or end tokens.

    ``cache`` is a folder of ``(digest, n_tokens)`` tables, one for each tokenizer file, that runs share; without one a new folder
    is used. SHA-256 digests of the normal forms are joined to it, the texts of digests that it lacks are encoded
    once each and appended, and all rows are then joined to the cache.

    Null texts count as empty and have no tokens. Very long texts are encoded whole, one at a time. Rows with null or repeated ids keep
    their own output rows, rows with equal texts share one count, other columns are not looked at, an empty table gives no rows.
    """
    spark, version = docs.sparkSession, tokenizer_version(model)
    cache = cache or scratch(spark, "token-cache")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = named.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), normal_form(F.col("text")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")  # fixed by the written table; it changes the spreading alone
    keys = store(texts.select("doc_id", "n_bytes", "digest", salt.alias("salt")), "digests")
    known = cached_counts(spark, cache, version)
    wanted = store(keys.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
    fill_cache(texts.select("digest", "text"), wanted, cache, version, model)
    counts = keys.select("digest", "salt").distinct().join(cached_counts(spark, cache, version), "digest")
    return keys.join(counts, ["digest", "salt"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

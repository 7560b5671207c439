"""Sums of looked-up vectors per row: rows and the vectors they ask for meet in blocks, where numpy adds them up in Arrow tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_IDS = 1 << 20  # ids of the rows of a block
BLOCK_BYTES = 1 << 25  # of the sums of a block
PIECE = 1 << 15  # vectors that are gathered at once


def known_vectors(found: pa.Table, dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different ids of ``(id, vec)``, the sum of the vectors of each and their number; null vectors add nothing."""
    found = found.filter(pc.is_valid(found["vec"])).combine_chunks()
    vectors = pa.chunked_array(found["vec"]).combine_chunks()
    if any(n != dim for n in pc.unique(pc.list_value_length(vectors)).to_pylist()):
        raise ValueError(f"vectors must have {dim} elements")
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    ids = pa.chunked_array(found["id"]).combine_chunks().dictionary_encode()
    place, counts = ids.indices.to_numpy(), np.bincount(ids.indices.to_numpy(), minlength=len(ids.dictionary))
    if len(counts) < len(matrix):
        order = np.argsort(place, kind="stable")
        matrix = np.add.reduceat(matrix[order], np.cumsum(counts) - counts)
    return ids.dictionary, matrix, counts


def block_sums(rows: pa.Table, found: pa.Table, row: str, slots: Sequence[str], dim: int, mean: bool) -> np.ndarray:
    """For each row the sums, or the means, of the vectors of its ids, slot by slot. Rows of equal ``row`` are summed together."""
    known, vectors, counts = known_vectors(found, dim)
    keys = pa.chunked_array(rows[row]).combine_chunks().dictionary_encode(null_encoding="encode")
    code, n = keys.indices.to_numpy(), len(keys.dictionary)
    out = np.zeros((n, len(slots), dim))
    for s, slot in enumerate(slots):
        lists = pa.chunked_array(rows[slot]).combine_chunks()
        place = pc.fill_null(pc.index_in(lists.flatten().cast(known.type), known), -1).to_numpy()
        key = np.repeat(code, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[place >= 0]
        place = place[place >= 0]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
        for a in range(0, len(key), PIECE):
            part = key[a : a + PIECE]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            out[part[starts], s] += np.add.reduceat(vectors[place[a : a + PIECE]], starts)
        if mean:
            out[:, s] /= np.maximum(np.bincount(key, counts[place], minlength=n), 1)[:, None]
    return out.reshape(n, -1)[code]


def pooled_lists(
    rows: DataFrame, row: str, slots: Sequence[str], table: DataFrame, dim: int, name: str, mean: bool = True, hot_rows: int = 100_000, **spreading
) -> DataFrame:
    """Add ``name``: the mean, or the sum, of the vectors of the ids in each slot, one slot after the other.

    ``table`` has the columns ``id`` and ``vec``. Unknown ids count as none. Rows are dealt to blocks by their
    key; a block asks once for each id that it has, so vectors move once for each block, not once for each
    row, and frequent ids are no hot keys unless there are more than ``hot_rows`` blocks. No vector is shuffled after the sums.
    """
    from batchloom.operators.lookups import skewed_lookup

    ids = F.concat(*[F.coalesce(s, F.array().cast(rows.schema[s].dataType)) for s in slots])
    total, n = rows.agg(F.sum(F.size(ids)), F.count(F.lit(1))).first()
    blocks = 1 + max((total or 0) // BLOCK_IDS, n * len(slots) * dim * 8 // BLOCK_BYTES)
    blocks = max(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("_block", F.pmod(F.xxhash64(row), F.lit(blocks)))
    asked = placed.select(F.col("_block").alias("_asks"), F.explode(ids).alias("id")).where(F.col("id").isNotNull()).distinct()
    found = skewed_lookup(asked, table, "id", "inner", hot_rows=hot_rows, **spreading) if blocks > hot_rows else asked.join(table, "id")

    def add(own: pa.Table, given: pa.Table) -> pa.Table:
        own = own.drop_columns(["_block"])
        sums = block_sums(own, given, row, slots, dim, mean) if own.num_rows else np.zeros((0, len(slots) * dim))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * (len(slots) * dim)), pa.array(sums.ravel()))
        return own.append_column(name, lists)

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return placed.groupBy("_block").cogroup(found.select("_asks", "id", "vec").groupBy("_asks")).applyInArrow(add, schema)

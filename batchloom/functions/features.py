"""Fixed-length inputs of a text model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model_features(df: DataFrame, ids: str, max_len: int) -> DataFrame:
    """``input_ids``, ``position_ids``, ``segment_ids`` and ``input_mask`` of length ``max_len``, for each window of ids.

    A list gives as many windows ``window_no`` as it needs, one if it is empty; the last is padded with 0.
    """
    count = F.greatest(F.lit(1), F.ceil(F.coalesce(F.size(ids), F.lit(0)) / max_len).cast("int"))
    df = df.withColumn("window_no", F.explode(F.sequence(F.lit(0), count - 1)))
    df = df.withColumn(ids, F.slice(ids, F.col("window_no") * max_len + 1, F.lit(max_len)))
    places = F.sequence(F.lit(0), F.lit(max_len - 1))
    used = F.coalesce(F.size(ids), F.lit(0))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return df.withColumns({
        "input_ids": F.transform(places, lambda i: F.coalesce(F.get(ids, i), zero)),
        "position_ids": F.transform(places, lambda i: F.when(i < used, i.cast("bigint")).otherwise(zero)),
        "segment_ids": F.array_repeat(zero, max_len),
        "input_mask": F.transform(places, lambda i: F.when(i < used, one).otherwise(zero)),
    })

"""Whitening of embeddings by their leading principal components, found by Chebyshev-filtered subspace iteration.

The covariance is never formed: each step multiplies a block of a few columns by it in one distributed pass over the centred rows.
A polynomial of these passes damps what lies in the unwanted part of the spectrum; QR and Rayleigh-Ritz on the small block follow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import store

WANTED = 4
GUARD = 12  # further columns of the block, which let it converge where eigenvalues lie close together
MOST_DEGREE = 30
SPREAD = 1e10  # how much more than the rest a filter may amplify the first component in one round
TOLERANCE = 2e-14  # residual, as a share of the largest eigenvalue, at which a component counts as found
ROUNDED = 1e-11  # a residual below this that falls no further is at the limit of double precision
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, x)``: ``floor(256 * entry)`` of the rows without null and non-finite entries; short vectors get zeros at the end."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("v", lambda c: F.floor(c * 256) + F.lit(0).cast("long"))
    rows = store(own.where(F.col("v").isNotNull() & finite).select("vec_id", x.alias("x")), "vectors")
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return rows
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))
    return rows.withColumn("x", F.concat("x", zeros))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


class Centre:
    """The number of vectors and their exact sums, as ``sum = whole * n + rest``: centred entries lose nothing to large means."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - sum) ** 2``; null where they pass 64 bits."""
        rough = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        out: list[int | None] = [None] * len(x)
        near = np.flatnonzero(rough < 2.0**61)
        small = (x[near] - self.whole) * self.n - np.array([s % self.n for s in self.sums], np.int64)
        for i, value in zip(near.tolist(), (small * small).sum(axis=1).tolist()):
            out[i] = value
        for i in np.flatnonzero((rough >= 2.0**61) & (rough < 2.0**64)).tolist():
            value = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums))
            out[i] = value if value < 1 << 63 else None
        return out


def summed(fit: DataFrame, partial, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``partial(x)``, an array of ``shape``, over all batches of rows. Only the sum comes to the driver."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

    parts = fit.select("x").mapInArrow(rows, "part array<double>").select(F.posexplode("part").alias("at", "v"))
    out = np.zeros(int(np.prod(shape)))
    for at, value in parts.groupBy("at").agg(F.sum("v")).collect():
        out[at] = value
    return out.reshape(shape)


def covariance_times(fit: DataFrame, centre: Centre, block: np.ndarray) -> np.ndarray:
    """The covariance of the rows times the columns of ``block``, in one pass."""

    def partial(x: np.ndarray) -> np.ndarray:
        rows = centre.centred(x)
        return rows.T @ (rows @ block)

    return summed(fit, partial, block.shape) / centre.n


def filtered(times, block: np.ndarray, product: np.ndarray, upper: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times ``block``: at most 1 on ``[0, upper]``, large above, scaled to 1 near ``top``.

    ``product`` is the covariance times ``block``, so a degree of m takes m - 1 passes.
    """
    half = upper / 2
    grow = np.arccosh(max(2 * top / upper - 1, 1.0 + 1e-12))
    degree = int(np.clip(np.log(SPREAD) / grow, 4, MOST_DEGREE))
    first = half / (top - half)
    scale, before, now = first, block, (product - half * block) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (times(now) - half * now) * (2 * following / half) - scale * following * before
        scale = following
    return now


def leading_components(times, width: int, wanted: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of the matrix that ``times`` multiplies by.

    A component is certified by its residual. Where rounds hardly help, as eigenvalues beyond the block lie too close, the block is
    doubled; a block as wide as the matrix is solved at once.
    """
    random = np.random.default_rng(seed)
    block = np.linalg.qr(random.standard_normal((width, min(width, wanted + GUARD))))[0]
    worst = np.inf
    while True:
        product = times(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        top = max(values[0], 0.0)
        residual = np.linalg.norm(product - block * values, axis=0)[:wanted].max()
        if residual <= TOLERANCE * top or (residual <= ROUNDED * top and residual > worst / 2) or block.shape[1] == width:
            return values[:wanted], block[:, :wanted]
        slow = residual > worst / 2
        worst = residual
        block = np.linalg.qr(filtered(times, block, product, max(values[-1], 1e-12 * top), top))[0]
        if slow:
            more = random.standard_normal((width, min(block.shape[1], width - block.shape[1])))
            block = np.linalg.qr(np.hstack([block, more]))[0]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = WANTED) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row and each of up to ``wanted`` components.

    Entries become ``floor(256 * entry)``. The fit is over distinct vectors: ``n`` of them, their covariance with divisor n, its eigenvectors by
    falling eigenvalue. ``deviation`` is the exact sum of ``(n * x - sum) ** 2``, null where it passes 64 bits; ``whitened`` the centred vector along the
    component over the root of the eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error`` how far the
    covariance of what is whitened is from the identity at most.

    Rows whose vector is null or holds null or non-finite entries are left out. Vectors shorter than the longest get zeros; entries beyond 64 bits
    count as the nearest long. Equal vectors count once in the fit, and each row has its own result; rows with null or repeated ids too. Components of equal
    eigenvalues are some orthonormal basis; those without variance, as of fewer than two different vectors, are not returned.
    An empty table gives no rows.
    """
    rows = integer_vectors(vectors, id_col, vector_col)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, {RESULT}"
    fit = store(rows.select("x").distinct(), "fit")
    n = fit.count()
    sums = dict(fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect())
    if not sums:
        return vectors.sparkSession.createDataFrame([], schema)
    width = len(sums)
    centre = Centre(n, [int(sums[i]) for i in range(width)])
    trace = float(summed(fit, lambda x: (centre.centred(x) ** 2).sum(keepdims=True).ravel(), (1,))[0]) / n
    if trace <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    values, block = leading_components(lambda q: covariance_times(fit, centre, q), width, min(wanted, width))
    real = values > width * np.finfo(float).eps * values[0]
    values, block = values[real], block[:, real]
    scaled, count = block / np.sqrt(values), int(real.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        white = centre.centred(x) @ scaled
        return np.vstack([white.T @ white, white.sum(axis=0)])

    found = summed(fit, moments, (count + 1, count)) / n
    error = float(np.abs(found[:count] - np.outer(found[count], found[count]) - np.eye(count)).max())
    explained = values / trace

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", *[c.split()[0] for c in RESULT.split(", ")]]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            size = len(x)
            white, deviation = centre.centred(x) @ scaled, pa.array(centre.deviations(x), pa.int64())
            for k in range(count):
                columns = [np.full(size, k + 1, np.int32), np.full(size, n), deviation, white[:, k], np.full(size, explained[k]), np.full(size, error)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names=names)

    return rows.mapInArrow(out, schema)

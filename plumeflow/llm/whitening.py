"""Whitening of embeddings: leading principal components by matrix-free block Lanczos.

Entries are put on a grid (``floor(scale * c)``), so that counts, sums and deviations are whole numbers and exact.  The fit list is
each distinct vector once.  Its covariance V is never formed: a pass multiplies V by a block of ``block`` columns,
each task adding up X'(Xv) of its own centred rows, and Spark adds up the tasks' sums.  What comes to the
driver is one block of d rows at a time; basis and projected matrix (d x ``basis`` numbers at most) stay there.

* Full reorthogonalisation: each new block is made orthogonal to the whole basis, twice.
* Breakdown: columns that vanish are replaced by random ones orthogonal to the basis (a restart in a space not yet reached), or left
  out when there is none left.
* Thick restart: a basis that has become too large goes down to the leading Ritz vectors, with what is left of the last block.
* Convergence: the norm of V y - theta y for each wanted Ritz pair is at most ``tolerance`` times the largest eigenvalue. As
  an eigenvalue may occur more often than a block has columns, the search then goes on from a random block outside the basis, until the
  first pair that is not wanted is known too; if the wanted values are still the same, it ends. It also ends when the basis spans all d dimensions.

The trace of V comes from the deviations of the rows and not from V, so that shares of the variance need no further component.

Defined results.  Rows whose vector is null, holds null or non-finite entries, entries beyond 1e12, or has not ``dim`` entries (by default the most
frequent length, the smaller of equals) go.  Repeated vectors count once in the fit and get equal results.  Components whose
eigenvalue is below 1e-12 of the largest are rounding and left out, so that a constant table, or one with no rows, has no components.
Signs are those that the largest entry of a component be positive. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle

#: Fixed values of the grid.
SCALE, OFFSET = 64, 1_000_000
#: An eigenvalue below this share of the largest is rounding.
NEGLIGIBLE = 1e-12
#: Wanted values are the same up to this share of the largest; the first pair beyond them is known at this residual.
CONFIRMED, RUNNER_UP = 1e-10, 1e-6


@dataclass
class Fit:
    """What is known of the fit list. sums are those of the grid values without OFFSET."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def gridded(embeddings: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    """(id, x) of the rows that are whole; x are the grid values without OFFSET."""
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) <= 1e12, F.lit(False))))
    if dim is None:
        sizes = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dim = sizes[0].d if sizes else 0
    return whole.where(F.size("v") == dim).select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _summed(fit: DataFrame, kernel, dtype: str) -> np.ndarray:
    """Sum over all batches of what kernel makes of a batch's matrix: always of the same shape, at most d rows of a few columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["i", *(f"c{j}" for j in range(total.shape[1]))])

    width = kernel.width
    columns = [f"c{j}" for j in range(width)]
    parts = fit.select("x").mapInArrow(run, ", ".join(["i int", *(f"{c} {dtype}" for c in columns)]))
    rows = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("i").collect()
    return np.array([[r[c] for c in columns] for r in rows])


class _Sums:
    """Sums of each dimension, in a column."""

    width = 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x.sum(axis=0)[:, None]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, by whole numbers first, so that nothing is lost by subtraction."""
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


class _Product:
    """V times a block."""

    def __init__(self, n: int, sums: np.ndarray, block: np.ndarray):
        self.n, self.sums, self.block, self.width = n, sums, block, block.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        c = centred(x, self.n, self.sums)
        return c.T @ (c @ self.block) / self.n


class _Moments:
    """Second moments of the projections, and their sums in a last column."""

    def __init__(self, n: int, sums: np.ndarray, projection: np.ndarray):
        self.n, self.sums, self.projection, self.width = n, sums, projection, projection.shape[1] + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = centred(x, self.n, self.sums) @ self.projection
        return np.column_stack([w.T @ w, w.sum(axis=0)])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int] | np.ndarray:
    """Sum over dimensions of (n x - sums) squared of each row, exact: in 64 bits where it fits, else by Python's whole numbers."""
    if not x.size:
        return np.zeros(len(x), dtype=np.int64)
    most = n * int(np.abs(x).max()) + int(np.abs(sums).max())
    if most * most * x.shape[1] < 1 << 63:
        y = n * x - sums
        return (y * y).sum(axis=1)
    y = n * x.astype(object) - sums.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def _orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _next_block(rest: np.ndarray, basis: np.ndarray, scale: float, random: np.random.Generator) -> np.ndarray:
    """Orthonormal columns of rest, those that vanish replaced by random ones outside the basis while there are any."""
    columns: list[np.ndarray] = []
    for k in range(rest.shape[1]):
        if basis.shape[1] + len(columns) == len(basis):
            break
        so_far = np.column_stack([basis, *columns]) if columns else basis
        v, floor = _orthogonal(rest[:, k], so_far), 1e-13 * scale
        while np.linalg.norm(v) <= floor:
            v, floor = _orthogonal(random.standard_normal(len(basis)), so_far), 1e-6
        v = _orthogonal(v / np.linalg.norm(v), so_far)
        columns.append(v / np.linalg.norm(v))
    return np.column_stack(columns) if columns else np.zeros((len(basis), 0))


def block_lanczos(times, d: int, k: int, block: int = 16, basis: int = 128, tolerance: float = 1e-13, passes: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a symmetric operator, falling, their vectors as columns, and the residual of each.

    times(Q) multiplies the operator by a matrix of d rows; each call is a pass over the data.
    """
    random = np.random.default_rng(seed)
    k, block = min(k, d), min(block, d)
    most = min(d, max(basis, k + 2 * block))
    q = np.linalg.qr(random.standard_normal((d, block)))[0]
    whole, image = q[:, :0], q[:, :0]
    settled = None  # the wanted values when they had converged, to be confirmed
    for _ in range(passes):
        whole, image = np.column_stack([whole, q]), np.column_stack([image, times(q)])
        projected = whole.T @ image
        theta, s = np.linalg.eigh((projected + projected.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, off = whole @ s, image @ s - whole @ s * theta
        largest = max(abs(theta[0]), abs(theta[-1]))
        residuals = np.linalg.norm(off, axis=0)
        if whole.shape[1] == d:
            return theta[:k], ritz[:, :k], residuals[:k]
        rest = image[:, -q.shape[1] :]
        if whole.shape[1] > k and residuals[:k].max() <= tolerance * largest:
            if settled is None or np.abs(settled - theta[:k]).max() > CONFIRMED * largest:
                settled, rest = theta[:k].copy(), random.standard_normal((d, block))
            elif residuals[k] <= RUNNER_UP * largest:
                return theta[:k], ritz[:, :k], residuals[:k]
        if whole.shape[1] + block > most and most < d:
            rest = _orthogonal(rest, whole)  # to what goes as well
            whole, image = ritz[:, : k + block], image @ s[:, : k + block]
        q = _next_block(rest, whole, largest, random)
    raise RuntimeError(f"no convergence in {passes} passes; residuals {residuals[:k]}")


def fitted(x: DataFrame, k: int = 16, **options) -> Fit:
    """The fit of a table with a column x of grid values; the distinct ones are written in the shared folder."""
    fit = settle(x.select("x").distinct(), "fit")
    n = fit.count()
    sums = _summed(fit, _Sums(), "long")[:, 0].astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    d = len(sums)
    none = Fit(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0)
    if not d:
        return none
    total = fit.mapInArrow(_deviation_kernel(n, sums, "x"), "deviation decimal(38,0)").agg(F.sum("deviation").alias("t")).first().t
    if not total:
        return none
    trace = float(total / Decimal(n) ** 3)
    values, vectors, residuals = block_lanczos(lambda q: _summed(fit, _Product(n, sums, q), "double"), d, k, **options)
    used = values > NEGLIGIBLE * values[0]
    values, vectors, residuals = values[used], vectors[:, used], residuals[used]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    moments = _summed(fit, _Moments(n, sums, vectors / np.sqrt(values)), "double")
    mean = moments[:, -1] / n
    error = float(np.abs(moments[:, :-1] / n - np.outer(mean, mean) - np.eye(len(values))).max())
    return Fit(n, sums, trace, values, vectors, residuals, error)


def _as_decimals(values) -> pa.Array:
    kind = pa.decimal128(38, 0)
    return pa.array(values, pa.int64()).cast(kind) if isinstance(values, np.ndarray) else pa.array([Decimal(v) for v in values], kind)


def _deviation_kernel(n: int, sums: np.ndarray, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_as_decimals(deviations(_matrix(batch.column(column)), n, sums))], names=["deviation"])

    return run


def _row_kernel(n: int, sums: np.ndarray, projection: np.ndarray):
    k = projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            w = centred(x, n, sums) @ projection if len(x) else np.zeros((0, k))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _as_decimals(deviations(x, n, sums)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

    return run


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, dim: int | None = None, **options) -> tuple[DataFrame, Fit]:
    """(id, deviation, whitened) for each whole row, and the fit; whitened has a value for each component, by falling eigenvalue."""
    rows = gridded(embeddings, id_col, vector_col, dim)
    fit = fitted(rows, k, **options)
    kind = rows.schema["id"].dataType.simpleString()
    kernel = _row_kernel(fit.n, fit.sums, fit.vectors / np.sqrt(fit.values))
    return rows.mapInArrow(kernel, f"id {kind}, deviation decimal(38,0), whitened array<double>"), fit

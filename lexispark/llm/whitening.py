"""Whitening of embeddings: leading principal components by matrix-free block subspace iteration.

A pass of Spark computes V Q = (X - m)'((X - m) Q) / n for a block Q of few columns; the covariance V itself is never
made. On the driver, which holds matrices of the dimension times the block alone, the block is made orthonormal (QR) and
rotated to the best estimates in its span (Rayleigh-Ritz). Between two such steps the block runs through a Chebyshev
polynomial of V that is small from 0 to the smallest Ritz value (Zhou and Saad, 2007), as embeddings may have an almost
flat spectrum, on which plain powers take thousands of passes. It ends when the residuals of all components certify them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Fixed value: an entry c counts as floor(SCALE * c).
SCALE = 256

#: Columns of the block beyond the components: the more, the wider the gap to what is left out.
SPARE = 28

#: A component is certified when its residual is at most this share of the largest eigenvalue ...
RESIDUAL = 1e-13

#: ... or, where rounding does not let it fall so far, at most this share and no longer falling.
FLOOR = 1e-11

#: exp of this bounds how much more a polynomial lifts the first column than the last one.
LIFT = 18.0

#: Partial matrices that the driver adds up itself; of more, tasks make sums first.
DRIVER_PARTS = 32


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors fitted, exact ``sums`` per dimension, unit ``components`` (rows) and ``eigenvalues`` of the covariance
    by falling eigenvalue, those above rounding only; ``trace`` of the covariance; ``residuals`` and ``passes`` of the fit; ``identity_error``, the largest
    absolute entry of the covariance of the whitened vectors of the fit, minus the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passes: int = 0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def matrix(self) -> np.ndarray:
        return self.components.T / np.sqrt(self.eigenvalues)


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all entries finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whole(vector: Column) -> Column:
    """Entries as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), dtype=np.int64)


def _bytes(values: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, pa.binary())], ["m"])


def _add_up(rows: DataFrame, parts: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``make`` of each batch's vectors. One partial sum a task; beyond ``DRIVER_PARTS`` tasks a
    second level adds them, so that the driver gets the square root of them at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = make(_matrix(batch, "x"))
                total = got if total is None else total + got
        if total is not None:
            yield _bytes([total.tobytes()])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0).to_pylist():
                got = np.frombuffer(value)
                total = got if total is None else total + got
        if total is not None:
            yield _bytes([total.tobytes()])

    made = rows.select("x").mapInArrow(partial, "m binary")
    if parts > DRIVER_PARTS:
        made = made.repartition(math.isqrt(parts) + 1).mapInArrow(second, "m binary")
    return sum((np.frombuffer(bytes(r.m)) for r in made.collect()), np.zeros(1))


def _exact(rows: DataFrame) -> tuple[int, list[int], list[int]]:
    """Vectors, and sums and sums of squares of each dimension, exactly. Vectors of several lengths are refused."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x")
                top = int(np.abs(x).max())
                x = x if top * top * len(x) < 1 << 62 else x.astype(object)
                n, sums, squares = n + len(x), sums + x.sum(axis=0).astype(object), squares + (x * x).sum(axis=0).astype(object)
        if n:
            text = [pa.array([str(v) for v in column]) for column in (sums, squares)]
            yield pa.record_batch([pa.array(np.arange(len(sums))), pa.array(np.full(len(sums), n)), *text], ["i", "n", "s", "q"])

    lengths = rows.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if lengths.a != lengths.b:
        raise ValueError(f"vectors have between {lengths.a} and {lengths.b} entries")
    each = rows.select("x").mapInArrow(partial, "i long, n long, s string, q string")
    found = sorted(each.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect())
    return found[0].n if found else 0, [int(r.s) for r in found], [int(r.q) for r in found]


def leading(apply: Callable[[np.ndarray], np.ndarray], dimension: int, k: int, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Eigenvalues, unit eigenvectors (columns) and residuals of the ``k`` largest eigenvalues of a positive semidefinite
    operator that is known by ``apply`` alone, and the number of its uses."""
    block = min(dimension, k + spare)
    q, passes, best, stuck = np.linalg.qr(np.random.default_rng(0).standard_normal((dimension, block)))[0], 0, math.inf, 0
    while True:
        image, passes = apply(q), passes + 1
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)[:k]
        scale = max(float(values[0]), 0.0)
        worst = float(residuals.max()) / scale if scale > 0 else 0.0
        stuck, best = (0 if worst < 0.5 * best else stuck + 1), min(best, worst)
        if worst <= RESIDUAL or worst <= FLOOR and stuck >= 2 or block == dimension and passes > 1:
            return values[:k], q[:, :k], residuals, passes
        # between 0 and the smallest Ritz value the polynomial stays within 1, above it grows
        half = max(float(values[-1]), 1e-12 * scale) / 2
        degree = max(1, min(12, int(LIFT / math.acosh(max(1 + 1e-9, (scale - half) / half)))))
        before, now = q, (image - half * q) / half
        for _ in range(degree - 1):
            image, passes = apply(now), passes + 1
            before, now = now, 2 / half * (image - half * now) - before
        q = np.linalg.qr(now)[0]


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 4) -> Whitening:
    """Components of each distinct usable vector of ``vectors``, once. Equal vectors meet after a sum in each task, so a
    vector that many rows share costs no more than another. A table without usable vectors, or with one distinct
    vector, has no components; components whose eigenvalue is nothing but rounding are left out."""
    small_batches(vectors.sparkSession)
    distinct = written(vectors.where(usable(F.col(f"`{vector}`"))).select(whole(F.col(f"`{vector}`")).alias("x")).groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    try:
        n, sums, squares = _exact(distinct)
        if not n:
            return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
        parts = distinct.select(F.spark_partition_id().alias("p")).distinct().count()
        mean, trace = np.array([s / n for s in sums]), sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / (n * n)
        if not trace:
            return Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0), 0.0)

        def apply(q: np.ndarray) -> np.ndarray:
            def make(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                return centred.T @ (centred @ q)

            return _add_up(distinct, parts, lambda x: make(x).ravel()).reshape(q.shape) / n

        values, vectors_, residuals, passes = leading(apply, len(sums), min(k, len(sums)))
        kept = values > 1e-12 * values[0]
        components = vectors_.T[kept]
        # either sign is right: the largest entry is positive
        components = components * np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])[:, None]
        model = Whitening(n, sums, components, values[kept], trace, residuals[kept], passes)
        matrix, k = model.matrix, len(components)

        def moments(x: np.ndarray) -> np.ndarray:
            z = np.hstack([(x - mean) @ matrix, np.ones((len(x), 1))])
            return (z.T @ z).ravel()

        got = _add_up(distinct, parts, moments).reshape(k + 1, k + 1) / n
        return replace(model, identity_error=float(np.abs(got[:k, :k] - np.outer(got[:k, k], got[:k, k]) - np.eye(k)).max()))
    finally:
        discard(distinct)


def transform(vectors: DataFrame, model: Whitening, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding") -> DataFrame:
    """``keep`` plus ``deviation long`` (exact; an OverflowError where it leaves the range) and ``whitened array<double>``,
    a value per component, for each row with a usable vector; repeated rows stay, columns of other names are not read.
    A model without components gives no values."""
    mean, matrix, n, sums, k = model.mean if model.n else np.zeros(0), model.matrix, model.n, model.sums, len(model.eigenvalues)
    names = [f"k{i}" for i in range(len(keep))]
    rows = vectors.where(usable(F.col(f"`{vector}`"))).select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keep, names, strict=True)), whole(F.col(f"`{vector}`")).alias("x"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(sums, dtype=object)
        for batch in batches:
            x = _matrix(batch, "x")
            if not len(x):
                continue
            top = n * int(np.abs(x).max()) + max(map(abs, sums))
            if top * top * len(sums) < 1 << 63:
                deviation = ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1)
            else:
                deviation = ((n * x.astype(object) - own) ** 2).sum(axis=1)
                if max(deviation) >= 1 << 63:
                    raise OverflowError("deviation leaves the range of a long")
            z = (x - mean) @ matrix if k else np.zeros((len(x), 0))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k) if k else np.zeros(len(x) + 1), pa.int32()), pa.array(z.ravel()))
            yield pa.record_batch([*(batch.column(i) for i in range(len(names))), pa.array([int(v) for v in deviation], pa.int64()), values], [*names, "deviation", "whitened"])

    small_batches(vectors.sparkSession)
    return rows.mapInArrow(run, f"{kinds}, deviation bigint, whitened array<double>").toDF(*keep, "deviation", "whitened")


def whitening(vectors: DataFrame, k: int = 4) -> DataFrame:
    """The digest of op11: a row for each usable vector and component. Rows whose vector is null or empty, or holds null,
    NaN or an infinity, are left out; equal vectors and ids each keep their rows; an empty table, or one whose vectors
    are all equal, gives no rows; null ids stay."""
    model = fit(vectors, k=k)
    of = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues)) if len(model.eigenvalues) else F.array().cast("array<double>")
    rows = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return rows.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(of, F.col("component")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))

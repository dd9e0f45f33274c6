"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. Tasks multiply it by a narrow block: for their
centred vectors X they return X'XQ, a matrix of dimensions by block columns, and these are added
up in two steps. A round runs the block through a Chebyshev polynomial of V, one pass over the
vectors for each degree, which damps the spectrum between a lower bound from a few Lanczos steps
and the block's smallest Ritz value, and raises what lies above; QR and Rayleigh-Ritz then give
the next Ritz pairs. Rounds go on until the residuals certify the wanted pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilscan.llm.rows import column, stored

# Entries become integers by a scale and a shift.
SCALE, SHIFT = 1024, 100_000
MOST_ENTRY = float(1 << 43)  # above it, scaled entries are not exact as doubles

BLOCK = 4  # block columns for each wanted component
DEGREE = 12
LANCZOS = 8  # steps that look for the lower end of the spectrum
MOST_SPREAD = 1e8  # of the amplification of the first and the last wanted component
EXACT = 1e-13  # residual by eigenvalue that ends the rounds
ENOUGH = 1e-8  # the same where rounding stops the progress
NOTHING = 1e-12  # of the first eigenvalue: less is no variance
SUM_GROUPS = 32  # partial sums that reach the driver


@dataclass(frozen=True)
class Fit:
    """Exact sums of the fit list, its components as columns, and their eigenvalues."""

    n: int
    sums: np.ndarray
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    passes: int = 0
    block: int = 0

    def explained(self) -> np.ndarray:
        return self.values / self.trace


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _added(rows: DataFrame, name: str, part: Callable[[np.ndarray], np.ndarray], like: np.ndarray) -> np.ndarray:
    """The sum over all rows of what `part` makes of a batch of vectors, shaped like `like`.

    Tasks add up their batches, then groups of tasks are added up in order, so that the driver
    receives a bounded number of matrices.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = np.zeros_like(like), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
        columns = [pa.array([task % SUM_GROUPS]), pa.array([task]), pa.array([total.tobytes()])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "task", "total"])

    def merged(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("task")
        total = np.zeros_like(like)
        for piece in ordered.column("total"):
            total += np.frombuffer(piece.as_py(), like.dtype).reshape(like.shape)
        return pa.table({"part": ordered.column("part").slice(0, 1), "total": pa.array([total.tobytes()])})

    parts = rows.select(column(name)).mapInArrow(partial, "part long, task long, total binary")
    found = parts.groupBy("part").applyInArrow(merged, "part long, total binary").collect()
    total = np.zeros_like(like)
    for row in sorted(found, key=lambda r: r["part"]):
        total += np.frombuffer(row["total"], like.dtype).reshape(like.shape)
    return total


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`(key, _x)`: vectors of integers, of the rows that take part; stored once.

    A row takes no part if its vector is null, empty, holds a null, a non-finite entry or one
    beyond `MOST_ENTRY`, or has another length than most vectors have (the longer length of
    two that are as frequent).
    """
    entries = column(vector)
    sound = F.forall(
        entries, lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) < MOST_ENTRY, F.lit(False))
    )
    whole = F.transform(entries, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT))
    picked = table.where(entries.isNotNull() & (F.size(entries) > 0) & sound)
    held = stored(picked.select(column(key), whole.cast("array<bigint>").alias("_x")), "vectors")
    lengths = held.groupBy(F.size("_x").alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return held.where(F.size("_x") == usual[0]["d"]) if usual else held


def _ritz(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values from the largest, and the rotated basis and images."""
    small = q.T @ w
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, w @ turn


def _lower_end(times: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> float:
    """A lower bound of the spectrum: the least Ritz value of some Lanczos steps, less the residual.

    Never below zero. It need not hold for sure: eigenvalues below it come up as Ritz values of
    the block, and then the bound gives way.
    """
    basis, diagonal, beside = [start / np.linalg.norm(start)], [], []
    for _ in range(min(LANCZOS, len(start))):
        image = times(basis[-1][:, None])[:, 0]
        diagonal.append(basis[-1] @ image)
        for vector in basis * 2:  # twice, to be orthogonal to the last digit
            image = image - (vector @ image) * vector
        beside.append(np.linalg.norm(image))
        if beside[-1] <= NOTHING * max(diagonal):
            break
        basis.append(image / beside[-1])
    off = beside[: len(diagonal) - 1]
    small = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    return max(0.0, float(np.linalg.eigvalsh(small)[0] - beside[-1]))


def _degree(first: float, last: float, middle: float, half: float) -> int:
    """The degree, less where the wanted amplifications would lie too far apart."""
    grow = [float(np.arccosh(max(1.0, (x - middle) / half))) for x in (first, last)]
    apart = max(grow[0] - grow[1], 1e-9)
    return int(np.clip(np.log(MOST_SPREAD) / apart, 2, DEGREE))


def leading(
    times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 0, block: int = BLOCK
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k leading eigenpairs of a positive semidefinite matrix that is known by products.

    Returns vectors, values and the final block size. Pairs that have converged are kept out of
    the filter. The last column of the block is drawn anew in every round, so that no direction
    is missed for good. Where a round gains little, the spectrum does not fall off inside the
    block: the block is doubled, up to all dimensions, where Rayleigh-Ritz alone is exact.
    """
    random = np.random.default_rng(seed)
    size = min(d, block * k)
    k = min(k, d)

    def basis(columns: np.ndarray) -> np.ndarray:
        return np.linalg.qr(columns)[0]

    lower = _lower_end(times, random.standard_normal(d)) if size < d else 0.0
    q = basis(random.standard_normal((d, size)))
    before = np.inf
    while True:
        values, q, w = _ritz(q, times(q))
        if values[0] <= 0:
            return q[:, :k], np.zeros(k), size
        real = max(1, int((values[:k] > NOTHING * values[0]).sum()))
        far = np.linalg.norm(w[:, :real] - q[:, :real] * values[:real], axis=0) / values[:real]
        gap = float(far.max())
        if size == d or gap <= EXACT or (gap <= ENOUGH and gap > before / 2):
            return q[:, :k], values[:k], size
        if before < np.inf and gap > before / 4:
            fresh = random.standard_normal((d, min(d, 2 * size) - size))
            q, size, before = basis(np.hstack([q, fresh])), min(d, 2 * size), np.inf
            continue
        before = gap
        done = int(np.argmax(np.append(far, np.inf) > EXACT))
        locked, y = q[:, :done], w[:, done:]
        bound, lower = values[-1], min(lower, values[-1] / 2 if values[-1] <= lower else lower)
        if bound > NOTHING * values[0]:  # else the block holds all there is
            middle, half = (bound + lower) / 2, (bound - lower) / 2
            older, y = q[:, done:], (y - middle * q[:, done:]) / half
            for _ in range(_degree(values[done], values[k - 1], middle, half) - 1):
                older, y = y, (times(y) - middle * y) * (2 / half) - older
                y -= locked @ (locked.T @ y)
        y = y / np.maximum(np.linalg.norm(y, axis=0), np.finfo(float).tiny)
        y[:, -1] = random.standard_normal(d)
        q = basis(np.hstack([locked, y]))


def fit(rows: DataFrame, k: int = 8, seed: int = 0, block: int = BLOCK) -> Fit | None:
    """The components of usable vectors; None if there are no vectors."""
    largest = F.greatest(F.abs(F.array_max("_x")), F.abs(F.array_min("_x")))
    facts = rows.agg(
        F.count("*").alias("n"), F.max(F.size("_x")).alias("d"), F.max(largest).alias("most")
    ).first()
    n, d = facts["n"], facts["d"]
    if not n:
        return None
    if n * facts["most"] >= 1 << 62:
        raise OverflowError("sums of these vectors do not fit into 64 bits")
    sums = _added(rows, "_x", lambda x: x.sum(axis=0), np.zeros(d, np.int64))

    def squares(x: np.ndarray) -> np.ndarray:
        return np.array([np.square((n * x - sums) / n).sum()])

    trace = float(_added(rows, "_x", squares, np.zeros(1))[0]) / n
    if not trace:
        return Fit(n, sums, 0.0, np.zeros((d, 0)), np.zeros(0))
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(x: np.ndarray) -> np.ndarray:
            centred = (n * x - sums) / n
            return centred.T @ (centred @ q)

        return _added(rows, "_x", product, np.zeros(q.shape)) / n

    vectors, values, size = leading(times, d, k, seed, block)
    real = values > NOTHING * values[0]
    return Fit(n, sums, trace, vectors[:, real], values[real], passes, size)


def _deviations(far: np.ndarray) -> pa.Array:
    """Exact sums of squares of 64-bit integers, as decimals."""
    rough = np.square(far.astype(np.float64)).sum(axis=1)
    if rough.max(initial=0) < 2.0**62:
        return pa.array(np.square(far).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = [Decimal(sum(v * v for v in row)) for row in far.tolist()]
    return pa.array(exact, pa.decimal128(38, 0))


def whitened(rows: DataFrame, model: Fit, key: str = "vec_id") -> DataFrame:
    """`(key, deviation, whitened)` of usable vectors, stored: an array with an entry a component."""
    schema = StructType(
        [rows.schema[key], *StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields]
    )
    n, sums = model.n, model.sums
    project = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = n * _matrix(batch.column(1)) - sums
            found = (far / n) @ project
            places = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _deviations(far), lists], schema.names)

    return stored(rows.select(column(key), "_x").mapInArrow(run, schema), "whitened")


def identity_error(done: DataFrame, k: int, n: int) -> float:
    """Largest entry of the covariance of stored whitened vectors less the identity."""
    means = _added(done, "whitened", lambda y: y.sum(axis=0), np.zeros(k)) / n
    square = _added(done, "whitened", lambda y: (y - means).T @ (y - means), np.zeros((k, k))) / n
    return float(np.abs(square - np.eye(k)).max())


def whiten(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, seed: int = 0
) -> DataFrame:
    """A row for each vector and component: `(key, component, n, deviation, whitened, explained,
    identity_error)`.

    Rows of vectors that take no part (see `usable`) are left out. Components without variance
    are left out too: fewer than k come of few or dependent vectors, and no rows at all of an
    empty table or of equal vectors. Ids are passed through, null or repeated as they are; other
    columns are not read. Equal vectors get equal values. Sums and `deviation`, a decimal, are
    exact; an OverflowError is raised where sums leave 64 bits.
    """
    rows = usable(table, key, vector)
    model = fit(rows, k, seed)
    fields = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        schema = StructType([rows.schema[key], *StructType.fromDDL(fields).fields])
        return table.sparkSession.createDataFrame([], schema)
    done = whitened(rows, model, key)
    error = identity_error(done, len(model.values), model.n)
    shares = F.array(*[F.lit(float(x)) for x in model.explained()])
    return done.select(
        column(key), "deviation", F.posexplode("whitened").alias("_at", "whitened")
    ).select(
        column(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )

"""Whitening of embeddings by Jacobi-Davidson.

Entries c become integers x = floor(64 c) + 1000000. Counts and sums are exact integers, and
a row is centred as (n x - S) / n with an exact numerator, so the offset costs no digits.
The covariance is never formed: the driver holds blocks of ``width`` columns of the dimension, and
one Spark job for each block returns the sum of centred rows times (centred rows times block),
added up on the executors. That is all that reaches the driver: dimension times columns.

Outer step: Rayleigh-Ritz in the subspace; leading pairs whose residual is at double precision
(``TOL`` of the largest eigenvalue) are locked. Inner step: for every pair left, the projected
correction equation (I - QQ')(V - theta I)(I - QQ') t = -r, Q being the locked vectors and the
pair's own, by MINRES; the pairs run in step, so an inner iteration is one job for all. The
corrections widen the subspace, which is restarted from its best Ritz vectors at ``WIDEST``
times the block. Locked vectors are checked at the end by a product of their own.

Defined cases: a null vector, or one with null or non-finite entries, is dropped; the dimension is
that of the longest vector, shorter ones (also empty ones) continue in zeros; every remaining row is
returned, also repeated rows and null ids. Entries beyond 2^40 in size count as 2^40. Components
without variance (eigenvalue at most ``FLAT`` of the largest) can't be whitened and are left out, so
one row, equal rows or none give no output. ``deviation`` is null where it does not fit a
long; ``deviation_exact`` has it as a decimal (null beyond 38 digits). Equal eigenvalues: any orthonormal choice.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm.tables import saved, table

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40
COMPONENTS = 32
GUARD = 8  # further columns of the first block
WIDEST = 4
INNER = 6  # MINRES steps of a correction
TOL = 1e-13  # of the largest eigenvalue, for residuals
FLAT = 1e-12
ROUNDS = 200
BATCH = 8192  # rows of a block in a task


def clean_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has only finite entries, the vector as doubles."""
    v = F.col(vector).cast("array<double>")
    broken = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.withColumn(vector, v).where(F.col(vector).isNotNull() & ~F.exists(vector, broken))


def integers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the scaled integers of every row that has a whole vector."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    near = lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)) + F.lit(SHIFT)
    # compared as doubles first: a floor beyond a long has no value
    cut = lambda c: F.greatest(F.least(c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return clean_vectors(own, "x").select("vec_id", F.transform("x", lambda c: near(cut(c))).alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    """Rows of a list column as whole numbers; missing ends are the integer of a zero entry."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == d).all():
        return flat.reshape(-1, d)
    out = np.full((len(size), d), SHIFT, np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


def _parts(batches, d: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            if part.num_rows:
                yield part, _matrix(part.column("x"), d)


def _totals(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray], d: int, width: int, kind: str) -> np.ndarray:
    """Sum over all rows of ``values`` (integer matrix to ``height`` x ``width``), added up by Spark."""

    def each(batches):
        total = 0
        for _, x in _parts(batches, d):
            total = total + values(x)
        if isinstance(total, np.ndarray):
            cells = [pa.array(c, pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()) for c in total.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *cells],
                                             ["i", *(f"c{j}" for j in range(width))])

    names = [f"c{j}" for j in range(width)]
    parts = rows.select("x").mapInArrow(each, ", ".join(["i int", *(f"{c} {kind}" for c in names)]))
    got = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).orderBy("i").collect()
    return np.array([[row[c] for c in names] for row in got])


class Covariance:
    """The covariance of the integer vectors as a product, never as a matrix."""

    def __init__(self, rows: DataFrame, d: int):
        self.rows, self.d = rows, d
        as_decimals = np.vectorize(decimal.Decimal, otypes=[object])
        found = _totals(rows, lambda x: as_decimals(np.stack([np.full(x.shape[1], len(x)), x.sum(0)], 1).astype(object)),
                        d, 2, "decimal(38,0)")
        self.n, self.sums = int(found[0, 0]), [int(v) for v in found[:, 1]]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles, from the exact numerator."""
        return centre(x, self.n, self.sums)

    def __call__(self, block: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums

        def part(x):
            c = centre(x, n, sums)
            return c.T @ (c @ block)

        return _totals(self.rows, part, self.d, block.shape[1], "double") / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float((_totals(self.rows, lambda x: (centre(x, n, sums) ** 2).sum(0)[:, None], self.d, 1, "double") / n).sum())

    def whitened_error(self, maps: np.ndarray) -> float:
        """Largest entry of the covariance of the mapped rows, centred by their own mean, minus the identity."""
        n, sums, k = self.n, self.sums, maps.shape[1]
        mean = _totals(self.rows, lambda x: (centre(x, n, sums) @ maps).sum(0)[:, None], self.d, 1, "double")[:, 0] / n

        def part(x):
            w = centre(x, n, sums) @ maps - mean
            return w.T @ w

        return float(np.abs(_totals(self.rows, part, self.d, k, "double") / n - np.eye(k)).max())


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as longs where they fit, else as Python's integers."""
    # the mean is taken off first, so that the numbers stay as small as the deviations are
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base)]
    y = x - np.array(base, np.int64)
    if n * (max(int(np.abs(y).max()), 1) + 1) >= 1 << 63:
        y, rest = y.astype(object), np.array(rest, object)
    return y * n - np.array(rest)


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return numerators(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n x - S)^2."""
    top = numerators(x, n, sums)
    most = int(np.abs(top).max(initial=0))
    if most * most * max(top.shape[1], 1) >= 1 << 63:
        top = top.astype(object)
    return [int(v) for v in (top * top).sum(1)]


def minres(product: Callable[[np.ndarray], np.ndarray], project: Callable[[np.ndarray], np.ndarray],
           shift: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Solutions of the shifted, projected systems, a column each, all columns in step."""
    x = np.zeros_like(right)
    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = np.divide(v, beta, where=live, out=np.zeros_like(v))
    old = np.zeros_like(v)
    eta, cos, cos_old, sin, sin_old = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    for step in range(steps):
        y = project(product(v) - v * shift)
        alpha = (v * y).sum(0)
        y -= v * alpha + old * (beta if step else 0)
        up = np.linalg.norm(y, axis=0)
        # two rotations of before, and the new one
        diag = cos * alpha - cos_old * sin * (beta if step else 0)
        over = sin * alpha + cos_old * cos * (beta if step else 0)
        far = sin_old * (beta if step else 0)
        size = np.hypot(diag, up)
        safe = np.where(size > 0, size, 1.0)
        cos_old, sin_old, cos, sin = cos, sin, diag / safe, up / safe
        w, w_old = (v - w * over - w_old * far) / safe * (size > 0) * live, w
        x += w * (cos * eta)
        eta = -sin * eta
        old, beta = v, up
        live = live & (up > 1e-300) & (size > 0)
        v = np.divide(y, up, where=live, out=np.zeros_like(y))
        if not live.any():
            break
    return x


def added(basis: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Orthonormal columns of what ``fresh`` has beyond ``basis``."""
    out = np.zeros((len(fresh), 0))
    for column in fresh.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):  # until orthogonal to rounding
            column = column - basis @ (basis.T @ column) - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.column_stack([out, column])
    return out


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, tol: float = TOL) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors of a symmetric operator on ``d`` dimensions."""
    wanted = min(wanted, d)
    width = min(d, wanted + GUARD)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    sub = added(np.zeros((d, 0)), np.random.default_rng(5).standard_normal((d, width)))
    image = product(sub)
    top, best, idle = 0.0, np.inf, 0
    for _ in range(ROUNDS):
        small = sub.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        sub, image = sub @ turn, image @ turn
        top = max(top, theta[0], values.max(initial=0.0))
        left = wanted - len(values)
        ritz = sub[:, :left]
        gap = image[:, :left] - ritz * theta[:left]
        gap -= locked @ (locked.T @ gap)
        error = np.linalg.norm(gap, axis=0)
        whole = sub.shape[1] + len(values) >= d  # nothing is outside: the pairs are exact
        idle = idle + 1 if error[0] > best / 2 else 0
        best = min(best, error[0])
        # a residual that stands still near the limit is the rounding of the sums
        done = (error <= tol * top) | whole | ((idle > 2) & (error <= 100 * tol * top))
        k = left if done.all() else int(np.argmin(done))
        if k:
            locked, values = np.column_stack([locked, ritz[:, :k]]), np.append(values, theta[:k])
            sub, image, ritz, gap, theta = sub[:, k:], image[:, k:], ritz[:, k:], gap[:, k:], theta[k:]
            best, idle = np.inf, 0
        if len(values) == wanted:
            break
        if sub.shape[1] + ritz.shape[1] > max(WIDEST * width, width + 1):
            sub, image = sub[:, :width], image[:, :width]

        def project(block, locked=locked, ritz=ritz):
            block = block - locked @ (locked.T @ block)
            return block - ritz * (ritz * block).sum(0)

        fresh = added(np.column_stack([locked, sub]), minres(product, project, theta[:ritz.shape[1]], -gap, INNER))
        if not fresh.shape[1]:  # no correction: look elsewhere
            fresh = added(np.column_stack([locked, sub]), np.random.default_rng(len(values)).standard_normal((d, GUARD)))
        sub, image = np.column_stack([sub, fresh]), np.column_stack([image, product(fresh)])
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs did not converge in {ROUNDS} rounds")
    # one product of all locked vectors takes off what was carried along
    basis = np.linalg.qr(locked)[0]
    small = basis.T @ product(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], (basis @ turn)[:, ::-1]


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each whole vector and component; see the module. ``rows`` may have any other columns."""
    out = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
           "deviation_exact decimal(38,0)")
    spark = rows.sparkSession
    held = saved(integers(rows, vec_id, vector), "whitening-x")
    d = held.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return spark.createDataFrame([], out)
    v = Covariance(held, d)
    trace = v.trace()
    values, vectors = leading(v, d, components)
    keep = values > FLAT * max(values[0], 0.0)
    if not trace or not keep.any():
        return spark.createDataFrame([], out)
    values, vectors = values[keep], vectors[:, keep]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    maps = vectors / np.sqrt(values)
    error, share, k = v.whitened_error(maps), values / trace, len(values)
    n, sums = v.n, v.sums

    def each(batches):
        for part, x in _parts(batches, d):
            exact = deviations(x, n, sums)
            white = centre(x, n, sums) @ maps
            m = len(exact)
            fits = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            whole = pa.array([decimal.Decimal(e) if e < 10 ** 38 else None for e in exact], pa.decimal128(38, 0))
            each_row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(each_row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, n)), fits.take(each_row), pa.array(white.ravel()), pa.array(np.tile(share, m)),
                 pa.array(np.full(m * k, error)), whole.take(each_row)],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return held.mapInArrow(each, out)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))

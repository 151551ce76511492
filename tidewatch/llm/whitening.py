"""PCA whitening of an embedding table.

Entries become integers on a fixed grid (floor of ``SCALE`` times the entry, plus ``OFFSET``), so sums and centred entries are exact
whatever the size of the table. One job adds up the entries of each dimension, a second one the products of entries that have
been centred with those sums; each task sends one matrix, added up row by row. The driver holds one
d x d covariance (d is the width of a vector, not the number of rows) and finds its leading eigenpairs: Householder
reflections make it tridiagonal, bisection on Sturm counts gives the wanted eigenvalues, inverse iteration gives the
vectors, made orthogonal inside clusters of close eigenvalues, and reflections take them back. The projection, d x k, goes
to all tasks. A third job measures the covariance of what was projected.

Defined results: vectors that are null, or hold null or non-finite entries, or entries beyond 2^53 / ``SCALE``, are dropped;
of tables with vectors of several lengths the most frequent length stays (of equally frequent ones the longest). Fewer dimensions than wanted
give as many components as dimensions. Components without variance, to working precision, are 0 throughout and left out of the identity
error. A deviation beyond 64 bits is null. Repeated rows and null ids are rows of their own; no rows left give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64.0, 1_000_000
MOST = 2.0 ** 53 / SCALE
COMPONENTS = 32
EPS = np.finfo(float).eps


# ---- leading eigenpairs of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors of a Householder reduction."""
    a, mirrors = matrix.astype(float).copy(), []
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        far = np.linalg.norm(x[1:])
        if far == 0:
            mirrors.append(np.zeros(len(x)))
            continue
        x[0] += np.copysign(np.hypot(x[0], far), x[0])
        v = x / np.linalg.norm(x)
        mirrors.append(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        q = p - (v @ p) * v
        rest -= 2 * (np.outer(v, q) + np.outer(q, v))
        column = a[k + 1:, k]
        column -= 2 * v * (v @ column)
        a[k, k + 1:] = column
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each shift."""
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny / EPS)
    count, q = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    squares = np.r_[0.0, off ** 2]
    for d, e in zip(diagonal, squares):
        q = d - shifts - e / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    reach = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    wanted = len(diagonal) - np.arange(k)  # this many eigenvalues lie below the upper bound
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    pad = EPS * max(np.abs(low).max(), np.abs(high).max()) + np.finfo(float).tiny
    low, high = low - pad, high + pad
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        enough = below(diagonal, off, middle) >= wanted
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)


def _solve(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """A tridiagonal system by elimination with row exchanges; zero pivots become ``tiny``."""
    n = len(diagonal)
    a, b, c, x = diagonal.tolist(), off.tolist() + [0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        under = off[i]
        if abs(a[i]) >= abs(under):
            f = under / a[i] if a[i] else 0.0
            a[i + 1] -= f * b[i]
            x[i + 1] -= f * x[i]
        else:
            f = a[i] / under
            a[i], above, b[i] = under, b[i], a[i + 1]
            c[i], b[i + 1] = b[i + 1], -f * b[i + 1]
            a[i + 1] = above - f * b[i]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (b[i] * x[i + 1] if i + 1 < n else 0.0) - (c[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / (a[i] if abs(a[i]) > tiny else (tiny if a[i] >= 0 else -tiny))
    return np.array(x)


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    n = len(matrix)
    k = min(k, n)
    scale = np.abs(matrix).max(initial=0.0)
    if not k or scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    norm = (np.abs(diagonal) + np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]).max()
    vectors = np.zeros((n, k))
    start = np.random.default_rng(0)
    first, shift = 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            first = i  # vectors first to i are made orthogonal to each other
        shift = min(value, shift - 4 * EPS * norm)  # equal eigenvalues need different systems
        x = start.standard_normal(n)
        for _ in range(6):
            x = _solve(diagonal - shift, off, x / np.linalg.norm(x), EPS * norm)
            for _ in range(2):
                x -= vectors[:, first:i] @ (vectors[:, first:i].T @ x)
        vectors[:, i] = x / np.linalg.norm(x)
    for m, v in reversed(list(enumerate(mirrors))):
        vectors[m + 1:] -= 2 * np.outer(v, v @ vectors[m + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---- jobs over the table


def usable(rows: DataFrame, vec: str = "embedding") -> tuple[DataFrame, int]:
    """(id, x) rows of whole, finite vectors of the most frequent length, as doubles; and that length."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= F.lit(MOST))
    good = rows.where(F.col(vec).isNotNull() & F.forall(vec, finite)).select(
        F.col("vec_id"), F.col(vec).cast("array<double>").alias("x"))
    size = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = size[0].d if size else 0
    return good.where(F.size("x") == d), d


def _grid(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of a batch on the integer grid."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def sums(good: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their dimensions. A task sends 24-bit limbs, so no sum can overflow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _grid(batch.column(0), d)
            n += len(x)
            low += (x & 0xFFFFFF).sum(axis=0)
            high += (x >> 24).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(low), pa.array(high)],
                                         ["i", "n", "low", "high"])

    parts = good.select("x").mapInArrow(run, "i int, n long, low long, high long")
    rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "low", "high")]).collect()
    total = {r.i: (r.n, r.low + (r.high << 24)) for r in rows}
    return (total[0][0], [total[i][1] for i in range(d)]) if total else (0, [0] * d)


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S as integers; Python integers where 64 bits might not do."""
    if max(n * int(np.abs(x).max(initial=0)), *map(abs, total), 1) < 1 << 61:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def covariance(rows: DataFrame, width: int, centred) -> np.ndarray:
    """Covariance with divisor n of vectors that ``centred`` makes of a column of rows (x), centred about their own mean.

    A task keeps (n, mean, centred products) and merges batches into it; the parts of all tasks are merged the
    same way in the order of their numbers, one row of the matrix in one group.
    """
    def merge(one, two):
        (n, mean, m2), (k, other, p2) = one, two
        both, gap = n + k, other - mean
        return both, mean + gap * (k / both), m2 + p2 + np.outer(gap, gap) * (n * k / both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = centred(batch.column(0))
            mean = x.mean(axis=0)
            part = (len(x), mean, (x - mean).T @ (x - mean))
            state = part if state is None else merge(state, part)
        if state is not None:
            n, mean, m2 = state
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([TaskContext.get().partitionId()] * width, pa.int32()),
                 pa.array([float(n)] * width), pa.array([mean.tolist()] * width, pa.list_(pa.float64())), pa.array(m2.tolist(), pa.list_(pa.float64()))],
                ["i", "part", "n", "mean", "m2"])

    def add(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        total = None
        for k in np.argsort(table.column("part").to_numpy()).tolist():
            n, mean, m2 = table.column("n")[k].as_py(), np.array(table.column("mean")[k].as_py()), np.array(table.column("m2")[k].as_py())
            if total is None:
                total = n, mean, m2
                continue
            before, old, products = total
            both, gap = before + n, mean - old
            total = both, old + gap * (n / both), products + m2 + gap[i] * gap * (before * n / both)
        return pa.table({"i": pa.array([i], pa.int32()), "row": pa.array([(total[2] / total[0]).tolist()], pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(run, "i int, part int, n double, mean array<double>, m2 array<double>")
    found = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    out = np.zeros((width, width))
    for r in found:
        out[r.i] = r.row
    return (out + out.T) / 2


def _squares(y: np.ndarray) -> pa.Array:
    """Exact sums of squares of the rows, null beyond 64 bits."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
        return pa.array((y * y).sum(axis=1))
    total = [sum(v * v for v in row) for row in y.tolist()]
    return pa.array([t if t < 1 << 63 else None for t in total], pa.int64())


def whitened(rows: DataFrame, components: int = COMPONENTS, vec: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good, d = usable(rows, vec)
    n, total = sums(good, d) if d else (0, [])
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    k = min(components, d)
    exact = covariance(good, d, lambda column: _centred(_grid(column, d), n, total).astype(float) / n)
    values, vectors = leading_pairs(exact, k)
    trace = float(np.trace(exact))
    real = values > d * EPS * max(trace, 0.0)
    project = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    seen = covariance(good, k, lambda column: _centred(_grid(column, d), n, total).astype(float) / n @ project)
    error = float(np.abs(seen - np.eye(k))[np.ix_(real, real)].max(initial=0.0))
    explained = np.where(real, values / trace if trace else 0.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            y = _centred(_grid(batch.column(1), d), n, total)
            out = (y.astype(float) / n) @ project
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                 _squares(y).take(at), pa.array(out.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.select("vec_id", "x").mapInArrow(run, schema)

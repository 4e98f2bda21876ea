"""Whitening of embeddings by spectral divide and conquer (operator 13).

Vectors become integers; each distinct one counts once in the fit list, which a grouped pass finds and stores. Two passes
over it add up the exact sums and the centred covariance, in tasks; only arrays of the dimension's square reach the
driver. There the polar factor of the shifted covariance (QDWH: dynamically weighted Halley steps by QR) gives the
projector on the eigenvectors above the shift; an orthonormal basis of its range and one of the complement split the
matrix into two blocks, which are split in turn, those of larger eigenvalues first, until the wanted components stand
alone. The mean and the scaled components go to all tasks inside the function that maps the rows.

Edge cases: null vectors, those with null or non-finite entries, empty ones and those of another length than the commonest
are left out; scaled entries are held within +-2^30; repeated rows count once in the fit and all return; null ids are kept; there
are at most as many components as dimensions; a component whose eigenvalue vanishes beside the largest has null
``whitened``, and ``explained`` is null where all vectors are equal; of equal eigenvalues any basis may come;
``deviation`` is null where no long holds it; an empty table gives an empty result; other columns are kept by ``whiten``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentmill.llm._common import discard, free_name, materialise
from talentmill.llm._vectors import matrix, scaled, task_sums, usable

EPS = float(np.finfo(float).eps)
BOUND = 1 << 30


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, which is its matrix sign, by QDWH."""
    n, x = len(a), a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x), 1)  # no more than the least singular value
    except np.linalg.LinAlgError:
        low = EPS
    low, eye = min(1.0, max(low, EPS)), np.eye(n)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        weight = root + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        after = b / c * x + (weight - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        after = (after + after.T) / 2
        low = min(1.0, low * (weight + b * low**2) / (1 + c * low**2))
        moved = np.linalg.norm(after - x)
        x = after
        if abs(1 - low) < 10 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift; None if no shift divides the matrix."""
    n, diagonal, size = len(a), np.diag(a), np.linalg.norm(a)
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(n)) / np.sqrt(n)
    best = None
    for shift in (np.median(diagonal), mean, mean + spread / 3, mean - spread / 3, mean + spread / 7, mean - spread / 7):
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(above)))
        if not 0 < rank < n:
            continue
        q = np.random.default_rng(rank).standard_normal((n, rank))
        for _ in range(2):
            q, _ = np.linalg.qr(above @ q)
        whole, _ = np.linalg.qr(q, mode="complete")
        left = np.linalg.norm(whole[:, rank:].T @ a @ whole[:, :rank])
        if best is None or left < best[0]:
            best = (left, whole[:, :rank], whole[:, rank:])
        if left <= 50 * n * EPS * size:
            break
    return best and best[1:]


def components(a: np.ndarray, k: int) -> np.ndarray:
    """Unit eigenvectors, as columns, of the ``k`` largest eigenvalues, falling."""
    n, k = len(a), min(k, len(a))
    halves = split(a) if n > 1 and np.linalg.norm(a - np.diag(np.diag(a))) > EPS * np.linalg.norm(a) else None
    if halves is None:
        return np.eye(n)[:, np.argsort(-np.diag(a), kind="stable")[:k]]
    out, need = [], k
    for q in halves:
        if need > 0:
            block = q.T @ a @ q
            out.append(q @ components((block + block.T) / 2, need))
            need -= out[-1].shape[1]
    found = np.hstack(out)
    return found / np.linalg.norm(found, axis=0)


@dataclass(frozen=True)
class Whitening:
    """What a fit found: n vectors, their exact sums, components as columns, their eigenvalues, and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - np.array(self.sums)) / self.n if self.small(x) else x - np.array([s / self.n for s in self.sums])

    def small(self, x: np.ndarray) -> bool:
        """Whether 64 bits hold the deviations of these rows."""
        return (self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)) ** 2 * len(self.sums) < 1 << 63

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows on the components, over the root of the eigenvalue; NaN where it vanishes."""
        root = np.sqrt(np.where(self.values > len(self.sums) * EPS * max(self.values[0], 0), self.values, np.nan))
        return self.centred(x) @ self.vectors / root

    def deviation(self, x: np.ndarray) -> list[int | None]:
        if self.small(x):
            return ((x * self.n - np.array(self.sums)) ** 2).sum(1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [d if d < 1 << 63 else None for d in exact]


def fit(vectors: DataFrame, width: int, k: int = 4, column: str = "x") -> Whitening | None:
    """Whitening of the distinct integer vectors of ``column``; None without rows."""
    listed = materialise(vectors.select(F.col(column).alias("x")).distinct())
    n = listed.count()
    if not n:
        return None
    sums = task_sums(listed, lambda m: m.sum(0), "x", width, "long")
    mean, upper = np.array([s / n for s in sums]), np.triu_indices(width)

    def products(m: np.ndarray) -> np.ndarray:
        y = m - mean
        return (y.T @ y)[upper]

    cov = np.zeros((width, width))
    cov[upper] = np.array(task_sums(listed, products, "x", width, "double")) / n
    cov = cov + np.triu(cov, 1).T
    found = components(cov, k)
    values = np.einsum("ij,ik,kj->j", found, cov, found)
    falling = np.argsort(-values, kind="stable")  # equal ones may come out of order by rounding
    found, values = found[:, falling], values[falling]
    trace = float(np.trace(cov))
    share = [float(e) / trace if trace > 0 else None for e in values]
    out = Whitening(n, tuple(sums), found, values, share, None)
    good = np.isfinite(out.whitened(np.zeros((1, width), dtype=np.int64))[0])
    error, m = None, int(good.sum())
    if m:

        def measured(rows: np.ndarray) -> np.ndarray:
            z = out.whitened(rows)[:, good]
            return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

        total = np.array(task_sums(listed, measured, "x", width, "double")) / n
        error = float(np.abs(total[: m * m].reshape(m, m) - np.outer(total[m * m :], total[m * m :]) - np.eye(m)).max())
    discard(listed)
    return Whitening(n, tuple(sums), found, values, share, error)


def numbers(values: np.ndarray) -> list[float | None]:
    return [v if v == v else None for v in values.tolist()]  # NaN: no value


def whiten(df: DataFrame, k: int = 4, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``df``'s usable rows with a last column ``whitened``: their ``k`` whitened coordinates."""
    kept, width = usable(df, vector)
    name = free_name("whitened", df.columns)
    integers = kept.withColumn(name, scaled(F.col(vector), scale, BOUND))
    model = fit(integers, width, k, name)
    if model is None:
        return integers.withColumn(name, F.col(name).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = model.whitened(matrix(b.column(b.num_columns - 1), width))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([numbers(r) for r in z], type=pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "x"])

    inside = integers.toDF(*(f"c{i}" for i in range(len(integers.columns))))  # names that cannot clash
    return inside.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in inside.dtypes[:-1]), "x array<double>"])).toDF(*integers.columns)


def report(df: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept, width = usable(df)
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale, BOUND).alias("x"))
    model = fit(rows, width, k)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = matrix(b.column(1), width), len(model.values)
            times = lambda values: [v for v in values for _ in range(m)]
            rows = b.num_rows
            out = {
                "vec_id": pa.array(times(b.column(0).to_pylist()), pa.int64()),
                "component": pa.array(list(range(1, m + 1)) * rows, pa.int32()),
                "n": pa.array([model.n] * m * rows, pa.int64()),
                "deviation": pa.array(times(model.deviation(x)), pa.int64()),
                "whitened": pa.array(numbers(model.whitened(x).ravel()), pa.float64()),
                "explained": pa.array(model.explained * rows, pa.float64()),
                "identity_error": pa.array([model.identity_error] * m * rows, pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(run, schema)

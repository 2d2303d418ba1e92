"""Whitening of embeddings, with principal components by QDWH spectral divide and conquer.

The covariance is summed by all tasks, each centring its rows, and merged. Its eigenvectors are
found on the driver, where only that matrix (the square of the vectors' width) is held: the
polar factor of the covariance less a shift is the matrix sign, whose projector splits the space
into the invariant subspaces of the eigenvalues above and below the shift; both halves are split
again until they are single components. The polar factors come from the dynamically weighted
Halley iteration (QDWH), by QR decompositions and, when well conditioned, by solves. The
components and the means are then sent to all tasks, which whiten their rows alone.

Entries are taken as integers, floor(64 c), so sums and deviations are exact.

Defined results: vectors that are null or hold null or non-finite entries go, as do entries whose
integer does not fit 64 bits; shorter ones count as padded with zeros; rows without vec_id, repeated rows and ties stay as rows of their own; a
component without variance (up to rounding) is left out, so equal vectors, one vector or an
empty table give no components; a deviation beyond 64 bits is null; other columns are kept in
``row``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewash.llm.moments import EXACT, moments
from tidewash.llm.shared import table, whole_row
from tidewash.llm.top_k import matrix, widened

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
EPS = float(np.finfo(np.float64).eps)
LONG = 2**63


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vector): all columns as one struct, and the vectors (array<double>) without null or non-finite entries."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LONG // SCALE))

    taken = vectors.select(whole_row(vectors).alias("row"), F.col("embedding").cast("array<double>").alias("vector"))
    return taken.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def integers(rows: np.ndarray) -> np.ndarray:
    """The features without their offset, which no sum of deviations sees."""
    return np.floor(SCALE * rows)


def polar_factor(a: np.ndarray, turns: int = 20) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its sign."""
    n = len(a)
    x, least, one = a / np.linalg.norm(a), EPS, np.eye(n)
    for _ in range(turns):
        square = least * least
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = math.sqrt(1 + d)
        weight = root + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([math.sqrt(c) * x, one]))[0]
            new = b / c * x + (weight - b / c) / math.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            new = b / c * x + (weight - b / c) * np.linalg.solve(one + c * (x.T @ x), x.T).T
        least = min(1.0, least * (weight + b * square) / (1 + c * square))
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        if moved < 1e-8 * math.sqrt(n) and least > 1 - 1e-8:  # the order of convergence is three
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k vectors span the eigenvalues above a shift; None if no shift splits them."""
    n, values = len(a), np.sort(np.diag(a))
    mean = float(values.mean())
    reach = np.linalg.norm(a - mean * np.eye(n))
    start = np.random.default_rng(n).standard_normal((n, n))
    for shift in [float(np.median(values)), mean, *(mean + reach * x for x in (1e-3, -1e-3, 1e-2, -1e-2, 0.1, -0.1))]:
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        sign = polar_factor(moved)
        if np.linalg.norm(sign @ sign - np.eye(n)) > 1e-10 * n:
            continue  # an eigenvalue at the shift has no sign
        above = (sign + np.eye(n)) / 2
        k = round(float(np.trace(above)))
        if 0 < k < n:
            basis = start
            for _ in range(2):  # the second time from an orthogonal basis, so that nothing is lost
                basis = np.linalg.qr(np.hstack([above @ basis[:, :k], basis[:, k:] - above @ basis[:, k:]]))[0]
            return basis, k
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns."""
    n = len(a)
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    vectors = np.zeros((n, 0))
    open_ = [(np.eye(n), a)] if n else []
    while open_:
        basis, part = open_.pop()
        size = len(part)
        rest = part - np.diag(np.diag(part))
        halves = None if size == 1 or np.linalg.norm(rest) <= EPS * scale else split(part)
        if halves is None:  # a single component, or diagonal already
            vectors = np.hstack([vectors, basis])
            continue
        q, k = halves
        for own in (q[:, :k], q[:, k:]):
            inner = own.T @ part @ own
            open_.append((basis @ own, (inner + inner.T) / 2))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """What was fitted: rows, exact sums of the integer features, components with variance, and all the variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.total).tolist()

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S of each integer feature, divided by n."""
        rows = widened(rows, len(self.sums))
        if self.n * (np.abs(rows).max(initial=0) + max(map(abs, self.sums), default=0) / self.n) < EXACT:
            return (self.n * rows - np.array(self.sums, np.float64)) / self.n
        return rows - np.array([x / self.n for x in self.sums])

    def squares(self, rows: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)^2 of each row; None beyond 64 bits."""
        rows = widened(rows, len(self.sums))
        near = ((self.n * rows - np.array(self.sums, np.float64)) ** 2).sum(axis=1)
        if near.max(initial=0) < LONG / 4 and np.abs(rows).max(initial=0) * self.n < LONG / 4:
            return ((self.n * rows.astype(np.int64) - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        out: list[int | None] = []
        for row, about in zip(rows, near.tolist()):
            exact = sum((self.n * int(x) - s) ** 2 for x, s in zip(row.tolist(), self.sums)) if about < 2.0 * LONG else LONG
            out.append(exact if exact < LONG else None)
        return out

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.deviations(rows) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The first ``components`` principal components of the usable vectors of ``vectors``."""
    found = moments(usable(vectors), integers, integers=True)
    if not found.n or not len(found.mean):
        return Whitening(found.n, found.sums, np.zeros(0), np.zeros((len(found.sums), 0)), 0.0)
    values, columns = eigen(found.covariance)
    kept = np.flatnonzero(values > 16 * EPS * len(values) * max(values[0], 0.0))[:components]
    return Whitening(found.n, found.sums, values[kept], columns[:, kept], float(np.trace(found.covariance)))


def whiten(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """(row, deviation, whitened) of the usable vectors, ``whitened`` with one entry for each component."""
    row_type = vectors.select(whole_row(vectors).alias("row")).schema["row"].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = integers(widened(matrix(batch["vector"]), len(own.sums)))
            white = own.whitened(rows)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1])
            columns = [batch["row"], pa.array(own.squares(rows), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "deviation", "whitened"])

    return usable(vectors).mapInArrow(run, f"row {row_type}, deviation bigint, whitened array<double>")


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors less the identity."""
    if not len(fitted.values):
        return 0.0
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)
    found = moments(usable(vectors), lambda rows: sent.value.whitened(integers(rows)))
    return float(np.abs(found.covariance - np.eye(len(fitted.values))).max())


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = fit(vectors)
    error = identity_error(vectors, fitted)
    explained = F.lit(fitted.explained).cast("array<double>")
    rows = whiten(vectors.select("vec_id", "embedding"), fitted).select(F.col("row.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error"),
    )

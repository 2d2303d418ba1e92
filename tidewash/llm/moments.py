"""Counts, exact sums and centred second moments of vectors, one small table a task, merged in tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewash.llm.top_k import matrix

#: Tasks that merge the tables of all tasks before the last one.
MERGERS = 16
EXACT = float(2**53)


def exact_sums(rows: np.ndarray) -> list[int]:
    """Sums of integer-valued columns, without rounding."""
    if not len(rows) or np.abs(rows).max(initial=0) * len(rows) < EXACT:
        return [int(x) for x in rows.sum(axis=0)]
    return [sum(map(int, column.tolist())) for column in rows.T]


@dataclass
class Moments:
    """``n`` vectors with their mean and the sum of products of their deviations; narrower ones count as padded with zeros.

    ``sums`` holds the exact totals of integer-valued vectors (empty for others).
    """

    n: int
    mean: np.ndarray
    products: np.ndarray
    sums: list[int]

    @staticmethod
    def of(rows: np.ndarray, integers: bool) -> Moments:
        if not len(rows):
            return Moments(0, np.zeros(0), np.zeros((0, 0)), [])
        sums = exact_sums(rows) if integers else []
        mean = np.array([x / len(rows) for x in sums]) if integers else rows.mean(axis=0)
        centred = rows - mean
        return Moments(len(rows), mean, centred.T @ centred, sums)

    def widened(self, width: int) -> Moments:
        more = width - len(self.mean)
        sums = self.sums + [0] * more if self.sums or not len(self.mean) else self.sums
        return Moments(self.n, np.pad(self.mean, (0, more)), np.pad(self.products, ((0, more), (0, more))), sums) if more else self

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        width = max(len(self.mean), len(other.mean))
        a, b = self.widened(width), other.widened(width)
        n, apart = a.n + b.n, b.mean - a.mean
        products = a.products + b.products + np.outer(apart, apart) * (a.n * b.n / n)
        return Moments(n, a.mean + apart * (b.n / n), products, [x + y for x, y in zip(a.sums, b.sums)])

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n


def moments(vectors: DataFrame, features: Callable[[np.ndarray], np.ndarray] | None = None, integers: bool = False) -> Moments:
    """The moments of the column ``vector`` (array<double>), or of ``features`` of its rows.

    Every task centres its own rows; what moves is one table of the vectors' width a task, and
    the driver gets one.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.of(np.zeros((0, 0)), integers)
        for batch in batches:
            rows = matrix(batch["vector"])
            total += Moments.of(rows if features is None else features(rows), integers)
        if total.n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "held": [pickle.dumps(total)]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.of(np.zeros((0, 0)), integers)
        for batch in batches:
            for held in batch["held"]:
                total += pickle.loads(held.as_py())
        if total.n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "held": [pickle.dumps(total)]})

    schema = "part int, held binary"
    some = vectors.select("vector").mapInArrow(parts, schema).repartition(MERGERS, F.pmod("part", F.lit(MERGERS)))
    held = some.mapInArrow(merge, schema).coalesce(1).mapInArrow(merge, schema).first()
    return pickle.loads(held["held"]) if held else Moments.of(np.zeros((0, 0)), integers)

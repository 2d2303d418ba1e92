"""Exact quantiles of many columns without gathering a column anywhere.

Spark's ``percentile`` is exact but merges every distinct value of a column on one task. Here it
is used only while that state is small. Beyond it two scans find all quantiles of all columns,
whatever the data: the first counts values in the cells of a fixed grid that grows with the
logarithm, with the smallest and largest value of each cell, so the cell of every rank is known;
the second tallies the values of those cells only. A cell of one value needs no second scan. A
cell with very many values is narrowed on its tallies, by grids between its ends. There is no
sample and no guess: counts over all rows decide everything.
"""

from __future__ import annotations

import bisect
import math
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewash.session import shared_folder

DIRECT_ROWS = 100_000      # `percentile` keeps at most this many values per column
INSIDE_ROWS = 100_000      # this few rows between two cuts are ranked one by one
COLUMNS_PER_PASS = 16      # a pass collects a few hundred cells of a column, at most some 270,000
CELLS_PER_OCTAVE = 64
INNER_CELLS = 4096
HUGE = sys.float_info.max


@dataclass(frozen=True)
class _Cell:
    """Neighbouring values of a column: how many rows are below them and in them, and the ends."""

    name: str
    number: int
    below: int
    rows: int
    low: float
    high: float

    @property
    def is_one_value(self) -> bool:
        return self.low == self.high or math.isnan(self.low)  # what is not a number has a cell of its own


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probabilities: Sequence[float],
    counts: Mapping[str, int] | None = None,
    direct_rows: int = DIRECT_ROWS,
    inside_rows: int = INSIDE_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each value column; nulls are ignored.

    ``counts`` are the non-null counts when the caller already knows them.
    """
    values = {name: value.cast("double") for name, value in values.items()}
    if not values:
        return {}
    if counts is None:
        row = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())]).first()
        counts = dict(zip(values, row))
    result: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in values}
    small = [n for n in values if 0 < counts[n] <= direct_rows]
    for batch in _batches(small, counts, 16 * DIRECT_ROWS):
        states = [F.percentile(values[n], list(probabilities)).alias(f"q{i}") for i, n in enumerate(batch)]
        row = df.agg(*states).first()
        result.update({n: list(row[i]) for i, n in enumerate(batch)})
    large = [n for n in values if counts[n] > direct_rows]
    for at in range(0, len(large), COLUMNS_PER_PASS):
        part = {n: values[n] for n in large[at:at + COLUMNS_PER_PASS]}
        result.update(_radix_quantiles(df, part, probabilities, counts, inside_rows))
    return result


def _batches(names: Sequence[str], counts: Mapping[str, int], limit: int):
    """Names whose `percentile` states fit into one task together."""
    batch: list[str] = []
    held = 0
    for name in names:
        if batch and held + counts[name] > limit:
            yield batch
            batch, held = [], 0
        batch.append(name)
        held += counts[name]
    if batch:
        yield batch


def _radix_quantiles(df, values, probabilities, counts, inside_rows):
    df = df.select(*[(v + F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(values.values())])  # zeros of both signs are one
    names = list(values)
    columns = [F.col(f"v{i}") for i in range(len(names))]
    places = {n: [p * (counts[n] - 1) for p in probabilities] for n in names}
    open_ = {(n, r) for n, ps in places.items() for p in ps for r in (math.floor(p), math.ceil(p))}
    cells = _cells(_cell_rows(df, columns, [_grid(v) for v in columns]), names)
    totals = {n: sum(c.rows for c in of) for n, of in cells.items()}
    if any(totals[n] != counts[n] for n in names):
        raise ValueError(f"the counts given do not fit the rows that were read: {totals}")
    found, wanted = _placed(open_, cells)
    if wanted:
        inner = [F.when(_grid(v).isin([c.number for c in wanted if c.name == n]), v) for n, v in zip(names, columns)]
        tallies = _tally(df, inner).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        if any(c.rows > inside_rows for c in wanted):
            folder = shared_folder(df.sparkSession, "quantiles")
            tallies.write.parquet(folder)
            tallies = df.sparkSession.read.parquet(folder)
        while wide := {c: r for c, r in wanted.items() if c.rows > inside_rows}:
            some, closer = _placed({(c.name, r) for c, rs in wide.items() for r in rs}, _narrowed(tallies, names, list(wide)))
            found.update(some)
            wanted = {**{c: r for c, r in wanted.items() if c not in wide}, **closer}
        found.update(_ranked(tallies, names, wanted))
    return {
        name: [_between(found[name, math.floor(p)], found[name, math.ceil(p)], p) for p in ps]
        for name, ps in places.items()
    }


def _between(lower: float, upper: float, place: float) -> float:
    """The value at a place between two ranks, by the formula of ``percentile``, so that both ways agree to the last bit."""
    return lower if lower == upper else (math.ceil(place) - place) * lower + (place - math.floor(place)) * upper


def _grid(value: Column) -> Column:
    """A whole number that never falls as the value grows: cells by the logarithm, of both signs."""
    size = F.floor(F.log2(F.abs(value)) * CELLS_PER_OCTAVE) + 1100 * CELLS_PER_OCTAVE
    far = F.lit(2200 * CELLS_PER_OCTAVE).cast("bigint")
    size = F.when(F.abs(value) == float("inf"), far - 1).otherwise(size)
    return F.when(F.isnan(value), far).when(value > 0, size).when(value < 0, -size).when(value == 0, F.lit(0).cast("bigint"))


def _cell_rows(df: DataFrame, columns: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
    """(column, cell, n, low, high) of all cells that hold rows, in one pass."""
    parts = [F.struct(F.lit(i).alias("column"), c.alias("cell"), v.alias("value")) for i, (v, c) in enumerate(zip(columns, cells))]
    rows = df.select(F.inline(F.array(*parts))).filter(F.col("cell").isNotNull())
    return rows.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def _cells(rows: DataFrame, names: Sequence[str], below: Mapping[int, int] | None = None) -> dict[str, list[_Cell]]:
    """The cells of each column in order, with the rows below them; ``below`` begins a cell number's count anew."""
    out: dict[str, list[_Cell]] = {n: [] for n in names}
    upto = dict.fromkeys(names, 0)
    for r in sorted(rows.collect(), key=lambda r: (r["column"], r["cell"])):
        name = names[r["column"]]
        upto[name] = max(upto[name], (below or {}).get((name, r["cell"] // INNER_CELLS), 0))
        out[name].append(_Cell(name, r["cell"], upto[name], r["n"], r["low"], r["high"]))
        upto[name] += r["n"]
    return out


def _placed(ranks: set[tuple[str, int]], cells: Mapping[str, list[_Cell]]):
    """What the cells say of ranks: values found (a cell of one value), and the other cells with their ranks."""
    found: dict[tuple[str, int], float] = {}
    wanted: dict[_Cell, list[int]] = {}
    for name, rank in sorted(ranks):
        of = cells[name]
        cell = of[bisect.bisect_right([c.below for c in of], rank) - 1]
        if cell.is_one_value:
            found[name, rank] = cell.low
        else:
            wanted.setdefault(cell, []).append(rank)
    return found, wanted


def _tally(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(column, value) of all cells that are not null."""
    parts = [F.struct(F.lit(i).alias("column"), v.alias("value")) for i, v in enumerate(values)]
    return df.select(F.inline(F.array(*parts))).filter(F.col("value").isNotNull())


def _bracket(names: Sequence[str], cells: Sequence[_Cell], then: Callable[[int, _Cell], Column]) -> Column:
    """``then`` of the cell that a tally's value lies in, null outside all."""
    of = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for i, c in enumerate(cells):
        of = of.when((F.col("column") == names.index(c.name)) & F.col("value").between(c.low, c.high), then(i, c))
    return of


def _narrowed(tallies: DataFrame, names: Sequence[str], wide: Sequence[_Cell]) -> dict[str, list[_Cell]]:
    """The cells of a grid between the ends of each of ``wide``; both ends have cells of their own."""
    wide = sorted(wide, key=lambda c: (c.name, c.below))

    def cell(i: int, c: _Cell) -> Column:
        low, high = max(c.low, -HUGE), min(c.high, HUGE)
        width = high / 2 - low / 2
        at = F.floor((F.col("value") / 2 - low / 2) / F.lit(width) * (INNER_CELLS - 2)) if width > 0 else F.lit(0)
        at = F.greatest(F.least(at.cast("bigint"), F.lit(INNER_CELLS - 3)), F.lit(0)) + 1
        return F.when(F.col("value") == c.high, INNER_CELLS - 1).when(F.col("value") == c.low, 0).otherwise(at) + F.lit(i * INNER_CELLS).cast("bigint")

    placed = tallies.withColumn("cell", _bracket(names, wide, cell)).filter(F.col("cell").isNotNull())
    rows = placed.groupBy("column", "cell").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return _cells(rows, names, {(c.name, i): c.below for i, c in enumerate(wide)})


def _ranked(tallies: DataFrame, names: Sequence[str], wanted: Mapping[_Cell, list[int]]) -> dict[tuple[str, int], float]:
    """The values of ranks in cells of few rows, one group per cell."""
    if not wanted:
        return {}
    cells = list(wanted)
    steps = F.array(*[F.array(*[F.lit(r - c.below) for r in wanted[c]]) for c in cells])
    upto = F.sum("n").over(Window.partitionBy("zone").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_step = lambda s: (s < F.col("upto")) & (s >= F.col("upto") - F.col("n"))
    zone = _bracket(names, cells, lambda i, c: F.lit(i).cast("bigint"))
    picked = (
        tallies.withColumn("zone", zone).filter(F.col("zone").isNotNull())
        .withColumn("upto", upto)
        .select("zone", "value", F.explode(F.filter(F.get(steps, F.col("zone").cast("int")), in_step)).alias("step"))
    )
    return {(cells[r["zone"]].name, cells[r["zone"]].below + r["step"]): r["value"] for r in picked.collect()}

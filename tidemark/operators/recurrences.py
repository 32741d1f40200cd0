"""Linear recurrences along long orders: exponential averages, Wilder's averages, Holt's smoothing.

A state follows ``state = matrix * state before + gain * input`` with constant matrix and gain. Rows are cut into
chunks of equal length by their rank. Inside a chunk the state is a running sum, as the matrix' powers can be
taken out of it; between chunks the map of a whole chunk is applied to what the chunks before have left, as many of
them as still tell. So every row sees the state of its own moment, nothing is folded over an array, and a hot
key is many tasks.

A smoothing that starts at some row is the scan at its end less what the scan had at its start:
see :func:`restarted`. So one scan serves every window, wherever that begins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import rejoined

#: Powers inside a chunk stay below this, so that running sums keep their digits.
GROWTH = 1e3
#: What a state has become when it no longer tells in a double.
GONE = 1e-18


@dataclass(frozen=True)
class Recurrence:
    """Matrix (rows) and gain; every eigenvalue lies inside the unit circle and none is 0."""

    matrix: tuple[tuple[float, ...], ...]
    gain: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.gain)

    def powers(self, n: int) -> np.ndarray:
        """Powers 0 to n of the matrix."""
        out = [np.eye(self.size)]
        for _ in range(n):
            out.append(np.array(self.matrix) @ out[-1])
        return np.array(out)

    @property
    def radii(self) -> tuple[float, float]:
        """Least and largest modulus of the eigenvalues."""
        sizes = np.abs(np.linalg.eigvals(np.array(self.matrix)))
        return float(sizes.min()), float(sizes.max())


def ema(period: int) -> Recurrence:
    a = 2 / (period + 1)
    return Recurrence(((1 - a,),), (a,))


def wilder(period: int) -> Recurrence:
    return Recurrence((((period - 1) / period,),), (1 / period,))


def ema_and_its_ema(period: int, smooth: int) -> Recurrence:
    """An exponential average and the exponential average of that one."""
    a, b = 2 / (period + 1), 2 / (smooth + 1)
    return Recurrence(((1 - a, 0.0), (b * (1 - a), 1 - b)), (a, b * a))


def holt(level: float = 0.3, trend: float = 0.1) -> Recurrence:
    """Level and slope of Holt's double exponential smoothing."""
    return Recurrence(((1 - level, 1 - level), (-level * trend, 1 - level * trend)), (level, level * trend))


def _numbers(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def scanned(rows: DataFrame, keys: Sequence[str], rank: str, scans: dict[str, tuple[Recurrence, Column]]) -> DataFrame:
    """``rows`` with the array ``name`` for each scan: its state at the row, from nothing before rank 1.

    ranks: 1, 2, 3, ... in each key without gaps. A null input counts as 0.
    """
    chunk = min(max(4, min(1024, int(math.log(GROWTH) / -math.log(r.radii[0])))) for r, _ in scans.values())
    reach = max(math.ceil(math.log(GONE) / math.log(r.radii[1]) / chunk) for r, _ in scans.values())
    rows = rows.withColumn("_chunk", F.floor((F.col(rank) - 1) / chunk)).withColumn("_place", (F.col(rank) - 1 - F.col("_chunk") * chunk).cast("int"))
    at = [*keys, "_chunk"]
    inside = Window.partitionBy(*at).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    powers = {n: r.powers(chunk * reach + 1) for n, (r, _) in scans.items()}

    def entry(name: str, k: int, j: int, shift: int = 0) -> Column:
        """Entry (k, j) of the power place + shift."""
        return F.element_at(_numbers(powers[name][shift : shift + chunk, k, j]), F.col("_place") + 1)

    for n, (r, x) in scans.items():
        weights = np.array([np.linalg.inv(p) @ np.array(r.gain) for p in powers[n][:chunk]])
        parts = [F.sum(F.element_at(_numbers(weights[:, j]), F.col("_place") + 1) * F.coalesce(x, F.lit(0.0))).over(inside) for j in range(r.size)]
        rows = rows.withColumn(f"_sum_{n}", F.array(*parts))
    for n, (r, _) in scans.items():
        own = [sum((entry(n, k, j) * F.col(f"_sum_{n}")[j] for j in range(r.size)), F.lit(0.0)) for k in range(r.size)]
        rows = rows.withColumn(n, F.array(*own)).drop(f"_sum_{n}")
    # what a full chunk leaves to each of the next ones: after j more chunks, the power j * chunk of it
    ends = rows.where(F.col("_place") == chunk - 1).select(*at, *scans, F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("_later"))
    left = []
    for n, (r, _) in scans.items():
        for k in range(r.size):
            past = [F.element_at(_numbers(powers[n][: chunk * reach : chunk, k, j]), F.col("_later") + 1) * F.col(n)[j] for j in range(r.size)]
            left.append(F.sum(sum(past, F.lit(0.0))).alias(f"_left_{n}_{k}"))
    left = ends.groupBy(*keys, (F.col("_chunk") + F.col("_later") + 1).alias("_chunk")).agg(*left)
    rows = rejoined(rows, left, at, "left")
    for n, (r, _) in scans.items():
        total = [F.col(n)[k] + sum((entry(n, k, j, 1) * F.coalesce(f"_left_{n}_{j}", F.lit(0.0)) for j in range(r.size)), F.lit(0.0)) for k in range(r.size)]
        rows = rows.withColumn(n, F.array(*total))
    return rows.drop("_chunk", "_place", *(f"_left_{n}_{k}" for n, (r, _) in scans.items() for k in range(r.size)))


def restarted(recurrence: Recurrence, most: int, steps: Column, start: Sequence[Column], scan_then: Sequence[Column], scan_now: Sequence[Column]) -> list[Column]:
    """State now of the recurrence that had the state ``start`` ``steps`` rows ago (``most`` at most), from the scan's states then and now."""
    powers = recurrence.powers(most)
    n = recurrence.size

    def component(k: int) -> Column:
        return sum((F.element_at(_numbers(powers[:, k, j]), (steps + 1).cast("int")) * (start[j] - scan_then[j]) for j in range(n)), scan_now[k])

    return [component(k) for k in range(n)]

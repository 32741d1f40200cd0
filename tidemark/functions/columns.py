"""Column expressions: binomial bounds, shrinkage, guarded arithmetic and threshold bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(up: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of up / n; null where n is 0."""
    n = n.cast("double")
    p = ratio(up, n)
    spread = 1 + F.try_divide(F.lit(z * z), n)
    middle = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return F.greatest(F.lit(0.0), (middle - half) / spread), F.least(F.lit(1.0), (middle + half) / spread)


def wilson_direction(up: Column, n: Column, least: int, z: float = Z95) -> tuple[Column, Column]:
    """Direction (UP, DOWN or NO_SIGNAL) and confidence that ``n`` outcomes with ``up`` rises support."""
    low, high = wilson(up, n, z)
    enough = n >= least
    direction = F.when(enough & (low > 0.5), "UP").when(enough & (high < 0.5), "DOWN").otherwise("NO_SIGNAL")
    return direction, F.when(enough & (low > 0.5), low).when(enough & (high < 0.5), 1 - high)


def beta_shrunk(up: Column, n: Column, strength: float = 4.0) -> Column:
    """Share of ups pulled towards one half by ``strength`` made-up outcomes of either kind."""
    return (up + strength) / (n + 2 * strength)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def ladder(x: Column, edges: Sequence[float]) -> Column:
    """How many edges x has reached: 0 below the first one."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x < edges[i], i).otherwise(out)
    return out


def move(now: Column, before: Column, up: str = "U", down: str = "D", flat: str = "F") -> Column:
    """Which way from ``before`` to ``now``; flat where either is null."""
    return F.when(now > before, up).when(now < before, down).otherwise(flat)


def last(array: Column, k: int) -> Column:
    """The last k elements, or all if there are fewer."""
    size = F.least(F.size(array), F.lit(k))
    return F.slice(array, F.greatest(F.size(array) - size + 1, F.lit(1)), size)


def fold(array: Column, start: Column, step, finish=None) -> Column:
    return F.aggregate(array, start, step, finish) if finish else F.aggregate(array, start, step)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)

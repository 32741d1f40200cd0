"""Embedding whitening by a tall-skinny QR factorisation.

Vectors become integers, and each distinct vector counts once for the fit. Their sums are exact, so rows are
centred to the last digit; every partition reduces its centred rows to a triangle R, triangles are merged
``FAN_IN`` at a time until few are left, and the singular values and right vectors of the last one give the
covariance's eigenvalues and eigenvectors. The covariance itself is never formed.

Scale: distinct vectors are one hashed aggregation with partial combining, so a vector that a third of the rows
share is one row a task. What tasks pass on is one triangle of d x d numbers; the driver sees ``FAN_IN`` of them.

Defined results: a vector that is null, empty or holds null, infinite or undefined entries takes no part, nor does
one whose entries leave ``LIMIT`` (their integers would not be exact numbers) or whose length isn't the most
frequent one (of equally frequent ones the largest). Rows with a null or repeated id are rows like others.
``whitened`` is null for components without variance, which take no part in ``identity_error``; ``explained`` is null where
no component has any. ``deviation`` is null where it doesn't fit 64 bits; ``deviation_text`` has it always.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carry, materialize

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Largest size of an entry: 64 times it is an exact double.
LIMIT = float(1 << 46)
FAN_IN = 16
#: A task factorises so many rows at a time.
ROWS = 4096
_LOW = 26  # bits of a number that are summed apart from the rest


def integers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(STEPS)) * c) + F.lit(OFFSET).cast("bigint"))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector takes part, with ``_x``, its integers."""
    good = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) <= LIMIT, F.lit(False)))  # an undefined number isn't below it
    rows = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(good)
    common = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(vector) == (common[0]["d"] if common else 0)).withColumn("_x", integers(F.col(vector)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their exact sums, unit right vectors (columns) by falling eigenvalue, eigenvalues, trace, and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts as integers, then the fraction."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Components of the rows of x; undefined where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n x - S) squared: with y = x less the whole mean and r the rest, n^2 y.y - 2 n y.r + r.r."""
        y = x - np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        far = int(np.abs(y).max(initial=0))
        if far * max(far, self.n) * len(rest) >= 1 << 62:
            y, r = y.astype(object), np.array(rest, object)
        else:
            r = np.array(rest, np.int64)
        square = sum(v * v for v in rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + square for a, b in zip((y * y).sum(1), (y * r).sum(1), strict=True)]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            x = _matrix(b.column(0), width)
            n, low, high = n + len(x), low + (x & ((1 << _LOW) - 1)).sum(0), high + (x >> _LOW).sum(0)
        dims = pa.array(range(width), pa.int32())
        yield pa.RecordBatch.from_arrays([dims, pa.array(low), pa.array(high), pa.array([n] * width, pa.int64())], names=["dim", "low", "high", "n"])

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high", "n")]
    rows = sorted(fit.mapInArrow(task, "dim int, low long, high long, n long").groupBy("dim").agg(*whole).collect())  # a row for each dimension
    return int(rows[0]["n"]), [(int(r["high"]) << _LOW) + int(r["low"]) for r in rows]


def _triangle(parts: Iterator[np.ndarray], width: int) -> np.ndarray:
    r = np.zeros((0, width))
    for part in parts:
        r = np.linalg.qr(np.vstack([r, part]), mode="r")
    return r


def _triangles(fit: DataFrame, centre: Whitening, width: int) -> list[np.ndarray]:
    """At most ``FAN_IN`` triangles whose rows have the same inner products as all centred rows of ``fit``."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (centre.centred(_matrix(b.column(0).slice(k, ROWS), width)) for b in batches for k in range(0, len(b), ROWS))
        r = _triangle(parts, width)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["k", "r"])

    def merge(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = _triangle((np.asarray(x, float).reshape(-1, width) for frame in rows for x in frame["r"]), width)
        yield pd.DataFrame({"k": [int(key[0])], "r": [r.ravel()]})

    left = fit.rdd.getNumPartitions()
    rows = fit.mapInArrow(reduce_rows, "k int, r array<double>")
    while left > FAN_IN:
        group = F.floor(F.col("k") / FAN_IN).cast("int").alias("k")
        rows = rows.groupBy(group).applyInPandas(merge, "k int, r array<double>")
        left = -(-left // FAN_IN)
    return [np.asarray(r["r"], float).reshape(-1, width) for r in sorted(rows.collect())]


def _error(fit: DataFrame, model: Whitening, width: int) -> float:
    """Largest entry of the whitened covariance less the identity, over components with variance; centred, then multiplied."""
    on = np.flatnonzero(model.values > 0)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(on))
        for b in batches:
            total += model.whitened(_matrix(b.column(0), width))[:, on].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(on)), pa.int32()), pa.array(total)], names=["i", "v"])

    found = fit.mapInArrow(means, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row for each component
    mean = np.array([r["v"] for r in sorted(found)]) / model.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(on), len(on)))
        for b in batches:
            w = model.whitened(_matrix(b.column(0), width))[:, on] - mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(len(on) ** 2), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    found = fit.mapInArrow(products, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row for each pair of components
    covariance = np.array([r["v"] for r in sorted(found)]).reshape(len(on), len(on)) / model.n
    return float(np.abs(covariance - np.eye(len(on))).max(initial=0.0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening learnt from the distinct ``_x`` of ``rows``; None without rows."""
    distinct = materialize(rows.select("_x").distinct(), "whitening-distinct")
    first = distinct.first()
    if first is None:
        return None
    width = len(first["_x"])
    n, sums = _sums(distinct, width)
    start = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    _, singular, right = np.linalg.svd(_triangle(iter(_triangles(distinct, start, width)), width))
    singular = np.concatenate([singular, np.zeros(width - len(singular))])
    singular[singular <= singular[0] * width * np.finfo(float).eps] = 0.0
    values = singular**2 / n
    model = Whitening(n, sums, right[:components].T, values[:components], float(values.sum()))
    return Whitening(n, sums, model.vectors, model.values, model.trace, _error(distinct, model, width))


def apply(rows: DataFrame, model: Whitening | None, carried: list[str]) -> DataFrame:
    """The columns ``carried`` of rows (with ``_x``) and their components: component from 1, n, deviation, deviation_text, whitened, explained and identity_error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["_x"].tolist(), np.int64).reshape(len(frame), -1)
            yield pd.DataFrame({"w": list(model.whitened(x)), "deviation_text": [str(v) for v in model.deviations(x)]})

    if model is None:
        made = rows.limit(0).select(*(f"`{c}`" for c in carried), F.array(F.lit(0.0)).alias("w"), F.lit("").alias("deviation_text"))
        n, shares, error = 0, [], None
    else:
        made = carry(rows, carried, ["_x"], "w array<double>, deviation_text string", run)
        n, shares, error = model.n, [float(v / model.trace) if model.trace > 0 else None for v in model.values], model.error
    made = made.select("*", F.posexplode("w").alias("_k", "_w")).drop("w")
    explained = F.get(F.array(*(F.lit(v).cast("double") for v in shares)).cast("array<double>"), F.col("_k"))
    return made.select(
        *(f"`{c}`" for c in carried), (F.col("_k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), F.expr("try_cast(deviation_text AS bigint)").alias("deviation"),
        F.when(~F.isnan("_w"), F.col("_w")).alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_text",
    )


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and the whitened components of every usable row of ``rows`` (vec_id, embedding)."""
    used = usable(rows.select("vec_id", "embedding"))
    return apply(used, fit(used, components), ["vec_id"])

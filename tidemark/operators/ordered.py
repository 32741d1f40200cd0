"""Running values in long orders, computed block by block so that one hot key is many tasks.

Rows are dealt to (keys, block of time). A first aggregation takes a row for each block; an order over these
few rows says what each block starts with, and inside a block a window carries on from there. No row is lost:
rows whose key is null belong together, and rows without a time come before all others of their keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import micros

#: Seconds in a block: a day.
BLOCK = 86_400.0
#: A block where the order is a number of rows, not a time: 4096 of them.
RANKS = 4096e-6


def in_block(time: str | Column, block: float = BLOCK) -> Column:
    return F.floor(F.col(time) / micros(block) if isinstance(time, str) else time / micros(block)).alias("_block")


def rejoined(rows: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``facts``, where null equals null."""
    named = facts.select(*(F.col(c).alias(f"_on_{c}" if c in on else c) for c in facts.columns))
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(named[f"_on_{c}"]) for c in on))
    return rows.join(named, same, how).drop(*(f"_on_{c}" for c in on))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], block: float = BLOCK) -> DataFrame:
    """``rows`` with the running sum of each of ``sums`` among the rows of their keys, own one included; order[0] is a time in microseconds."""
    rows = rows.withColumn("_block", in_block(order[0], block))
    at = [*keys, "_block"]
    totals = rows.groupBy(*at).agg(*(F.sum(x).alias(f"_start_of_{n}") for n, x in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*at, *(F.coalesce(F.sum(f"_start_of_{n}").over(earlier), F.lit(0)).alias(f"_start_of_{n}") for n in sums))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n, x in sums.items():
        rows = rows.withColumn(n, F.coalesce(F.sum(x).over(inside), F.lit(0)))
    rows = rejoined(rows, starts, at)
    for n in sums:
        rows = rows.withColumn(n, F.col(n) + F.col(f"_start_of_{n}"))
    return rows.drop("_block", *(f"_start_of_{n}" for n in sums))


def lagged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, block: float = BLOCK) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the row before in the order of their keys, null for the first."""
    rows = rows.withColumn("_block", in_block(order[0], block))
    at = [*keys, "_block"]
    last = rows.groupBy(*at).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    starts = last.select(*at, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_start_of_block"))
    rows = rows.withColumn(name, F.lag(value).over(Window.partitionBy(*at).orderBy(*order)))
    first = F.row_number().over(Window.partitionBy(*at).orderBy(*order)) == 1
    rows = rejoined(rows.withColumn("_first", first), starts, at)
    return rows.withColumn(name, F.when(F.col("_first"), F.col("_start_of_block")).otherwise(F.col(name))).drop("_block", "_start_of_block", "_first")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], block: float = BLOCK) -> DataFrame:
    """``rows`` with the last value that isn't null of each of ``values`` among the rows of their keys so far, own one included."""
    rows = rows.withColumn("_block", in_block(order[0], block))
    at = [*keys, "_block"]
    place = F.struct(*order)
    last = rows.groupBy(*at).agg(*(F.max_by(x, F.when(x.isNotNull(), place)).alias(f"_start_of_{n}") for n, x in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select(*at, *(F.last(f"_start_of_{n}", ignorenulls=True).over(earlier).alias(f"_start_of_{n}") for n in values))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n, x in values.items():
        rows = rows.withColumn(n, F.last(x, ignorenulls=True).over(inside))
    rows = rejoined(rows, starts, at)
    for n in values:
        rows = rows.withColumn(n, F.coalesce(n, f"_start_of_{n}"))
    return rows.drop("_block", *(f"_start_of_{n}" for n in values))


def streaks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: float = BLOCK) -> DataFrame:
    """``rows`` with run_start (order[0] of the first row of the run of equal ``value`` that a row is in) and run_length (rows of it so far).

    Null is a value like others. A run may go on over any number of blocks: what is carried is where the last one began.
    """
    rows = running(rows, keys, order, {"_place": F.lit(1)}, block)
    rows = lagged(rows.withColumn("_value", F.struct(value)), keys, order, "_value", "_before", block)
    starts = F.when(F.col("_before").isNull() | ~F.col("_value").eqNullSafe(F.col("_before")), F.struct(F.col(order[0]).alias("at"), F.col("_place").alias("place")))
    rows = latest(rows, keys, order, {"_start": starts}, block)
    return rows.withColumn("run_start", F.col("_start.at")).withColumn("run_length", F.col("_place") - F.col("_start.place") + 1).drop("_place", "_value", "_before", "_start")

"""Joins on time: price as of a moment, the next ticks after it, ticks inside an interval.

Moments and ticks are put in one order by time inside (symbol, block of time), and what a block starts or ends
with is carried over from the other blocks: no join of moments with ticks, and a hot symbol is many tasks.
No moment is lost: one without a time has no price and no ticks after it, one without a symbol those of the ticks
without one. Ticks without a time take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import micros
from tidemark.operators.ordered import BLOCK, in_block, rejoined

TICK = "struct<us:bigint,price:double>"


def _together(moments: DataFrame, ticks: DataFrame, at: str, block: float, keys: Sequence[str] = ("symbol",)) -> tuple[DataFrame, list[str]]:
    """Moments (_kind 1, with their other columns in _own) and ticks (_kind 0, with _tick) by keys and _block."""
    own = [c for c in moments.columns if c not in (*keys, at)]
    right = ticks.where("us IS NOT NULL").select(*keys, F.col("us").alias("_us"), F.lit(0).alias("_kind"), F.col("event_id").alias("_tie"), F.struct("us", "price").alias("_tick"))
    left = moments.select(*keys, F.col(at).alias("_us"), F.lit(1).alias("_kind"), F.struct(F.lit(1).alias("_"), *own).alias("_own"))
    return left.unionByName(right, allowMissingColumns=True).withColumn("_block", in_block("_us", block)), own


def _result(rows: DataFrame, at: str, own: list[str], found: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return rows.select(*keys, F.col("_us").alias(at), *(F.col(f"_own.{c}").alias(c) for c in own), found)


def price_asof(moments: DataFrame, ticks: DataFrame, at: str = "target_us", forward: bool = True, block: float = BLOCK, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``moments`` (keys, ``at``, ...) with price: of the last tick not after the moment, else (``forward``) of the first one after it.

    ticks: keys, us, event_id (order among equal times) and price, which may be of any type.
    """
    rows, own = _together(moments, ticks, at, block, keys)
    order = F.struct("_us", "_tie")
    blocks = rows.groupBy(*keys, "_block").agg(F.max_by("_tick.price", F.when(F.col("_kind") == 0, order)).alias("_last"), F.min_by("_tick.price", F.when(F.col("_kind") == 0, order)).alias("_first"))
    by_block = Window.partitionBy(*keys)
    before = F.last("_last", ignorenulls=True).over(by_block.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", ignorenulls=True).over(by_block.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))
    edges = blocks.select(*keys, "_block", before.alias("_before"), after.alias("_after"))
    inside = Window.partitionBy(*keys, "_block")
    frame = (Window.unboundedPreceding, 0)
    rows = rows.withColumn("_back", F.last("_tick.price", ignorenulls=True).over(inside.orderBy("_us", "_kind", "_tie").rowsBetween(*frame)))
    if forward:
        rows = rows.withColumn("_ahead", F.last("_tick.price", ignorenulls=True).over(inside.orderBy(F.desc("_us"), F.desc("_kind"), F.desc("_tie")).rowsBetween(*frame)))
    rows = rejoined(rows.where("_kind = 1"), edges, [*keys, "_block"])
    price = F.coalesce("_back", "_before", *(("_ahead", "_after") if forward else ()))
    return _result(rows.withColumn("price", F.when(F.col("_us").isNotNull(), price)), at, own, "price", keys)


def next_ticks(moments: DataFrame, ticks: DataFrame, k: int, at: str = "at_us", block: float = BLOCK) -> DataFrame:
    """``moments`` with ``next``, the array (us, price) of the first k ticks strictly after the moment."""
    rows, own = _together(moments, ticks, at, block)
    none = F.array().cast(f"array<{TICK}>")
    # each tick carries itself and those that follow it in its block
    among = Window.partitionBy("symbol", "_block", "_kind").orderBy("_us", "_tie")
    ahead = F.array_compact(F.array("_tick", *(F.lead("_tick", i).over(among) for i in range(1, k))))
    rows = rows.withColumn("_ahead", F.when(F.col("_kind") == 0, ahead))
    # the first k ticks of the later blocks: each of the next k blocks that have ticks gives one at least
    first = rows.where("_kind = 0").groupBy("symbol", "_block").agg(F.min_by("_ahead", F.struct("_us", "_tie")).alias("_first"))
    blocks = rejoined(rows.select("symbol", "_block").distinct(), first, ["symbol", "_block"], "left")
    later = Window.partitionBy("symbol").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    # the blocks with ticks are numbered from the last one back
    blocks = blocks.withColumn("_n", F.count("_first").over(later))
    has = blocks.where("_first IS NOT NULL").select("symbol", (F.col("_n") + 1).alias("_n"), "_first")
    near = F.collect_list("_first").over(Window.partitionBy("symbol").orderBy("_n").rowsBetween(-(k - 1), 0))
    in_order = F.slice(F.flatten(F.reverse(near)), 1, k)
    edges = rejoined(blocks.select("symbol", "_block", "_n"), has.select("symbol", "_n", in_order.alias("_after")), ["symbol", "_n"], "left")
    back = Window.partitionBy("symbol", "_block").orderBy(F.desc("_us"), F.desc("_kind"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_found", F.last("_ahead", ignorenulls=True).over(back)).where("_kind = 1")
    rows = rejoined(rows, edges, ["symbol", "_block"])
    found = F.slice(F.concat(F.coalesce("_found", none), F.coalesce("_after", none)), 1, k)
    return _result(rows.withColumn("next", F.when(F.col("_us").isNotNull(), found).otherwise(none)), at, own, "next")


def range_join(intervals: DataFrame, ticks: DataFrame, bucket: float, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Each interval (symbol, ``start``, ``end``, ...) with every tick inside it, ends included.

    Intervals are spread over time buckets of ``bucket`` seconds, so the join is an equi-join with a check.
    """
    size = micros(bucket)
    wide = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    narrow = ticks.select("symbol", F.col("us"), F.col("event_id"), F.col("price"), F.floor(F.col("us") / size).alias("_bucket"))
    return wide.join(narrow, ["symbol", "_bucket"]).where((F.col("us") >= F.col(start)) & (F.col("us") <= F.col(end))).drop("_bucket")


def within(rows: DataFrame, as_of: Column, seconds: float, time: str = "us") -> DataFrame:
    """``rows`` of the last ``seconds`` before the moment ``as_of`` (microseconds), both ends included."""
    return rows.where((F.col(time) <= as_of) & (F.col(time) >= as_of - micros(seconds)))

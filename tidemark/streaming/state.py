"""Stateful processors: the ticks of the last minutes per symbol, and labels that come due at a moment.

Both keep their state by symbol in the state store and use event time: the watermark is the clock, timers
fire when it has passed them, and rows behind it never reach a processor. State is bounded by time, not by
what has been seen: ticks are let go as soon as neither the window nor any open prediction can ask for them.
Sessions need the RocksDB state store, see :func:`with_state_store`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import TimeScale, micros
from tidemark.streaming.ingest import LATE

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TICK = "us bigint, event_id bigint, price double"
RECENT = "symbol string, as_of_us bigint, n_ticks bigint, first_us bigint, low double, high double, price double, ticks array<struct<us:bigint,event_id:bigint,price:double>>"
DUE = "symbol string, prediction_id bigint, direction string, price_then double, at_us bigint, target_us bigint, actual_price double"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _micros(column: str = "ts"):
    return F.unix_micros(column).alias("us")


class RecentTicks(StatefulProcessor):
    """Keeps the ticks of the last ``seconds`` before a symbol's newest one, and lets all go when the watermark is that far ahead."""

    def __init__(self, seconds: float):
        self.reach = micros(seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getListState("ticks", TICK)

    def _keep(self, ticks: list[tuple]) -> None:
        if ticks:
            self.ticks.put(ticks)
        else:
            self.ticks.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = set(map(tuple, self.ticks.get()))
        for frame in rows:
            ticks.update(zip(frame["us"].tolist(), frame["event_id"].tolist(), frame["price"].tolist(), strict=True))
        newest = max(t[0] for t in ticks)
        ticks = sorted(t for t in ticks if t[0] >= newest - self.reach)
        self._keep(ticks)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer((newest + self.reach) // 1000 + 1)
        yield self._snapshot(key[0], newest, ticks)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = expiredTimerInfo.getExpiryTimeInMs() * 1000
        left = sorted(t for t in map(tuple, self.ticks.get()) if t[0] >= clock - self.reach)
        self._keep(left)
        yield self._snapshot(key[0], clock, left)

    def _snapshot(self, symbol: str | None, as_of: int, ticks: list[tuple]) -> pd.DataFrame:
        prices = [t[2] for t in ticks]
        row = (symbol, as_of, len(ticks), ticks[0][0] if ticks else None, min(prices, default=None), max(prices, default=None), prices[-1] if ticks else None, [dict(zip(("us", "event_id", "price"), t, strict=True)) for t in ticks])
        frame = pd.DataFrame([row], columns=["symbol", "as_of_us", "n_ticks", "first_us", "low", "high", "price", "ticks"])
        return frame.astype({"first_us": "Int64", "low": "Float64", "high": "Float64", "price": "Float64"})


def recent_ticks(ticks: DataFrame, seconds: float = TimeScale().history, late: str = LATE) -> DataFrame:
    """Per symbol and micro-batch: the ticks (symbol, ts, event_id, price) of the last ``seconds`` before its newest one.

    A tick that comes twice counts once, one that comes out of order takes its place, one older than the window is left out.
    A symbol that has been quiet for ``seconds`` gives one empty row, and its state is gone.
    """
    rows = ticks.where("ts IS NOT NULL AND price IS NOT NULL").withWatermark("ts", late).select("symbol", "ts", _micros(), "event_id", "price")
    return rows.groupBy("symbol").transformWithStateInPandas(RecentTicks(seconds), RECENT, "Append", "EventTime")


class DueLabels(StatefulProcessor):
    """Holds predictions until the watermark has passed their target, and looks up the price as of then among the ticks held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getListState("ticks", TICK)
        self.open = handle.getListState("open", "prediction_id bigint, direction string, price_then double, at_us bigint, target_us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks, waiting = set(map(tuple, self.ticks.get())), list(map(tuple, self.open.get()))
        for frame in rows:
            for r in frame.itertuples(index=False):
                if pd.isna(r.target_us):
                    ticks.add((int(r.us), int(r.event_id), float(r.price)))
                else:
                    then = None if pd.isna(r.price_then) else float(r.price_then)
                    waiting.append((int(r.event_id), r.direction, then, int(r.us), int(r.target_us)))
        yield self._settle(key[0], sorted(ticks), waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key[0], sorted(map(tuple, self.ticks.get())), list(map(tuple, self.open.get())), timerValues.getCurrentWatermarkInMs())

    def _settle(self, symbol: str | None, ticks: list[tuple], waiting: list[tuple], watermark_ms: int) -> pd.DataFrame:
        clock = watermark_ms * 1000
        done, left = [], []
        for p in waiting:
            before = [t for t in ticks if t[0] <= p[4]]
            after = next((t for t in ticks if t[0] > p[4]), None)
            # a price is sure when nothing that could change it can come any more
            if p[4] < clock and before:
                done.append((symbol, *p, before[-1][2]))
            elif p[4] < clock and after and after[0] < clock:
                done.append((symbol, *p, after[2]))
            else:
                left.append(p)
        # what an open prediction, or one still to come, may ask for: the last tick up to its target and all later ones
        earliest = min([p[4] for p in left] + [max(clock, 0)])
        last = max((k for k, t in enumerate(ticks) if t[0] <= earliest), default=0)
        ticks = ticks[last:]
        for state, rows in ((self.ticks, ticks), (self.open, left)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        due = set()
        for p in left:
            after = next((t for t in ticks if t[0] > p[4]), None)
            if p[4] >= clock:
                due.add(p[4] // 1000 + 1)
            elif after:
                due.add(after[0] // 1000 + 1)
        held = set(self.handle.listTimers())
        for t in held - due:
            self.handle.deleteTimer(t)
        for t in due - held:
            self.handle.registerTimer(t)
        frame = pd.DataFrame(done, columns=["symbol", "prediction_id", "direction", "price_then", "at_us", "target_us", "actual_price"])
        return frame.astype({"price_then": "Float64", "prediction_id": "int64", "at_us": "int64", "target_us": "int64", "actual_price": "float64"})


def due_labels(predictions: DataFrame, ticks: DataFrame, late: str = LATE) -> DataFrame:
    """Predictions (symbol, ts, prediction_id, direction, price_then, target) with the price as of their target, once it is sure.

    The price is that of the last tick (symbol, ts, event_id, price) not after the target, else of the first one after it, as
    in the batch join. Adds actual_direction and correct (null where nothing was said or the price then isn't known).
    """
    asked = predictions.where("ts IS NOT NULL AND target IS NOT NULL").select(
        "symbol", "ts", _micros(), F.col("prediction_id").alias("event_id"), F.lit(None).cast("double").alias("price"), "direction", "price_then", F.unix_micros("target").alias("target_us")
    )
    seen = ticks.where("ts IS NOT NULL AND price IS NOT NULL").select(
        "symbol", "ts", _micros(), "event_id", "price", F.lit(None).cast("string").alias("direction"), F.lit(None).cast("double").alias("price_then"), F.lit(None).cast("bigint").alias("target_us")
    )
    rows = asked.unionByName(seen).withWatermark("ts", late)
    rows = rows.groupBy("symbol").transformWithStateInPandas(DueLabels(), DUE, "Append", "EventTime")
    moved = F.col("actual_price") - F.col("price_then")
    actual = F.when(moved > 0, "UP").when(moved < 0, "DOWN").when(moved == 0, "FLAT")
    rows = rows.withColumn("actual_direction", actual)
    return rows.withColumn("correct", F.when(F.col("direction").isin("UP", "DOWN"), F.col("direction") == F.col("actual_direction")))

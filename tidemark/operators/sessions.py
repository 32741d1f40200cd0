"""Sessions cut where ticks pause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import micros
from tidemark.operators.asof import price_asof
from tidemark.operators.ordered import lagged, running


def with_sessions(ticks: DataFrame, gap: float) -> DataFrame:
    """``ticks`` with gap_us (since the tick before, null for a symbol's first) and session_num; a pause of exactly ``gap`` seconds cuts."""
    order = ["us", "event_id"]
    rows = lagged(ticks, ["symbol"], order, "us", "_before").withColumn("gap_us", F.col("us") - F.col("_before")).drop("_before")
    cut = F.when(F.col("gap_us") >= micros(gap), 1).otherwise(0)
    return running(rows, ["symbol"], order, {"session_num": cut})


def session_stats(ticks: DataFrame, gap: float) -> DataFrame:
    """symbol, session_num, start_us, end_us, gap_before_us, n_ticks, status and reason of every session."""
    rows = with_sessions(ticks, gap)
    out = rows.groupBy("symbol", "session_num").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min_by("gap_us", F.struct("us", "event_id")).alias("gap_before_us"), F.count(F.lit(1)).alias("n_ticks")
    )
    is_last = F.col("session_num") == F.max("session_num").over(Window.partitionBy("symbol"))
    return out.withColumn("status", F.when(is_last, "ACTIVE").otherwise("INTERRUPTED")).withColumn("reason", F.when(F.col("gap_before_us").isNull(), "startup").otherwise("gap"))


def rounds_in_sessions(rounds: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rounds`` (symbol, start_us, ...) with the number of the session that runs at their start: the newest one begun by then, else null."""
    begun = sessions.select("symbol", F.col("start_us").alias("us"), F.col("session_num").alias("event_id"), F.col("session_num").cast("double").alias("price"))
    found = price_asof(rounds, begun, "start_us", forward=False)
    return found.withColumn("session_num", F.col("price").cast("bigint")).drop("price")

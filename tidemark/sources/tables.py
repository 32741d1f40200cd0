"""Adapters from the generated tables to ticks, rounds and their like.

Times are microseconds since 1970 (bigint), so arithmetic on them is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SPARSE, TimeScale, micros

BASE_PRICE = 1_000_000.0  # makes relative moves as small as those of a price series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with ``us``, their time in microseconds whatever the session's time zone is."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").withColumn("us", us)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, us, event_id (order among equal times), price."""
    return events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "us", "event_id", (F.lit(BASE_PRICE) + F.col("value")).alias("price"))


def rounds(ticks: DataFrame, scale: TimeScale = SPARSE) -> DataFrame:
    """Tumbling rounds by symbol: symbol, round_num, times, first and last price, winner (1 up, 2 down, 0 neither)."""
    length, play = micros(scale.round_length), micros(scale.round_length * scale.play_share)
    order = F.struct("us", "event_id")
    rows = ticks.groupBy("symbol", F.floor(F.col("us") / length).alias("round_num")).agg(
        F.min_by("price", order).alias("start_price"), F.max_by("price", order).alias("end_price"), F.count(F.lit(1)).alias("n_ticks")
    )
    start = F.col("round_num") * length
    side = F.when(F.col("end_price") > F.col("start_price"), 1).when(F.col("end_price") < F.col("start_price"), 2).otherwise(0)
    return rows.select(
        "symbol", "round_num", start.alias("start_us"), (start + play).alias("cutoff_us"), (start + length).alias("end_us"), "start_price", "end_price", "n_ticks",
        side.alias("win_side"), F.when(side == 1, "UP").when(side == 2, "DOWN").otherwise("UNRESOLVED").alias("raw_direction"),
    )

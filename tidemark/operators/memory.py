"""Pattern memory: what followed a signature, as of now or strictly as of an earlier time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, wilson_direction
from tidemark.operators.ordered import rejoined, running

LATEST, LEAST = 50, 40


def latest_rates(outcomes: DataFrame, keys: Sequence[str] = ("signature",), latest: int = LATEST, least: int = LEAST, order: Sequence[str] = ("us", "event_id")) -> DataFrame:
    """For each key: all outcomes, ups among the ``latest`` ones, the rate, and the direction it supports.

    outcomes: the keys, ``order`` and result UP or DOWN; other results are left out.
    """
    rows = outcomes.where(F.col("result").isin("UP", "DOWN"))
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    rows = rows.withColumn("_rank", F.row_number().over(newest))
    recent = F.col("_rank") <= latest
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("result") == "UP").alias("ups"), F.count_if(recent).alias("n_recent"), F.count_if(recent & (F.col("result") == "UP")).alias("up_recent")
    )
    direction, confidence = wilson_direction(F.col("up_recent"), F.col("n_recent"), least)
    return out.withColumn("recent_rate", ratio(F.col("up_recent"), F.col("n_recent"))).withColumn("direction", direction).withColumn("confidence", confidence)


def point_in_time(observations: DataFrame, latest: int = LATEST, least: int = LEAST) -> DataFrame:
    """Observations (signature, us, event_id, label_us, result) with what memory knew of their signature at ``us``.

    Lookups and labels stand in one order by time, labels first. A lookup sees the labels so far: their number
    n and, for the latest ``latest`` of them, the ups: the running sum at label n less that at label n - latest.
    Sums run block by block, so that a frequent signature is many tasks. A label without a time is never known, a lookup
    without one knows nothing.
    """
    key = [c for c in observations.columns if c not in ("us", "event_id", "label_us", "result")]
    up = F.when(F.col("result") == "UP", 1).otherwise(0)
    labels = observations.where(F.col("result").isin("UP", "DOWN") & F.col("label_us").isNotNull()).select(*key, F.col("label_us").alias("_us"), F.lit(0).alias("_kind"), "event_id", up.alias("_up"))
    lookups = observations.select(*key, F.col("us").alias("_us"), F.lit(1).alias("_kind"), "event_id", F.lit(None).cast("int").alias("_up"))
    order = ["_us", "_kind", "event_id"]
    rows = running(labels.unionByName(lookups), key, order, {"_n": F.when(F.col("_up").isNull(), 0).otherwise(1), "_sum": F.coalesce("_up", F.lit(0))})
    seen = rows.where("_kind = 0").select(*key, F.col("_n").alias("_old"), F.col("_sum").alias("_before"))
    asked = rows.where("_kind = 1").withColumn("_old", F.col("_n") - latest)
    found = rejoined(asked, seen, [*key, "_old"], "left")
    n, ups = F.least(F.col("_n"), F.lit(latest)), F.col("_sum") - F.coalesce("_before", F.lit(0))
    direction, confidence = wilson_direction(F.col("up_seen"), F.col("n_seen"), least)
    found = found.select(*key, F.col("_us").alias("us"), "event_id", n.alias("n_seen"), ups.alias("up_seen"))
    return found.withColumn("direction", direction).withColumn("confidence", confidence)

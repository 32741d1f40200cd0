"""Predictions at a round's cutoff, their status, and what the market did by their target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import TimeScale, micros
from tidemark.operators.asof import next_ticks, price_asof


def predictions(says: DataFrame, rounds: DataFrame, ticks: DataFrame, scale: TimeScale) -> DataFrame:
    """``says`` (symbol, round_num, engine, direction) as predictions made at the round's cutoff, with the price then."""
    cutoffs = rounds.select("symbol", "round_num", F.col("cutoff_us").alias("at_us"))
    priced = price_asof(cutoffs, ticks, "at_us", forward=False).withColumnRenamed("price", "price_then")
    return says.join(priced, ["symbol", "round_num"]).withColumn("target_us", F.col("at_us") + micros(scale.horizon))


def outcomes(predicted: DataFrame, ticks: DataFrame) -> DataFrame:
    """Predictions with the price at their target, the move and whether they were right (null unless UP or DOWN was said and the price is known)."""
    targets = price_asof(predicted.select("symbol", "target_us").distinct(), ticks).withColumnRenamed("price", "actual_price")
    rows = predicted.join(targets, ["symbol", "target_us"])
    moved = F.col("actual_price") - F.col("price_then")
    actual = F.when(moved > 0, "UP").when(moved < 0, "DOWN").when(moved == 0, "FLAT")
    right = F.when(F.col("direction").isin("UP", "DOWN") & actual.isNotNull(), F.col("direction") == actual)
    return rows.select("*", moved.alias("price_difference"), (moved / F.col("price_then") * 100).alias("percentage_difference"), actual.alias("actual_direction"), right.alias("correct"))


def prediction_status(now_us: Column, cutoff_us: Column, buffer_s: float = 2.0) -> tuple[Column, Column]:
    """Lead time in whole milliseconds to the lock (``buffer_s`` before the cutoff), and INVALID, LATE or LOCKED."""
    lead = ((cutoff_us - micros(buffer_s) - now_us) / 1000).cast("bigint")
    return lead, F.when(now_us >= cutoff_us, "INVALID").when(lead < int(buffer_s * 1000), "LATE").otherwise("LOCKED")


def accuracy_label(total: Column, accuracy: Column) -> Column:
    return F.when(total == 0, "learning").when(accuracy.isNull(), "pending").when(accuracy >= 0.55, "edge").when(accuracy >= 0.50, "marginal").otherwise("below_chance")


def model_scores(forecasts: DataFrame, moved: DataFrame, ticks: DataFrame, k: int) -> DataFrame:
    """Each model's forecast of the next ``k`` ticks against those that came after the round's moment.

    forecasts: symbol, round_num, price_now and models (model, weight, direction, values: prices); moved: symbol, round_num, at_us, result.
    symbol, round_num, model, weight, direction, expected, actual, endpoint_error, trajectory_rms, internal_correct (the way to the
    k-th tick) and target_correct (the way to the horizon); the flags are null where a side is neither UP nor DOWN. A round with fewer
    ticks after it gives no rows, nor does a forecast of another length. Ticks are looked up once a round, then models are taken apart.
    """
    rows = forecasts.join(moved.select("symbol", "round_num", "at_us", "result"), ["symbol", "round_num"])
    rows = next_ticks(rows, ticks, k).where(F.size("next") == k).withColumn("actual", F.transform("next", lambda x: x.price))
    rows = rows.select("symbol", "round_num", "price_now", "result", "actual", F.inline("models")).where(F.size("values") == k)
    gaps = F.zip_with("values", "actual", lambda a, b: a - b)
    came = F.signum(F.element_at("actual", -1) - F.col("price_now"))
    went = F.when(came > 0, "UP").when(came < 0, "DOWN")
    says = F.col("direction").isin("UP", "DOWN")
    return rows.withColumn("_gaps", gaps).select(
        "symbol", "round_num", "model", "weight", "direction", F.col("values").alias("expected"), "actual", F.abs(F.element_at("_gaps", -1)).alias("endpoint_error"),
        F.sqrt(F.aggregate("_gaps", F.lit(0.0), lambda a, g: a + g * g) / k).alias("trajectory_rms"), F.when(says, F.col("direction") == went).alias("internal_correct"),
        F.when(says & F.col("result").isin("UP", "DOWN"), F.col("direction") == F.col("result")).alias("target_correct"),
    )


def as_models(expected: DataFrame, name: str) -> DataFrame:
    """Forecasts (symbol, round_num, direction, expected_price) of one price as :func:`model_scores` takes them."""
    one = F.struct(F.lit(name).alias("model"), F.lit(None).cast("double").alias("weight"), F.col("direction"), F.array("expected_price").alias("values"))
    return expected.where("expected_price IS NOT NULL").select("symbol", "round_num", F.lit(None).cast("double").alias("price_now"), F.array(one).alias("models"))

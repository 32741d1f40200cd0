"""Prices as angles over a reference range, with their trigonometric functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import within

#: Fixed value: below it a denominator counts as zero.
SINGULAR = 0.02


def trig_states(ticks: DataFrame, as_of: Column, seconds: float, reference: float) -> DataFrame:
    """Ticks of the last ``seconds`` before ``as_of``: theta runs from 0 to 2 pi over the symbol's price range in the ``reference`` seconds before it.

    Where that range is empty or of no width, the range of the ticks themselves takes its place. tan, cot, sec and csc
    are null where their denominator is about zero; ``singular`` counts these.
    """
    rows = within(ticks, as_of, seconds)
    wide = within(ticks, as_of, max(reference, seconds)).groupBy("symbol")
    inside, own = (F.when(F.col("us") >= as_of - round(x * 1_000_000), F.col("price")) for x in (reference, seconds))
    spans = wide.agg(F.min(inside).alias("low"), F.max(inside).alias("high"), F.min(own).alias("own_low"), F.max(own).alias("own_high"))
    usable = F.coalesce(F.col("high") > F.col("low"), F.lit(False))
    low, high = F.when(usable, F.col("low")).otherwise(F.col("own_low")), F.when(usable, F.col("high")).otherwise(F.col("own_high"))
    spans = spans.select("symbol", low.alias("low"), F.when(high > low, high - low).otherwise(1.0).alias("span"))
    rows = rows.join(spans, "symbol").withColumn("theta", 2 * math.pi * (F.col("price") - F.col("low")) / F.col("span"))
    rows = rows.withColumn("sin", F.sin("theta")).withColumn("cos", F.cos("theta"))
    s, c = (F.when(F.abs(x) >= SINGULAR, F.col(x)) for x in ("sin", "cos"))
    parts = {"tan": F.col("sin") / c, "cot": F.col("cos") / s, "sec": 1 / c, "csc": 1 / s}
    rows = rows.select("symbol", "us", "event_id", "price", "theta", "sin", "cos", *(v.alias(k) for k, v in parts.items()))
    return rows.withColumn("singular", sum((F.col(k).isNull().cast("int") for k in parts), F.lit(0)))

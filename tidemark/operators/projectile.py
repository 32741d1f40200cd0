"""Kinematic fit of a round's play period: height over time as a parabola, by power sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.functions.columns import ladder
from tidemark.operators.asof import range_join

UNIT = 0.001  # of the first price: ten basis points


def projectile(rounds: DataFrame, ticks: DataFrame, scale: TimeScale) -> DataFrame:
    """symbol, round_num, n_points, y0, vy0, ay, rms, consistency, signature, direction and expected_price (at the cutoff) of rounds with three ticks in play.

    Time runs from 0 to 1 over the play period while fitting, which keeps the sums well-conditioned.
    """
    span = scale.round_length * scale.play_share
    played = range_join(rounds.select("symbol", "round_num", "start_us", "cutoff_us"), ticks, span, end="cutoff_us")
    order = Window.partitionBy("symbol", "round_num").orderBy("us", "event_id")
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = played.withColumn("p0", F.first("price").over(first)).withColumn("t0", F.first("us").over(first))
    rows = rows.select("symbol", "round_num", "us", "event_id", "p0", ((F.col("us") - F.col("t0")) / 1e6 / span).alias("t"), ((F.col("price") - F.col("p0")) / (F.col("p0") * UNIT)).alias("y"))
    # local accelerations in seconds
    seconds = F.greatest((F.col("t") - F.lag("t").over(order)) * span, F.lit(1e-9))
    rows = rows.withColumn("dt", seconds).withColumn("v", (F.col("y") - F.lag("y").over(order)) / F.col("dt"))
    rows = rows.withColumn("a", (F.col("v") - F.lag("v").over(order)) / F.col("dt"))
    powers = [F.sum(F.pow("t", F.lit(k))).alias(f"s{k}") for k in range(1, 5)] + [F.sum(F.pow("t", F.lit(k)) * F.col("y")).alias(f"m{k}") for k in range(3)]
    g = rows.groupBy("symbol", "round_num").agg(
        F.count(F.lit(1)).alias("n_points"), *powers, F.sum(F.col("y") * F.col("y")).alias("yy"), F.max_by("y", F.struct("us", "event_id")).alias("y_now"), F.max("p0").alias("p0"), F.coalesce(F.stddev_pop("a"), F.lit(0.0)).alias("spread")
    )
    n, s1, s2, s3, s4, m0, m1, m2 = (F.col(x) for x in ("n_points", "s1", "s2", "s3", "s4", "m0", "m1", "m2"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    g = g.where("n_points >= 3").withColumn("det", det).where("abs(det) > 1e-12")
    c0 = (m0 * (s2 * s4 - s3 * s3) - s1 * (m1 * s4 - s3 * m2) + s2 * (m1 * s3 - s2 * m2)) / F.col("det")
    c1 = (n * (m1 * s4 - s3 * m2) - m0 * (s1 * s4 - s2 * s3) + s2 * (s1 * m2 - s2 * m1)) / F.col("det")
    c2 = (n * (s2 * m2 - m1 * s3) - s1 * (s1 * m2 - s2 * m1) + m0 * (s1 * s3 - s2 * s2)) / F.col("det")
    g = g.withColumn("c0", c0).withColumn("c1", c1).withColumn("c2", c2)
    error = F.col("yy") - F.col("c0") * m0 - F.col("c1") * m1 - F.col("c2") * m2  # of the least squares
    error = F.when(n == 3, 0.0).otherwise(F.greatest(error, F.lit(0.0)))  # a parabola meets three points
    g = g.withColumn("rms", F.sqrt(error / n)).withColumn("ay", 2 * F.col("c2") / (span * span))
    spread = F.when(n >= 4, F.col("spread")).otherwise(F.lit(0.0))
    g = g.withColumn("consistency", F.exp(-5 * (F.col("rms") + spread)) * F.when(F.col("ay") < 0, 1.0).otherwise(0.5))
    # the peak, where the parabola opens downwards and its top lies ahead
    top = F.when((F.col("ay") < -1e-9) & (F.col("c1") > 0), F.col("c0") - F.col("c1") * F.col("c1") / (4 * F.col("c2")))
    height = F.when(top.isNull(), 0).when(top < 0.5, 1).when(top < 2.0, 2).otherwise(3)
    delta = F.col("c0") + F.col("c1") + F.col("c2") - F.col("y_now")
    return g.select(
        "symbol", "round_num", "n_points", F.col("c0").alias("y0"), (F.col("c1") / span).alias("vy0"), "ay", "rms", "consistency",
        F.format_string("proj:a%d_c%d_h%d", ladder(F.col("c1"), (-1.0, -0.2, 0.2, 1.0)), ladder(F.round("consistency", 9), (0.2, 0.5, 0.75)), height).alias("signature"),
        F.when(delta > 1e-4, "UP").when(delta < -1e-4, "DOWN").alias("direction"), (F.col("p0") + (F.col("c0") + F.col("c1") + F.col("c2")) * F.col("p0") * UNIT).alias("expected_price"),
    )

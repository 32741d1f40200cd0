"""The flow engine: a feature vector of a short window, scored by a logistic model whose weights are an argument.

Features and score are columns over the window's array of ticks. Without weights the engine says nothing and
why; nobody publishes weights, so whoever has some passes them as JSON to :func:`load_weights`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.functions.columns import ladder, last, sigmoid, total
from tidemark.operators.engines import latest_windows

# Ticks in a window, ticks needed, probability that speaks, edges of the probability's bins and the features' names in the weights.
WINDOW, LEAST, THRESHOLD = 40, 45, 0.58
EDGES = (0.50, 0.60, 0.70, 0.85)
FEATURES = (
    "velocity", "acceleration", "jerk", "curvature", "diffusion", "terrain_volatility", "path_signed", "path_absolute", "flow_inertia", "flow_viscous", "pressure_proxy",
    "advection", "trend_fast", "trend_slow", "velocity_consistency",
)
FAST, SLOW, CONSISTENT, REACH = 8, 16, 12, 10.0


@dataclass(frozen=True)
class FlowWeights:
    weights: tuple[float, ...]  # as FEATURES
    bias: float = 0.0


def load_weights(text: str | None) -> tuple[FlowWeights | None, str | None]:
    """Weights from JSON ({"weights": {feature: number, ...}, "bias": number}), or None and what is wrong with it."""
    if not (text or "").strip():
        return None, "no weights"
    try:
        data = json.loads(text)
        given, bias = data.get("weights", {}), float(data.get("bias", 0.0))
        missing = [n for n in FEATURES if n not in given]
        if missing:
            return None, "missing weights: " + ", ".join(missing)
        return FlowWeights(tuple(float(given[n]) for n in FEATURES), bias), None
    except (ValueError, TypeError, AttributeError) as error:
        return None, f"invalid weights: {error}"


def features(rows: DataFrame, window: str = "w") -> DataFrame:
    """``rows`` with the structs ``measured`` (the features of the array ``window``: us, price; oldest first) and ``flow`` (the same within the bounds that the score takes); null with fewer than four ticks or three steps in time.

    Steps without time between their ticks have no velocity. The time of the k-th change of velocity is that of the window's
    k-th step, whichever steps were left out before it.
    """
    w, n = F.col(window), F.size(window)

    def at(k: Column | int) -> Column:
        return F.element_at(w, k if isinstance(k, int) else k.cast("int"))

    step = F.transform(F.sequence(F.lit(2), n), lambda k: F.struct(((at(k).us - at(k - 1).us) / 1e6).alias("dt"), (at(k).price - at(k - 1).price).alias("dp"), at(k - 1).price.alias("p")))
    rows = rows.withColumn("_steps", F.when(n >= 4, step))
    rows = rows.withColumn("_v", F.transform(F.filter("_steps", lambda s: s.dt > 0), lambda s: s.dp / s.dt))
    v, m = F.col("_v"), F.size("_v")
    change = F.transform(F.sequence(F.lit(2), m), lambda k: F.when(F.element_at("_steps", k - 1).dt > 0, (F.element_at(v, k) - F.element_at(v, k - 1)) / F.element_at("_steps", k - 1).dt))
    rows = rows.withColumn("_a", F.when(m >= 3, F.array_compact(change)))
    rows = rows.withColumn("_r", F.transform(F.filter("_steps", lambda s: s.p != 0), lambda s: s.dp / s.p))
    price = F.transform(w, lambda x: x.price)
    rows = rows.withColumn("_p", F.when(F.col("_a").isNotNull(), price))

    def mean(x: Column) -> Column:
        return total(x) / F.size(x)

    p, now = F.col("_p"), F.element_at("_p", -1)
    velocity, size = F.element_at(v, -1), F.size("_a")
    acceleration = F.coalesce(F.try_element_at("_a", F.lit(-1)), F.lit(0.0))
    newest = F.element_at("_steps", -1).dt
    jerk = F.when((size >= 2) & (newest > 0), F.try_divide(F.try_element_at("_a", F.lit(-1)) - F.try_element_at("_a", F.lit(-2)), newest)).otherwise(0.0)
    diffusion = now - 2 * F.element_at(p, -2) + F.element_at(p, -3)
    middle = mean(F.col("_r"))
    volatility = F.when(F.size("_r") < 2, 0.0).otherwise(F.sqrt(F.aggregate("_r", F.lit(0.0), lambda a, r: a + (r - middle) * (r - middle)) / (F.size("_r") - 1)))
    scale = F.greatest(F.abs(now), F.lit(1e-12))

    def trend(ticks: int) -> Column:
        return F.when(F.abs(now) < 1e-12, 0.0).otherwise((now - mean(last(p, ticks))) / now)

    made = {
        "velocity": velocity / scale,
        "acceleration": acceleration / scale,
        "jerk": jerk / scale,
        "curvature": acceleration / F.pow(1 + velocity * velocity, F.lit(1.5)) / scale,
        "diffusion": diffusion / scale,
        "terrain_volatility": volatility,
        "path_signed": (now - F.element_at(p, 1)) / scale,
        "path_absolute": total(F.transform("_steps", lambda s: F.abs(s.dp))) / scale,
        "flow_inertia": (velocity + acceleration) / scale,
        "flow_viscous": diffusion / scale,
        "pressure_proxy": (mean(p) - now) / scale,
        "advection": velocity * acceleration / scale,
        "trend_fast": trend(FAST),
        "trend_slow": trend(SLOW),
        "velocity_consistency": mean(F.transform(last(v, CONSISTENT), lambda x: F.signum(x))),
    }
    reach = {"terrain_volatility": 1.0}
    rows = rows.withColumn("measured", F.when(F.col("_a").isNotNull(), F.struct(*(x.alias(k) for k, x in made.items()))))
    bounded = [F.greatest(F.lit(-reach.get(k, REACH)), F.least(F.lit(reach.get(k, REACH)), F.col(f"measured.{k}"))).alias(k) for k in made]
    return rows.withColumn("flow", F.when(F.col("measured").isNotNull(), F.struct(*bounded))).drop("_steps", "_v", "_a", "_r", "_p")


def scored(rows: DataFrame, weights: FlowWeights | None, enough: Column) -> DataFrame:
    """``rows`` (flow) with p_up, direction, confidence, signature and the reason for silence."""
    if weights is None:
        p = F.lit(None).cast("double")
    else:
        p = sigmoid(sum((F.lit(w) * F.col(f"flow.{n}") for n, w in zip(FEATURES, weights.weights, strict=True)), F.lit(weights.bias)))
    rows = rows.withColumn("p_up", F.when(enough & F.col("flow").isNotNull(), p))
    up = F.col("p_up") >= 0.5
    rows = rows.withColumn("_sure", F.when(up, F.col("p_up")).otherwise(1 - F.col("p_up")))
    signature = F.concat(F.lit("nsflow:"), F.when(up, "up").otherwise("down"), F.lit(":p"), ladder(F.col("_sure"), EDGES).cast("string"))
    reason = F.when(F.lit(weights is None), "weights not loaded").when(~F.coalesce(enough, F.lit(False)), "insufficient ticks").when(F.col("flow").isNull(), "feature extraction failed").when(F.col("_sure") < THRESHOLD, "below threshold")
    rows = rows.withColumn("reason", reason).withColumn("signature", F.when(F.col("p_up").isNotNull(), signature))
    speaks = F.col("reason").isNull()
    return rows.withColumn("direction", F.when(speaks, F.when(up, "UP").otherwise("DOWN")).otherwise("NO_SIGNAL")).withColumn("confidence", F.when(speaks, F.col("_sure"))).drop("_sure")


def flow(ticks: DataFrame, scale: TimeScale, weights: FlowWeights | None, wanted: Column | None = None) -> DataFrame:
    """symbol, us, event_id, measured, flow, p_up, direction, confidence, signature and reason of every tick, or of those ``wanted`` as in :func:`tidemark.operators.engines.near`."""
    rows = latest_windows(ticks, scale, LEAST, wanted)
    enough = F.size("w") >= LEAST
    rows = rows.withColumn("_enough", enough).withColumn("w", last(F.col("w"), WINDOW))
    rows = scored(features(rows), weights, F.col("_enough"))
    return rows.select("symbol", "us", "event_id", "measured", "flow", "p_up", "direction", "confidence", "signature", "reason")

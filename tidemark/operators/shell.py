"""All engines side by side: their signatures as of each round's cutoff, and the direction that memory gives them.

An engine that fails on a window says nothing for it; the others go on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TimeScale, micros
from tidemark.functions import windows
from tidemark.functions.columns import ladder
from tidemark.operators import engines
from tidemark.operators.asof import price_asof, range_join
from tidemark.operators.candles import candlestick_signatures
from tidemark.operators.memory import point_in_time
from tidemark.operators.projectile import projectile
from tidemark.scratch import materialize

#: Engines whose signatures are columns of the last ticks or candles.
COLUMNS = ("crt", "labouchere", "entropy_regime", "candlestick")
#: The order in which engines are asked for a direction.
ORDER = (
    "crt", "labouchere", "trig_euler", "entropy_regime", "superformula", "navier_stokes", "candlestick", "momentum", "trail_tracer", "curve_geometry",
    "ns_flow", "trajectory", "projectile",
)


def before_cutoff(scale: TimeScale) -> Column:
    """True of the last tick not after a cutoff: the cutoff of its own round, or of the one before the next tick's."""
    length, play = micros(scale.round_length), micros(scale.round_length * scale.play_share)
    us, following = F.col("us"), F.col("next_us")
    cutoff = F.floor(us / length) * length + play
    return (us <= cutoff) & (following.isNull() | (following > cutoff)) | (us > cutoff) & (following.isNull() | (following > cutoff + length))


def column_facts(ticks: DataFrame, scale: TimeScale) -> DataFrame:
    """engine, symbol, us, event_id and price (a signature) of the engines in ``COLUMNS``, at the last tick before each cutoff or whenever a candle closes."""
    last = before_cutoff(scale)
    made = {"crt": engines.crt(ticks, scale, last), "labouchere": engines.labouchere(ticks, scale, last), "entropy_regime": engines.entropy_regime(ticks, scale, last)}
    out = None
    for name, found in made.items():
        rows = found.select(F.lit(name).alias("engine"), "symbol", "us", "event_id", F.col("signature").alias("price"))
        out = rows if out is None else out.unionByName(rows)
    closed = ((F.col("bucket") + 1) * micros(scale.candle)).alias("us")
    rows = candlestick_signatures(ticks, scale).select(F.lit("candlestick").alias("engine"), "symbol", closed, F.col("bucket").alias("event_id"), F.col("signature").alias("price"))
    return out.unionByName(rows)


def at_cutoffs(facts: DataFrame, rounds: DataFrame, names: Sequence[str]) -> DataFrame:
    """symbol, round_num, at_us, engine, signature: each engine's newest signature at each round's cutoff, null if it has none."""
    asked = F.explode(F.array(*map(F.lit, names))).alias("engine")
    moments = rounds.select("symbol", "round_num", F.col("cutoff_us").alias("at_us"), asked)
    return price_asof(moments, facts, "at_us", forward=False, keys=("engine", "symbol")).withColumnRenamed("price", "signature")


# Ticks that dwell needs, and the seconds that it looks back.
CURVE_RECENT, CURVE_BACKS = 40, (5.0, 15.0, 30.0, 60.0)


def play_points(rounds: DataFrame, ticks: DataFrame, scale: TimeScale, most: int = windows.CURVE_POINTS) -> DataFrame:
    """symbol, round_num, n_play and points: the ticks (us, price) of the play period in order, ``most`` of them evenly by number if there are more.

    Each tick is in one play period at most; which of them are taken is known from their number, before any array is made.
    """
    played = range_join(rounds.select("symbol", "round_num", "start_us", "cutoff_us"), ticks, scale.round_length * scale.play_share, end="cutoff_us")
    whole = Window.partitionBy("symbol", "round_num")
    rows = played.withColumn("_at", F.row_number().over(whole.orderBy("us", "event_id")) - 1).withColumn("n_play", F.count(F.lit(1)).over(whole))
    step = F.col("n_play") / float(most)
    about = F.ceil(F.col("_at") / step)  # the only number whose point this tick can be, but for rounding
    taken = F.exists(F.array(about - 1, about, about + 1), lambda i: i.between(0, most - 1) & (F.floor(i * step) == F.col("_at")))
    rows = rows.where((F.col("n_play") <= most) | taken)
    g = rows.groupBy("symbol", "round_num", "n_play").agg(F.sort_array(F.collect_list(F.struct("us", "event_id", "price"))).alias("_p"))
    return g.select("symbol", "round_num", "n_play", F.transform("_p", lambda x: F.struct(x.us.alias("us"), x.price.alias("price"))).alias("points"))


def curve_of_play(ticks: DataFrame, rounds: DataFrame, scale: TimeScale) -> DataFrame:
    """symbol, round_num, at_us, n_play, core and signature of the path of each round's play period; of the latest ticks where the period has too few.

    Dwell is looked for in the ticks of the last minute before the cutoff; it is 0 where the history holds fewer than ``CURVE_RECENT``.
    """
    factor = scale.history / TimeScale().history
    backs, reach = tuple(b * factor for b in CURVE_BACKS), micros(CURVE_BACKS[-1] * factor)
    # the newest tick at each cutoff, and the latest ones up to it: only of these few ticks are windows made
    latest = engines.latest_windows(ticks, scale, windows.CURVE_POINTS, before_cutoff(scale))
    facts = latest.select("symbol", "us", "event_id", F.struct("us", "w").alias("price"))
    found = price_asof(rounds.select("symbol", "round_num", F.col("cutoff_us").alias("at_us")), facts, "at_us", forward=False).where("price IS NOT NULL")
    found = materialize(found.select("symbol", "round_num", "at_us", "price.*").withColumn("enough", F.size("w") >= CURVE_RECENT), "latest-of-play")
    rows = found.join(play_points(rounds, ticks, scale), ["symbol", "round_num"], "left").withColumn("n_play", F.coalesce("n_play", F.lit(0)))
    rows = rows.select("symbol", "round_num", "at_us", F.col("n_play").cast("bigint").alias("n_play"), F.when(F.col("n_play") >= windows.CURVE_LEAST, F.col("points")).otherwise(F.col("w")).alias("v"), "enough")
    # each tick is in the minutes of a few cutoffs; a round's minute goes to Python by itself, as columns
    minutes = found.where("enough").select("symbol", "round_num", (F.col("us") - reach).alias("start_us"), F.col("us").alias("end_us"))
    minutes = range_join(minutes, ticks, reach / 1e6).select(F.col("symbol").alias("_symbol"), F.col("round_num").alias("_round"), "us", "event_id", "price")

    def judged(round_: pa.Table, minute: pa.Table) -> pa.Table:
        core, dwell = None, 0.0
        if round_.num_rows:
            try:
                core = windows.curve(*engines.arrays(round_["v"][0].as_py()))
                if core and round_["enough"][0].as_py():
                    minute = minute.take(pc.sort_indices(minute, [("us", "ascending"), ("event_id", "ascending"), ("price", "ascending")]))
                    dwell = windows.curve_dwell(minute["us"].to_numpy() / 1e6, minute["price"].to_numpy().astype(float), core, backs)
            except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
                core, dwell = None, 0.0
        out = round_.select(["symbol", "round_num", "at_us", "n_play"])
        return out.append_column("core", pa.array([core] * len(out), pa.string())).append_column("dwell", pa.array([dwell] * len(out), pa.float64()))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("symbol", "round_num", "at_us", "n_play")) + ", core string, dwell double"
    rows = rows.where("v IS NOT NULL").groupBy("symbol", "round_num").cogroup(minutes.groupBy("_symbol", "_round")).applyInArrow(judged, schema)
    signature = F.format_string("%s_dw%d", F.col("core"), ladder(F.col("dwell"), scale.dwell))
    return rows.where("core IS NOT NULL").select("symbol", "round_num", "at_us", "n_play", "core", signature.alias("signature"))


def moves(rounds: DataFrame, ticks: DataFrame, scale: TimeScale) -> DataFrame:
    """symbol, round_num, at_us, target_us, price_then, actual_price and result (UP, DOWN, FLAT) from the cutoff to the horizon."""
    then = price_asof(rounds.select("symbol", "round_num", F.col("cutoff_us").alias("at_us")), ticks, "at_us", forward=False).withColumnRenamed("price", "price_then")
    rows = price_asof(then.withColumn("target_us", F.col("at_us") + micros(scale.horizon)), ticks).withColumnRenamed("price", "actual_price")
    moved = F.col("actual_price") - F.col("price_then")
    return rows.withColumn("result", F.when(moved > 0, "UP").when(moved < 0, "DOWN").when(moved == 0, "FLAT"))


def directed(outputs: DataFrame, moved: DataFrame) -> DataFrame:
    """outputs (symbol, round_num, at_us, engine, signature) with n_seen, up_seen, direction and confidence from what had followed the signature by then."""
    rows = outputs.where(F.col("signature").isNotNull()).join(moved.select("symbol", "round_num", "target_us", "result"), ["symbol", "round_num"])
    seen = rows.select("engine", "signature", F.col("at_us").alias("us"), F.struct("symbol", "round_num").alias("event_id"), F.col("target_us").alias("label_us"), "result")
    known = point_in_time(seen).select("event_id.symbol", "event_id.round_num", F.col("us").alias("at_us"), "engine", "signature", "n_seen", "up_seen", "direction", "confidence")
    silent = outputs.where("signature IS NULL").select(
        "symbol", "round_num", "at_us", "engine", "signature", F.lit(0).cast("bigint").alias("n_seen"), F.lit(0).cast("bigint").alias("up_seen"), F.lit("NO_SIGNAL").alias("direction"), F.lit(None).cast("double").alias("confidence")
    )
    return known.unionByName(silent)


def decided(own: Column, strength: Column, recalled: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """Direction, confidence and decision_source of an engine with a direction of its own (null if none) beside the one that memory gives (NO_SIGNAL if none)."""
    speaks, known = own.isin("UP", "DOWN"), recalled.isin("UP", "DOWN")
    speaks, known = F.coalesce(speaks, F.lit(False)), F.coalesce(known, F.lit(False))
    agree = speaks & known & (own == recalled)
    direction = F.when(agree | (speaks & ~known), own).when(known & ~speaks, recalled).otherwise("NO_SIGNAL")
    sure = F.when(agree, F.least(F.lit(1.0), strength * (0.5 + 0.5 * confidence))).when(speaks & ~known, strength).when(known & ~speaks, confidence)
    source = F.when(agree, "agree").when(speaks & known, "disagree").when(speaks, "own_only").when(known, "pattern_fallback").otherwise("both_silent")
    return direction, sure, source


def with_own_direction(said: DataFrame, moved: DataFrame) -> DataFrame:
    """said (symbol, round_num, engine, signature, own_direction, strength) decided beside memory: symbol, round_num, engine, direction, confidence, decision_source, signature."""
    cutoffs = moved.select("symbol", "round_num", "at_us")
    recalled = directed(said.join(cutoffs, ["symbol", "round_num"]).select("symbol", "round_num", "at_us", "engine", "signature"), moved)
    rows = said.join(recalled.select("symbol", "round_num", "engine", F.col("direction").alias("recalled"), F.col("confidence").alias("sure")), ["symbol", "round_num", "engine"])
    direction, confidence, source = decided(F.col("own_direction"), F.col("strength"), F.col("recalled"), F.col("sure"))
    return rows.select("symbol", "round_num", "engine", direction.alias("direction"), confidence.alias("confidence"), source.alias("decision_source"), "signature")


def thrown(rounds: DataFrame, ticks: DataFrame, scale: TimeScale) -> DataFrame:
    """The projectile engine's own words at every cutoff, as :func:`with_own_direction` takes them."""
    rows = projectile(rounds, ticks, scale)
    return rows.select("symbol", "round_num", F.lit("projectile").alias("engine"), "signature", F.col("direction").alias("own_direction"), F.col("consistency").alias("strength"))

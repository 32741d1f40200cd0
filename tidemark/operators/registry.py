"""The engines under one protocol: what each says at every cutoff, who decides its direction, and why it is silent.

An engine is a function of ticks, rounds and scale that gives a row for each round it can speak of; whether it
is made of columns or of Arrow functions is its own affair. Each engine is run and written by itself, so
whatever fails in one - its plan, its job, an output that is none - leaves its rounds silent with the reason and the
other engines untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import TimeScale, micros
from tidemark.operators import engines, shell
from tidemark.operators.candles import candles, candlestick_signatures
from tidemark.operators.flow import FlowWeights, flow
from tidemark.operators.memory import point_in_time
from tidemark.scratch import materialize

MEMORY, BESIDE, OWN = "memory", "beside", "own"
#: Engines whose jobs are handed to Spark at a time; they share nothing, and one's few last tasks leave room for another's.
AT_ONCE = 6


@dataclass(frozen=True)
class Engine:
    """says: (ticks, rounds, scale) -> symbol, round_num, signature, own_direction, strength, reason.

    decides: ``memory`` (what has followed the signature), ``own`` (the engine's own direction) or ``beside`` (the own one unless memory objects).
    """

    name: str
    says: Callable[[DataFrame, DataFrame, TimeScale], DataFrame]
    decides: str = MEMORY


def at_ticks(make: Callable[[DataFrame, TimeScale, Column], DataFrame]) -> Callable[[DataFrame, DataFrame, TimeScale], DataFrame]:
    """An engine whose signatures (symbol, us, event_id, signature, and why there is none in ``reason``) stand at ticks, as of each cutoff."""

    def says(ticks: DataFrame, rounds: DataFrame, scale: TimeScale) -> DataFrame:
        made = make(ticks, scale, shell.before_cutoff(scale))
        reason = F.col("reason") if "reason" in made.columns else F.lit(None).cast("string")
        own = [F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in (("own_direction", "string"), ("strength", "double"))]
        # written before anything is asked of them: a filter would be pushed below the columns that it names, and make them again
        made = materialize(made.select("symbol", "us", "event_id", "signature", *own, reason.alias("reason")), "facts").where("signature IS NOT NULL OR reason IS NOT NULL")
        facts = made.select(F.lit("").alias("engine"), "symbol", "us", "event_id", F.struct("signature", "own_direction", "strength", "reason").alias("price"))
        found = shell.at_cutoffs(facts, rounds, [""])
        return found.select("symbol", "round_num", "signature.*")

    return says


def _at_closes(make: Callable[[DataFrame, TimeScale], DataFrame]) -> Callable[[DataFrame, TimeScale, Column], DataFrame]:
    """Signatures of closed candles, from the moment when they close."""
    return lambda ticks, scale, _: make(ticks, scale).select("symbol", ((F.col("bucket") + 1) * micros(scale.candle)).alias("us"), F.col("bucket").alias("event_id"), "signature")


def _curve(ticks: DataFrame, rounds: DataFrame, scale: TimeScale) -> DataFrame:
    return _own(shell.curve_of_play(ticks, rounds, scale))


def _own(rows: DataFrame, direction: str | None = None, strength: str | None = None) -> DataFrame:
    """Rows of an engine that speaks once a round."""
    own = F.col(direction) if direction else F.lit(None).cast("string")
    sure = F.col(strength) if strength else F.lit(None).cast("double")
    return rows.select("symbol", "round_num", "signature", own.alias("own_direction"), sure.alias("strength"), F.lit(None).cast("string").alias("reason"))


def _trajectory(ticks: DataFrame, rounds: DataFrame, scale: TimeScale) -> DataFrame:
    length, play = micros(scale.round_length), micros(scale.round_length * scale.play_share)
    return _own(engines.trajectory(ticks, scale, F.floor(F.col("us") / length), F.pmod(F.col("us"), F.lit(length)) <= play), "ensemble_direction", "strength")


def _projectile(ticks: DataFrame, rounds: DataFrame, scale: TimeScale) -> DataFrame:
    return _own(shell.thrown(rounds, ticks, scale), "own_direction", "strength")


def _flow(weights: FlowWeights | None, ticks: DataFrame, scale: TimeScale, wanted: Column) -> DataFrame:
    return flow(ticks, scale, weights, wanted).select("symbol", "us", "event_id", "signature", F.col("direction").alias("own_direction"), F.col("confidence").alias("strength"), "reason")


def registered(weights: FlowWeights | None = None) -> dict[str, Engine]:
    """All engines in the order in which they are asked."""
    numeric = {n: Engine(n, at_ticks(partial(lambda name, ticks, scale, wanted: engines.numeric(ticks, scale, name, wanted), n))) for n in engines.NUMERIC}
    made = {
        "crt": Engine("crt", at_ticks(engines.crt)),
        "labouchere": Engine("labouchere", at_ticks(engines.labouchere)),
        "entropy_regime": Engine("entropy_regime", at_ticks(engines.entropy_regime)),
        "candlestick": Engine("candlestick", at_ticks(_at_closes(candlestick_signatures))),
        "momentum": Engine("momentum", at_ticks(_at_closes(lambda ticks, scale: engines.momentum(candles(ticks, scale.candle), scale)))),
        **numeric,
        "curve_geometry": Engine("curve_geometry", _curve),
        "ns_flow": Engine("ns_flow", at_ticks(partial(_flow, weights)), OWN),
        "trajectory": Engine("trajectory", _trajectory, BESIDE),
        "projectile": Engine("projectile", _projectile, BESIDE),
    }
    return {n: made[n] for n in shell.ORDER}


def said(engine: Engine, ticks: DataFrame, rounds: DataFrame, scale: TimeScale) -> DataFrame:
    """What the engine says, a row for each round, written as a table; if that fails, silence and the reason for every round."""
    base = rounds.select("symbol", "round_num")
    try:
        rows = engine.says(ticks, rounds, scale).select("symbol", "round_num", "signature", "own_direction", F.col("strength").cast("double"), "reason")
        odd = ~F.coalesce(F.col("own_direction"), F.lit("NO_SIGNAL")).isin("UP", "DOWN", "NO_SIGNAL") | ~F.coalesce(F.col("strength"), F.lit(0.0)).between(0, 1)
        kept = [F.when(~odd, F.col(c)).alias(c) for c in ("signature", "own_direction", "strength")]
        rows = rows.select("symbol", "round_num", *kept, F.when(odd, "invalid output").otherwise(F.col("reason")).alias("reason"))
        rows = base.join(rows, ["symbol", "round_num"], "left").withColumn("reason", F.when(F.col("signature").isNull(), F.coalesce("reason", F.lit("nothing to say"))).otherwise(F.col("reason")))
        return materialize(rows, f"said-{engine.name}")
    except Exception as error:  # noqa: BLE001 - one engine's failure is not the others'
        why = f"failed: {type(error).__name__}: {str(error).strip().splitlines()[0][:200] if str(error).strip() else ''}"
        return base.select("*", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("own_direction"), F.lit(None).cast("double").alias("strength"), F.lit(why).alias("reason"))


def outputs(ticks: DataFrame, rounds: DataFrame, scale: TimeScale, chosen: Iterable[Engine], moved: DataFrame | None = None) -> DataFrame:
    """symbol, round_num, engine, direction, confidence, signature, decision_source and reason of every chosen engine at every round's cutoff."""
    chosen = list(chosen)
    moved = materialize(shell.moves(rounds, ticks, scale), "moves") if moved is None else moved
    with ThreadPoolExecutor(AT_ONCE) as pool:
        made = list(pool.map(lambda engine: said(engine, ticks, rounds, scale), chosen))
    rows = None
    for engine, own in zip(chosen, made, strict=True):
        own = own.select(F.lit(engine.name).alias("engine"), F.lit(engine.decides).alias("decides"), "*")
        rows = own if rows is None else rows.unionByName(own)
    known = rows.where("signature IS NOT NULL AND decides <> 'own'").join(moved.select("symbol", "round_num", "at_us", "target_us", "result"), ["symbol", "round_num"])
    seen = known.select("engine", "signature", F.col("at_us").alias("us"), F.struct("symbol", "round_num").alias("event_id"), F.col("target_us").alias("label_us"), "result")
    recalled = point_in_time(seen).select("event_id.symbol", "event_id.round_num", "engine", F.col("direction").alias("recalled"), F.col("confidence").alias("sure"))
    rows = rows.join(recalled, ["symbol", "round_num", "engine"], "left")
    speaks = F.col("own_direction").isin("UP", "DOWN")
    own = F.when((F.col("decides") != MEMORY) & speaks, F.col("own_direction"))
    beside = F.when(F.col("decides") != OWN, F.coalesce("recalled", F.lit("NO_SIGNAL"))).otherwise("NO_SIGNAL")
    direction, confidence, source = shell.decided(own, F.col("strength"), beside, F.col("sure"))
    return rows.select("symbol", "round_num", "engine", direction.alias("direction"), confidence.alias("confidence"), "signature", source.alias("decision_source"), "reason")


"""Votes over engines: weights from rolling accuracy, combinations and the choice of one direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import fold, ratio
from tidemark.operators.memory import latest_rates, point_in_time
from tidemark.operators.ordered import RANKS, rejoined, running
from tidemark.operators.recurrences import holt, restarted, scanned
from tidemark.scratch import materialize

ROLLING = 100


def rolling_accuracy(outcomes: DataFrame, window: int = ROLLING) -> DataFrame:
    """Outcomes (engine, at_us, symbol, correct not null) with n_seen and accuracy over the last ``window`` of their engine, own one included.

    Running hits at the engine's n-th outcome less those at its (n - window)-th; an engine's outcomes are dealt to blocks of time.
    """
    known = outcomes.where("correct IS NOT NULL")
    rows = running(known, ["engine"], ["at_us", "symbol"], {"_n": F.lit(1), "_hits": F.col("correct").cast("int")})
    old = rows.select("engine", (F.col("_n") + window).alias("_n"), F.col("_hits").alias("_before"))
    rows = rejoined(rows, old, ["engine", "_n"], "left").withColumn("n_seen", F.least("_n", F.lit(window)))
    return rows.withColumn("accuracy", (F.col("_hits") - F.coalesce("_before", F.lit(0))) / F.col("n_seen")).drop("_n", "_hits", "_before")


#: Fixed values of the vote: outcomes in a weight's history, in its accuracy, needed at all and in the series of accuracies.
HISTORY, LEAST_OUTCOMES, LEAST_POINTS = 300, 30, 5
#: Deviations below the mean that mute, least weight, share that decides, floor and cap of an engine that stands alone.
BAND, LEAST_WEIGHT, SHARE, LONE_FLOOR, LONE_CAP = 2.0, 0.05, 0.55, 0.53, 0.62


def holt_slope(series: Column, level: float = 0.3, trend: float = 0.1) -> Column:
    """Last slope of Holt's double exponential smoothing of an array: it starts at the first value with the first step (0 for fewer than two values)."""

    def step(a: Column, x: Column) -> Column:
        new = level * x + (1 - level) * (a.level + a.slope)
        return F.struct(new.alias("level"), (trend * (new - a.level) + (1 - trend) * a.slope).alias("slope"))

    first, second = F.get(series, F.lit(0)), F.get(series, F.lit(1))
    start = F.struct(first.alias("level"), (second - first).alias("slope"))
    return F.when(F.size(series) < 2, 0.0).otherwise(fold(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), start, step, lambda a: a.slope))


def _numbered(moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled rounds with their number ``_r`` by the time of their outcome, and all rounds with the number of those settled by their own moment."""
    settled = moved.where(F.col("result").isin("UP", "DOWN") & F.col("target_us").isNotNull())
    labels = settled.select("symbol", "round_num", "result", F.col("target_us").alias("_us"), F.lit(0).alias("_kind"))
    asked = moved.select("symbol", "round_num", "result", F.col("at_us").alias("_us"), F.lit(1).alias("_kind"))
    rows = labels.unionByName(asked).withColumn("_all", F.lit(0))
    rows = running(rows, ["_all"], ["_us", "_kind", "symbol", "round_num"], {"_r": 1 - F.col("_kind")}).drop("_all", "_us")
    return rows.where("_kind = 0").drop("_kind"), rows.where("_kind = 1").drop("_kind", "result")


def engine_weights(says: DataFrame, moved: DataFrame, window: int = ROLLING, history: int = HISTORY, least: int = LEAST_OUTCOMES, least_points: int = LEAST_POINTS) -> DataFrame:
    """says (symbol, round_num, engine, direction) with each engine's weight as of the round's moment, and the reason where it has none.

    moved: symbol, round_num, at_us, target_us, result. An engine's history is what it said in the latest ``history`` rounds
    whose outcome was known by then. It is muted while its accuracy over the last ``window`` outcomes is more than ``BAND`` sample
    deviations below the mean of the accuracies in that history; its weight grows with accuracy and shrinks while Holt's
    smoothing of them falls. Accuracies are running hits, their moments running sums of whole numbers, and the
    smoothing is one scan of all outcomes that every history takes its own part of, so nothing is folded over an array.
    Adds n_history, accuracy, lower_band, slope, weight and reason.
    """
    numbered, moments = _numbered(moved)
    said = says.where(F.col("direction").isin("UP", "DOWN"))
    known = said.join(numbered, ["symbol", "round_num"]).select("engine", "_r", F.lit(0).alias("_kind"), "symbol", "round_num", (F.col("direction") == F.col("result")).cast("int").alias("_hit"))
    ends = F.explode(F.array(F.struct(F.lit(1).alias("_kind"), F.col("_r")), F.struct(F.lit(2).alias("_kind"), (F.col("_r") - history).alias("_r")))).alias("_x")
    asked = said.join(moments, ["symbol", "round_num"]).select("engine", "symbol", "round_num", ends).select("engine", "_x._r", "_x._kind", "symbol", "round_num", F.lit(None).cast("int").alias("_hit"))
    rows = running(known.unionByName(asked), ["engine"], ["_r", "_kind", "symbol", "round_num"], {"_n": F.when(F.col("_kind") == 0, 1).otherwise(0), "_hits": F.coalesce("_hit", F.lit(0))}, RANKS)
    # the series: hits among the last outcomes at each outcome, from the first one that has enough before it
    outcome = rows.where("_kind = 0").select("engine", "_n", "_hits")
    before = outcome.select("engine", (F.col("_n") + window).alias("_n"), F.col("_hits").alias("_before"))
    outcome = rejoined(outcome, before, ["engine", "_n"], "left").withColumn("_h", F.when(F.col("_n") >= window, F.col("_hits") - F.coalesce("_before", F.lit(0)))).drop("_hits", "_before")
    smooth = holt()
    outcome = running(outcome, ["engine"], ["_n"], {"_sum": F.col("_h"), "_squares": F.col("_h") * F.col("_h")}, RANKS)
    outcome = materialize(scanned(outcome, ["engine"], "_n", {"_z": (smooth, F.col("_h") / window)}), "outcome-series")

    def at(rank: Column, name: str) -> DataFrame:
        """The series at rank ``_n``, with every column's name ending in ``name``."""
        return outcome.select("engine", rank.alias("_key"), *(F.col(c).alias(f"{c}{name}") for c in ("_h", "_sum", "_squares", "_z")))

    asked = rows.where("_kind > 0").groupBy("engine", "symbol", "round_num").agg(F.max(F.when(F.col("_kind") == 1, F.col("_n"))).alias("_end"), F.max(F.when(F.col("_kind") == 2, F.col("_n"))).alias("_old"))
    found = asked.withColumn("_key", F.col("_end"))
    found = rejoined(found, at(F.col("_n"), "_e"), ["engine", "_key"], "left").withColumn("_key", F.col("_old") + window)
    found = rejoined(found, at(F.col("_n"), "_s"), ["engine", "_key"], "left")
    found = rejoined(found, at(F.col("_n") - 1, "_t"), ["engine", "_key"], "left")
    points = F.col("_end") - F.col("_old") - window + 1
    enough = points >= least_points
    total, squares = F.col("_sum_e") - F.col("_sum_s") + F.col("_h_s"), F.col("_squares_e") - F.col("_squares_s") + F.col("_h_s") * F.col("_h_s")
    deviation = F.sqrt(F.greatest(F.lit(0), points * squares - total * total) / (points * (points - 1)))
    start = [F.col("_h_s") / window, (F.col("_h_t") - F.col("_h_s")) / window]
    slope = restarted(smooth, history, points - 1, start, [F.col("_z_s")[k] for k in range(2)], [F.col("_z_e")[k] for k in range(2)])[1]
    found = found.select(
        "engine", "symbol", "round_num", (F.col("_end") - F.col("_old")).alias("n_history"), F.when(enough, F.col("_h_e") / window).alias("accuracy"),
        F.when(enough, (total / points - BAND * deviation) / window).alias("lower_band"), F.when(enough, slope).alias("slope"),
        F.when(enough, F.col("_h_e") < total / points - BAND * deviation).alias("_muted"),
    )
    factor = F.when(F.col("slope") >= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), 1 + 10 * F.col("slope")))
    found = found.withColumn("_weight", F.exp(4 * (F.col("accuracy") - 0.5)) * factor)
    reason = (
        F.when(~F.coalesce(F.col("direction").isin("UP", "DOWN"), F.lit(False)), "silent").when(F.coalesce("n_history", F.lit(0)) < least, "insufficient history")
        .when(F.col("accuracy").isNull(), "accuracy series too short").when(F.col("_muted"), "below lower band").when(F.col("_weight") < LEAST_WEIGHT, "weight too small")
    )
    out = rejoined(says, found, ["engine", "symbol", "round_num"], "left").withColumn("reason", reason)
    return out.withColumn("weight", F.when(F.col("reason").isNull(), F.col("_weight"))).drop("_muted", "_weight")


def weighted_vote(weighed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_firing, n_voters, up_share, direction, confidence, signature and reason of a vote among the rows (keys, engine, direction, accuracy, weight null if it has none).

    UP or DOWN needs ``SHARE`` of the weight; an engine that is alone on the winning side needs ``LONE_FLOOR`` of its outcomes right and gives ``LONE_CAP`` of confidence at most.
    """
    fires = F.col("direction").isin("UP", "DOWN")
    votes = fires & F.col("weight").isNotNull()
    up = F.col("direction") == "UP"
    g = weighed.groupBy(*keys).agg(
        F.count_if(fires).alias("n_firing"), F.count_if(votes).alias("n_voters"), F.sum(F.when(votes, F.col("weight"))).alias("_w"), F.coalesce(F.sum(F.when(votes & up, F.col("weight"))), F.lit(0.0)).alias("_up"),
        F.count_if(votes & up).alias("_n_up"), F.max(F.when(votes & up, F.col("accuracy"))).alias("_best_up"), F.max(F.when(votes & ~up, F.col("accuracy"))).alias("_best_down"),
    )
    g = g.withColumn("up_share", F.col("_up") / F.col("_w"))
    side = F.when(F.col("up_share") >= SHARE, "UP").when(1 - F.col("up_share") >= SHARE, "DOWN")
    g = g.withColumn("_side", side).withColumn("_share", F.when(F.col("_side") == "UP", F.col("up_share")).otherwise(1 - F.col("up_share")))
    agreeing = F.when(F.col("_side") == "UP", F.col("_n_up")).otherwise(F.col("n_voters") - F.col("_n_up"))
    sole = F.when(F.col("_side") == "UP", F.col("_best_up")).otherwise(F.col("_best_down"))
    g = g.withColumn("_lone", agreeing == 1).withColumn("_sole", sole)
    reason = (
        F.when(F.col("n_firing") < 1, "no engine speaks").when(F.col("n_voters") < 1, "no engine has a weight").when(F.col("_side").isNull(), "disagreement")
        .when(F.col("_lone") & (F.col("_sole") < LONE_FLOOR), "single engine below accuracy floor")
    )
    g = g.withColumn("reason", reason)
    confidence = F.when(F.col("reason").isNull(), F.when(F.col("_lone"), F.least(F.col("_share"), F.lit(LONE_CAP))).otherwise(F.col("_share")))
    g = g.withColumn("confidence", confidence).withColumn("direction", F.when(F.col("reason").isNull(), F.col("_side")).otherwise("NO_SIGNAL"))
    signature = F.when(F.col("reason").isNull(), F.concat(F.lit("ek:"), F.lower("direction"), F.lit(":"), F.floor(F.col("confidence") * 10).cast("string")))
    return g.select(*keys, "n_firing", "n_voters", "up_share", "direction", "confidence", signature.alias("signature"), "reason")


def combinations(says: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and combination: every engine with its direction, in order, joined by a bar."""
    each = F.concat_ws(":", "engine", "direction")
    return says.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(each)), "|").alias("combination"))


def pick_direction(says: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """keys, engine, direction of the first engine in ``priority`` that speaks; NO_SIGNAL of the first one if none does."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("engine"))
    silent = ~F.col("direction").isin("UP", "DOWN")
    return says.where(order > 0).groupBy(*keys).agg(F.min_by(F.struct("engine", "direction"), F.struct(silent, order)).alias("x")).select(*keys, "x.*")


#: The recent rate of rises from which, and up to which, a combination's own record says a direction.
RISES, FALLS = 0.55, 0.45


def combination_outcomes(outputs: DataFrame, moved: DataFrame) -> DataFrame:
    """combination, symbol, round_num, at_us, target_us and result of every round of outputs (symbol, round_num, engine, direction).

    Engines that are silent are part of a combination. moved: symbol, round_num, at_us, target_us, result.
    """
    return combinations(outputs, ["symbol", "round_num"]).join(moved.select("symbol", "round_num", "at_us", "target_us", "result"), ["symbol", "round_num"])


def combination_record(recorded: DataFrame) -> DataFrame:
    """Counters of every combination in rows of :func:`combination_outcomes`: occurrences, correct (rises), incorrect, accuracy, recent_accuracy and combined_output.

    Only rises and falls are counted; the recent rate is that of the latest outcomes, by the time they came.
    """
    g = latest_rates(recorded, ["combination"], order=["target_us", "symbol", "round_num"])
    said = F.when(F.col("recent_rate") >= RISES, "UP").when(F.col("recent_rate") <= FALLS, "DOWN").otherwise("NO_SIGNAL")
    return g.select(
        "combination", "occurrences", F.col("ups").alias("correct"), (F.col("occurrences") - F.col("ups")).alias("incorrect"),
        ratio(F.col("ups"), F.col("occurrences")).alias("accuracy"), F.col("recent_rate").alias("recent_accuracy"), said.alias("combined_output"),
    )


def decisions(outputs: DataFrame, moved: DataFrame, priority: Sequence[str]) -> DataFrame:
    """The prediction of every round: symbol, round_num, combination, engine, direction and confidence, from what was known at its moment.

    outputs: symbol, round_num, engine, direction, confidence. What has followed the round's combination decides, if it has been
    seen often enough and an engine speaks at all; else the first engine in ``priority`` that speaks; else NO_SIGNAL of the first one.
    """
    keys = ["symbol", "round_num"]
    combined = combination_outcomes(outputs, moved)
    seen = combined.select("combination", F.col("at_us").alias("us"), F.struct(*keys).alias("event_id"), F.col("target_us").alias("label_us"), "result")
    known = point_in_time(seen).select("combination", "event_id.*", F.col("direction").alias("recalled"), F.col("confidence").alias("sure"))
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("engine"))
    silent = ~F.coalesce(F.col("direction").isin("UP", "DOWN"), F.lit(False))
    first = outputs.where(order > 0).groupBy(*keys).agg(F.min_by(F.struct("engine", "direction", "confidence"), F.struct(silent, order)).alias("x")).select(*keys, "x.*")
    speaks = F.coalesce(F.col("direction").isin("UP", "DOWN"), F.lit(False))
    recalled = speaks & F.coalesce(F.col("recalled").isin("UP", "DOWN"), F.lit(False))
    return first.join(known, keys, "left").select(
        *keys, "combination", F.when(recalled, "combination").otherwise(F.col("engine")).alias("engine"),
        F.when(recalled, F.col("recalled")).when(speaks, F.col("direction")).otherwise("NO_SIGNAL").alias("direction"),
        F.when(recalled, F.col("sure")).when(speaks, F.col("confidence")).alias("confidence"),
    )

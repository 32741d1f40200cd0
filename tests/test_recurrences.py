"""Recurrences over blocks, the vote's weights as of every round and momentum, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.functions import windows
from tidemark.operators import engines, recurrences, voting
from tidemark.operators.asof import next_ticks, price_asof
from tidemark.operators.memory import point_in_time
from tidemark.operators.ordered import lagged, latest, running, streaks
from tidemark.operators.sessions import session_stats, with_sessions

TICK = "symbol string, us bigint, event_id bigint, price double"


@pytest.mark.parametrize("recurrence", [recurrences.ema(30), recurrences.wilder(60), recurrences.holt(), recurrences.ema_and_its_ema(30, 20)])
def test_a_scan_over_many_chunks(spark, recurrence):
    rng = random.Random(1)
    data = {None: [rng.gauss(1e6, 30) for _ in range(700)], "b": [rng.random() for _ in range(5)], "c": [None, 1.0, None]}
    rows = [(k, i + 1, x) for k, values in data.items() for i, x in enumerate(values)]
    table = spark.createDataFrame(rows, "key string, rank bigint, x double").repartition(5)
    got = {(r["key"], r["rank"]): r["state"] for r in recurrences.scanned(table, ["key"], "rank", {"state": (recurrence, F.col("x"))}).collect()}
    assert len(got) == len(rows)
    matrix, gain = np.array(recurrence.matrix), np.array(recurrence.gain)
    for k, values in data.items():
        state = np.zeros(recurrence.size)
        for i, x in enumerate(values):
            state = matrix @ state + gain * (x or 0.0)
            assert got[k, i + 1] == pytest.approx(state.tolist(), rel=1e-11, abs=1e-9)


def test_a_smoothing_that_starts_anywhere(spark):
    values = [random.Random(2).random() for _ in range(150)]
    table = spark.createDataFrame([("k", i + 1, x) for i, x in enumerate(values)], "key string, rank bigint, x double")
    rule = recurrences.holt()
    z = [r["z"] for r in recurrences.scanned(table, ["key"], "rank", {"z": (rule, F.col("x"))}).orderBy("rank").collect()]
    for s, e in ((0, 149), (40, 90), (148, 149), (10, 14)):
        level, slope = values[s], values[s + 1] - values[s]
        for x in values[s + 1 : e + 1]:
            new = 0.3 * x + 0.7 * (level + slope)
            level, slope = new, 0.1 * (new - level) + 0.9 * slope
        start = [F.lit(values[s]), F.lit(values[s + 1] - values[s])]
        found = recurrences.restarted(rule, 200, F.lit(e - s), start, [F.lit(x) for x in z[s]], [F.lit(x) for x in z[e]])
        assert list(spark.range(1).select(*found).first()) == pytest.approx([level, slope], abs=1e-12)


def plain_weight(hist, window=100, least=30, least_points=5):
    """Weight and reason of a history, newest last."""
    if len(hist) < least:
        return None, "insufficient history"
    series = [sum(hist[i - window : i]) / window for i in range(window, len(hist) + 1)]
    if len(series) < least_points:
        return None, "accuracy series too short"
    mean = sum(series) / len(series)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in series) / (len(series) - 1))
    if series[-1] < mean - 2 * deviation - 1e-12:
        return None, "below lower band"
    level, slope = series[0], series[1] - series[0]
    for x in series[1:]:
        new = 0.3 * x + 0.7 * (level + slope)
        level, slope = new, 0.1 * (new - level) + 0.9 * slope
    weight = math.exp(4 * (series[-1] - 0.5)) * (1 if slope >= 0 else max(0.3, 1 + 10 * slope))
    return (weight, None) if weight >= 0.05 else (None, "weight too small")


def test_weights_know_only_what_had_come_out(spark, monkeypatch):
    monkeypatch.setattr(voting, "RANKS", 60e-6)  # one engine is many blocks
    rng = random.Random(3)
    rounds = [("ab"[i % 2], i, 1000 * i, 1000 * i + rng.choice([500, 2500, 2500]), rng.choice(["UP", "UP", "DOWN", "DOWN", "FLAT", None])) for i in range(700)]
    rounds.append(("a", 9000, 5000, None, "UP"))  # never settled
    says = []
    for symbol, n, _, _, result in rounds:
        says.append((symbol, n, "often", rng.choice([result, "UP", "DOWN"]) or "UP"))
        says.append((symbol, n, "right", result if result in ("UP", "DOWN") and rng.random() < 0.8 else "NO_SIGNAL"))
        says.append((symbol, n, "worse", "UP" if rng.random() < n / 900 else result or "DOWN"))
        if n > 600:
            says.append((symbol, n, "late", "UP"))
        if n % 50 == 0:
            says.append((symbol, n, None, "DOWN"))
    moved = spark.createDataFrame(rounds, "symbol string, round_num int, at_us bigint, target_us bigint, result string").repartition(3)
    table = spark.createDataFrame(says, "symbol string, round_num int, engine string, direction string").repartition(3)
    got = voting.engine_weights(table, moved).collect()
    assert len(got) == len(says)
    settled = sorted((t, s, n, r) for s, n, _, t, r in rounds if r in ("UP", "DOWN") and t is not None)
    said = {(s, n, e): d for s, n, e, d in says}
    reasons = set()
    for r in got:
        at = 1000 * r["round_num"] if r["round_num"] != 9000 else 5000
        if r["direction"] not in ("UP", "DOWN"):
            assert (r["weight"], r["reason"]) == (None, "silent")
            continue
        known = [x for x in settled if x[0] <= at][-300:]
        hist = [said[s, n, r["engine"]] == result for _, s, n, result in known if said.get((s, n, r["engine"])) in ("UP", "DOWN")]
        weight, reason = plain_weight(hist)
        assert (r["n_history"] or 0, r["reason"]) == (len(hist), reason) and r["weight"] == (None if weight is None else pytest.approx(weight, rel=1e-9))
        reasons.add(reason)
    assert reasons >= {None, "insufficient history", "accuracy series too short", "below lower band"}


def test_vote_and_the_engine_that_stands_alone(spark):
    rows = [
        (1, "a", "UP", 0.6, 1.0), (1, "b", "UP", 0.5, 0.5), (1, "c", "DOWN", 0.7, 0.4),  # 1.5 of 1.9
        (2, "a", "UP", 0.6, 1.0), (2, "b", "DOWN", 0.5, 0.9),  # neither side has enough
        (3, "a", "DOWN", 0.52, 1.0),  # alone and below the floor
        (4, "a", "DOWN", 0.53, 1.0), (4, "b", "NO_SIGNAL", None, None),  # alone: capped
        (5, "a", "UP", None, None),
        (6, "a", "NO_SIGNAL", None, None),
    ]
    table = spark.createDataFrame(rows, "k int, engine string, direction string, accuracy double, weight double")
    got = {r["k"]: (r["direction"], r["confidence"], r["signature"], r["reason"]) for r in voting.weighted_vote(table, ["k"]).collect()}
    assert got == {
        1: ("UP", pytest.approx(1.5 / 1.9), "ek:up:7", None), 2: ("NO_SIGNAL", None, None, "disagreement"), 3: ("NO_SIGNAL", None, None, "single engine below accuracy floor"),
        4: ("DOWN", 0.62, "ek:down:6", None), 5: ("NO_SIGNAL", None, None, "no engine has a weight"), 6: ("NO_SIGNAL", None, None, "no engine speaks"),
    }


def plain_momentum(rows, most=120):
    """core and dwell in candles of the last row of ``rows`` (bucket, h, l, c, n), from all candles of the history."""
    window = [r for r in rows if r[0] > rows[-1][0] - most]
    if len(window) < 90 or sum(r[4] for r in window) < 200:
        return None

    def core(part):
        return windows.momentum(*(np.array([r[k] for r in part], float) for k in (1, 2, 3))) if len(part) >= 90 else None

    own, held = core(window), 12
    for back in range(1, 13):
        if core(window[:-back]) != own:
            held = back - 1
            break
    return own, held


@pytest.mark.parametrize("kind", ["walk", "gaps", "flat", "steps"])
def test_momentum_of_every_candle(spark, kind):
    rng = random.Random(kind)
    price, bucket, rows = 50_000.0, 1000, []
    for i in range(1300 if kind == "walk" else 260):
        price += {"walk": rng.gauss(0, 20), "gaps": rng.gauss(0, 20), "flat": 0.0, "steps": rng.choice([0, 0, 0, 5, -5])}[kind]
        rows.append((bucket, price + rng.random() * (kind != "flat"), price - rng.random() * (kind != "flat"), price, rng.randrange(1, 5)))
        bucket += rng.choice([1, 1, 1, 1, 9]) if kind == "gaps" and i % 60 == 0 else 1
    table = spark.createDataFrame([(None if kind == "steps" else "a", b, h, h, l, c, n) for b, h, l, c, n in rows], "symbol string, bucket bigint, o double, h double, l double, c double, n bigint").repartition(4)
    scale = TimeScale()
    got = {r["bucket"]: r for r in engines.momentum(table, scale).collect()}
    for i in range(len(rows)):
        want = plain_momentum(rows[: i + 1])
        if want is None:
            assert rows[i][0] not in got
        elif kind != "flat":  # a loop's own rounding decides what a flat series is
            held = want[1] * scale.candle
            assert got[rows[i][0]]["signature"] == f"{want[0]}_dw{sum(held >= x for x in scale.dwell)}"
    assert len(got) > 50


def test_streaks_and_last_values_over_many_blocks(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "a", None]), rng.choice([None, *range(0, 3000, 7)]), i, rng.choice("xxxy") if i % 5 else None) for i in range(600)]
    rows += [("long", 10 * i, i, "same") for i in range(400)]
    table = spark.createDataFrame(rows, "symbol string, us bigint, event_id bigint, v string").repartition(4)
    for block in (1e-4, 1e-3, 86_400.0):
        got = {(r["symbol"], r["event_id"]): r for r in streaks(table, ["symbol"], ["us", "event_id"], "v", block).collect()}
        filled = {(r["symbol"], r["event_id"]): r["w"] for r in latest(table, ["symbol"], ["us", "event_id"], {"w": F.col("v")}, block).collect()}
        for symbol in ("a", None, "long"):
            own = sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            run, last = 0, None
            for k, (_, us, i, v) in enumerate(own):
                run = run + 1 if k and own[k - 1][3] == v else 1
                last = v or last
                assert (got[symbol, i]["run_length"], got[symbol, i]["run_start"], filled[symbol, i]) == (run, own[k - run + 1][1], last)


def test_no_row_is_lost_for_want_of_a_key_or_a_time(spark):
    rows = [("a", 1, 1, 1.0), (None, 5, 2, 2.0), ("a", None, 3, 3.0), (None, None, 4, 4.0), ("a", 100, 5, 5.0), (None, 100_000_000, 6, 6.0)]
    ticks = spark.createDataFrame(rows, TICK)
    for block in (1e-5, 1.0, 86_400.0):
        sums = {r["event_id"]: r["n"] for r in running(ticks, ["symbol"], ["us", "event_id"], {"n": F.lit(1)}, block).collect()}
        assert sums == {3: 1, 1: 2, 5: 3, 4: 1, 2: 2, 6: 3}
        before = {r["event_id"]: r["x"] for r in lagged(ticks, ["symbol"], ["us", "event_id"], "event_id", "x", block).collect()}
        assert before == {3: None, 1: 3, 5: 1, 4: None, 2: 4, 6: 2}
        asked = spark.createDataFrame([("a", 50, 1), (None, 50, 2), ("a", None, 3), (None, 0, 4), ("z", 50, 5)], "symbol string, at_us bigint, k int")
        assert {r["k"]: r["price"] for r in price_asof(asked, ticks, "at_us", block=block).collect()} == {1: 1.0, 2: 2.0, 3: None, 4: 2.0, 5: None}
        assert {r["k"]: [x["price"] for x in r["next"]] for r in next_ticks(asked, ticks, 2, block=block).collect()} == {1: [5.0], 2: [6.0], 3: [], 4: [2.0, 6.0], 5: []}
    assert with_sessions(ticks, 60.0).count() == len(rows) and session_stats(ticks, 60.0).agg(F.sum("n_ticks")).first()[0] == len(rows)
    seen = spark.createDataFrame([(None, 10, 1, 20, "UP"), (None, 30, 2, None, "UP"), (None, None, 3, 40, "DOWN"), ("s", 50, 4, None, "UP")], "signature string, us bigint, event_id bigint, label_us bigint, result string")
    assert {r["event_id"]: r["n_seen"] for r in point_in_time(seen, 50, 1).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    said = spark.createDataFrame([(None, 1, "a", True), (None, 2, "a", False), ("e", 1, "a", True)], "engine string, at_us bigint, symbol string, correct boolean")
    assert sorted((r["at_us"], r["accuracy"]) for r in voting.rolling_accuracy(said).where("engine IS NULL").collect()) == [(1, 1.0), (2, 0.5)]

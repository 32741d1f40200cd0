"""The flow engine against a plain version, with made-up weights."""

import json
import math
import random
import statistics

import pytest

from tidemark.config import TimeScale
from tidemark.operators import flow, seeds

WEIGHTS = {n: (-1) ** i * (i + 1) * 3.0 for i, n in enumerate(flow.FEATURES)}


def plain(ticks):
    section = ticks[-40:]
    t, p = [x[0] for x in section], [x[1] for x in section]
    v = [(p[k] - p[k - 1]) / (t[k] - t[k - 1]) for k in range(1, len(p)) if t[k] > t[k - 1]]
    if len(section) < 4 or len(v) < 3:
        return None
    a = [(v[k] - v[k - 1]) / (t[k] - t[k - 1]) for k in range(1, len(v)) if t[k] > t[k - 1]]
    acc = a[-1] if a else 0.0
    jerk = (a[-1] - a[-2]) / (t[-1] - t[-2]) if len(a) > 1 and t[-1] > t[-2] else 0.0
    r = [(p[k] - p[k - 1]) / p[k - 1] for k in range(1, len(p))]
    s, d = abs(p[-1]), p[-1] - 2 * p[-2] + p[-3]
    signs = [(x > 0) - (x < 0) for x in v[-12:]]
    values = [
        v[-1] / s, acc / s, jerk / s, acc / (1 + v[-1] ** 2) ** 1.5 / s, d / s, statistics.stdev(r), (p[-1] - p[0]) / s, sum(abs(p[k] - p[k - 1]) for k in range(1, len(p))) / s, (v[-1] + acc) / s,
        d / s, (statistics.mean(p) - p[-1]) / s, v[-1] * acc / s, (p[-1] - statistics.mean(p[-8:])) / p[-1], (p[-1] - statistics.mean(p[-16:])) / p[-1], statistics.mean(signs),
    ]
    return [max(-1.0 if n == "terrain_volatility" else -10.0, min(1.0 if n == "terrain_volatility" else 10.0, x)) for n, x in zip(flow.FEATURES, values, strict=True)]


def test_features_and_score(spark):
    rng = random.Random(4)
    rows, us, price = [], 0, 100.0
    for i in range(150):
        us += rng.choice([0, 0, 200_000, 500_000, 900_000]) if i > 60 else 500_000
        price += rng.gauss(0, 0.4) if i < 120 else 30.0
        rows.append(("a", us, i, price))
    rows += [("b", i * 500_000, 1000 + i, 5.0 + i % 3) for i in range(44)] + [("c", 7, 2000 + i, 5.0) for i in range(60)]
    table = spark.createDataFrame(rows, "symbol string, us bigint, event_id bigint, price double").repartition(3)
    weights, wrong = flow.load_weights(json.dumps({"weights": WEIGHTS, "bias": 0.4}))
    assert wrong is None
    got = {r["event_id"]: r for r in flow.flow(table, TimeScale(), weights).collect()}
    spoken = set()
    for k, (symbol, _, i, _) in enumerate(rows):
        history = [(x[1] / 1e6, x[3]) for x in rows[: k + 1] if x[0] == symbol]
        r = got[i]
        want = plain(history) if len(history) >= 45 else None
        if want is None:
            assert (r["direction"], r["signature"], r["p_up"]) == ("NO_SIGNAL", None, None) and r["reason"] == ("insufficient ticks" if len(history) < 45 else "feature extraction failed")
            continue
        assert [r["flow"][n] for n in flow.FEATURES] == pytest.approx(want, rel=1e-9, abs=1e-12)
        p = 1 / (1 + math.exp(-max(-60, min(60, 0.4 + sum(WEIGHTS[n] * x for n, x in zip(flow.FEATURES, want, strict=True))))))
        sure = max(p, 1 - p)
        assert r["p_up"] == pytest.approx(p, rel=1e-9)
        assert r["signature"] == f"nsflow:{'up' if p >= 0.5 else 'down'}:p{sum(sure >= e for e in (0.5, 0.6, 0.7, 0.85))}"
        assert (r["direction"], r["reason"]) == (("UP" if p >= 0.5 else "DOWN", None) if sure >= 0.58 else ("NO_SIGNAL", "below threshold"))
        spoken.add(r["direction"])
    assert spoken == {"UP", "DOWN", "NO_SIGNAL"}
    silent = flow.flow(table, TimeScale(), None).collect()
    assert {(r["direction"], r["reason"], r["signature"]) for r in silent} == {("NO_SIGNAL", "weights not loaded", None)}


def test_weights_that_are_no_weights():
    assert flow.load_weights(None) == (None, "no weights") and flow.load_weights(" ") == (None, "no weights")
    assert flow.load_weights("{")[1].startswith("invalid weights") and flow.load_weights("[1]")[1].startswith("invalid weights")
    assert flow.load_weights('{"weights": {"velocity": 1}}')[1].startswith("missing weights: acceleration, ")
    assert flow.load_weights(json.dumps({"weights": dict.fromkeys(flow.FEATURES, "x")}))[1].startswith("invalid weights")


def test_the_rule_that_needs_the_flow_fires(spark):
    rows = [(1, "entropy_regime", "NO_SIGNAL", "ent:p3_r2_dU_dw0_v0"), (1, "navier_stokes", "NO_SIGNAL", "ns:v1_p0_d0_a0_dw0"), (1, "ns_flow", "NO_SIGNAL", "nsflow:up:p1")]
    got = seeds.seed_votes(spark.createDataFrame(rows, "k int, engine string, direction string, signature string"), ["k"]).first()
    assert got["fired"] == ["r006"] and got["direction"] == "UP"

"""Combinations of what engines say: their record and the decisions that follow, against a plain version."""

import math
import random

import pytest

from tidemark.operators.voting import combination_outcomes, combination_record, decisions

PRIORITY = ("a", "b", "c")
OUTPUT = "symbol string, round_num bigint, engine string, direction string, confidence double"
MOVE = "symbol string, round_num bigint, at_us bigint, target_us bigint, result string"


def bounds(p, n):
    centre, margin = p + 3.8416 / (2 * n), 1.96 * math.sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))
    return max(0.0, (centre - margin) / (1 + 3.8416 / n)), min(1.0, (centre + margin) / (1 + 3.8416 / n))


@pytest.fixture(scope="module")
def market(spark):
    """Rounds of two symbols; one combination nearly always rises, one engine may be silent, outcomes come after several further rounds."""
    rng = random.Random(5)
    outputs, moved = [], []
    for k in range(300):
        for symbol in ("s", "t"):
            first = rng.choice(("UP", "UP", "NO_SIGNAL"))
            says = {"a": first, "b": rng.choice(("DOWN", "NO_SIGNAL")), "c": "NO_SIGNAL" if rng.random() < 0.8 else "UP"}
            outputs += [(symbol, k, e, d, round(rng.random(), 3) if d != "NO_SIGNAL" else None) for e, d in says.items()]
            rises = rng.random() < (0.9 if first == "UP" and says["b"] == "NO_SIGNAL" else 0.5)
            result = rng.choice((None, "FLAT")) if rng.random() < 0.1 else "UP" if rises else "DOWN"
            moved.append((symbol, k, k * 100 + (symbol == "t"), None if rng.random() < 0.02 else k * 100 + 350, result))
    return outputs, moved, spark.createDataFrame(outputs, OUTPUT), spark.createDataFrame(moved, MOVE)


def keyed(outputs):
    said = {}
    for symbol, k, engine, direction, confidence in outputs:
        said.setdefault((symbol, k), {})[engine] = (direction, confidence)
    return said, {r: "|".join(sorted(f"{e}:{d}" for e, (d, _) in x.items())) for r, x in said.items()}


def test_decisions_from_what_was_known(market):
    outputs, moved, o, m = market
    said, names = keyed(outputs)
    want = {}
    for symbol, k, at, _, _ in moved:
        name = names[symbol, k]
        known = sorted((t, s, r, result) for s, r, _, t, result in moved if t is not None and t <= at and result in ("UP", "DOWN") and names[s, r] == name)[-50:]
        first = next(((e, *said[symbol, k][e]) for e in PRIORITY if said[symbol, k][e][0] != "NO_SIGNAL"), None)
        if first and len(known) >= 40:
            low, high = bounds(sum(x[3] == "UP" for x in known) / len(known), len(known))
            if low > 0.5 or high < 0.5:
                first = ("combination", "UP", low) if low > 0.5 else ("combination", "DOWN", 1 - high)
        want[symbol, k] = (name, *(first or ("a", "NO_SIGNAL", None)))
    got = {(r["symbol"], r["round_num"]): r for r in decisions(o, m, PRIORITY).collect()}
    assert got.keys() == want.keys()
    for key, (name, engine, direction, confidence) in want.items():
        r = got[key]
        assert (r["combination"], r["engine"], r["direction"]) == (name, engine, direction)
        assert r["confidence"] == (None if confidence is None else pytest.approx(confidence, abs=1e-12))
    sources = {r["engine"] for r in got.values()}
    assert {"combination", "a", "b"} <= sources


def test_records_count_rises_and_falls(market):
    outputs, moved, o, m = market
    names = keyed(outputs)[1]
    want = {}
    for symbol, k, _, target, result in moved:
        if result in ("UP", "DOWN"):
            want.setdefault(names[symbol, k], []).append((target is not None, target or 0, symbol, k, result))
    got = {r["combination"]: r for r in combination_record(combination_outcomes(o, m)).collect()}
    assert got.keys() == want.keys()
    for name, rows in want.items():
        ups, recent = sum(x[-1] == "UP" for x in rows), [x[-1] for x in sorted(rows)[-50:]]
        rate, r = recent.count("UP") / len(recent), got[name]
        assert (r["occurrences"], r["correct"], r["incorrect"]) == (len(rows), ups, len(rows) - ups)
        assert (r["accuracy"], r["recent_accuracy"]) == (pytest.approx(ups / len(rows)), pytest.approx(rate))
        assert r["combined_output"] == ("UP" if rate >= 0.55 else "DOWN" if rate <= 0.45 else "NO_SIGNAL")

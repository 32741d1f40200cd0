"""The protocol of engines: isolation, reasons, and who decides."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.operators import engines, registry, shell
from tidemark.sources.tables import rounds as rounds_of

TICK = "symbol string, us bigint, event_id bigint, price double"


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(2)
    price, rows = 50_000.0, []
    for i in range(2400):
        price += rng.gauss(0, 8)
        rows.append(("a", i * 500_000, i, round(price, 2)))
    ticks = spark.createDataFrame(rows, TICK).repartition(4)
    return ticks, rounds_of(ticks, TimeScale())


def rows_of(made):
    return lambda ticks, rounds, scale: made(rounds.select("symbol", "round_num"))


def test_one_failure_is_not_the_others(spark, market):
    @F.udf("string")
    def explodes(x):
        raise RuntimeError("in the middle of the job")

    none = [F.lit(None).cast("string").alias("own_direction"), F.lit(None).cast("double").alias("strength"), F.lit(None).cast("string").alias("reason")]

    def planned(ticks, rounds, scale):
        raise KeyError("no plan")

    def said(direction, strength):
        return rows_of(lambda r: r.select("*", F.lit("s").alias("signature"), F.lit(direction).alias("own_direction"), F.lit(strength).alias("strength"), F.lit(None).cast("string").alias("reason")))

    chosen = [
        registry.Engine("crt", registry.at_ticks(engines.crt)),
        registry.Engine("plan", planned),
        registry.Engine("job", rows_of(lambda r: r.select("*", explodes("symbol").alias("signature"), *none))),
        registry.Engine("columns", rows_of(lambda r: r)),
        registry.Engine("sideways", said("SIDEWAYS", 0.5), registry.OWN),
        registry.Engine("too sure", said("UP", 1.5), registry.OWN),
        registry.Engine("good", said("UP", 0.75), registry.OWN),
        registry.Engine("quiet", rows_of(lambda r: r.limit(0).select("*", F.lit("s").alias("signature"), *none))),
    ]
    ticks, rounds = market
    got = registry.outputs(ticks, rounds, TimeScale(), chosen).collect()
    n = rounds.count()
    by = {}
    for r in got:
        by.setdefault(r["engine"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {e.name: n for e in chosen}
    assert all(r["signature"].startswith("crt:") and r["reason"] is None for r in by["crt"])
    reasons = {k: {r["reason"] for r in v} for k, v in by.items()}
    assert reasons["sideways"] == reasons["too sure"] == {"invalid output"} and reasons["good"] == {None} and reasons["quiet"] == {"nothing to say"}
    assert {x.split(":")[1].strip() for x in reasons["plan"]} == {"KeyError"} and all(x.startswith("failed: ") for k in ("job", "columns") for x in reasons[k])
    assert {(r["direction"], r["confidence"], r["decision_source"]) for r in by["good"]} == {("UP", 0.75, "own_only")}
    assert {r["direction"] for k in ("plan", "job", "columns", "sideways", "too sure", "quiet") for r in by[k]} == {"NO_SIGNAL"}


def test_numeric_engines_keep_their_reasons(spark, market, monkeypatch):
    def fussy(times, prices):
        if len(prices) < 5:
            return None
        if int(times[-1]) % 2:
            raise ZeroDivisionError
        return "fussy:1"

    monkeypatch.setitem(engines.NUMERIC, "fussy", (8, 4, fussy))
    ticks, _ = market
    got = engines.numeric(ticks.where("event_id < 40"), TimeScale(), "fussy").collect()
    for r in got:
        want = (None, "insufficient ticks") if r["event_id"] < 4 else (None, "failed: ZeroDivisionError") if (r["us"] // 1_000_000) % 2 else ("fussy:1", None)
        assert (r["core"], r["reason"]) == want


def test_all_engines_speak_of_a_lively_market(spark, market):
    assert tuple(registry.registered()) == shell.ORDER
    ticks, rounds = market
    got = registry.outputs(ticks, rounds, TimeScale(), registry.registered().values()).collect()
    spoken = {}
    for r in got:
        spoken.setdefault(r["engine"], []).append(r["signature"])
    assert {k for k, v in spoken.items() if any(v)} == set(shell.ORDER) - {"ns_flow"}  # that one has no weights
    assert {r["reason"] for r in got if r["engine"] == "ns_flow"} == {"weights not loaded"}
    assert not [r["reason"] for r in got if (r["reason"] or "").startswith("failed")]

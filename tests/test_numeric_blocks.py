"""Numeric engines over blocks of ranks: the same signatures as window by window, however many ticks a symbol has in a day."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.functions import windows as w
from tidemark.operators import engines, shell

TICK = "symbol string, us bigint, event_id bigint, price double"
RNG = np.random.default_rng(3)
SERIES = {
    "walk": lambda n: 50_000 + np.cumsum(RNG.normal(0, 8, n)), "few": lambda n: 1e6 + RNG.integers(0, 5, n), "pairs": lambda n: 1e6 + np.repeat(np.round(RNG.exponential(50, n), 2), 2)[:n],
    "small": lambda n: RNG.integers(0, 4, n).astype(float), "flat": lambda n: np.full(n, 7.0) + (RNG.random(n) < 0.1), "wide": lambda n: 1e6 + np.round(RNG.exponential(50, n), 2),
}


def same_as_one_by_one(one):
    for n in (7, 8, 12, 20, 30, 31, 47, 48, 50):
        prices = np.stack([make(n) for make in SERIES.values() for _ in range(20)])
        times = np.tile(np.arange(n) * 0.5, (len(prices), 1))
        assert w.MANY[one](times, prices).tolist() == [one(t, p) for t, p in zip(times, prices, strict=True)]


def test_flows_of_many_windows_at_once():
    same_as_one_by_one(w.flow)


def test_trails_of_many_windows_at_once():
    same_as_one_by_one(w.trail)


def plain(rows, name, scale):
    """Signature of every tick, looked for over the whole series."""
    size, back, function = engines.NUMERIC[name]
    cores, out = [], {}
    for k, (_, us, event_id, _) in enumerate(rows):
        window = [x for x in rows[max(0, k - size + 1) : k + 1] if x[1] > us - scale.history * 1e6]
        cores.append(function(np.array([x[1] for x in window], float) / 1e6, np.array([x[3] for x in window], float)) or "")
        first = max(0, k - back + 1)
        since = next((j + 1 for j in range(k - 1, first - 1, -1) if cores[j] != cores[k]), first)
        held = sum((us - rows[since][1]) / 1e6 >= e for e in scale.dwell)
        out[event_id] = (cores[k] or None, f"{cores[k]}_dw{held}" if cores[k] else None)
    return out


@pytest.mark.parametrize("name", ["navier_stokes", "trail_tracer", "superformula", "curve_geometry", "trig_euler"])
def test_blocks_of_ranks_lose_nothing(spark, monkeypatch, name):
    monkeypatch.setattr(engines, "RANK_BLOCK", 128)
    rng, us, price, rows = random.Random(5), 0, 50_000.0, []
    for i in range(500):
        us += rng.choice([0, 0, 200_000, 900_000]) if i % 90 else 550_000_000
        price += rng.choice([0, 0, 0, rng.gauss(0, 8)])
        rows.append(("a", us, i, round(price, 2)))
    ticks = spark.createDataFrame(rows, TICK).repartition(5)
    want = plain(rows, name, TimeScale())
    assert {r["event_id"]: (r["core"], r["signature"]) for r in engines.numeric(ticks, TimeScale(), name).collect()} == want
    some = {r["event_id"]: (r["core"], r["signature"]) for r in engines.numeric(ticks, TimeScale(), name, shell.before_cutoff(TimeScale())).collect()}
    assert 5 < len(some) < 500 and some.items() <= want.items()


def test_a_busy_symbol_is_many_tasks(spark):
    ticks = spark.range(20_000).select(F.lit("a").alias("symbol"), (F.col("id") * 1000).alias("us"), F.col("id").alias("event_id"), (50_000 + F.col("id") % 17).cast("double").alias("price"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = engines.numeric(ticks, TimeScale(), "navier_stokes").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in rows) == 20_000 and len(rows) > 2

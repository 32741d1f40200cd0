"""The curve engine where very many ticks are in the minute before a cutoff."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.functions import windows
from tidemark.functions.columns import ladder
from tidemark.operators import shell
from tidemark.sources.tables import rounds

STEP, N = 2000, 40_000  # microseconds between ticks; ticks


def test_a_minute_of_very_many_ticks(spark):
    """Every tick's minute made by itself would hold 600 million ticks here; each is needed at two cutoffs or so."""
    scale = TimeScale()
    price = 50_000 + F.sin(F.col("id") / 900) * 3 + (F.col("id") % 7) * 0.001
    ticks = spark.range(N).select(F.lit("a").alias("symbol"), (F.col("id") * STEP).alias("us"), F.col("id").alias("event_id"), price.alias("price")).repartition(4)
    got = {r["round_num"]: r for r in shell.curve_of_play(ticks, rounds(ticks, scale), scale).collect()}
    prices = np.array([r["price"] for r in ticks.orderBy("event_id").select("price").collect()])
    times = np.arange(N) * STEP / 1e6
    held = {}
    for round_num in range(3):
        start, cutoff = round_num * 30.0, round_num * 30.0 + 15.0
        played = (times >= start) & (times <= cutoff)
        core = windows.curve(times[played], prices[played])
        newest = times[times <= cutoff][-1]
        minute = (times <= newest) & (times >= newest - 60.0)
        held[round_num] = (core, windows.curve_dwell(times[minute], prices[minute], core, shell.CURVE_BACKS), int(played.sum()))
    edges = spark.createDataFrame([(k, d) for k, (_, d, _) in held.items()], "k long, d double").select("k", ladder(F.col("d"), scale.dwell).alias("bin"))
    bins = {r["k"]: r["bin"] for r in edges.collect()}
    assert {k: (r["n_play"], r["core"], r["signature"]) for k, r in got.items()} == {k: (n, core, f"{core}_dw{bins[k]}") for k, (core, _, n) in held.items()}

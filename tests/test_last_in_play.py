"""The last tick in play of each round and its window, where a round has more ticks than a block of ranks."""

import random

from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.operators import engines


def test_last_in_play_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(engines, "RANK_BLOCK", 64)
    rng, us, rows = random.Random(6), 0, []
    for i in range(700):
        us += rng.choice([0, 100_000, 300_000]) if i % 150 else 45_000_000
        rows.append(("a", us, i, 50_000.0 + i % 11))
    ticks = spark.createDataFrame(rows, "symbol string, us bigint, event_id bigint, price double").repartition(3)
    length, play = 30_000_000, 15_000_000
    got = engines.last_in_play(ticks, TimeScale(), 40, F.floor(F.col("us") / length), F.pmod(F.col("us"), F.lit(length)) <= play).collect()
    want = {}
    for k, (_, at, _, _) in enumerate(rows):
        if at % length <= play:
            want[at // length] = (at, [(x[1], x[3]) for x in rows[max(0, k - 39) : k + 1] if x[1] > at - 600_000_000])
    assert {r["round_num"]: (r["us"], [(x["us"], x["price"]) for x in r["w"]]) for r in got} == want

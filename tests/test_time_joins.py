"""As-of, next-k and interval joins, sessions and keyed sinks against plain loops."""

import random

from pyspark.sql import functions as F

from tidemark.operators.asof import next_ticks, price_asof, range_join
from tidemark.operators.ordered import lagged, running
from tidemark.operators.sessions import rounds_in_sessions, session_stats
from tidemark.operators.upserts import add_counts, insert_if_absent, latest_wins

TICK = "symbol string, us bigint, event_id bigint, price double"
S = 1_000_000


def some_ticks(seed=3, n=200):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(1000), i, float(rng.randrange(50))) for i in range(n)]


def test_price_as_of_with_forward_fallback(spark):
    rows = some_ticks()
    asked = [(s, t, t) for s in "abc" for t in range(-5, 1010, 37)]
    got = {(r["symbol"], r["k"]): r["price"] for r in price_asof(spark.createDataFrame(asked, "symbol string, target_us bigint, k bigint"), spark.createDataFrame(rows, TICK)).collect()}
    for s, t, _ in asked:
        own = sorted((u, e, p) for x, u, e, p in rows if x == s)
        before = [p for u, e, p in own if u <= t]
        after = [p for u, e, p in own if u > t]
        assert got[s, t] == (before[-1] if before else after[0] if after else None)


def test_next_ticks_are_strictly_after(spark):
    rows = some_ticks(5)
    asked = [(s, t, t) for s in "abc" for t in range(-5, 1010, 41)]
    got = {(r["symbol"], r["k"]): [tuple(x) for x in r["next"]] for r in next_ticks(spark.createDataFrame(asked, "symbol string, at_us bigint, k bigint"), spark.createDataFrame(rows, TICK), 3).collect()}
    for s, t, _ in asked:
        assert got[s, t] == [(u, p) for u, e, p in sorted((u, e, p) for x, u, e, p in rows if x == s and u > t)[:3]]


def test_range_join_takes_both_ends(spark):
    ticks = spark.createDataFrame([("a", t * S, t, float(t)) for t in range(20)], TICK)
    spans = spark.createDataFrame([("a", 1, 3 * S, 7 * S), ("a", 2, 19 * S, 40 * S), ("a", 3, 50 * S, 60 * S)], "symbol string, k int, start_us bigint, end_us bigint")
    got = sorted((r["k"], int(r["price"])) for r in range_join(spans, ticks, 2.0).collect())
    assert got == [(1, t) for t in range(3, 8)] + [(2, 19)]


def test_a_pause_of_exactly_the_gap_cuts(spark):
    ticks = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 59_999_999, 1, 1.0), ("a", 119_999_999, 2, 1.0)], TICK)
    rows = session_stats(ticks, 60.0).orderBy("session_num").collect()
    assert [(r["n_ticks"], r["status"], r["reason"], r["gap_before_us"]) for r in rows] == [(2, "INTERRUPTED", "startup", None), (1, "ACTIVE", "gap", 60_000_000)]


def test_keyed_sinks(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("l", 1, "z")], "key string, at int, v string")
    assert sorted(tuple(r) for r in latest_wins(rows, ["key"], ["at"]).select("key", "at", "v").collect()) == [("k", 2, "y"), ("l", 1, "z")]
    more = spark.createDataFrame([("k", 9, "n"), ("m", 5, "q"), ("m", 4, "p")], "key string, at int, v string")
    held = latest_wins(rows, ["key"], ["at"]).select("key", "at", "v")
    assert sorted(tuple(r) for r in insert_if_absent(held, more, ["key"], ["at"]).collect()) == [("k", 2, "y"), ("l", 1, "z"), ("m", 4, "p")]
    counts = spark.createDataFrame([("k", 1), ("l", 2)], "key string, n int"), spark.createDataFrame([("k", 5)], "key string, n int")
    assert sorted(tuple(r) for r in add_counts(*counts, ["key"], ["n"]).collect()) == [("k", 6), ("l", 2)]


def test_one_symbol_over_many_blocks(spark):
    """As-of, next-k, sessions and running sums carry over blocks, empty ones too."""
    rng = random.Random(7)
    rows = [("a", rng.randrange(0, 400) * S + (0 if i % 2 else 900 * S), i, float(rng.randrange(50))) for i in range(120)]
    ticks = spark.createDataFrame(rows, TICK)
    own = sorted((u, e, p) for _, u, e, p in rows)
    asked = spark.createDataFrame([("a", t * S, t) for t in range(-20, 1400, 13)], "symbol string, at_us bigint, k bigint")
    for block in (7.0, 100.0, 5000.0):
        got = {r["k"]: r["price"] for r in price_asof(asked, ticks, "at_us", block=block).collect()}
        after = {r["k"]: [tuple(x) for x in r["next"]] for r in next_ticks(asked, ticks, 4, block=block).collect()}
        for k, price in got.items():
            before = [p for u, e, p in own if u <= k * S]
            later = [(u, p) for u, e, p in own if u > k * S]
            assert price == (before[-1] if before else later[0][1])
            assert after[k] == later[:4]
        sums = running(ticks, ["symbol"], ["us", "event_id"], {"n": F.lit(1), "s": F.col("price")}, block=block).collect()
        place = {e: i for i, (_, e, _) in enumerate(own)}
        assert all(r["n"] == place[r["event_id"]] + 1 and abs(r["s"] - sum(p for _, _, p in own[: r["n"]])) < 1e-6 for r in sums)
        gaps = {r["event_id"]: r["before"] for r in lagged(ticks, ["symbol"], ["us", "event_id"], "us", "before", block=block).collect()}
        assert all(gaps[e] == (own[i - 1][0] if i else None) for i, (_, e, _) in enumerate(own))


def test_rounds_belong_to_the_session_that_runs(spark):
    sessions = spark.createDataFrame([("a", 0, 10), ("a", 1, 50), ("b", 0, 5)], "symbol string, session_num bigint, start_us bigint")
    rounds = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("a", 3, 49), ("a", 4, 70), ("b", 1, 6)], "symbol string, round_num int, start_us bigint")
    got = {(r["symbol"], r["round_num"]): r["session_num"] for r in rounds_in_sessions(rounds, sessions).collect()}
    assert got == {("a", 1): None, ("a", 2): 0, ("a", 3): 0, ("a", 4): 1, ("b", 1): 0}
